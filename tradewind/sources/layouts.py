"""Headers, statuses and keywords of the raw exports.

They have to equal what the sales platforms write, so they are plain lists in the order of the exports.
Keys are source headers, values are the column names used everywhere else.
"""

MARKETPLACE_ORDERS = {
    "หมายเลขคำสั่งซื้อ": "Order_ID",
    "สถานะการสั่งซื้อ": "Order_Status",
    "วันที่ทำการสั่งซื้อ": "Order_Date",
    "ชื่อสินค้า": "Product_Name",
    "เลขอ้างอิง SKU (SKU Reference No.)": "SKU",
    "ราคาตั้งต้น": "Original_Price",
    "ราคาขาย": "Selling_Price",
    "จำนวน": "Quantity",
    "จำนวนที่ส่งคืน": "Return_Qty",
    "ราคาขายสุทธิ": "Net_Sales",
    "ส่วนลดจาก Shopee": "Platform_Discount",
    "โค้ดส่วนลดชำระโดยผู้ขาย": "Seller_Discount",
    "โค้ดส่วนลดชำระโดย Shopee (เช่น โค้ดจากโปรแกรม ร้านโค้ดคุ้ม, โค้ดส่วนลด Shopee, โค้ดส่วนลด Shopee Mall)": "Platform_Voucher",
    "ค่าคอมมิชชั่น": "Commission",
    "Transaction Fee": "Transaction_Fee",
    "ค่าบริการ": "Service_Fee",
    "ค่าจัดส่งที่ชำระโดยผู้ซื้อ": "Shipping_Fee",
    "จำนวนเงินทั้งหมด": "Total_Amount",
    "จังหวัด": "Province",
    "เขต/อำเภอ": "District",
    "รหัสไปรษณีย์": "Postal_Code",
    "ช่องทางการชำระเงิน": "Payment_Method",
    "ชื่อผู้ใช้ (ผู้ซื้อ)": "Buyer_Username",
}
MARKETPLACE_ORDER_NUMBERS = [
    "Net_Sales", "Quantity", "Original_Price", "Selling_Price", "Commission", "Transaction_Fee",
    "Service_Fee", "Shipping_Fee", "Total_Amount", "Platform_Discount", "Seller_Discount",
]
MARKETPLACE_STATUSES = ["สำเร็จแล้ว", "ที่ต้องจัดส่ง", "กำลังจัดส่ง", "รอการชำระเงิน"]

EXCLUDED_KEYWORDS = [
    "iphone", "ipad", "apple", "samsung", "phone", "case", "cable",
    "charger", "headphone", "earphone", "laptop", "computer",
]

SOCIAL_ORDERS = {
    "Order ID": "Order_ID",
    "Order Status": "Order_Status",
    "Order Substatus": "Order_Substatus",
    "Normal or Pre-order": "Order_Type",
    "SKU ID": "SKU_ID",
    "Seller SKU": "SKU",
    "Product Name": "Product_Name",
    "Variation": "Variation",
    "Quantity": "Quantity",
    "Sku Quantity of return": "Return_Qty",
    "SKU Unit Original Price": "Original_Price",
    "SKU Subtotal Before Discount": "Gross_Sales",
    "SKU Platform Discount": "Platform_Discount",
    "SKU Seller Discount": "Seller_Discount",
    "SKU Subtotal After Discount": "Net_Sales",
    "Shipping Fee After Discount": "Shipping_Fee",
    "Original Shipping Fee": "Original_Shipping",
    "Order Amount": "Order_Amount",
    "Order Refund Amount": "Refund_Amount",
    "Created Time": "Order_Date",
    "Paid Time": "Paid_Time",
    "Delivered Time": "Delivered_Time",
    "Cancelled Time": "Cancelled_Time",
    "Province": "Province",
    "District": "District",
    "Buyer Username": "Buyer_Username",
    "Payment Method": "Payment_Method",
    "Package ID": "Package_ID",
    "Weight(kg)": "Weight",
}
SOCIAL_ORDER_NUMBERS = [
    "Quantity", "Return_Qty", "Original_Price", "Gross_Sales", "Platform_Discount", "Seller_Discount",
    "Net_Sales", "Shipping_Fee", "Order_Amount", "Refund_Amount", "Weight",
]
SOCIAL_STATUSES = [
    "เสร็จสมบูรณ์", "ที่จะจัดส่ง", "จัดส่งแล้ว", "ส่งสำเร็จ", "พร้อมจัดส่ง", "รอการชำระเงิน", "กำลังจัดส่ง",
]

DIRECT_SALES = {
    "เลขที่เอกสาร": "Order_ID",
    "วัน/เดือน/ปี": "Order_Date",
    "ชื่อลูกค้า": "Customer_Type",
    "มูลค่า": "Net_Sales",
    "ภาษีมูลค่าเพิ่ม": "VAT",
    "ยอดรวมสุทธิ": "Total_Amount",
}
DIRECT_SALES_NUMBERS = ["Net_Sales", "VAT", "Total_Amount"]

ADS_HEADER_START = "ลำดับ"
ADS = {
    "ชื่อโฆษณา": "Ad_Name",
    "สถานะ": "Status",
    "ประเภทโฆษณา": "Ad_Type",
    "รหัสสินค้า": "Product_ID",
    "การมองเห็น": "Impressions",
    "จำนวนคลิก": "Clicks",
    "อัตราการคลิก (CTR)": "CTR",
    "การสั่งซื้อ": "Orders",
    "การสั่งซื้อโดยตรง": "Direct_Orders",
    "อัตราการสั่งซื้อ": "Conversion_Rate",
    "สินค้าที่ขายแล้ว": "Products_Sold",
    "ยอดขาย": "Sales",
    "ยอดขายโดยตรง": "Direct_Sales",
    "ค่าโฆษณา": "Ad_Cost",
    "ยอดขาย/รายจ่าย (ROAS)": "ROAS",
    "ACOS": "ACOS",
}
ADS_NUMBERS = [
    "Impressions", "Clicks", "Orders", "Direct_Orders", "Products_Sold", "Sales", "Direct_Sales", "Ad_Cost",
]
ADS_PERCENTS = ["CTR", "Conversion_Rate", "ACOS"]
ADS_RUNNING = "กำลังดำเนินการ"

# Overview reports: a header that contains the text gets the name; the first match wins.
LIVE_OVERVIEW = [
    ("ระยะเวลาเก็บข้อมูล", "Report_Period"),
    ("ยอดขาย(คำสั่งซื้อที่เกิดขึ้น)", "Sales_Pending"),
    ("ยอดขาย(คำสั่งซื้อที่ยืนยันแล้ว)", "Sales_Confirmed"),
    ("คำสั่งซื้อ(คำสั่งซื้อที่เกิดขึ้น)", "Orders_Pending"),
    ("คำสั่งซื้อ(คำสั่งซื้อที่ยืนยันแล้ว)", "Orders_Confirmed"),
    ("จำนวน Live ทั้งหมด", "Total_Live_Sessions"),
    ("ระยะเวลา Live ทั้งหมด", "Total_Live_Duration"),
    ("ผู้ชมทั้งหมด", "Total_Viewers"),
    ("PCU", "Peak_Concurrent_Users"),
    ("GPM(คำสั่งซื้อที่เกิดขึ้น)", "GPM_Pending"),
    ("GPM(คำสั่งซื้อที่ยืนยันแล้ว)", "GPM_Confirmed"),
]
VIDEO_OVERVIEW = [
    ("ระยะเวลาเก็บข้อมูล", "Report_Period"),
    ("ยอดขาย(คำสั่งซื้อที่เกิดขึ้น)", "Video_Sales_Pending"),
    ("ยอดขาย(คำสั่งซื้อที่ยืนยันแล้ว)", "Video_Sales_Confirmed"),
    ("คำสั่งซื้อ(คำสั่งซื้อที่เกิดขึ้น)", "Video_Orders_Pending"),
    ("คำสั่งซื้อ(คำสั่งซื้อที่ยืนยันแล้ว)", "Video_Orders_Confirmed"),
    ("ผู้ชมทั้งหมด", "Total_Viewers"),
    ("การเข้าชม", "Total_Views"),
    ("GPM(คำสั่งซื้อที่เกิดขึ้น)", "Video_GPM_Pending"),
    ("GPM(คำสั่งซื้อที่ยืนยันแล้ว)", "Video_GPM_Confirmed"),
    ("วิดีโอที่มีสินค้า", "Videos_With_Products"),
    ("วิดีโอที่สร้างรายได้", "Revenue_Generating_Videos"),
    ("ถูกใจ", "Total_Likes"),
    ("แชร์ทั้งหมด", "Total_Shares"),
    ("คอมเมนต์ทั้งหมด", "Total_Comments"),
    ("ผู้ติดตามใหม่", "New_Followers"),
]

SOCIAL_LIVE = {
    "ครีเอเตอร์ ID": "Creator_ID",
    "ครีเอเตอร์": "Creator",
    "ชื่อเล่น": "Nickname",
    "เริ่ม": "Start_Time",
    "ระยะเวลา": "Duration",
    "มูลค่าสินค้ารวมจาก LIVE (฿)": "GMV",
    "สินค้าที่เพิ่ม": "Products_Added",
    "ผลิตภัณฑ์ต่าง ๆ ที่ขาย": "Products_Sold",
    "คำสั่งซื้อ SKU ที่สร้างขึ้น": "Orders_Created",
    "คำสั่งซื้อ SKU จาก LIVE": "Orders",
    "รายการจาก LIVE ที่ขายได้": "Items_Sold",
    "ลูกค้าที่ไม่ซ้ำกัน": "Unique_Customers",
    "ราคาเฉลี่ย (฿)": "Avg_Price",
    "อัตราการคลิกเพื่อสั่งซื้อ (LIVE)": "CTR",
    "GMV ที่มาจากไลฟ์ (฿)": "Live_GMV",
    "ผู้ชม": "Viewers",
    "ยอดการดู": "Views",
    "ระยะเวลาการดูโดยเฉลี่ย (ไลฟ์สตรีม)": "Avg_Watch_Time",
    "ความคิดเห็น": "Comments",
    "การแชร์": "Shares",
    "ยอดการถูกใจของ LIVE": "Likes",
    "ผู้ติดตามใหม่ (วิดีโอครีเอเตอร์)": "New_Followers",
    "การแสดงผลสินค้า": "Product_Impressions",
    "การคลิกผลิตภัณฑ์": "Product_Clicks",
    "อัตราการคลิกผ่าน (CTR)": "Click_Through_Rate",
}
SOCIAL_LIVE_NUMBERS = [
    "GMV", "Orders", "Orders_Created", "Items_Sold", "Viewers", "Views", "Comments", "Shares", "Likes",
    "New_Followers", "Unique_Customers", "Product_Impressions", "Product_Clicks", "Avg_Price", "Live_GMV",
]
SOCIAL_LIVE_PERCENTS = ["CTR", "Click_Through_Rate"]

SOCIAL_VIDEO = {
    "ชื่อครีเอเตอร์": "Creator",
    "ครีเอเตอร์ ID": "Creator_ID",
    "ข้อมูลวิดีโอ": "Video_Title",
    "วิดีโอ ID": "Video_ID",
    "เวลา": "Post_Time",
    "สินค้า": "Product",
    "VV": "Views",
    "การกดถูกใจ": "Likes",
    "ความคิดเห็น": "Comments",
    "การแชร์": "Shares",
    "ผู้ติดตามใหม่": "New_Followers",
    "การคลิก V-to-L": "V_to_L_Clicks",
    "การแสดงผลสินค้า": "Product_Impressions",
    "การคลิกผลิตภัณฑ์": "Product_Clicks",
    "ลูกค้าที่ไม่ซ้ำกัน": "Unique_Customers",
    "คำสั่งซื้อ": "Orders",
    "รายการในวิดีโอที่ขายได้": "Items_Sold",
    "มูลค่าสินค้ารวม (วิดีโอ) (฿)": "GMV",
    "GPM (฿)": "GPM",
    "GMV ที่มาจากวิดีโอขายสินค้า (฿)": "Video_Sales_GMV",
    "อัตราการคลิกผ่าน (วิดีโอ)": "Video_CTR",
    "อัตรา V-to-L": "V_to_L_Rate",
    "อัตราการดูวิดีโอจนจบ": "Completion_Rate",
    "อัตราการคลิกเพื่อสั่งซื้อ (วิดีโอ)": "Conversion_Rate",
    "การวินิจฉัย": "Diagnosis",
}
SOCIAL_VIDEO_LIST = {
    "ชื่อวิดีโอ": "Video_Title",
    "ลิงก์วิดีโอ": "Video_Link",
    "วันที่โพสต์วิดีโอ": "Post_Date",
    "ชื่อผู้ใช้ของครีเอเตอร์": "Creator",
    "GMV": "GMV",
    "จำนวนที่ขายได้จากแอฟฟิลิเอต": "Items_Sold",
    "GMV จากวิดีโอขายสินค้าของแอฟฟิลิเอต": "Video_Sales_GMV",
    "มูลค่าคำสั่งซื้อเฉลี่ยจากวิดีโอขายสินค้า": "Avg_Order_Value",
    "ค่าคอมมิชชั่นโดยประมาณ": "Commission",
    "ค่าธรรมเนียมคงที่โดยประมาณ": "Fixed_Fee",
    "คำสั่งซื้อแอฟฟิลิเอต": "Orders",
    "ยอดการแสดงผลวิดีโอขายสินค้า": "Product_Impressions",
    "CTR จากแอฟฟิลิเอต": "CTR",
    "GPM จากวิดีโอขายสินค้า": "GPM",
    "จำนวนสินค้าแอฟฟิลิเอตที่คืนเงิน": "Refund_Items",
    "GMV ของการคืนเงินจากแอฟฟิลิเอต": "Refund_GMV",
    "ความคิดเห็นในวิดีโอขายสินค้า": "Comments",
    "การกดถูกใจในวิดีโอขายสินค้า": "Likes",
}
SOCIAL_VIDEO_NUMBERS = [
    "Views", "Likes", "Comments", "Shares", "New_Followers", "Orders", "GMV", "GPM", "Video_Sales_GMV",
    "Unique_Customers", "Product_Impressions", "Product_Clicks", "V_to_L_Clicks", "Items_Sold",
    "Commission", "Fixed_Fee", "Avg_Order_Value", "Refund_Items", "Refund_GMV",
]
SOCIAL_VIDEO_PERCENTS = ["Video_CTR", "V_to_L_Rate", "Completion_Rate", "Conversion_Rate", "CTR"]
# First cell of the list layout holds the first text, or the second one without the third.
VIDEO_LIST_MARK = "ชื่อวิดีโอ"
VIDEO_WORD = "วิดีโอ"
DATE_RANGE_WORD = "ช่วงวันที่"
