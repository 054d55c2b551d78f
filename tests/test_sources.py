import hashlib
import os
import time
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from workbook import write_workbook

from tradewind.operators import channels, promotion
from tradewind.plans.refresh import OrderStore
from tradewind.sources import delimited, files, layouts, tables, workbooks


def _headers(layout, *names):
    reverse = {name: source for source, name in layout.items()}
    return [reverse[n] for n in names]


def test_marketplace_workbooks(spark, tmp_path):
    head = _headers(
        layouts.MARKETPLACE_ORDERS,
        "Order_ID", "Order_Status", "Order_Date", "Product_Name", "Quantity", "Net_Sales", "Commission", "Platform_Discount",
    )
    valid = layouts.MARKETPLACE_STATUSES[0]
    rows = [
        head,
        ["A1", valid, 45292.5, "cream", 2, "฿1,234.50", 10, 5],
        ["A2", "ยกเลิกแล้ว", 45292, "cream", 1, 10, 0, 0],
        ["A3", valid, 45293, "Phone Case", 1, 10, 0, 0],
        ["A4", valid, "bad", None, 1, 7, None, None],
    ]
    write_workbook(tmp_path / "Order.all.20240101_20240131.xlsx", rows, {(1, 2), (2, 2), (3, 2)})
    write_workbook(tmp_path / "other.xlsx", [[head[5], head[0], head[1]], [3, "A5", valid]])
    (tmp_path / "broken.xlsx").write_bytes(b"not a workbook")
    (tmp_path / "empty.xlsx").write_bytes(b"")
    raw = workbooks.read_marketplace_orders(spark, str(tmp_path))
    found = {r["Order_ID"]: r for r in channels.clean_marketplace_orders(raw).collect()}
    assert set(found) == {"A1", "A4", "A5"}
    first = found["A1"]
    assert first["Order_Date"] == datetime(2024, 1, 1, 12) and first["Order_Date_Only"] == date(2024, 1, 1)
    assert (first["Net_Sales"], first["Total_Fees"], first["True_Net_Revenue"], first["Total_Discount"]) == (1234.5, 10, 1224.5, 5)
    assert first["File_Date_Range"] == "2024-01-01 - 2024-01-31"
    assert found["A4"]["Order_Date"] is None and found["A4"]["Product_Name"] is None
    assert found["A5"]["Net_Sales"] == 3 and found["A5"]["Quantity"] == 0
    bad = workbooks.damaged(workbooks.workbook_rows(spark, str(tmp_path))).collect()
    assert [r["File_Source"] for r in bad] == ["broken.xlsx"]  # Spark itself skips files without content


def test_social_live_workbook(spark, tmp_path):
    head = _headers(layouts.SOCIAL_LIVE, "Creator", "Duration", "GMV", "Views", "Likes", "Comments", "Shares", "CTR")
    rows = [["ช่วงวันที่: 2026-01-01 ~ 2026-01-31"], [], head, ["anna", "7h 12min", "1,000", 10, 1, 2, 3, "15.5%"], ["ben", "2h", 5, 0, 1, 1, 1, "1%"]]
    write_workbook(tmp_path / "live.xlsx", rows)
    found = {r["Creator"]: r for r in promotion.clean_social_live(workbooks.read_social_live(spark, str(tmp_path))).collect()}
    anna = found["anna"]
    assert (anna["Duration_Minutes"], anna["GMV"], anna["Engagement_Rate"], anna["CTR"]) == (432, 1000, 0.6, 0.155)
    assert anna["Report_Date"] == date(2026, 1, 31) and anna["Report_Start"] == date(2026, 1, 1)
    assert found["ben"]["Engagement_Rate"] is None


def test_social_video_layouts(spark, tmp_path):
    standard = _headers(layouts.SOCIAL_VIDEO, "Creator", "Video_Title", "Post_Time", "Views", "Likes", "Comments", "Shares", "GMV")
    listed = _headers(layouts.SOCIAL_VIDEO_LIST, "Video_Title", "Post_Date", "Creator", "GMV", "Likes", "Comments")
    write_workbook(
        tmp_path / "Video_20260131.xlsx",
        [["ช่วงวันที่ วิดีโอ"], [], standard, ["anna", "one", "2026-01-05 10:00:00", 10, 2, 1, 1, 50]],
    )
    write_workbook(tmp_path / "list.xlsx", [listed, ["two", "2026-01-07", "ben", "฿70", 5, 6]])
    found = {r["Creator"]: r for r in promotion.clean_social_video(workbooks.read_social_video(spark, str(tmp_path))).collect()}
    assert found["anna"]["GMV"] == 50 and found["anna"]["Engagement_Rate"] == 0.4
    assert found["anna"]["Report_Date"] == date(2026, 1, 31) and found["anna"]["Post_Date"] == date(2026, 1, 5)
    assert found["ben"]["GMV"] == 70 and found["ben"]["Likes"] == 5 and found["ben"]["Report_Date"] is None
    assert found["ben"]["Post_Date"] == date(2026, 1, 7) and found["ben"]["Engagement_Rate"] == 0


def test_direct_sales_workbook(spark, tmp_path):
    head = list(layouts.DIRECT_SALES)
    rows = [head, ["D1", "5/2/2026", "shop", 100, 7, 107], ["D2", "bad", "shop", 1, 1, 1], [None, None, None, 101, 8, 108]]
    write_workbook(tmp_path / "direct.xlsx", rows)
    found = channels.clean_direct_sales(workbooks.read_direct_sales(spark, str(tmp_path))).collect()
    assert [(r["Order_ID"], r["Order_Date_Only"], r["Net_Sales"], r["Sales_Channel"]) for r in found] == [
        ("D1", date(2026, 2, 5), 100, "shop")
    ]


def test_ads_reports(spark, tmp_path):
    name, status, cost, sales, roas = _headers(layouts.ADS, "Ad_Name", "Status", "Ad_Cost", "Sales", "ROAS")
    (tmp_path / "ข้อมูล a-Ads-01_01_2026-31_01_2026.csv").write_text(
        f'﻿รายงาน\nวันที่, x\n\nลำดับ,{name}, {status} ,{cost},{sales},{roas}\n1,"ad, one",run,10,50,9\n2,two,run,0,50,9\n', encoding="utf-8"
    )
    (tmp_path / "other.csv").write_text(f"ลำดับ,{sales},{name}\n1,7,three\n", encoding="utf-8")
    (tmp_path / "none.csv").write_text("no header\n1,2\n", encoding="utf-8")
    ads = promotion.clean_ads(delimited.read_ads_reports(spark, str(tmp_path)))
    found = {r["Ad_Name"]: r for r in ads.collect()}
    assert set(found) == {"ad, one", "two", "three"}
    assert found["ad, one"]["ROAS"] == 5 and found["ad, one"]["ACOS"] == 0.2 and found["ad, one"]["Status"] == "run"
    assert found["ad, one"]["Period_End"] == date(2026, 1, 31) and found["three"]["Period_End"] is None
    assert found["two"]["ROAS"] == 9 and found["three"]["Sales"] == 7 and found["three"]["Ad_Cost"] == 0


def test_ads_report_larger_than_a_block(spark, tmp_path):
    (name,) = _headers(layouts.ADS, "Ad_Name")
    lines = ["free text", f"ลำดับ,{name}"] + [f"{i},ad {i}" for i in range(3000)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert delimited.read_ads_reports(spark, str(tmp_path)).select("Ad_Name").distinct().count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_overview_reports(spark, tmp_path):
    texts = {n: t for t, n in layouts.LIVE_OVERVIEW}
    upper = f"{texts['Report_Period']},ยอดขาย,,{texts['Total_Live_Duration']},x PCU y"
    lower = ",(คำสั่งซื้อที่เกิดขึ้น),(คำสั่งซื้อที่ยืนยันแล้ว),,"
    (tmp_path / "overview-v2_1m_2026-01-31_x.csv").write_text(f'{upper}\n{lower}\nJan,"1,000",฿900,4ชั่วโมง9นาที28วินาที,77\nextra,1,1,1,1\n', encoding="utf-8")
    (tmp_path / "short.csv").write_text("a,b\n", encoding="utf-8")
    rules = [("ยอดขาย_(คำสั่งซื้อที่เกิดขึ้น)", "Sales_Pending"), ("ยอดขาย_(คำสั่งซื้อที่ยืนยันแล้ว)", "Sales_Confirmed"), *layouts.LIVE_OVERVIEW]
    assert delimited.read_overview_reports(spark, str(tmp_path), rules).count() == 2
    reports = delimited.read_overview_reports(spark, str(tmp_path), rules, first_row_only=True)
    (row,) = promotion.clean_live_overview(reports).collect()
    assert (row["Report_Period"], row["Sales_Pending"], row["Sales_Confirmed"], row["Peak_Concurrent_Users"]) == ("Jan", 1000, 900, 77)
    assert row["Live_Duration_Seconds"] == 14968 and row["Report_Date"] == date(2026, 1, 31) and row["Total_Viewers"] == 0


def test_csv_with_different_headers(spark, tmp_path):
    (tmp_path / "a [1].csv").write_text('x,y\n1,"q ""z"", w"\n')
    (tmp_path / "b.csv").write_text("y,x,z\n2,3,4\n")
    (tmp_path / "c.csv").write_text("")
    found = {r["File_Source"]: r for r in delimited.read_csv(spark, str(tmp_path)).collect()}
    assert (found["a [1].csv"]["x"], found["a [1].csv"]["y"], found["a [1].csv"]["z"]) == ("1", 'q "z", w', None)
    assert (found["b.csv"]["x"], found["b.csv"]["y"], found["b.csv"]["z"]) == ("3", "2", "4")


def _export(folder, name, rows, age):
    head = _headers(layouts.SOCIAL_ORDERS, "Order_ID", "SKU_ID", "Order_Status", "Order_Date", "Product_Name", "Quantity", "Net_Sales")
    lines = [",".join(head)] + [",".join(r) for r in rows]
    path = folder / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    moment = time.time() - age
    os.utime(path, (moment, moment))


def test_order_store(spark, tmp_path):
    """New files only; a later file changes and cancels orders; a rewritten file is read again."""
    exports = tmp_path / "exports"
    exports.mkdir()
    done, gone = layouts.SOCIAL_STATUSES[0], "ยกเลิกแล้ว"
    day = "19/02/2026 09:10:25\t"
    _export(exports, "1.csv", [("1", "s", done, day, "a", "1", "10"), ("2", "s", done, day, "a", "1", "20"), ("2", "t", done, day, "b", "1", "5")], 300)
    store = OrderStore(spark, str(tmp_path / "store"))
    assert store.ingest(str(exports)) == 1
    assert store.ingest(str(exports)) == 0
    _export(exports, "2.csv", [("1", "s", gone, day, "a", "1", "10"), ("3", "s", done, day, "a", "2", "30")], 200)
    assert [r["Name"] for r in store.pending(str(exports)).collect()] == ["2.csv"]
    store.refresh(str(exports), str(tmp_path / "tables"))
    daily = spark.read.parquet(str(tmp_path / "tables/daily_sales")).collect()
    assert [(r["Orders"], r["GMV"], r["Units_Sold"]) for r in daily] == [(2, 55.0, 4.0)]
    _export(exports, "2.csv", [("3", "s", done, day, "a", "2", "31")], 100)
    assert store.ingest(str(exports)) == 1
    current = channels.clean_social_orders(store.current()).groupBy().sum("Net_Sales").first()[0]
    assert current == 56.0
    records = {r["Name"]: r["Records"] for r in files.latest_manifest(store.manifest()).collect()}
    assert records == {"1.csv": 3, "2.csv": 1}


def test_unfinished_batch_is_ignored(spark, tmp_path):
    exports = tmp_path / "exports"
    exports.mkdir()
    done = layouts.SOCIAL_STATUSES[0]
    _export(exports, "1.csv", [("1", "s", done, "19/02/2026 09:10:25\t", "a", "1", "10")], 300)
    store = OrderStore(spark, str(tmp_path / "store"))
    spark.range(3).write.parquet(str(tmp_path / "store/batches/0"))
    store.ingest(str(exports))
    assert store.current().count() == 1


def test_changed_files(spark, tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    (folder / "a.csv").write_text("1")
    (folder / "desktop.ini").write_text("1")
    before = spark.createDataFrame(files.content_hashes(spark, str(tmp_path)).collect(), "Folder string, Name string, Hash string")
    (folder / "a.csv").write_text("2")
    (folder / "b.csv").write_text("1")
    found = {r["Name"]: r["Status"] for r in files.changed(files.content_hashes(spark, str(tmp_path)), before).collect()}
    assert found == {"a.csv": "modified", "b.csv": "new"}


def test_long_files_are_hashed_in_blocks(spark, tmp_path):
    """Files of up to a block have their plain MD5; longer ones one of their blocks, which any change alters."""
    content = {"a b%20+c.bin": bytes(range(256)) * 20, "short.bin": b"x" * 1000, "even.bin": b"y" * 3000}
    (tmp_path / "in").mkdir()
    for name, value in content.items():
        (tmp_path / "in" / name).write_bytes(value)
    (tmp_path / "in" / "empty.bin").touch()

    def hashes():
        return {r["Name"]: r["Hash"] for r in files.content_hashes(spark, str(tmp_path), "*.bin", block=1000).collect()}

    def md5(value):
        return hashlib.md5(value).hexdigest()

    def blocks(value):
        digests = [md5(value[i : i + 1000]) for i in range(0, len(value), 1000)]
        return f"{md5(''.join(digests).encode())}-{len(digests)}"

    first = hashes()
    assert first == {name: md5(value) if len(value) <= 1000 else blocks(value) for name, value in content.items()}
    swapped = content["a b%20+c.bin"]
    (tmp_path / "in" / "a b%20+c.bin").write_bytes(swapped[1000:2000] + swapped[:1000] + swapped[2000:])
    assert {name for name, value in hashes().items() if value != first[name]} == {"a b%20+c.bin"}
    long = [r for r in files.content_hashes(spark, str(tmp_path), block=1000).collect() if "-" in r["Hash"]]
    assert {r["Folder"] for r in long} == {"in"}


def test_table_access(spark):
    assert tables.load_or_empty(spark, "no_such_table", "a int").count() == 0
    spark.range(3).selectExpr("id", "cast(id as double) as Total_GMV").createOrReplaceTempView("products")
    assert [r["id"] for r in tables.load(spark, "products", ordered=True).collect()] == [2, 1, 0]
    assert tables.load(spark, "no_such_table", ordered=True).count() == 0 and tables.load(spark, "all_orders", prefix="none_").count() == 0
    spark.sql("SELECT 1 AS Order_ID, DATE'2024-01-01' AS Order_Date").createOrReplaceTempView("some_orders_raw")
    spark.sql("SELECT 2 AS Order_ID, DATE'2024-01-02' AS Order_Date, 'x' AS SKU").createOrReplaceTempView("some_direct_orders")
    assert [r["Order_ID"] for r in tables.load(spark, "all_orders", ordered=True, prefix="some_").collect()] == [2, 1]
    assert tables.list_tables(spark, "products").count() == 1
    assert [r["Column_Name"] for r in tables.describe(spark, "products").collect()] == ["id", "Total_GMV"]
    spark.catalog.dropTempView("products")


@pytest.mark.parametrize("name", ["a b+c.csv", "50%.csv"])
def test_file_names_are_decoded(spark, tmp_path, name):
    (tmp_path / name).write_text("x\n1\n")
    assert [r["File_Source"] for r in delimited.read_csv(spark, str(tmp_path)).collect()] == [name]


def test_ingestion_loses_nothing(spark, tmp_path):
    """A blank first line, a quoted line break, lines with one SKU or none, a file without a header, a restored file."""
    exports = tmp_path / "exports"
    exports.mkdir()
    header = "Order ID,SKU ID,Product Name\n"
    (exports / "1.csv").write_text("\n" + header + '1,a,"x\ny"\n1,a,z\n1,,v\n1,,w\n')
    (exports / "2.csv").write_text(header + "2,b,plain\n")
    (exports / "3.csv").write_text("\n  \n")
    store = OrderStore(spark, str(tmp_path / "store"))
    assert store.ingest(str(exports)) == 2
    assert sorted(r["Product Name"] for r in store.current().collect()) == ["plain", "v", "w", "x\ny", "z"]
    assert [(r["Name"], r["Reason"]) for r in store.rejected().collect()] == [("3.csv", "no header")]
    assert [r["Name"] for r in store.pending(str(exports)).collect()] == ["3.csv"] and store.ingest(str(exports)) == 0
    first, kept = (exports / "2.csv").read_text(), os.stat(exports / "2.csv").st_mtime
    (exports / "2.csv").write_text(header + "2,b,changed\n")
    assert store.ingest(str(exports)) == 1
    (exports / "2.csv").write_text(first)
    os.utime(exports / "2.csv", (kept, kept))
    assert [r["Name"] for r in store.pending(str(exports)).collect() if r["Name"] != "3.csv"] == ["2.csv"]
    assert store.ingest(str(exports)) == 1
    assert store.current().filter("`Order ID` = '2'").first()["Product Name"] == "plain"
    assert store.ingest(str(exports), force=True) == 2


def test_a_file_rewritten_during_a_run_is_read_again(spark, tmp_path, monkeypatch):
    exports = tmp_path / "exports"
    exports.mkdir()
    (exports / "1.csv").write_text("Order ID,SKU ID\n1,a\n")
    store = OrderStore(spark, str(tmp_path / "store"))
    commit = OrderStore.commit

    def rewritten(self, number, processed):
        (exports / "1.csv").write_text("Order ID,SKU ID\n1,a\n2,b\n")
        commit(self, number, processed)

    monkeypatch.setattr(OrderStore, "commit", rewritten)
    assert store.ingest(str(exports)) == 1
    assert store.pending(str(exports)).count() == 1


def test_long_lines_and_quotes(spark):
    line = ",".join(f'"c{i},""q"""' for i in range(20_000))
    rows = spark.createDataFrame([(line,), ('a,"b,c",,"", d ,"e""f"',)], "value string").select(delimited.csv_cells(F.col("value")).alias("c")).collect()
    assert len(rows[0]["c"]) == 20_000 and rows[0]["c"][7] == 'c7,"q"'
    assert rows[1]["c"] == ["a", "b,c", "", "", " d ", 'e"f']


def test_folders_of_one_name(spark, tmp_path):
    for folder in ("a/x", "b/x"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "f.csv").write_text(folder)
    hashes = files.content_hashes(spark, str(tmp_path), "*.csv")
    assert sorted(r["Folder"] for r in hashes.collect()) == ["a/x", "b/x"]
    assert files.changed(hashes, hashes).count() == 0


def test_first_sheet_and_dates_of_the_workbook(spark, tmp_path):
    """The sheet the workbook lists first need not be sheet1.xml, and days may count from 1904."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    write_workbook(tmp_path / "plain.xlsx", [["x"], [1.0]], dates={(1, 0)})
    with zipfile.ZipFile(tmp_path / "plain.xlsx") as archive:
        parts = {n: archive.read(n) for n in archive.namelist()}
    parts["xl/worksheets/sheet2.xml"] = parts["xl/worksheets/sheet1.xml"]
    parts["xl/worksheets/sheet1.xml"] = f'<worksheet xmlns="{main}"><sheetData/></worksheet>'.encode()
    sheets = '<sheet name="a" sheetId="2" r:id="r2"/><sheet name="b" sheetId="1" r:id="r1"/>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{relation}"><workbookPr date1904="1"/><sheets>{sheets}</sheets></workbook>'.encode()
    targets = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2))
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships>{targets}</Relationships>".encode()
    (tmp_path / "plain.xlsx").unlink()
    with zipfile.ZipFile(tmp_path / "second.xlsx", "w") as archive:
        for name, content in parts.items():
            archive.writestr(name, content)
    content = bytearray((tmp_path / "second.xlsx").read_bytes())
    (tmp_path / "cut.xlsx").write_bytes(content[: len(content) // 2])
    with zipfile.ZipFile(tmp_path / "broken.xlsx", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("xl/sharedStrings.xml", "<sst>" + "<si><t>abc</t></si>" * 500 + "</sst>")
        archive.writestr("xl/worksheets/sheet1.xml", "<worksheet/>")
    content = bytearray((tmp_path / "broken.xlsx").read_bytes())
    content[60:75] = b"\xff" * 15
    (tmp_path / "broken.xlsx").write_bytes(content)
    rows = workbooks.workbook_rows(spark, str(tmp_path))
    found = [r["Cells"] for r in rows.filter("File_Source = 'second.xlsx'").orderBy("Row").collect()]
    assert found == [["x"], ["1904-01-02 00:00:00"]]
    assert sorted(r["File_Source"] for r in workbooks.damaged(rows).collect()) == ["broken.xlsx", "cut.xlsx"]
