"""Customer scoring, baskets and row versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.adapters import LINES, RAW_LINES, order_lines, table
from checks.base import Check
from tradewind.operators import baskets, customers, versions

_LINES = (RAW_LINES, LINES)


def _base(spark, folder):
    return customers.rfm_base(order_lines(spark, folder, "buyer"))


def _scores(spark, folder):
    return customers.rfm_scores(_base(spark, folder))


def _segments(spark, folder):
    return customers.rfm_segments(_scores(spark, folder))


_RULES = "\n".join(
    f"WHEN R_Score BETWEEN {r[0]} AND {r[1]} AND F_Score BETWEEN {f[0]} AND {f[1]} AND M_Score BETWEEN {m[0]} AND {m[1]} THEN '{name}'"
    for name, r, f, m in [
        ("Champions", (4, 5), (4, 5), (4, 5)),
        ("Loyal Customers", (3, 5), (3, 5), (3, 5)),
        ("Potential Loyalist", (4, 5), (1, 3), (3, 5)),
        ("New Customers", (4, 5), (1, 2), (1, 5)),
        ("Promising", (3, 4), (1, 2), (1, 3)),
        ("Need Attention", (2, 3), (2, 3), (2, 4)),
        ("About to Sleep", (2, 3), (1, 2), (1, 2)),
        ("At Risk", (1, 2), (3, 5), (3, 5)),
        ("Cant Lose Them", (1, 1), (4, 5), (4, 5)),
        ("Hibernating", (1, 2), (1, 2), (1, 3)),
        ("Lost", (1, 1), (1, 1), (1, 2)),
    ]
)
_RFM = f"""rfm_base AS (
  SELECT "Buyer_Username" AS "Customer_ID",
    date_diff('day', max("Order_Date"), (SELECT max("Order_Date") FROM lines) + INTERVAL 1 DAY) AS "Recency",
    count(DISTINCT "Order_ID") AS "Frequency", sum("Net_Sales") AS "Monetary"
  FROM lines WHERE "Buyer_Username" <> '' GROUP BY 1),
rfm_edges AS (SELECT quantile_cont("Recency", [0.2, 0.4, 0.6, 0.8]) AS q, count(*) AS n FROM rfm_base),
rfm_scores AS (
  SELECT rfm_base.*,
    CASE WHEN "Recency" <= q[1] THEN 5 WHEN "Recency" <= q[2] THEN 4 WHEN "Recency" <= q[3] THEN 3 WHEN "Recency" <= q[4] THEN 2 ELSE 1 END AS "R_Score",
    greatest(1, ((row_number() OVER (ORDER BY "Frequency", "Customer_ID") - 1) * 5 + n - 2) // (n - 1)) AS "F_Score",
    greatest(1, ((row_number() OVER (ORDER BY "Monetary", "Customer_ID") - 1) * 5 + n - 2) // (n - 1)) AS "M_Score"
  FROM rfm_base, rfm_edges),
rfm AS (
  SELECT *, "R_Score" || '' || "F_Score" || '' || "M_Score" AS "RFM_Segment",
    CASE {_RULES}
      WHEN R_Score + F_Score + M_Score >= 13 THEN 'Loyal Customers' WHEN R_Score + F_Score + M_Score >= 10 THEN 'Potential Loyalist'
      WHEN R_Score + F_Score + M_Score >= 7 THEN 'Need Attention' WHEN R_Score + F_Score + M_Score >= 4 THEN 'At Risk' ELSE 'Lost' END AS "Segment"
  FROM rfm_scores)"""
_RFM_WITH = (*_LINES, _RFM)
# The advice per segment, stated here apart from the code under test.
_STRATEGY = """WHEN 'Champions' THEN 'Reward with early access, exclusive offers. Ask for reviews and referrals.'
WHEN 'Loyal Customers' THEN 'Upsell higher-value products. Engage with loyalty program.'
WHEN 'Potential Loyalist' THEN 'Recommend products, offer membership benefits.'
WHEN 'New Customers' THEN 'Onboarding series, provide excellent support.'
WHEN 'Promising' THEN 'Create brand awareness, offer first-purchase incentives.'
WHEN 'Need Attention' THEN 'Reactivate with limited-time offers, highlight new products.'
WHEN 'About to Sleep' THEN 'Re-engage with personalized recommendations.'
WHEN 'At Risk' THEN 'Send aggressive win-back campaigns, conduct surveys.'
WHEN 'Cant Lose Them' THEN 'Personal outreach, premium support, understand their needs.'
WHEN 'Hibernating' THEN 'Offer steep discounts, highlight value proposition.'
WHEN 'Lost' THEN 'Attempt reactivation, but focus budget elsewhere.'"""

MIN_SUPPORT, PAIR_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.02, 0.1, 1.0


def _items(spark, folder):
    return baskets.basket_items(order_lines(spark, folder, "product"), product="SKU")


def _itemsets(spark, folder, min_support=MIN_SUPPORT, max_length=3):
    found = baskets.frequent_itemsets(_items(spark, folder), min_support, max_length)
    return found.withColumn("Items", F.array_join("Itemset", "|"))


def _rules(spark, folder):
    lines = order_lines(spark, folder, "product")
    _, rules = baskets.market_baskets(
        lines, product="SKU", min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE, min_lift=MIN_LIFT
    )
    return rules


_ITEMS = """basket AS (SELECT "Order_ID", "SKU" AS i, sum("Quantity") > 0 AS bought FROM lines GROUP BY 1, 2),
b AS (SELECT * FROM basket WHERE bought), total AS (SELECT count(DISTINCT "Order_ID") AS n FROM basket),
singles AS (SELECT [i] AS its, count(*) AS c FROM b GROUP BY i),
pairs AS (SELECT [x.i, y.i] AS its, count(*) AS c FROM b x JOIN b y ON x."Order_ID" = y."Order_ID" AND x.i < y.i GROUP BY x.i, y.i),
triples AS (SELECT [x.i, y.i, z.i] AS its, count(*) AS c FROM b x JOIN b y ON x."Order_ID" = y."Order_ID" AND x.i < y.i
  JOIN b z ON y."Order_ID" = z."Order_ID" AND y.i < z.i GROUP BY x.i, y.i, z.i)"""
_SETS = f"""itemsets AS (
  SELECT its, array_to_string(its, '|') AS "Items", c AS "Orders", c / n AS "Support", len(its) AS "Length"
  FROM (FROM singles UNION ALL FROM pairs UNION ALL FROM triples), total WHERE c / n >= {MIN_SUPPORT})"""
_RULE_SQL = f"""splits AS (
  SELECT [its[1]] AS a, [its[2]] AS k, "Support" AS s FROM itemsets WHERE "Length" = 2
  UNION ALL SELECT [its[2]], [its[1]], "Support" FROM itemsets WHERE "Length" = 2
  UNION ALL SELECT [its[1]], [its[2], its[3]], "Support" FROM itemsets WHERE "Length" = 3
  UNION ALL SELECT [its[2]], [its[1], its[3]], "Support" FROM itemsets WHERE "Length" = 3
  UNION ALL SELECT [its[3]], [its[1], its[2]], "Support" FROM itemsets WHERE "Length" = 3
  UNION ALL SELECT [its[1], its[2]], [its[3]], "Support" FROM itemsets WHERE "Length" = 3
  UNION ALL SELECT [its[1], its[3]], [its[2]], "Support" FROM itemsets WHERE "Length" = 3
  UNION ALL SELECT [its[2], its[3]], [its[1]], "Support" FROM itemsets WHERE "Length" = 3),
rules AS (
  SELECT a, k, array_to_string(a, '|') AS "Antecedent_Items", array_to_string(k, '|') AS "Consequent_Items",
    x."Support" AS "Antecedent_Support", y."Support" AS "Consequent_Support", s AS "Support", s / x."Support" AS "Confidence",
    s / x."Support" / y."Support" AS "Lift"
  FROM splits JOIN itemsets x ON x.its = a JOIN itemsets y ON y.its = k
  WHERE s / x."Support" >= {MIN_CONFIDENCE} AND s / x."Support" / y."Support" >= {MIN_LIFT})"""
_OFFERS = """offers AS (
  SELECT "For_Product", "Product", "Confidence", "Lift", "Support",
    row_number() OVER (PARTITION BY "For_Product" ORDER BY "Lift" DESC, "Confidence" DESC, "Support" DESC, "Product",
      array_to_string(a, ','), array_to_string(k, ',')) AS "Position"
  FROM (SELECT *, unnest(a) AS "For_Product" FROM rules) r, unnest(r.k) AS t("Product"))"""
_BASKET = (*_LINES, _ITEMS)
_SETS_WITH = (*_BASKET, _SETS)
_RULES_WITH = (*_SETS_WITH, _RULE_SQL)


def _versions(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_linestatus"
    )


_NEWEST = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_NEWEST_SQL = f"""SELECT * FROM lineitem QUALIFY row_number() OVER (
  PARTITION BY l_orderkey ORDER BY {", ".join(f"{c} DESC" for c in _NEWEST)}) = 1"""
_VERSION = "l_orderkey:l l_linenumber:i l_partkey:l l_suppkey:l l_shipdate:t l_quantity:f2 l_extendedprice:f2"

CHECKS = [
    Check("rfm_base", "Customer_ID:s Recency:l Frequency:l Monetary:f4", _base, "SELECT * FROM rfm_base", _RFM_WITH),
    Check(
        "rfm_scores",
        "Customer_ID:s Recency:l Frequency:l Monetary:f4 R_Score:i F_Score:i M_Score:i",
        _scores,
        "SELECT * FROM rfm_scores",
        _RFM_WITH,
    ),
    Check(
        "rfm_segments",
        "Customer_ID:s R_Score:i F_Score:i M_Score:i RFM_Segment:s Segment:s",
        _segments,
        "SELECT * FROM rfm",
        _RFM_WITH,
    ),
    Check(
        "rfm_strategy",
        "Customer_ID:s Segment:s Strategy:s",
        lambda s, f: customers.customer_rfm(order_lines(s, f, "buyer")),
        f'SELECT *, CASE "Segment" {_STRATEGY} END AS "Strategy" FROM rfm',
        _RFM_WITH,
    ),
    Check(
        "segment_summary",
        "Segment:s Customers:l Avg_Recency_Days:f2 Avg_Frequency:f2 Avg_Monetary:f2 Total_Monetary:f2 Pct_Customers:f1 Pct_Revenue:f1",
        lambda s, f: customers.segment_summary(_segments(s, f)),
        """SELECT *, round_even("Customers" / sum("Customers") OVER () * 100, 1) AS "Pct_Customers",
             round_even("Total_Monetary" / sum("Total_Monetary") OVER () * 100, 1) AS "Pct_Revenue"
           FROM (SELECT "Segment", count(*) AS "Customers", round_even(avg("Recency"), 2) AS "Avg_Recency_Days",
             round_even(avg("Frequency"), 2) AS "Avg_Frequency", round_even(CAST(sum("Monetary") AS DOUBLE) / count(*), 2) AS "Avg_Monetary",
             round_even(CAST(sum("Monetary") AS DOUBLE), 2) AS "Total_Monetary" FROM rfm GROUP BY 1)""",
        _RFM_WITH,
    ),
    Check(
        "campaign_targets",
        "Customer_ID:s Segment:s Monetary:f4",
        lambda s, f: customers.campaign_targets(_segments(s, f), ["Champions", "Loyal Customers"], limit=100),
        """SELECT * FROM rfm WHERE "Segment" IN ('Champions', 'Loyal Customers') ORDER BY "Monetary" DESC, "Customer_ID" LIMIT 100""",
        _RFM_WITH,
    ),
    Check("basket_items", "Order_ID:s Product:s Bought:b", _items, 'SELECT "Order_ID", i AS "Product", bought AS "Bought" FROM basket', _BASKET),
    Check(
        "item_support",
        "Product:s Orders:l Support:f8",
        lambda s, f: baskets.item_support(_items(s, f), 0.01),
        'SELECT its[1] AS "Product", c AS "Orders", c / n AS "Support" FROM singles, total WHERE c / n >= 0.01',
        _BASKET,
    ),
    Check(
        "itemsets_pairs",
        "Items:s Orders:l Support:f8",
        lambda s, f: _itemsets(s, f, PAIR_SUPPORT, 2).filter("Length = 2"),
        f"""SELECT array_to_string(its, '|') AS "Items", c AS "Orders", c / n AS "Support" FROM pairs, total WHERE c / n >= {PAIR_SUPPORT}""",
        _BASKET,
    ),
    Check(
        "itemsets_triples",
        "Items:s Orders:l Support:f8",
        lambda s, f: _itemsets(s, f).filter("Length = 3"),
        'SELECT * FROM itemsets WHERE "Length" = 3',
        _SETS_WITH,
    ),
    Check("frequent_itemsets", "Items:s Orders:l Support:f8 Length:i", _itemsets, "SELECT * FROM itemsets", _SETS_WITH),
    Check(
        "association_rules",
        "Antecedent_Items:s Consequent_Items:s Antecedent_Support:f8 Consequent_Support:f8 Support:f8 Confidence:f8 Lift:f8",
        lambda s, f: _rules(s, f).withColumns(
            {"Antecedent_Items": F.array_join("Antecedents", "|"), "Consequent_Items": F.array_join("Consequents", "|")}
        ),
        "SELECT * FROM rules",
        _RULES_WITH,
    ),
    Check(
        "recommendations",
        "For_Product:s Position:i Product:s Confidence:f8 Lift:f8 Support:f8",
        lambda s, f: baskets.recommendations(_rules(s, f)),
        'SELECT * FROM offers WHERE "Position" <= 5',
        (*_RULES_WITH, _OFFERS),
    ),
    Check(
        "bundles",
        "Bundle:s Support:f8 Confidence:f8 Lift:f8",
        lambda s, f: baskets.bundles(_rules(s, f), min_lift=1.0, min_confidence=0.15),
        """SELECT array_to_string(a, ', ') || ' → ' || array_to_string(k, ', ') AS "Bundle", "Support", "Confidence", "Lift" FROM rules
           WHERE "Lift" >= 1.0 AND "Confidence" >= 0.15 ORDER BY "Lift" DESC, "Confidence" DESC, "Support" DESC, "Bundle" LIMIT 10""",
        _RULES_WITH,
    ),
    Check(
        "cross_sell",
        "For_Product:s Position:i Product:s",
        lambda s, f: baskets.cross_sell(_rules(s, f), top=3),
        'SELECT * FROM offers WHERE "Position" <= 3',
        (*_RULES_WITH, _OFFERS),
    ),
    Check(
        "dedupe_orders_latest",
        _VERSION,
        lambda s, f: versions.newest(_versions(s, f), ["l_orderkey"], _NEWEST),
        _NEWEST_SQL,
    ),
    Check(
        "upsert_orders",
        _VERSION,
        lambda s, f: versions.upsert(
            _versions(s, f).filter("l_linestatus = 'F'"), _versions(s, f).filter("l_linestatus <> 'F'"), ["l_orderkey"], _NEWEST
        ),
        _NEWEST_SQL,
    ),
]
