"""Products bought together: frequent itemsets, association rules and what follows from them.

Itemsets are counted level by level with partial aggregation. Baskets are reduced to frequent items, and equal baskets
are merged into one row with a weight, so copies of a basket are counted once. A basket is taken apart into its items with
the items that follow each; these rows are dealt out anew, so that an order with very many items is spread over
the tasks. Itemsets grow by an item of their row only while they are frequent.

At most ``mean basket size / min_support`` items are frequent, whatever the number of orders, so no basket is longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.numbers import total
from tradewind.session import stage


def basket_items(lines: DataFrame, order="Order_ID", product="Product_Name", quantity="Quantity") -> DataFrame:
    """One row per order and product with a flag for a positive total quantity."""
    known = lines.filter(F.col(product).isNotNull() & F.col(order).isNotNull())
    return known.groupBy(F.col(order).alias("Order_ID"), F.col(product).alias("Product")).agg(
        (total(quantity) > 0).alias("Bought")
    )


def order_count(items: DataFrame) -> DataFrame:
    """Orders with a known product, also those whose quantities cancel out; one row."""
    return items.agg(F.count_distinct("Order_ID").alias("n"))


def item_support(items: DataFrame, min_support: float = 0.01, orders: int | None = None) -> DataFrame:
    """Share of the orders each product is in. Without a known order count the items are stored first,
    because they are read twice."""
    if orders is None:
        items = stage(items, "basket-items")
        orders = order_count(items).first()["n"]
    counts = items.filter("Bought").groupBy("Product").agg(F.count("*").alias("Orders"))
    return counts.withColumn("Support", F.col("Orders") / F.lit(orders)).filter(F.col("Support") >= min_support)


def _extended(rows: DataFrame) -> DataFrame:
    """Each itemset with each of the items that follow it in the basket: one item longer, with the items after that."""
    each = rows.select("Weight", "Itemset", "Rest", F.posexplode("Rest").alias("_at", "_item"))
    return each.select(
        "Weight", F.concat("Itemset", F.array("_item")).alias("Itemset"), F.expr("slice(Rest, _at + 2, size(Rest))").alias("Rest")
    )


def frequent_itemsets(items: DataFrame, min_support: float = 0.005, max_length: int = 3) -> DataFrame:
    """Itemsets (sorted arrays of products) up to ``max_length`` with their orders, support and length."""
    items = stage(items, "basket-items")
    orders = order_count(items).first()["n"]
    frequent = stage(item_support(items, min_support, orders), "frequent-items")
    bought = items.filter("Bought").join(frequent.select("Product"), "Product", "left_semi")
    baskets = (
        bought.groupBy("Order_ID").agg(F.array_sort(F.collect_list("Product")).alias("Rest"))
        .groupBy("Rest").agg(F.count("*").alias("Weight"))
    )
    empty = F.array().cast("array<string>")
    rows = _extended(baskets.select("Weight", empty.alias("Itemset"), "Rest")).filter(F.size("Rest") > 0)
    rows = stage(rows.repartition("Itemset", "Rest"), "basket-rows")
    result = frequent.select(F.array("Product").alias("Itemset"), "Orders")
    for length in range(2, max_length + 1):
        rows = _extended(rows)
        counts = rows.groupBy("Itemset").agg(F.sum("Weight").alias("Orders"))
        counts = stage(counts.filter(F.col("Orders") / F.lit(orders) >= min_support), f"itemsets-{length}")
        result = result.unionByName(counts)
        rows = rows.filter(F.size("Rest") > 0).join(counts.select("Itemset"), "Itemset", "left_semi")
    return result.select(
        "Itemset",
        "Orders",
        (F.col("Orders") / F.lit(orders)).alias("Support"),
        F.size("Itemset").alias("Length"),
    )


def association_rules(itemsets: DataFrame, min_confidence: float = 0.3, min_lift: float = 1.0) -> DataFrame:
    """Rules for every split of an itemset into two non-empty parts, strongest lift first."""
    support = itemsets.select("Itemset", "Support")

    def part(wanted: int) -> Column:
        return F.filter("Itemset", lambda _, i: F.getbit(F.col("Mask"), i) == wanted)

    splits = (
        itemsets.filter(F.col("Length") >= 2)
        .withColumn("Mask", F.explode(F.expr("sequence(1, shiftleft(1, Length) - 2)")))
        .select(
            part(1).alias("Antecedents"),
            part(0).alias("Consequents"),
            F.col("Support"),
        )
    )
    antecedents = support.select(
        F.col("Itemset").alias("Antecedents"), F.col("Support").alias("Antecedent_Support")
    )
    consequents = support.select(
        F.col("Itemset").alias("Consequents"), F.col("Support").alias("Consequent_Support")
    )
    confidence = F.col("Support") / F.col("Antecedent_Support")
    return (
        splits.join(antecedents, "Antecedents")
        .withColumn("Confidence", confidence)
        .filter(F.col("Confidence") >= min_confidence)
        .join(consequents, "Consequents")
        .withColumn("Lift", F.col("Confidence") / F.col("Consequent_Support"))
        .filter(F.col("Lift") >= min_lift)
        .select(
            "Antecedents", "Consequents", "Antecedent_Support", "Consequent_Support", "Support", "Confidence", "Lift"
        )
    )


def _by_strength(*ties) -> list[Column]:
    return [F.desc("Lift"), F.desc("Confidence"), F.desc("Support"), *[F.col(t) for t in ties]]


def market_baskets(
    lines: DataFrame,
    order="Order_ID",
    product="Product_Name",
    quantity="Quantity",
    min_support: float = 0.005,
    min_confidence: float = 0.2,
    min_lift: float = 1.0,
    max_length: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """Frequent itemsets and association rules of order lines."""
    itemsets = frequent_itemsets(basket_items(lines, order, product, quantity), min_support, max_length)
    itemsets = stage(itemsets, "itemsets")
    return itemsets, association_rules(itemsets, min_confidence, min_lift)


def recommendations(rules: DataFrame, product: str | None = None, top: int = 5) -> DataFrame:
    """The ``top`` consequents per product, strongest lift first; a product may be recommended twice.

    Without ``product`` the answer covers every product that occurs in an antecedent.
    """
    if product is not None:
        rules = rules.filter(F.array_contains("Antecedents", product))
    offers = (
        rules.withColumn("For_Product", F.explode("Antecedents"))
        .withColumn("Product", F.explode("Consequents"))
        .withColumn("_from", F.array_join("Antecedents", ","))
        .withColumn("_to", F.array_join("Consequents", ","))
    )
    if product is not None:
        offers = offers.filter(F.col("For_Product") == product)
    strength = Window.partitionBy("For_Product").orderBy(*_by_strength("Product", "_from", "_to"))
    return (
        offers.withColumn("Position", F.row_number().over(strength))
        .filter(F.col("Position") <= top)
        .select("For_Product", "Position", "Product", "Confidence", "Lift", "Support")
    )


def cross_sell(rules: DataFrame, product: str | None = None, top: int = 5) -> DataFrame:
    """Names only, strongest first."""
    return recommendations(rules, product, top).select("For_Product", "Position", "Product")


def bundles(rules: DataFrame, min_lift: float = 2.0, min_confidence: float = 0.3, top: int = 10) -> DataFrame:
    """The ``top`` strongest rules as text."""
    left, right = F.array_join("Antecedents", ", "), F.array_join("Consequents", ", ")
    strong = rules.filter((F.col("Lift") >= min_lift) & (F.col("Confidence") >= min_confidence))
    return (
        strong.withColumn("Bundle", F.concat(left, F.lit(" → "), right))
        .orderBy(*_by_strength("Bundle"))
        .limit(top)
        .select("Bundle", "Antecedents", "Consequents", "Support", "Confidence", "Lift")
    )
