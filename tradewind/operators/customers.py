"""Customer scoring by recency, frequency and monetary value."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.numbers import first_match, total, whole_table
from tradewind.operators.order_statistics import after, rank_first_edges
from tradewind.session import stage

CUSTOMER_COLUMNS = ["Buyer_Username", "Customer_ID", "Buyer"]

# Score ranges (recency, frequency, monetary) per segment; the first match wins.
SEGMENT_RULES = {
    "Champions": [(4, 5), (4, 5), (4, 5)],
    "Loyal Customers": [(3, 5), (3, 5), (3, 5)],
    "Potential Loyalist": [(4, 5), (1, 3), (3, 5)],
    "New Customers": [(4, 5), (1, 2), (1, 5)],
    "Promising": [(3, 4), (1, 2), (1, 3)],
    "Need Attention": [(2, 3), (2, 3), (2, 4)],
    "About to Sleep": [(2, 3), (1, 2), (1, 2)],
    "At Risk": [(1, 2), (3, 5), (3, 5)],
    "Cant Lose Them": [(1, 1), (4, 5), (4, 5)],
    "Hibernating": [(1, 2), (1, 2), (1, 3)],
    "Lost": [(1, 1), (1, 1), (1, 2)],
}
# Lowest score sum per segment when no rule matches.
SEGMENT_BY_SUM = [(13, "Loyal Customers"), (10, "Potential Loyalist"), (7, "Need Attention"), (4, "At Risk")]
# Marketing advice per segment.
SEGMENT_STRATEGIES = {
    "Champions": "Reward with early access, exclusive offers. Ask for reviews and referrals.",
    "Loyal Customers": "Upsell higher-value products. Engage with loyalty program.",
    "Potential Loyalist": "Recommend products, offer membership benefits.",
    "New Customers": "Onboarding series, provide excellent support.",
    "Promising": "Create brand awareness, offer first-purchase incentives.",
    "Need Attention": "Reactivate with limited-time offers, highlight new products.",
    "About to Sleep": "Re-engage with personalized recommendations.",
    "At Risk": "Send aggressive win-back campaigns, conduct surveys.",
    "Cant Lose Them": "Personal outreach, premium support, understand their needs.",
    "Hibernating": "Offer steep discounts, highlight value proposition.",
    "Lost": "Attempt reactivation, but focus budget elsewhere.",
}


def rfm_base(lines: DataFrame, customer: str | None = None, reference=None, by_platform: bool = False) -> DataFrame:
    """Days since the last order, distinct orders and revenue per customer.

    ``reference`` defaults to one day after the newest order of the data; the day count is in elapsed
    days, not calendar days. The grouped customers are staged: the newest date and all later steps read
    them instead of the order lines.
    """
    return recency(customer_totals(lines, customer, ["Platform"] if by_platform else []), reference)


def customer_totals(lines: DataFrame, customer: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Last order, distinct orders and revenue per customer, and per ``by``; rows without a customer are left out."""
    customer = customer or next(c for c in CUSTOMER_COLUMNS if c in lines.columns)
    known = lines.filter(F.col(customer).isNotNull() & (F.col(customer) != ""))
    return known.groupBy(F.col(customer).alias("Customer_ID"), *by).agg(
        F.max("Order_Date").alias("Last_Order"),
        F.count_distinct("Order_ID").alias("Frequency"),
        total("Net_Sales").alias("Monetary"),
    )


def add_customers(parts: DataFrame) -> DataFrame:
    """Partial results as one; right when no order is in two of them."""
    return parts.groupBy("Customer_ID").agg(
        F.max("Last_Order").alias("Last_Order"), F.sum("Frequency").alias("Frequency"), total("Monetary").alias("Monetary")
    )


def recency(grouped: DataFrame, reference=None) -> DataFrame:
    """Customer totals with the whole days from the last order to ``reference``."""
    grouped = stage(grouped, "customers")
    if reference is None:
        reference = grouped.agg(F.max("Last_Order") + F.expr("INTERVAL 1 DAY")).first()[0]
    days = F.timestamp_diff("DAY", F.col("Last_Order"), F.lit(reference).cast("timestamp"))
    return grouped.withColumn("Recency", days).select(
        "Customer_ID", *(["Platform"] if "Platform" in grouped.columns else []), "Recency", "Frequency", "Monetary"
    )


def _bins_passed(base: DataFrame, keys: Sequence[str], edges: Sequence) -> Column:
    score = F.lit(1)
    for edge in edges:
        score = score + after(base, keys, edge).cast("int")
    return score


def rfm_scores(base: DataFrame, bins: int = 5) -> DataFrame:
    """Scores 1 to ``bins``: recency by value quantiles (recent is high), the others by rank.

    Ties of frequency and revenue are ranked in the order of the customer id. The base should be a stored
    table (``rfm_base`` gives one): each rank is one pass over (value, id), and scoring compares every row
    with ``bins - 1`` edges.
    """
    ids = [c for c in ("Customer_ID", "Platform") if c in base.columns]
    probabilities = F.array(*[F.lit(s / bins) for s in range(1, bins)])
    # Recency has at most one distinct value per calendar day, so its exact quantiles are a small state.
    stats = base.agg(F.percentile("Recency", probabilities).alias("q")).first()
    recency = F.lit(bins)
    for edge in stats["q"] or []:
        recency = recency - (F.col("Recency") > F.lit(edge)).cast("int")
    scores = {"R_Score": recency}
    for column, name in (("Frequency", "F_Score"), ("Monetary", "M_Score")):
        keys = [column, *ids]
        scores[name] = _bins_passed(base, keys, rank_first_edges(base, keys, bins))
    return base.withColumns(scores)


def segment() -> Column:
    """Name of the first segment whose three score ranges hold, else by the sum of the scores."""
    scores = [F.col("R_Score"), F.col("F_Score"), F.col("M_Score")]
    rules = []
    for name, ranges in SEGMENT_RULES.items():
        condition = F.lit(True)
        for score, (low, high) in zip(scores, ranges):
            condition = condition & score.between(low, high)
        rules.append((condition, name))
    points = scores[0] + scores[1] + scores[2]
    rules += [(points >= lowest, name) for lowest, name in SEGMENT_BY_SUM]
    return first_match(rules, "Lost")


def rfm_segments(scored: DataFrame) -> DataFrame:
    code = F.concat(*[F.col(c).cast("string") for c in ("R_Score", "F_Score", "M_Score")])
    advice = F.create_map(*[F.lit(x) for x in chain.from_iterable(SEGMENT_STRATEGIES.items())])
    return scored.withColumns({"RFM_Segment": code, "Segment": segment()}).withColumn(
        "Strategy", advice[F.col("Segment")]
    )


def customer_rfm(lines: DataFrame, customer: str | None = None, reference=None, by_platform: bool = False) -> DataFrame:
    """Whole scoring, with the time of the run."""
    scored = rfm_scores(rfm_base(lines, customer, reference, by_platform))
    return rfm_segments(scored).withColumn("Last_Updated", F.current_timestamp())


def segment_summary(rfm: DataFrame) -> DataFrame:
    """Customers, means and revenue per segment with their shares, largest revenue first."""
    summary = rfm.groupBy("Segment").agg(
        F.count("Customer_ID").alias("Customers"),
        F.bround(F.avg("Recency"), 2).alias("Avg_Recency_Days"),
        F.bround(F.avg("Frequency"), 2).alias("Avg_Frequency"),
        F.bround(F.round(F.avg("Monetary"), 6), 2).alias("Avg_Monetary"),
        F.bround(total("Monetary"), 2).alias("Total_Monetary"),
    )

    def share(column: str) -> Column:
        return F.bround(F.col(column) / F.sum(column).over(whole_table()) * 100, 1)

    return summary.withColumns(
        {"Pct_Customers": share("Customers"), "Pct_Revenue": share("Total_Monetary")}
    ).orderBy(F.desc("Total_Monetary"), "Segment")


def campaign_targets(rfm: DataFrame, segments: str | Sequence[str], limit: int | None = None) -> DataFrame:
    """Customers of the given segments, largest revenue first."""
    wanted = [segments] if isinstance(segments, str) else list(segments)
    targets = rfm.filter(F.col("Segment").isin(wanted)).orderBy(F.desc("Monetary"), "Customer_ID")
    return targets.limit(limit) if limit else targets
