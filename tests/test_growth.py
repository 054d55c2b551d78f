"""Attribution, broadcasts, sketches, months, retention and repurchase: edge cases and plans."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tradewind.operators import attribution, broadcasts, repurchase, retention, sketches, trailing
from tradewind.plans import months

TOUCH = "Customer_ID long, Touch_ID long, Touch_Time timestamp, Channel string, Campaign_ID string"
ORDER = "Customer_ID long, Order_ID long, Order_Time timestamp, GMV double"
NOON = datetime(2024, 3, 1, 12)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_credits_sum_to_one_and_keep_the_look_back(spark):
    """A busy customer, touches at the very edge of the look-back, at the moment of the order and after it, and ties."""
    chance = random.Random(2)
    touches = [(1, i, NOON - timedelta(hours=chance.randint(-50, 900)), "ads", None) for i in range(300)]
    touches += [(2, 1000, NOON - timedelta(days=30), "edge", None), (2, 1001, NOON - timedelta(days=30, seconds=1), "outside", None), (2, 1002, NOON, "now", None)]
    touches += [(3, 1003, NOON - timedelta(days=1), "b", None), (3, 1004, NOON - timedelta(days=1), "a", None), (None, 1005, NOON, "nobody", None), (3, 1006, None, "never", None)]
    orders = [(1, 1, NOON, 10.0), (1, 2, NOON - timedelta(days=3), 5.0), (2, 3, NOON, 7.0), (3, 4, NOON, 1.0), (4, 5, NOON, 2.0), (None, 6, NOON, 3.0)]
    found = attribution.credits(spark.createDataFrame(touches, TOUCH), spark.createDataFrame(orders, ORDER)).collect()
    by_order = defaultdict(list)
    for row in found:
        by_order[row["Order_ID"]].append(row)
    assert set(by_order) == {1, 2, 3, 4, 5, 6}
    for number, rows in by_order.items():
        for model in attribution.MODELS:
            assert sum(r[model] for r in rows) == pytest.approx(1), (number, model)
    time_of = {o[1]: o[2] for o in orders}
    for number in (1, 2):
        near = {t[1] for t in touches if t[0] == 1 and time_of[number] - timedelta(days=30) <= t[2] <= time_of[number]}
        assert {r["Touch_ID"] for r in by_order[number]} == near
    assert [(r["Channel"], r["Touchpoint_Position"]) for r in sorted(by_order[3], key=lambda r: r["Position"])] == [("edge", "first"), ("now", "last")]
    assert [r["Channel"] for r in sorted(by_order[4], key=lambda r: r["Position"])] == ["b", "a"]
    for number in (5, 6):
        assert [(r["Channel"], r["Touches"], r["Touchpoint_Position"]) for r in by_order[number]] == [("organic", 0, None)]


def test_time_decay_halves(spark):
    touches = [(1, 1, NOON - timedelta(days=7), "a", None), (1, 2, NOON, "b", None)]
    found = attribution.credits(spark.createDataFrame(touches, TOUCH), spark.createDataFrame([(1, 1, NOON, 9.0)], ORDER))
    assert {r["Channel"]: round(r["Time_Decay"], 6) for r in found.collect()} == {"a": round(1 / 3, 6), "b": round(2 / 3, 6)}


def test_attribution_of_nothing(spark):
    nothing = spark.createDataFrame([], TOUCH)
    assert attribution.credits(nothing, spark.createDataFrame([], ORDER)).collect() == []
    assert [r["Channel"] for r in attribution.credits(nothing, spark.createDataFrame([(1, 1, NOON, 9.0)], ORDER)).collect()] == ["organic"]


def test_attribution_joins_by_customer_and_time(spark):
    """Large sides meet by an equal customer and bucket, never by a loop over pairs."""
    touches, orders = spark.createDataFrame([(1, 1, NOON, "a", None)], TOUCH), spark.createDataFrame([(1, 1, NOON, 9.0)], ORDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(attribution.credits(touches, orders))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


BROADCAST = "Broadcast_ID long, Send_Time timestamp, Cost double, Recipients long"


@pytest.mark.parametrize("hours", [48, 2, 1])
def test_effect_equals_a_plain_count(spark, hours):
    chance = random.Random(hours)
    sent = [(i, NOON + timedelta(seconds=chance.randint(0, 400_000)), float(i), 10) for i in range(30)] + [(99, NOON, 0.0, 0)]
    orders = [(1, i, NOON + timedelta(seconds=chance.randint(0, 500_000)), 1.5) for i in range(400)]
    orders += [(1, 1000, NOON, 2.0), (1, 1001, NOON + timedelta(hours=hours), 4.0), (1, 1002, NOON + timedelta(hours=hours, microseconds=-1), 8.0), (1, 1003, None, 16.0)]
    found = broadcasts.effect(spark.createDataFrame(sent, BROADCAST), spark.createDataFrame(orders, ORDER), hours=hours)
    expected = {}
    for number, time, *_ in sent:
        own = [o[3] for o in orders if o[2] and time <= o[2] < time + timedelta(hours=hours)]
        expected[number] = (len(own), sum(own))
    assert {r["Broadcast_ID"]: (r[f"Orders_{hours}h"], r[f"GMV_{hours}h"]) for r in found.collect()} == expected
    assert {r["Broadcast_ID"]: r["ROI"] for r in found.collect()}[99] == 0.0


def test_effect_has_no_loop(spark):
    sent, orders = spark.createDataFrame([(1, NOON, 1.0, 1)], BROADCAST), spark.createDataFrame([(1, 1, NOON, 9.0)], ORDER)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(broadcasts.effect(sent, orders))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert broadcasts.effect(sent, orders.limit(0)).first()["Orders_48h"] == 0


def test_sketches_merge_over_days(spark):
    """Orders over several days count once in a period; errors stay within the stated bounds."""
    lines = spark.range(40_000).select(
        (F.col("id") % 15_000).cast("string").alias("Order_ID"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("Order_Date_Only"),
        F.lit("social").alias("Platform"),
        F.concat(F.lit("b"), F.col("id") % 3_000).alias("Buyer_Username"),
        (F.col("id") % 1000).cast("double").alias("Net_Sales"),
    )
    daily = sketches.daily_sketches(lines)
    row = sketches.merged(daily).first()
    assert abs(row["Orders"] - 15_000) <= 3 * sketches.distinct_error() * 15_000
    assert abs(row["Buyers"] - 3_000) <= 3 * sketches.distinct_error() * 3_000
    part = sketches.merged(daily, date(2024, 1, 5), date(2024, 1, 5)).first()
    exact = lines.filter("Order_Date_Only = '2024-01-05'").agg(F.count_distinct("Order_ID")).first()[0]
    assert abs(part["Orders"] - exact) <= max(1, 3 * sketches.distinct_error() * exact)


ROWS = "`Order ID` string, Day date, Status string, Value double, File_Modified long, File_Source string"


def store_of(spark, folder):
    def parts(lines):
        return {"daily": lines.groupBy("Month", "Day").agg(F.sum("Value").alias("Value"))}

    return months.MonthlyStore(spark, str(folder), lambda df: df.filter("Status <> 'cancelled'"), date=F.col("Day"), parts=parts)


def rows_of(spark, *rows):
    return spark.createDataFrame([(o, date.fromisoformat(d) if d else None, s, v, m, "f") for o, d, s, v, m in rows], ROWS)


def contents(rows):
    return sorted((r["Order ID"], str(r["Day"]), r["Value"]) for r in rows.collect())


def test_months_are_rewritten_only_where_something_changed(spark, tmp_path):
    store = store_of(spark, tmp_path)
    first = rows_of(spark, ("a", "2024-01-05", "ok", 1.0, 1), ("a", "2024-01-05", "ok", 2.0, 1), ("b", "2024-02-05", "ok", 3.0, 1), ("c", "2024-03-05", "ok", 4.0, 1), (None, None, "ok", 9.0, 1))
    assert store.merge(first, 0) == ["2024-01", "2024-02", "2024-03", months.UNDATED]
    # One order moves from February to April; January and March stay as they are.
    assert store.merge(rows_of(spark, ("b", "2024-04-01", "ok", 5.0, 2)), 1) == ["2024-02", "2024-04"]
    assert store.snapshot() == {"2024-01": 0, "2024-03": 0, "2024-04": 1, months.UNDATED: 0}
    read = store._months("rows", ["2024-02", "2024-04"]).inputFiles()
    assert read and all("/batch=1/Month=2024-04/" in f for f in read)
    assert [r for r in contents(store.rows(["2024-01", "2024-03", "2024-04"]))] == [("a", "2024-01-05", 1.0), ("a", "2024-01-05", 2.0), ("b", "2024-04-01", 5.0), ("c", "2024-03-05", 4.0)]
    assert {(r["Month"], r["Value"]) for r in store.stored_part("daily").collect()} == {("2024-01", 3.0), ("2024-03", 4.0), ("2024-04", 5.0), (months.UNDATED, 9.0)}


def test_late_repeated_and_cancelled_versions(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.merge(rows_of(spark, ("a", "2024-01-05", "ok", 1.0, 5), ("b", "2024-01-06", "ok", 2.0, 5)), 0)
    # Late: older than what is stored.
    assert store.merge(rows_of(spark, ("a", "2023-01-05", "ok", 7.0, 3)), 1) == []
    # Repeated: the number is known.
    assert store.merge(rows_of(spark, ("a", "2023-01-05", "ok", 8.0, 9)), 0) == []
    assert contents(store.rows()) == [("a", "2024-01-05", 1.0), ("b", "2024-01-06", 2.0)]
    # The same version once more replaces itself; a cancelled version hides the order.
    store.merge(rows_of(spark, ("a", "2024-01-05", "ok", 1.0, 5), ("b", "2024-01-06", "cancelled", 2.0, 6)), 2)
    assert contents(store.rows()) == [("a", "2024-01-05", 1.0), ("b", "2024-01-06", 2.0)]
    assert [r["Order ID"] for r in store.lines().collect()] == ["a"]
    assert store.merged() == {0, 1, 2}


def test_a_failed_merge_leaves_what_was_there(spark, tmp_path):
    store = store_of(spark, tmp_path)
    store.merge(rows_of(spark, ("a", "2024-01-05", "ok", 1.0, 1)), 0)

    def fails(lines):
        raise OSError("no space")

    broken = store_of(spark, tmp_path)
    broken.parts = fails
    with pytest.raises(OSError):
        broken.merge(rows_of(spark, ("a", "2024-01-05", "ok", 2.0, 2)), 1)
    assert contents(store.rows()) == [("a", "2024-01-05", 1.0)]
    store.merge(rows_of(spark, ("a", "2024-01-05", "ok", 2.0, 2)), 1)
    assert contents(store.rows()) == [("a", "2024-01-05", 2.0)]


LINE = "Order_ID long, Order_Date timestamp, Order_Date_Only date, Buyer_Username string, SKU string, Net_Sales double, True_Net_Revenue double"


def lines_of(spark, rows):
    return spark.createDataFrame([(o, datetime.combine(d, datetime.min.time()), d, b, "s", v, v) for o, d, b, v in rows], LINE)


def test_cohorts_with_earlier_runs(spark):
    lines = lines_of(spark, [(1, date(2024, 2, 1), "x", 5.0), (2, date(2024, 3, 1), "x", 5.0), (3, date(2024, 3, 9), "y", 7.0), (4, date(2024, 3, 9), None, 1.0), (5, date(2024, 3, 9), "", 1.0)])
    purchases = retention.monthly_purchases(lines)
    known = spark.createDataFrame([("x", date(2023, 12, 1)), ("z", date(2023, 1, 1))], "Customer_ID string, Cohort date")
    rows = {(str(r["Month"]), r["Kind"]): r["Customers"] for r in retention.new_and_returning(retention.with_cohort(purchases, known)).collect()}
    assert rows == {("2024-02-01", "returning"): 1, ("2024-03-01", "returning"): 1, ("2024-03-01", "new"): 1}
    triangle = {(str(r["Cohort"]), r["Age"]): r["Retention"] for r in retention.cohort_triangle(retention.with_cohort(purchases)).collect()}
    assert triangle == {("2024-02-01", 0): 1.0, ("2024-02-01", 1): 1.0, ("2024-03-01", 0): 1.0}


def test_snapshots_read_the_lines_once(spark, tmp_path):
    lines_of(spark, [(1, date(2024, 1, 1), "x", 5.0)]).write.parquet(f"{tmp_path}/lines")
    stored = spark.read.parquet(f"{tmp_path}/lines")
    before, after = retention.snapshots(stored, [date(2024, 1, 1), date(2024, 2, 1)])
    assert before.collect() == [] and [r["Recency"] for r in after.collect()] == [31]
    assert not any(f"{tmp_path}/lines" in f for f in after.inputFiles())


def test_gaps_are_days_without_sales(spark):
    daily = spark.createDataFrame([(date(2024, 1, 1), "p", 70.0), (date(2024, 1, 9), "p", 10.0), (date(2024, 1, 10), "p", 10.0)], "Date date, Platform string, GMV double")
    found = {r["Date"].day: (r["GMV"], r["GMV_Mean7"], r["GMV_Change"]) for r in trailing.against_trailing_mean(daily, ["GMV"]).collect()}
    assert len(found) == 10
    assert found[1] == (70.0, None, None) and found[8] == (0.0, 10.0, -1.0) and found[9] == (10.0, 0.0, None)
    assert found[10][1] == pytest.approx(10 / 7)


def test_repurchase_model_on_held_out_customers(spark):
    """Customers with a rhythm of 20 days come back, others buy once; the model tells them apart, and knows nothing of later orders."""
    chance = random.Random(9)
    rows, number = [], 0
    for customer in range(400):
        loyal = customer % 2 == 0
        day = date(2024, 1, 1) + timedelta(days=chance.randint(0, 40))
        while day < date(2024, 6, 1):
            number += 1
            rows.append((number, day, f"c{customer}", float(chance.randint(5, 50))))
            day += timedelta(days=chance.randint(12, 25) if loyal else 1000)
    orders = repurchase.orders_of(lines_of(spark, rows)).cache()
    cut = date(2024, 4, 15)
    labelled = repurchase.labelled(orders, cut)
    assert {r["Customer_ID"]: r["Recency"] for r in repurchase.features(orders.filter(F.col("Order_Date") < F.lit(cut)), cut).collect()} == {
        r["Customer_ID"]: r["Recency"] for r in labelled.collect()
    }
    fitted = repurchase.fit(labelled)
    assert fitted.auc > 0.9 and fitted.held_out > 40
    scored = fitted.scored(repurchase.features(orders, cut))
    assert scored.filter("Probability < 0 OR Probability > 1").count() == 0
