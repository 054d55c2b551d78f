from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradewind.operators import customers, masters, order_statistics
from tradewind.session import stage


def _base(spark, n, seed, ties):
    rng = np.random.default_rng(seed)
    frequency = np.where(rng.random(n) < ties, 1, rng.integers(1, 9, n))
    return pd.DataFrame(
        {
            "Customer_ID": [f"c{i:06d}" for i in range(n)],
            "Recency": rng.integers(1, 400, n),
            "Frequency": frequency,
            "Monetary": np.round(rng.random(n) * 50, 1),
        }
    )


def _expected(pdf):
    pdf = pdf.sort_values("Customer_ID")
    for column, name in (("Frequency", "F_Score"), ("Monetary", "M_Score")):
        pdf[name] = pd.qcut(pdf[column].rank(method="first"), 5, labels=range(1, 6)).astype(int)
    pdf["R_Score"] = pd.qcut(pdf["Recency"], 5, labels=range(5, 0, -1)).astype(int)
    return pdf.set_index("Customer_ID")[["R_Score", "F_Score", "M_Score"]]


@pytest.mark.parametrize("n, ties", [(5, 0.3), (17, 0.3), (101, 0.9), (2000, 0.4)])
def test_scores_equal_pandas(spark, n, ties):
    """Also with a third and more of the customers sharing one frequency."""
    pdf = _base(spark, n, n, ties)
    found = customers.rfm_scores(spark.createDataFrame(pdf).repartition(4)).toPandas()
    found = found.sort_values("Customer_ID").set_index("Customer_ID")[["R_Score", "F_Score", "M_Score"]]
    pd.testing.assert_frame_equal(found, _expected(pdf), check_dtype=False)


def test_few_customers(spark):
    base = spark.createDataFrame([("a", 3, 1, 10.0)], "Customer_ID string, Recency bigint, Frequency bigint, Monetary double")
    assert customers.rfm_scores(base).select("R_Score", "F_Score", "M_Score").first()[1:] == (1, 1)
    assert customers.rfm_scores(base.limit(0)).count() == 0
    same = base.unionByName(base.withColumn("Customer_ID", F.lit("b")))
    assert customers.rfm_scores(same).count() == 2  # equal recency everywhere does not empty the result


@pytest.mark.parametrize("hot", [0.0, 0.5])
def test_quantiles_over_ranges(spark, hot):
    rng = np.random.default_rng(3)
    values = np.where(rng.random(999) < hot, 7.0, np.round(rng.random(999) * 10, 2))
    df = stage(spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5), "t")
    probabilities = [0.0, 0.2, 0.5, 0.77, 1.0]
    ordered = order_statistics.value_ranges(df, "v")
    found = order_statistics.quantiles(ordered, probabilities)
    assert (ordered.rows, ordered.total) == (999, pytest.approx(values.sum()))
    assert found == pytest.approx(list(pd.Series(values).quantile(probabilities)))


def test_recency_counts_elapsed_days(spark):
    rows = [("a", 1, datetime(2024, 1, 1, 23), 5.0), ("b", 2, datetime(2024, 1, 2, 1), 5.0), ("", 3, datetime(2024, 1, 2), 1.0)]
    lines = spark.createDataFrame(rows, "Buyer_Username string, Order_ID int, Order_Date timestamp, Net_Sales double")
    base = {r["Customer_ID"]: r["Recency"] for r in customers.rfm_base(lines).collect()}
    assert base == {"a": 1, "b": 1}


def test_by_platform(spark):
    rows = [("a", 1, datetime(2024, 1, 1), 5.0, "x"), ("a", 2, datetime(2024, 1, 3), 7.0, "y")]
    lines = spark.createDataFrame(rows, "Buyer_Username string, Order_ID int, Order_Date timestamp, Net_Sales double, Platform string")
    assert customers.customer_rfm(lines, by_platform=True).count() == 2


def test_every_score_has_one_segment(spark):
    scores = spark.sql(
        "select r as R_Score, f as F_Score, m as M_Score from (select explode(sequence(1,5)) r) "
        "lateral view explode(sequence(1,5)) as f lateral view explode(sequence(1,5)) as m"
    )
    rows = customers.rfm_segments(scores).collect()
    assert len(rows) == 125 and all(r["Segment"] in customers.SEGMENT_RULES and r["Strategy"] for r in rows)
    by_code = {r["RFM_Segment"]: r["Segment"] for r in rows}
    assert by_code["555"] == "Champions" and by_code["111"] == "Hibernating" and by_code["511"] == "New Customers"


def test_growth_is_null_on_zero(spark):
    days = spark.createDataFrame(
        [("2024-01-01", "x", 0.0), ("2024-01-02", "x", 5.0), ("2024-01-03", "x", 10.0)], "Date string, Platform string, GMV double"
    )
    found = [r["DoD_GMV_Growth"] for r in masters.with_growth(days).orderBy("Date").collect()]
    assert found == [None, None, 1.0]
