"""Will a customer buy again: features as of a day, label from the days after it, a model with a fixed split."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.numbers import ratio, total

NUMBERS = ["Recency", "Frequency", "Monetary", "Average_Order_Value", "Days_Between_Orders", "Month_Sin", "Month_Cos"]


def orders_of(lines: DataFrame, customer: str = "Buyer_Username", category: str = "SKU") -> DataFrame:
    """One row per customer and order: first moment, GMV, and the category with the highest GMV in it (ties: the first by name)."""
    known = lines.filter(F.col(customer).isNotNull() & (F.col(customer) != "") & F.col("Order_Date").isNotNull())
    keys = [F.col(customer).alias("Customer_ID"), F.col("Order_ID")]
    parts = known.groupBy(*keys, F.col(category).alias("Category")).agg(F.min("Order_Date").alias("Order_Date"), total("Net_Sales").alias("GMV"))
    best = F.min(F.struct(-F.col("GMV"), F.col("Category")))
    return parts.groupBy("Customer_ID", "Order_ID").agg(F.min("Order_Date").alias("Order_Date"), total("GMV").alias("GMV"), best["Category"].alias("Category"))


def features(orders: DataFrame, as_of: date) -> DataFrame:
    """Per customer who bought before the morning of ``as_of``, from those orders only: days since the last one, number, GMV, mean value, mean
    days between orders (0 for one), category of the last one, and the season of the day as sine and cosine."""
    past = orders.filter(F.col("Order_Date") < F.lit(as_of))
    day = F.lit(as_of).cast("timestamp")
    angle = F.lit(2 * 3.141592653589793 * (as_of.month - 1) / 12)
    grouped = past.groupBy("Customer_ID").agg(
        F.timestamp_diff("DAY", F.max("Order_Date"), day).alias("Recency"),
        F.count("*").alias("Frequency"),
        total("GMV").alias("Monetary"),
        F.timestamp_diff("DAY", F.min("Order_Date"), F.max("Order_Date")).alias("_span"),
        F.max_by("Category", F.struct("Order_Date", "Order_ID")).alias("Category"),
    )
    return grouped.withColumns(
        {
            "Average_Order_Value": ratio("Monetary", "Frequency"),
            "Days_Between_Orders": ratio("_span", F.col("Frequency") - 1),
            "Month_Sin": F.sin(angle),
            "Month_Cos": F.cos(angle),
        }
    ).drop("_span")


def labelled(orders: DataFrame, as_of: date, within_days: int = 30) -> DataFrame:
    """Features as of a day with ``Repurchase``: 1 if an order follows in the ``within_days`` days from it on, else 0. Nothing of those days is
    in the features."""
    ahead = orders.filter((F.col("Order_Date") >= F.lit(as_of)) & (F.col("Order_Date") < F.lit(as_of + timedelta(days=within_days))))
    bought = ahead.select("Customer_ID").distinct().withColumn("_bought", F.lit(1))
    found = features(orders, as_of).join(bought, "Customer_ID", "left")
    return found.withColumn("Repurchase", F.coalesce("_bought", F.lit(0))).withColumn("As_Of", F.lit(as_of)).drop("_bought")


def days_to_next_order(orders: DataFrame) -> DataFrame:
    """Orders with the days to the customer's next one, and whether it came within 30 days; null and false for the last."""
    after = F.lead("Order_Date").over(Window.partitionBy("Customer_ID").orderBy("Order_Date", "Order_ID"))
    days = F.timestamp_diff("DAY", F.col("Order_Date"), after)
    return orders.withColumn("Days_To_Next_Order", days).withColumn("Repurchase_30d", F.coalesce(F.col("Days_To_Next_Order") <= 30, F.lit(False)))


@dataclass
class Fitted:
    model: PipelineModel
    auc: float
    held_out: int

    def scored(self, rows: DataFrame) -> DataFrame:
        """Feature rows with ``Probability`` of another purchase."""
        probability = F.get(vector_to_array(F.col("probability")), F.lit(1))
        return self.model.transform(rows).withColumn("Probability", probability).select(*rows.columns, "Probability")


def is_held_out(share: float = 0.2):
    """A fixed share of the customers by hash, the same in every run and for every day of features."""
    return F.pmod(F.xxhash64("Customer_ID"), F.lit(1000)) < int(share * 1000)


def fit(rows: DataFrame, held_out: float = 0.2, regularisation: float = 0.01) -> Fitted:
    """Logistic regression on labelled rows (of one or more days); the AUC is of customers no row of whom was fitted."""
    steps = [
        StringIndexer(inputCol="Category", outputCol="_category", handleInvalid="keep"),
        OneHotEncoder(inputCols=["_category"], outputCols=["_one_hot"]),
        VectorAssembler(inputCols=[*NUMBERS, "_one_hot"], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features"),
        LogisticRegression(labelCol="Repurchase", regParam=regularisation, maxIter=50),
    ]
    model = Pipeline(stages=steps).fit(rows.filter(~is_held_out(held_out)))
    rest = rows.filter(is_held_out(held_out))
    auc = BinaryClassificationEvaluator(labelCol="Repurchase").evaluate(model.transform(rest))
    return Fitted(model, auc, rest.count())
