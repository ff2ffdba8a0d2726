"""A raw labelled table in, a model out, applied to raw tables with and without the label."""

from pyspark.sql import functions as F

from ledgerwatch.operators import automl
from ledgerwatch.plans.base import lines


def test_fit_and_apply_a_raw_table(spark, sf):
    li = lines(spark, sf).select("line_id", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice", "is_fraud")
    raw = li.withColumn("fraud_flag", F.when(F.col("is_fraud") == 1, "Fraud").when(F.col("l_tax") > 0.07, F.lit(None)).otherwise("normal")).drop("is_fraud")
    fitted = automl.fit_table(raw, "line_id", params={"n_estimators": 15, "max_depth": 3})
    assert fitted.label == "fraud_flag" and "line_id" not in fitted.reads
    assert fitted.model.performance["test_auc"] > 0.95
    a = automl.apply_table(raw, fitted, "line_id").select("line_id", F.round("fraud_probability", 9).alias("p"))
    b = automl.apply_table(raw.drop("fraud_flag"), fitted, "line_id").select("line_id", F.round("fraud_probability", 9).alias("p"))
    assert a.count() == raw.count() and a.exceptAll(b).isEmpty()
    c = automl.apply_table(raw.drop("l_tax", "fraud_flag").withColumn("customer_id", F.lit(1)), fitted, "line_id", keep=["customer_id"])
    assert c.count() == raw.count() and "customer_id" in c.columns
