"""Sinks for predictions, reports, grids and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.operators import report
from ledgerwatch.session import cut_lineage


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        cut_lineage(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def write_as(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> str:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_predictions(scored: DataFrame, path: str) -> str:
    return write_as(scored, path, "csv")


def write_report(scored: DataFrame, path: str, key: str, meta: dict[str, str]) -> str:
    """metadata, summary and top ten as one nested document; all rows as their own data set."""
    top = report.top_frauds(scored, key).agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("fraud_probability")).alias("o"), key, "fraud_probability", "risk_level"))).alias("top_10_frauds"))
    summary = scored.agg(F.struct(F.count("*").alias("total_transactions"), F.sum("fraud_prediction").alias("frauds_detected"),
                                  F.avg("fraud_probability").alias("mean_probability")).alias("summary_statistics"))
    doc = summary.join(F.broadcast(top)).select(
        F.create_map(*[F.lit(x) for kv in meta.items() for x in kv]).alias("metadata"), "summary_statistics",
        F.transform("top_10_frauds", lambda x: x.dropFields("o")).alias("top_10_frauds"))
    doc.coalesce(1).write.json(f"{path}/report")
    write_as(scored, f"{path}/predictions", "json")
    return path


def write_three_sheets(scored: DataFrame, path: str, key: str) -> str:
    """All predictions by risk level, high risk sorted, and the summary, as three data sets."""
    write_as(scored, f"{path}/all_predictions", "parquet", partition_by=["risk_level"])
    write_as(report.high_risk(scored, key), f"{path}/high_risk")
    write_as(report.summary_metrics(scored).coalesce(1), f"{path}/summary")
    return path


def write_grid(grid: DataFrame, path: str, params: list[str]) -> str:
    """Grid records with the parameters as one map."""
    m = F.map_from_arrays(F.array(*[F.lit(p) for p in params]), F.array(*[F.col(p).cast("double") for p in params]))
    return write_as(grid.withColumn("params", m).drop(*params), path, "json")


def write_importance_documents(imp: DataFrame, path: str) -> str:
    docs = imp.groupBy("dataset").agg(F.collect_list(F.struct("feature", "importance")).alias("production_feature_importance"))
    return write_as(docs.withColumn("dataset", F.col("dataset").cast("string")), path, "json")
