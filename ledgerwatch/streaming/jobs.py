"""Streaming jobs: scoring, alert counts, velocity alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions import features as ft
from ledgerwatch.operators.boosting import FraudModel


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).parquet(folder))


def with_event_time(stream: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def scored_stream(stream: DataFrame, model: FraudModel, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """Scores arriving rows with a frozen model; stateless."""
    return model.score(stream, keep, threshold)


def alert_counts(stream: DataFrame, tier: Column, ts: str = "ts") -> DataFrame:
    """Rows per 5-minute window and risk tier."""
    return (with_event_time(stream, ts).groupBy(F.window(ts, "5 minutes").alias("w"), tier.alias("risk_level")).count()
            .select(F.col("w.start").alias("window_start"), "risk_level", F.col("count").alias("n")))


def velocity_alerts(stream: DataFrame, cust: str, ts: str = "ts", min_tx: int = 8) -> DataFrame:
    """Customers with many rows in a 6-hour window that slides by the hour.

    State is one counter per customer and open window, whatever a customer's volume.
    """
    return (with_event_time(stream, ts).groupBy(F.window(ts, "6 hours", "1 hour").alias("w"), cust).count()
            .where(F.col("count") >= min_tx).select(F.col("w.start").alias("window_start"), cust, F.col("count").alias("n")))


def probability_tier(x: str, scale: float) -> Column:
    return F.coalesce(ft.risk_level(F.least(F.col(x) / scale, F.lit(1.0)), include_zero=True), F.lit("LOW"))


def run_available(out: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what has arrived, appends it to Parquet and returns."""
    q = (out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
