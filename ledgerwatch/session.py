"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerwatch", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on (UTC, AQE, Arrow)."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return tune(b.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Runtime setting for wide feature projections: generated methods above 8000 bytes are
    never JIT-compiled, so such stages run several times faster with split projections."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


SPLIT_BYTES = 4 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Spreads a small batch input over all cores before CPU-heavy work.

    Only inputs below 4 MB per core by the planner's size are shuffled; larger ones
    already have enough splits and keep their partitioning.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df) else df


def is_small(df: DataFrame) -> bool:
    """Below 4 MB per core by the planner's size estimate."""
    if df.isStreaming:
        return False
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size < df.sparkSession.sparkContext.defaultParallelism * SPLIT_BYTES


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="ledgerwatch-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
