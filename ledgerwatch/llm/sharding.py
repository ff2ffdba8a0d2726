"""Contiguous shards of near equal bytes by a global prefix sum of sizes.

Rows are range-partitioned by (text hash, id), so equal texts are neighbours and stay together unless a
cut falls inside their group. Per-partition totals give every partition its offset (one row per
partition passes between them), a running sum inside the partition gives each row its global prefix, and
the shard is the sixteenth in which the middle of the row lies. No group, key or shard meets in one
task: partitions are cut by range over a key that ends with the id.

Defined cases: a null text has no bytes and checksum 0; every row costs one byte more than its text;
null ids come first among equal texts; rows that repeat id and text are counted and placed one by one;
an empty table gives an empty result; a row larger than a shard fills its shard alone, and shards that
lie wholly inside it stay empty; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.llm.common import settled

SHARDS = 16
LAW = "bytes"


def by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
             partitions: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    raw = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.xxhash64(text_col).alias("x"))
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = settled(rows.repartitionByRange(parts, "text_crc32", "x", F.col("doc_id").asc_nulls_first())
                   .withColumn("part", F.spark_partition_id()))
    # one row per partition: their offsets
    totals = laid.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    whole = totals.agg(F.sum("b").alias("total"))
    within = (Window.partitionBy("part").orderBy("text_crc32", "x", F.col("doc_id").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (laid.withColumns({"upto": F.sum("size").over(within), "nth": F.row_number().over(within)})
              .join(F.broadcast(offsets), "part").crossJoin(F.broadcast(whole))
              .withColumns({"start": F.col("b0") + F.col("upto") - F.col("size"), "row": F.col("n0") + F.col("nth") - 1})
              .withColumn("shard", F.expr(f"cast(((2 * start + size) * {shards}) div (2 * total) as int)")))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return (placed.join(F.broadcast(firsts), "shard")
            .select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                    (F.col("row") - F.col("first")).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
