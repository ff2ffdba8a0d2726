"""Per-key computations that stay correct and parallel when one key holds a
large share of all rows.

Keys above a checked row count are cut into chunks of equally many rows (range
partitions of key and time); each chunk is one window partition and only small
per-chunk summaries travel between chunks.  NULL is a key like any other, and rows
without time come before all others of their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.session import cut_lineage

#: Stands for a missing time: before every real one, far enough from the end of the type for any span.
NO_TIME = -(1 << 61)
HOT_ROWS = 1_000_000
BROADCAST_KEYS = 100_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def instant(ts: str) -> Column:
    """The time as a number to order by, never NULL."""
    return F.coalesce(micros(ts), F.lit(NO_TIME))


def whole_key(key: str) -> Column:
    """The key as a value that is never NULL, so that joins keep rows without key."""
    return F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("value"))


def attach_group_stats(df: DataFrame, key: str, aggs: dict[str, Column]) -> DataFrame:
    """Group totals on every row: map-side combined aggregate joined back.

    The right side has one row per key, so a hot key only repeats a single
    row and adaptive skew-join handling can split the left side freely.
    """
    stats = df.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, key, "left")


def split_hot(df: DataFrame, hot_rows: int):
    """(rows of other keys, rows of hot keys or None, number of chunks) by the column ``_key``."""
    per_key = df.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    s = per_key.agg(F.count("*").alias("keys"), F.sum("_n").alias("n")).first()
    if s["keys"] == 0:
        return df, None, 0
    keys = per_key.select("_key")
    if s["keys"] <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, "_key", "left_anti"), df.join(keys, "_key", "left_semi"), max(2, -(-2 * s["n"] // hot_rows))


def chunked(df: DataFrame, t: str, chunks: int, tie: str | None = None) -> DataFrame:
    """Adds ``_chunk``: ranges of (key, time, tie) with about equally many rows, so a key whose rows
    share one time (or have none) is cut like any other; callers carry state between chunks in
    chunk order, which is the order of (key, time, tie). Without a tie equal times stay together.

    Range bounds are sampled, so the rows are checkpointed once to keep them.
    """
    by = ["_key", t, *([tie] if tie else [])]
    return cut_lineage(df.repartitionByRange(chunks, *by).withColumn("_chunk", F.spark_partition_id()))


def rolling_totals(df: DataFrame, key: str, ts: str, span_micros: int,
                   measures: dict[str, Column], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Totals over the inclusive look-back [ts - span, ts] of the same key.

    Measures must be integral or decimal, so that the difference of two
    running totals (hot keys) equals the direct window sum.
    """
    base = df.withColumns({"_key": whole_key(key), "_t": instant(ts), **{f"_m_{k}": m for k, m in measures.items()}})
    normal, hot, chunks = split_hot(base, hot_rows)
    drop = ["_key", "_t", *[f"_m_{k}" for k in measures]]
    w = Window.partitionBy("_key").orderBy("_t").rangeBetween(-span_micros, 0)
    out = normal.withColumns({k: F.sum(f"_m_{k}").over(w) for k in measures}).drop(*drop)
    if hot is None:
        return out
    # one row per (key, instant), then one probe per row at the window start
    pre = hot.groupBy("_key", "_t").agg(*[F.sum(f"_m_{k}").alias(f"_m_{k}") for k in measures])
    sums = [F.col(f"_m_{k}") for k in measures]
    here = pre.select("_key", "_t", F.col("_t").alias("_p"), F.lit(1).alias("_kind"), *sums)
    start = pre.select("_key", "_t", (F.col("_t") - span_micros).alias("_p"), F.lit(0).alias("_kind"),
                       *[(F.col(f"_m_{k}") * 0).cast(dict(pre.dtypes)[f"_m_{k}"]).alias(f"_m_{k}")
                         for k in measures])
    both = chunked(here.unionByName(start), "_p", chunks)
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (both.groupBy("_key", "_chunk").agg(*[F.sum(f"_m_{k}").alias(f"_s_{k}") for k in measures])
               .select("_key", "_chunk", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}")
                                        for k in measures]))
    inside = (Window.partitionBy("_key", "_chunk").orderBy("_p", "_kind")
              .rowsBetween(Window.unboundedPreceding, 0))
    diff = (both.withColumns({f"_r_{k}": F.sum(f"_m_{k}").over(inside) for k in measures})
            .join(offsets, ["_key", "_chunk"])
            .groupBy("_key", "_t")
            .agg(*[F.sum((F.col(f"_r_{k}") + F.col(f"_o_{k}")) * F.when(F.col("_kind") == 1, 1).otherwise(-1))
                   .alias(k) for k in measures]))
    split = hot.join(diff, ["_key", "_t"]).drop(*drop)
    return out.unionByName(split.select(out.columns))


def prior_totals(df: DataFrame, key: str, ts: str, tie: str, measures: dict[str, Column],
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Totals over all earlier rows of the same key (order ts, tie), NULL on the first."""
    base = df.withColumns({"_key": whole_key(key), "_t": instant(ts), **{f"_m_{k}": m for k, m in measures.items()}})
    normal, hot, chunks = split_hot(base, hot_rows)
    drop = ["_key", "_t", *[f"_m_{k}" for k in measures]]
    w = Window.partitionBy("_key").orderBy("_t", tie).rowsBetween(Window.unboundedPreceding, -1)
    out = normal.withColumns({k: F.sum(f"_m_{k}").over(w) for k in measures}).drop(*drop)
    if hot is None:
        return out
    hot = chunked(hot, "_t", chunks, tie)
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (hot.groupBy("_key", "_chunk").agg(*[F.sum(f"_m_{k}").alias(f"_s_{k}") for k in measures])
               .select("_key", "_chunk", *[F.sum(f"_s_{k}").over(before).alias(f"_o_{k}") for k in measures]))
    inside = (Window.partitionBy("_key", "_chunk").orderBy("_t", tie)
              .rowsBetween(Window.unboundedPreceding, -1))
    total = {k: F.when(F.col(f"_r_{k}").isNull() & F.col(f"_o_{k}").isNull(), None).otherwise(
        F.coalesce(F.col(f"_r_{k}"), F.lit(0)) + F.coalesce(F.col(f"_o_{k}"), F.lit(0))) for k in measures}
    split = (hot.withColumns({f"_r_{k}": F.sum(f"_m_{k}").over(inside) for k in measures})
             .join(offsets, ["_key", "_chunk"])
             .withColumns(total))
    return out.unionByName(split.select(out.columns))


def previous_value(df: DataFrame, key: str, ts: str, tie: str, value: Column, name: str,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """The value on the preceding row of the same key (order ts, tie)."""
    base = df.withColumns({"_key": whole_key(key), "_t": instant(ts), "_v": value})
    normal, hot, chunks = split_hot(base, hot_rows)
    out = normal.withColumn(name, F.lag("_v").over(Window.partitionBy("_key").orderBy("_t", tie))).drop("_key", "_t", "_v")
    if hot is None:
        return out
    hot = chunked(hot, "_t", chunks, tie)
    last = (hot.groupBy("_key", "_chunk").agg(F.max_by("_v", F.struct("_t", tie)).alias("_last"))
            .select("_key", "_chunk", F.lag("_last").over(Window.partitionBy("_key").orderBy("_chunk")).alias("_prev")))
    inside = Window.partitionBy("_key", "_chunk").orderBy("_t", tie)
    split = (hot.withColumns({"_in": F.lag("_v").over(inside), "_i": F.row_number().over(inside)})
             .join(last, ["_key", "_chunk"])
             .withColumn(name, F.when(F.col("_i") == 1, F.col("_prev")).otherwise(F.col("_in"))))
    return out.unionByName(split.select(out.columns))


def _recent_three(df: DataFrame, part: list[str], order: list, t: str, value: str) -> DataFrame:
    """Adds ``_s2`` and ``_s3``: the latest (t, value) of the second and third most
    recently seen distinct values, counting the current row's value first."""
    w = Window.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct(F.col(t).alias("t"), F.col(value).alias("v"))
    step = df.withColumn("_prev", F.lag(here).over(w))
    change = F.when(F.col("_prev").isNotNull() & (F.col("_prev.v") != F.col(value)), F.col("_prev"))
    step = step.withColumn("_change", change)
    step = step.withColumns({"_s2": F.last("_change", True).over(upto),
                             "_older": F.last("_change", True).over(prior)})
    third = F.when(F.col("_change").isNotNull() & (F.col("_older.v") != F.col(value)), F.col("_older"))
    return (step.withColumn("_third", third)
            .withColumn("_s3", F.last("_third", True).over(upto))
            .drop("_prev", "_change", "_older", "_third"))


def rolling_at_most_two(df: DataFrame, key: str, ts: str, tie: str, value: str, span_micros: int,
                        name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """True where [ts - span, ts] of the key has at most two distinct values.

    It holds exactly when the third most recently seen distinct value is older
    than the window start, so three remembered values replace a collected set.
    """
    base = df.withColumns({"_key": whole_key(key), "_t": instant(ts)})
    normal, hot, chunks = split_hot(base, hot_rows)
    peers = lambda *part: (Window.partitionBy(*part).orderBy("_t")
                           .rangeBetween(Window.unboundedPreceding, 0))
    ok = lambda c: F.coalesce(c < F.col("_t") - span_micros, F.lit(True)) | (F.col("_t") == NO_TIME)
    helper = ["_key", "_t", "_s2", "_s3", "_c"]
    out = (_recent_three(normal, ["_key"], ["_t", tie], "_t", value)
           .withColumn("_c", F.max("_s3.t").over(peers("_key")))
           .withColumn(name, ok(F.col("_c"))).drop(*helper))
    if hot is None:
        return out
    hot = chunked(hot, "_t", chunks, tie)
    # the three latest distinct values of each chunk, and from them of all chunks before
    latest = hot.groupBy("_key", "_chunk", value).agg(F.max(F.struct("_t", tie)).alias("_at"))
    top = Window.partitionBy("_key", "_chunk").orderBy(F.desc("_at"))
    summary = (latest.withColumn("_i", F.row_number().over(top)).where("_i <= 3")
               .select("_key", "_chunk", value, F.col("_at._t").alias("_t"), F.col(f"_at.{tie}").alias("_tie")))
    state = (_recent_three(summary, ["_key"], ["_t", "_tie"], "_t", value)
             .groupBy("_key", "_chunk")
             .agg(F.max_by(F.struct(F.struct(F.col("_t").alias("t"), F.col(value).alias("v")).alias("s1"),
                                    "_s2", "_s3"), F.struct("_t", "_tie")).alias("_st"))
             .withColumn("_st", F.lag("_st").over(Window.partitionBy("_key").orderBy("_chunk")))
             .where("_st is not null"))
    seeds = (state.select("_key", "_chunk", F.posexplode(F.array("_st._s3", "_st._s2", "_st.s1")).alias("_seed", "_x"))
             .where("_x is not null")
             .select("_key", "_chunk", "_seed", F.col("_x.t").alias("_t"), F.col("_x.v").alias(value)))
    rows = hot.withColumn("_seed", F.lit(None).cast("int"))
    mixed = rows.unionByName(seeds, allowMissingColumns=True)
    # seeds carry older instants; NULL tie sorts first and _seed keeps their own order
    order = ["_t", F.col("_seed").asc_nulls_last(), tie]
    # rows of one instant may lie in several chunks: their latest third value is a grouped maximum
    # (combined before the shuffle) joined back, one row per (key, instant)
    third = (_recent_three(mixed, ["_key", "_chunk"], order, "_t", value).where("_seed is null"))
    peak = third.groupBy("_key", "_t").agg(F.max("_s3.t").alias("_c"))
    split = third.join(peak, ["_key", "_t"]).withColumn(name, ok(F.col("_c")))
    return out.unionByName(split.select(out.columns))
