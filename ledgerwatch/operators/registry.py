"""Model registry, usage and licence reports over ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.operators import keyed
from ledgerwatch.session import cut_lineage


def active_models(registry: DataFrame, domain: str | None = None, min_auc: float | None = 0.90) -> DataFrame:
    out = registry.where("is_active")
    if domain:
        out = out.where(F.col("domain") == domain)
    if min_auc:
        out = out.where(F.col("roc_auc") >= min_auc)
    return out.orderBy(F.desc("roc_auc"), "model_name")


def search(df: DataFrame, cols: list[str], text: str) -> DataFrame:
    """Rows where any of the columns contains the text, in any case."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.col(c).ilike(f"%{text}%")
    return df.where(hit)


def licence_times(df: DataFrame, expires: str, now: Column) -> DataFrame:
    e = F.col(expires).cast("timestamp")
    return df.withColumns({
        "is_expired": F.coalesce((e < now).cast("int"), F.lit(0)),
        "is_valid": (F.col("is_active") & F.coalesce(e >= now, F.lit(True))).cast("int"),
        "days_remaining": F.greatest(F.lit(0), F.floor((F.unix_micros(e) - F.unix_micros(now)) / 86_400_000_000).cast("int"))})


def recent(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return df.where(F.col(ts).cast("timestamp") >= now - F.make_dt_interval(F.lit(days)))


def usage(log: DataFrame, key: str, ts: str, tie: str, score: str) -> DataFrame:
    """Exponential average 0.7 old + 0.3 new in time order, usage count, last use.

    The average is a weighted sum: a score with k later ones weighs 0.3 * 0.7^k, the first
    one 0.7^k.  Positions come from totals over earlier rows, which stay parallel when one
    key has most of the log.
    """
    scored = log.where(F.col(score).isNotNull()).select(key, ts, tie, score)
    placed = keyed.prior_totals(scored, key, ts, tie, {"_before": F.lit(1).cast("bigint")})
    placed = keyed.attach_group_stats(placed.withColumn("_before", F.coalesce("_before", F.lit(0))), key, {"_n": F.count("*")})
    weight = F.pow(F.lit(0.7), F.col("_n") - 1 - F.col("_before")) * F.when(F.col("_before") == 0, 1.0).otherwise(0.3)
    last = placed.groupBy(key).agg(F.sum(weight * F.col(score)).alias("avg_similarity_score"))
    count = log.groupBy(key).agg(F.count("*").alias("usage_count"), F.max(ts).alias("last_used_at"))
    return count.join(last, key, "left")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values win where present; keys of either side are kept."""
    o, n = old.alias("o"), new.alias("n")
    cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def daily_counts(df: DataFrame, ts: str, last_day: Column, days: int = 31) -> DataFrame:
    """Rows per day over a spine that includes empty days."""
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    counts = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def run_report(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count_if("success").alias("n_success"), F.count_if(~F.col("success")).alias("n_failed"), F.avg(F.when(F.col("success"), F.col("test_f1"))).alias("mean_f1"),
        F.avg(F.when(F.col("success"), F.col("test_auc"))).alias("mean_auc"), F.sum("training_time").alias("total_time"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of an ordered listing (numbers start at 1) by OFFSET; see `keyset_page` for large numbers."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def _after(keys: list[tuple[str, bool]], bound: str, strict: bool) -> Column:
    """The row comes after (or at, unless strict) the key tuple in column `bound`, in the listing's order."""
    out = F.lit(not strict)
    for name, desc in reversed(keys):
        c, b = F.col(name), F.col(bound)[name]
        beyond = c < b if desc else c > b
        out = beyond | (c.eqNullSafe(b) & out)
    return out


def page_index(df: DataFrame, keys: list[tuple[str, bool]], size: int) -> DataFrame:
    """(page, first): the key tuple of the first row of every page of `size` rows in the order of
    `keys` ((column, descending) pairs that together are unique and not null). Positions come from
    per-partition totals of a range-partitioned sort (no task holds more than its range), and the
    index, one row per page, is settled in the shared checkpoint folder to serve many requests."""
    from ledgerwatch.operators.ordering import global_rank
    order = [F.desc(k) if d else F.asc(k) for k, d in keys]
    ranked = global_rank(df.select(*[k for k, _ in keys]), order, "_pos")
    firsts = ranked.where((F.col("_pos") - 1) % size == 0)
    return cut_lineage(firsts.select(((F.col("_pos") - 1) / size + 1).cast("long").alias("page"),
                                     F.struct(*[k for k, _ in keys]).alias("first")))


def keyset_page(df: DataFrame, keys: list[tuple[str, bool]], index: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) as a range of keys between its first row and the next page's first row:
    a filter on the key columns, which a sorted or clustered table answers from one range; no OFFSET."""
    bounds = index.where(F.col("page").isin(number, number + 1)).collect()
    got = {r["page"]: r["first"].asDict() for r in bounds}
    if number not in got:
        return df.limit(0)
    lo = F.struct(*[F.lit(v).alias(k) for k, v in got[number].items()])
    cond = _after(keys, "_lo", strict=False)
    out = df.withColumn("_lo", lo).where(cond)
    if number + 1 in got:
        hi = F.struct(*[F.lit(v).alias(k) for k, v in got[number + 1].items()])
        out = out.withColumn("_hi", hi).where(~_after(keys, "_hi", strict=False)).drop("_hi")
    order = [F.desc(k) if d else F.asc(k) for k, d in keys]
    return out.drop("_lo").orderBy(*order).limit(size)


def nearest_by_log(left: DataFrame, refs: DataFrame, n: str, m: str, lkey: str, rkey: str,
                   partitions: int | None = None) -> DataFrame:
    """Nearest reference by |ln(n+1) - ln(m+1)|, smaller reference key on ties: an as-of join both ways.

    Rows are first reduced to distinct values (references keep their smallest key per value). Both
    sides are dealt together into range partitions of the value (boundaries sampled by Spark, so a
    crowded stretch of values is split like any other) and each query row finds the closest reference
    before and after it inside its partition by running windows. Each partition then hands its first
    and last reference to its neighbours: a table of one row per partition, which is all that a query
    needs when its own partition holds no reference on one side. No pairs are formed and no value
    range is fixed in advance. A null size has no logarithm and gets no nearest reference.
    """
    from pyspark.sql import Window
    x = lambda c: F.log(F.col(c).cast("double") + 1.0)
    r = refs.where(F.col(m).isNotNull()).groupBy(x(m).alias("v")).agg(F.min(rkey).alias("ref"))
    q = left.where(F.col(n).isNotNull()).select(x(n).alias("v")).distinct()
    both = (q.withColumn("ref", F.lit(None).cast(dict(r.dtypes)["ref"])).withColumn("k", F.lit(1))
            .unionByName(r.withColumn("k", F.lit(0))))
    parts = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = both.repartitionByRange(parts, "v", "k").withColumn("pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # read twice below; the partition number is fixed from here on
    point = F.struct(F.col("v"), F.col("ref"))
    here = F.when(F.col("k") == 0, point)
    edge = ranged.groupBy("pid").agg(F.min(here).alias("lo"), F.max(here).alias("hi"))
    wp = Window.orderBy("pid")  # one row per partition
    edge = edge.select("pid", F.last("hi", True).over(wp.rowsBetween(Window.unboundedPreceding, -1)).alias("below"),
                       F.first("lo", True).over(wp.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    up = Window.partitionBy("pid").orderBy("v", "k").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("pid").orderBy(F.desc("v"), "k").rowsBetween(Window.unboundedPreceding, 0)
    near = (ranged.withColumns({"_lo": F.last(here, True).over(up), "_hi": F.last(here, True).over(down)})
            .where("k = 1").join(F.broadcast(edge), "pid")
            .select("v", F.coalesce("_lo", "below").alias("a"), F.coalesce("_hi", "above").alias("z")))
    d = lambda s: F.abs(F.col("v") - F.col(f"{s}.v"))
    take_a = F.col("z").isNull() | (d("a") < d("z")) | ((d("a") == d("z")) & (F.col("a.ref") <= F.col("z.ref")))
    best = near.select("v", F.when(F.col("a").isNotNull() & take_a, F.col("a")).otherwise(F.col("z")).alias("near"))
    return (left.withColumn("v", x(n)).join(best, "v", "left")
            .select(lkey, n, F.col("near.ref").alias("nearest"), F.abs(F.col("v") - F.col("near.v")).alias("distance")))
