"""Feature selection and grid-search tables.  Every input carries a ``dataset``
column, so one job serves all data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.operators import profile as pf
from ledgerwatch.session import cut_lineage

# Name patterns of features that proved useful elsewhere.
USEFUL = ["_log", "_sqrt", "_bin", "_is_high", "_is_low", "is_same_", "is_international", "transaction_hour",
          "transaction_weekday", "is_business_hours", "is_night", "interaction", "_length", "_words"]


def _by(*order):
    return Window.partitionBy("dataset").orderBy(*order)


def ranked(imp: DataFrame) -> DataFrame:
    """Position by importance per data set; the names of one model's features per window."""
    return imp.withColumn("rank", F.row_number().over(_by(F.desc("importance"), "feature")))


def with_cumulative(imp: DataFrame) -> DataFrame:
    """Adds normalised, percentage and cumulative importance and the counts for 80 and 95 %."""
    w = _by(F.desc("importance"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("importance").over(Window.partitionBy("dataset"))
    out = (imp.withColumn("importance_normalized", F.when(total > 0, F.col("importance") / total).otherwise(0.0))
           .withColumns({"importance_percentage": F.col("importance_normalized") * 100,
                         "importance_cumulative": F.try_divide(F.sum("importance").over(w), total) * 100}))
    return out


def features_needed(cum: DataFrame) -> DataFrame:
    c, e = F.col("importance_cumulative"), 1e-9
    return cum.groupBy("dataset").agg((F.count_if(c < 80 - e) + 1).alias("for_80"), (F.count_if(c < 95 - e) + 1).alias("for_95"))


def top_padded(imp: DataFrame, k: int = 20) -> DataFrame:
    """(dataset, rank 1..k, value): the k largest divided by the largest, zeros at the end."""
    top = ranked(imp).where(F.col("rank") <= k)
    spine = imp.select("dataset").distinct().withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    peak = F.max("importance").over(Window.partitionBy("dataset"))
    top = top.withColumn("value", F.when(peak > 0, F.col("importance") / peak).otherwise(F.col("importance")))
    return spine.join(top.select("dataset", "rank", "value"), ["dataset", "rank"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0)))


def at_least(imp: DataFrame, threshold: float, top_n: int | None = None) -> DataFrame:
    out = imp.where(F.col("importance") >= threshold)
    return ranked(out).where(F.col("rank") <= top_n) if top_n else out


def transferable(available: DataFrame, reference: DataFrame) -> DataFrame:
    """Available (dataset, feature) rows whose name is a reference feature or fits a useful pattern."""
    known = reference.select("feature").distinct().withColumn("known", F.lit(True))
    pattern = F.lit(False)
    for p in USEFUL:
        pattern = pattern | F.contains(F.col("feature"), F.lit(p))
    return (available.join(known, "feature", "left")
            .where(F.coalesce("known", F.lit(False)) | pattern).drop("known"))


def intelligent(imp: DataFrame, min_cumulative: float = 0.95, min_features: int = 10,
                max_features: int | None = None) -> DataFrame:
    """Keeps the largest valid of: enough for the cumulative share, all non-zero, all above
    mean - deviation of the non-zero; the minimum when none is valid."""
    run = F.sum("importance").over(_by(F.desc("importance"), "feature").rowsBetween(Window.unboundedPreceding, 0))
    r = ranked(imp).withColumn("_run", run)
    some = F.when(F.col("importance") > 0, F.col("importance"))
    s = r.groupBy("dataset").agg(
        F.coalesce(F.min(F.when(F.col("_run") >= min_cumulative, F.col("rank"))), F.lit(0)).alias("n1"),
        F.count(some).alias("n2"),
        F.greatest(F.lit(0.001), F.coalesce(F.avg(some) - F.stddev_pop(some), F.lit(0.001))).alias("cut"))
    n3 = (imp.join(s.select("dataset", "cut"), "dataset").groupBy("dataset")
          .agg(F.count_if(F.col("importance") >= F.col("cut")).alias("n3")))
    valid = lambda c: F.when((F.col(c) >= min_features)
                             & (F.lit(True) if max_features is None else F.col(c) <= max_features), F.col(c))
    keep = s.join(n3, "dataset").select(
        "dataset", F.coalesce(F.greatest(valid("n1"), valid("n2"), valid("n3")), F.lit(min_features)).alias("n_selected"))
    return r.join(keep, "dataset").where(F.col("rank") <= F.col("n_selected")).select("dataset", "feature", "importance", "rank")


def by_score_vector(features: DataFrame, scores: DataFrame, threshold: float = 0.1, at_least_n: int = 10) -> DataFrame:
    """(dataset, position, feature) joined with (dataset, position, score): the best-scored
    positions, as many as score above the threshold; nothing when fewer than ``at_least_n``."""
    n = scores.groupBy("dataset").agg(F.count_if(F.col("score") > threshold).alias("n_above"))
    width = features.groupBy("dataset").agg(F.count("*").alias("width"))
    order = scores.withColumn("rank", F.row_number().over(_by(F.desc("score"), F.desc("position"))))
    return (order.join(n, "dataset").join(width, "dataset")
            .where((F.col("n_above") >= at_least_n) & (F.col("rank") <= F.least("n_above", "width")))
            .join(features, ["dataset", "position"]).select("dataset", "position", "feature", "score"))


def importance_statistics(imp: DataFrame) -> DataFrame:
    """Concentration record per data set, with the true Gini coefficient."""
    up = imp.withColumn("_up", F.row_number().over(_by("importance", "feature")))
    r = ranked(up)
    x = F.col("importance")
    return r.groupBy("dataset").agg(
        F.count("*").alias("n_features"), F.sum(x).alias("total"), F.max(x).alias("top"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        (-F.sum(F.when(x > 0, x * F.log(x + 1e-10)))).alias("entropy"),
        F.try_divide(F.sum(F.when(F.col("rank") <= 5, x)), F.sum(x)).alias("top5_share"), F.try_divide(F.sum(F.when(F.col("rank") <= 10, x)), F.sum(x)).alias("top10_share"),
        F.greatest(F.lit(0.0), F.try_divide(F.sum(F.col("_up") * x) * 2, F.count("*") * F.sum(x)) - (F.count("*") + 1) / F.count("*")).alias("gini")
    ).join(dominant(imp), "dataset")


def dominant(imp: DataFrame, share: float = 0.1) -> DataFrame:
    t = imp.groupBy("dataset").agg(F.sum("importance").alias("t"))
    return imp.join(t, "dataset").groupBy("dataset").agg(F.count_if(F.col("importance") > F.col("t") * share).alias("num_dominant"))


def engineering_flags(imp: DataFrame) -> DataFrame:
    """Which techniques the feature names of a data set show."""
    f = F.lower("feature")
    has = lambda *w: F.coalesce(F.bool_or(f.rlike("|".join(w))), F.lit(False)).cast("int")
    return imp.groupBy("dataset").agg(
        has("_log", "log_").alias("log"), has("interaction", r"\*", "_x_").alias("interaction"),
        has("hour", "day", "is_night", "is_business").alias("temporal"),
        F.bool_or(~F.col("feature").rlike("_log|_sqrt|_squared|_bin|interaction")).cast("int").alias("encoding"),
        has("_bin", "_range", "binned").alias("binning"))


def top_by_statistic(df: DataFrame, cols: list[str], k: int, label: str | None = None) -> DataFrame:
    """Best k columns of a table by variance, or by |r| with the label."""
    if label is None:
        s = pf.moments(df, cols).select("name", F.col("variance").alias("statistic"))
    else:
        s = pf.target_correlations(df, label, cols).select("name", F.col("correlation").alias("statistic"))
    return s.where("statistic is not null").orderBy(F.desc("statistic"), "name").limit(k)


def anova_f(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """One-way F statistic per column in one pass of class-wise sums."""
    g = df.groupBy(label).agg(F.count("*").alias("n"), *[c for x in cols for c in (
        F.sum(F.col(x).cast("double")).alias(f"s_{x}"), F.sum(F.col(x).cast("double") * F.col(x)).alias(f"q_{x}"))])
    aggs = [F.sum("n").alias("n"), F.count("*").alias("k")]
    fields = {}
    for x in cols:
        aggs += [F.sum(f"s_{x}").alias(f"S_{x}"), F.sum(f"q_{x}").alias(f"Q_{x}"), F.sum(F.col(f"s_{x}") * F.col(f"s_{x}") / F.col("n")).alias(f"B_{x}")]
        between = F.col(f"B_{x}") - F.col(f"S_{x}") * F.col(f"S_{x}") / F.col("n")
        within = F.col(f"Q_{x}") - F.col(f"B_{x}")
        fields[x] = {"f_score": F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k")))}
    return pf.melt(g.agg(*aggs), fields)


def apply_selection(df: DataFrame, selected: list[str]) -> DataFrame:
    """Selected columns that exist; all columns when none of them does."""
    keep = [c for c in selected if c in df.columns]
    return df.select(*keep) if keep else df


# ---- grid-search tables ---------------------------------------------------------------------------

def top_configs(grid: DataFrame, metrics: list[str], k: int = 5) -> DataFrame:
    """Best k configurations per data set and metric."""
    long = grid.select("dataset", "config_id", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])).alias("x")).select(
        "dataset", "config_id", "x.*")
    w = Window.partitionBy("dataset", "metric").orderBy(F.desc("score"), "config_id")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def grid_statistics(grid: DataFrame, score: str = "mean_test_f1", std: str = "std_test_f1") -> DataFrame:
    s, d = F.col(score), F.col(std)
    return grid.groupBy("dataset").agg(
        F.count("*").alias("n_configs"), F.max(s).alias("best"), F.min(s).alias("worst"), (F.max(s) - F.min(s)).alias("score_range"), F.avg(s).alias("mean"),
        F.stddev_pop(s).alias("std"), F.count_if(d < 0.05).alias("stable"), F.count_if(d > 0.1).alias("unstable"),
        F.count_if(d < 0.03).alias("low_variance"), F.count_if((d >= 0.03) & (d <= 0.07)).alias("medium_variance"), F.count_if(d > 0.07).alias("high_variance"))


def convergence(grid: DataFrame, score: str = "mean_test_f1") -> DataFrame:
    best = grid.groupBy("dataset").agg(F.max(score).alias("best"))
    s = F.col(score)
    return grid.join(best, "dataset").groupBy("dataset").agg(
        F.stddev_pop(s).alias("stability"), F.count_if(s >= F.col("best") * 0.95).alias("near_best"), F.count_if(s <= F.col("best") * 0.8).alias("poor"))


def global_categories(grid: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """Rank of every configuration over the whole catalogue and its category."""
    from ledgerwatch.operators.ordering import global_rank
    out = global_rank(grid, [F.desc(score), *keys], "target_rank")
    k = F.col("target_rank")
    return out.withColumn("category", F.when(k <= 25, "excellent").when(k <= 50, "good").when(k <= 80, "fair").otherwise("poor"))


def diverse_configs(grid: DataFrame, params: list[str], score: str, key: str, threshold: float = 0.95, k: int = 15,
                    fallback: int = 50) -> DataFrame:
    """Greedy max-min distance choice of k configurations of one catalogue.

    Each round is one distributed pass that returns a single row: the configuration
    farthest from those already chosen.  Earlier keys win ties.
    """
    good = grid.where(F.col(score) >= threshold)
    if good.limit(k).count() < k:
        good = grid.orderBy(F.desc(score), key).limit(fallback)
    s = good.agg(*[F.struct(F.avg(p).alias("m"), F.stddev_pop(p).alias("s")).alias(p) for p in params]).first()
    scaled = good.withColumns({f"_z_{p}": (F.col(p) - s[p]["m"]) / (s[p]["s"] or 1.0) for p in params})
    scaled = cut_lineage(scaled)  # the rounds below re-read it
    first = scaled.orderBy(F.desc(score), key).first()
    if first is None:
        return grid.limit(0).withColumn("pick", F.lit(0))
    chosen = [first]
    for _ in range(k - 1):
        dist = None
        for c in chosen:
            d = F.sqrt(sum(((F.col(f"_z_{p}") - c[f"_z_{p}"]) * (F.col(f"_z_{p}") - c[f"_z_{p}"]) for p in params), F.lit(0.0)))
            dist = d if dist is None else F.least(dist, d)
        rest = scaled.where(~F.col(key).isin([c[key] for c in chosen])).withColumn("_d", dist)
        nxt = rest.orderBy(F.desc("_d"), key).first()
        if nxt is None:
            break
        chosen.append(nxt)
    picks = F.when(F.lit(False), 0)
    for i, c in enumerate(chosen):
        picks = picks.when(F.col(key) == c[key], i + 1)
    return (scaled.where(F.col(key).isin([c[key] for c in chosen])).withColumn("pick", picks)
            .select(*grid.columns, "pick"))


#: Distances are compared at this many decimals, so equal distances tie whatever the summation order.
DISTANCE_DIGITS = 9


def candidate_pool(grid: DataFrame, score: str, key: str, threshold: float, k: int, fallback: int,
                   group: str = "dataset") -> DataFrame:
    """Rows of each data set that take part in its choice: those scoring at least `threshold`, or,
    where fewer than k do, the `fallback` best (score descending, then key). The count per data set is
    a grouped sum (combined before the shuffle); the best rows come from a ranking window whose limit
    Spark applies inside every task before the shuffle, so a data set with a third of all rows never
    reaches one task whole."""
    s = F.col(score)
    counts = grid.groupBy(group).agg(F.count_if(s >= threshold).alias("_n_good"))
    enough = grid.join(counts.where(F.col("_n_good") >= k), group, "left_semi").where(s >= threshold)
    few = grid.join(counts.where(F.col("_n_good") < k), group, "left_semi")
    best = (few.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.col(key))))
            .where(F.col("_rank") <= fallback).drop("_rank"))
    return enough.unionByName(best)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def diverse_per_dataset(grid: DataFrame, params: list[str], score: str, key: str, threshold: float = 0.95, k: int = 15,
                        fallback: int = 50, group: str = "dataset") -> DataFrame:
    """Farthest-first choice of k configurations in every data set at once.

    Pool: `candidate_pool`. Parameters are standardised per data set (population deviation; a
    constant parameter is divided by one; a null parameter counts as its mean). The first pick of a
    data set is its best score (smaller key on ties); each later pick is the pool row farthest from
    its nearest earlier pick (distance at DISTANCE_DIGITS decimals, smaller key on ties), never a row
    picked before. Every round is one pass over the settled pool, joined to the picks so far of each
    data set (at most k per data set, held as one array), and one grouped minimum per data set; no
    row reaches the driver. A data set whose pool holds fewer than k rows gets them all; an empty
    grid gives no rows.

    Returns (group, pick, key, score, params..., distance): `distance` is the distance to the nearest
    earlier pick when the row was picked (null for the first).
    """
    pool = candidate_pool(grid, score, key, threshold, k, fallback, group)
    stats = pool.groupBy(group).agg(*[F.avg(F.col(p).cast("double")).alias(f"_m_{p}") for p in params],
                                    *[F.stddev_pop(F.col(p).cast("double")).alias(f"_s_{p}") for p in params])
    z = [F.coalesce((F.col(p).cast("double") - F.col(f"_m_{p}")) / F.when(F.col(f"_s_{p}") > 0, F.col(f"_s_{p}")).otherwise(1.0),
                    F.lit(0.0)) for p in params]
    pool = cut_lineage(pool.join(stats, group).select(group, key, score, *params, F.array(*z).alias("_z")))
    first = (pool.groupBy(group).agg(F.min(F.struct(-F.col(score).cast("double"), F.col(key), F.col("_z"))).alias("_x"))
             .select(group, F.lit(1).alias("pick"), F.col("_x")[key].alias(key), F.col("_x._z").alias("_z"),
                     F.lit(None).cast("double").alias("distance")))
    rounds = [cut_lineage(first)]  # each round's picks, settled; their union stays a shallow plan
    for r in range(2, k + 1):
        picks = _union(rounds)
        centres = picks.groupBy(group).agg(F.collect_list("_z").alias("_c"), F.collect_list(key).alias("_taken"))
        zc = F.col("_z")
        near = F.aggregate("_c", F.lit(float("inf")),
                           lambda acc, c: F.least(acc, F.sqrt(F.aggregate(F.zip_with(zc, c, lambda a, b: (a - b) * (a - b)),
                                                                          F.lit(0.0), lambda t, v: t + v))))
        rest = pool.join(centres, group).where(~F.array_contains("_taken", F.col(key))).withColumn("_d", near)
        nxt = cut_lineage(rest.groupBy(group).agg(F.min(F.struct(-F.round("_d", DISTANCE_DIGITS), F.col(key), F.col("_z"), F.col("_d"))).alias("_x"))
                          .select(group, F.lit(r).alias("pick"), F.col("_x")[key].alias(key), F.col("_x._z").alias("_z"), F.col("_x._d").alias("distance")))
        if nxt.isEmpty():
            break
        rounds.append(nxt)
    picks = _union(rounds)
    return (picks.drop("_z").join(pool.drop("_z"), [group, key])
            .select(group, "pick", key, score, *params, "distance"))


def diversity_per_dataset(chosen: DataFrame, params: list[str], group: str = "dataset") -> DataFrame:
    """Per data set: mean distance between its chosen configurations in raw parameters (0.0 below two)
    and the population deviation of every parameter; at most k rows per data set are gathered."""
    vec = F.array(*[F.col(p).cast("double") for p in params])
    a = chosen.groupBy(group).agg(F.collect_list(vec).alias("_all"), *[F.stddev_pop(F.col(p).cast("double")).alias(f"std_{p}") for p in params])
    dist = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    total = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.aggregate("_all", F.lit(0.0), lambda t, y: t + dist(x, y)))
    n = F.size("_all")
    return a.select(group, n.alias("n_chosen"), F.when(n > 1, total / (n * (n - 1))).otherwise(0.0).alias("avg_distance"),
                    *[f"std_{p}" for p in params])


def diversity_report(chosen: DataFrame, params: list[str]) -> DataFrame:
    """Mean pairwise distance of the chosen few (at most some tens by construction) and
    the deviation of every parameter."""
    a = chosen.agg(F.collect_list(F.array(*[F.col(p).cast("double") for p in params])).alias("all"),
                   *[F.stddev_pop(p).alias(f"std_{p}") for p in params])
    dist = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    total = F.aggregate("all", F.lit(0.0), lambda s, x: s + F.aggregate("all", F.lit(0.0), lambda t, y: t + dist(x, y)))
    n = F.size("all")
    return a.select((total / (n * (n - 1))).alias("avg_distance"), *[f"std_{p}" for p in params])


def derived_scores(rows: DataFrame) -> DataFrame:
    """Complexity, quality, diversity and category columns from a data set's basic numbers
    (n_rows, n_cols, n_features, missing_rate, fraud_rate, corr_strength, max_depth, learning_rate, n_estimators, cv_score)."""
    c = F.col
    quality = (1 - c("missing_rate") + F.least(c("n_features") / 50, F.lit(1.0)) + F.least(c("fraud_rate") * 10, F.lit(1.0))
               + 1 - F.least(c("corr_strength"), F.lit(1.0))) / 4
    diversity = (F.abs(c("max_depth") - 3) / 3 + F.abs(c("learning_rate") - 0.1) / 0.1 + F.abs(c("n_estimators") - 100) / 100) / 3
    return rows.withColumns({
        "complexity_score": c("n_rows") * c("n_features") / 1_000_000, "dataset_quality_score": quality, "hyperparameter_diversity": diversity,
        "model_complexity": (c("max_depth") / 10 + c("n_estimators") / 500 + c("n_features") / 100) / 3,
        "size_category": F.when(c("n_rows") > 20_000, "large").when(c("n_rows") > 10_000, "medium").otherwise("small"),
        "engineering_level": F.when(c("n_cols") > 25, "advanced").when(c("n_cols") > 15, "intermediate").otherwise("basic"),
        "score_category": F.when(c("cv_score") >= 0.9, "excellent").when(c("cv_score") >= 0.8, "good").when(c("cv_score") >= 0.7, "fair").otherwise("poor"),
        "recommended_use_case": F.when(quality > 0.7, "production").otherwise("development")})
