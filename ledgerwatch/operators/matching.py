"""Matching data sets by the meaning of their column names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerwatch.functions import names as nm


def with_groups(catalog: DataFrame) -> DataFrame:
    """Adds ``norm`` and ``grp``; each distinct name is evaluated once."""
    names = (catalog.select("col_name").distinct()
             .withColumn("norm", nm.normalized(F.col("col_name")))
             .withColumn("grp", nm.semantic_group(F.col("norm"))))
    return catalog.join(names, "col_name")


def greedy_pairs(left: list[tuple[str, str]], right: list[tuple[str, str]], threshold: float = 0.7,
                 smart: bool = True, ratio=nm.ratio) -> list[tuple[str, str, str, float]]:
    """One-to-one pairs for the columns of two data sets, each given as (name, group).

    Left columns choose in order: same name, else same group, else the closest
    spelling above the threshold; among equals the earlier right column wins.
    ``ratio`` gives the spelling likeness of two names. `match_columns` makes the same choice in Spark.
    """
    free = dict.fromkeys(range(len(right)))
    out = []
    for name, group in left:
        pick = next((i for i in free if right[i][0].lower() == name.lower()), None)
        kind, score = "exact", 1.0
        if pick is None and group != "unknown":
            pick, kind, score = next((i for i in free if right[i][1] == group), None), "semantic", 1.0
        if pick is None:
            need = min(0.85, threshold + 0.15) if smart and len(name) < 5 else threshold
            kind, score = "fuzzy", 0.0
            for i in free:
                s = ratio(name, right[i][0])
                if s >= need and s > score:
                    pick, score = i, s
        if pick is not None:
            del free[pick]
            out.append((kind, name, right[pick][0], score))
    return out


def least_ratio(threshold: float, smart: bool = True) -> float:
    """Smallest spelling likeness that `greedy_pairs` can accept at this threshold."""
    return min(threshold, min(0.85, threshold + 0.15)) if smart else threshold


def _letters(a: str, b: str) -> float:
    """Upper bound of the ratio: letters in common, counted with multiplicity."""
    ca, common = Counter(a), 0
    for ch, n in Counter(b).items():
        common += min(n, ca.get(ch, 0))
    return 2.0 * common / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def _bounded_ratio(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Exact ratio of a pair whose letter bound reaches `least`, else null (it cannot be chosen)."""
    for a, b, least in pairs:
        out = []
        for x, y, m in zip(a, b, least):
            x, y = x.lower(), y.lower()
            out.append(nm.ratio(x, y) if _letters(x, y) >= m else None)
        yield pd.Series(out, dtype="float64")


def spelling_index(target: list[str], references: DataFrame, least: float) -> DataFrame:
    """(col_name, left, ratio) for every distinct reference name and target name whose spelling
    likeness reaches `least`. Filters come first: the length bound 2 min(la, lb) / (la + lb) in SQL,
    then the shared-letter bound in the task; the exact ratio is computed once per distinct pair that
    survives both, never again per data set."""
    names = references.select("col_name").distinct().where(F.col("col_name").isNotNull())
    lefts = F.explode(F.array(*[F.lit(c) for c in dict.fromkeys(target)])) if target else F.explode(F.array().cast("array<string>"))
    pairs = names.select("col_name", lefts.alias("left"))
    la, lb = F.length("left"), F.length("col_name")
    length_bound = F.when(la + lb > 0, 2.0 * F.least(la, lb) / (la + lb)).otherwise(1.0)
    kept = pairs.where(length_bound >= least).withColumn("ratio", _bounded_ratio("left", "col_name", F.lit(float(least))))
    return kept.where(F.col("ratio") >= least)


def _name_scores(left: list[tuple[str, str]], names: DataFrame, threshold: float, smart: bool) -> DataFrame:
    """(col_name, scores) of the distinct names that some target column can choose. ``scores`` holds per target
    column 3 for the same name, 2 for the same group, else the spelling likeness if it is near enough, else null:
    the highest score is the choice of `greedy_pairs`."""
    index = (spelling_index([name for name, _ in left], names, least_ratio(threshold, smart))
             .groupBy("col_name").agg(F.map_from_entries(F.collect_list(F.struct("left", "ratio"))).alias("likes")))

    def score(name: str, group: str) -> Column:
        need = min(0.85, threshold + 0.15) if smart and len(name) < 5 else threshold
        like = F.col("likes")[F.lit(name)]
        return (F.when(F.lower("col_name") == F.lit(name.lower()), 3.0)
                .when((F.col("grp") == F.lit(group)) & (F.lit(group) != "unknown"), 2.0)
                .when((like >= need) & (like > 0), like))

    scored = with_groups(names).join(index, "col_name", "left").select(
        "col_name", F.array(*[score(n, g) for n, g in left]).cast("array<double>").alias("scores"))
    return scored.where(F.exists("scores", lambda s: s.isNotNull()))


def match_columns(target: list[str], references: DataFrame, threshold: float = 0.7,
                  smart: bool = True) -> DataFrame:
    """(dataset, kind, left, right, score) of one target table against every reference
    data set in the catalogue (dataset, position, col_name).

    The target is one schema and each reference is one schema, so a row works on lists no longer than
    a table is wide. Names are scored once per distinct name and joined to every column that bears the
    name; columns that no target column can choose do not reach the lists. The choice is that of
    `greedy_pairs`, made by array expressions, so no data set enters a Python process.
    """
    spark = references.sparkSession
    left = [(x["col_name"], x["grp"]) for x in with_groups(
        spark.createDataFrame([(c,) for c in target], "col_name string")).collect()]
    order = {c: i for i, c in enumerate(target)}
    left.sort(key=lambda x: order[x[0]])
    names = _name_scores(left, references.select("col_name").distinct(), threshold, smart)
    lists = (references.select("dataset", "position", "col_name").join(names, "col_name").groupBy("dataset")
             .agg(F.sort_array(F.collect_list(F.struct("position", "col_name", "scores"))).alias("cols"))
             .withColumn("cols", F.transform("cols", lambda c, at: F.struct(c["col_name"].alias("col_name"), c["scores"].alias("scores"), (-at).alias("back")))))

    def choose(found: Column, i: Column) -> Column:
        # highest score first, then the earlier column (``back`` is its place, negated)
        free = F.filter("cols", lambda c: F.get(c["scores"], i).isNotNull() & ~F.exists(found, lambda f: f["back"] == c["back"]))
        best = F.array_max(F.transform(free, lambda c: F.struct(i.alias("i"), F.get(c["scores"], i).alias("s"), c["back"].alias("back"))))
        return F.concat(found, F.array_compact(F.array(best)))

    none = F.array().cast("array<struct<i:int,s:double,back:int>>")
    found = F.aggregate(F.array(*[F.lit(i) for i in range(len(left))]).cast("array<int>"), none, choose)
    pair, s = lists.select("dataset", "cols", F.explode(found).alias("p")), F.col("p.s")
    return pair.select(
        "dataset", F.when(s == 3.0, "exact").when(s == 2.0, "semantic").otherwise("fuzzy").alias("kind"),
        F.get(F.array(*[F.lit(n) for n, _ in left]), F.col("p.i")).alias("left"),
        F.get("cols", -F.col("p.back"))["col_name"].alias("right"), F.when(s >= 2.0, 1.0).otherwise(s).alias("score"))


def similarity(target: list[str], references: DataFrame, threshold: float = 0.7, smart: bool = True,
               pairs: DataFrame | None = None) -> DataFrame:
    """Similarity, overlap, precision, recall, F1 and confidence per reference."""
    pairs = match_columns(target, references, threshold, smart) if pairs is None else pairs
    n1 = F.lit(len(target))
    size = references.groupBy("dataset").agg(F.count("*").alias("n_cols2"))
    per = pairs.groupBy("dataset").agg(
        F.count_if(F.col("kind") == "exact").alias("exact_matches"),
        F.count_if(F.col("kind") == "semantic").alias("semantic_matches"),
        F.count_if(F.col("kind") == "fuzzy").alias("fuzzy_matches"),
        F.sum(F.when(F.col("kind") == "fuzzy", F.col("score") * 0.85)).alias("fuzzy_score"))
    e, s, z = (F.coalesce(F.col(f"{k}_matches"), F.lit(0)) for k in ("exact", "semantic", "fuzzy"))
    total, widest = e + s + z, F.greatest(n1, F.col("n_cols2"))
    out = size.join(per, "dataset", "left").select(
        "dataset", e.alias("exact_matches"), s.alias("semantic_matches"), z.alias("fuzzy_matches"),
        total.alias("total_matches"), n1.alias("n_cols1"), "n_cols2",
        ((e + s * 0.95 + F.coalesce("fuzzy_score", F.lit(0.0))) / widest).alias("similarity"),
        (total / widest).alias("overlap_ratio"), (total / n1).alias("precision"),
        (total / F.col("n_cols2")).alias("recall"),
        F.when(total > 0, (e + s * 0.9) / total).otherwise(0.0).alias("confidence"))
    pr = F.col("precision") + F.col("recall")
    return out.withColumns({
        "f1_score": F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(0.0),
        "match_quality": match_quality(F.col("similarity"), F.col("confidence")),
        "unmatched_cols1": n1 - F.col("total_matches"),
        "unmatched_cols2": F.col("n_cols2") - F.col("total_matches")})


def match_quality(sim: Column, confidence: Column) -> Column:
    c = sim * 0.7 + confidence * 0.3
    return (F.when(c >= 0.85, "excellent").when(c >= 0.70, "good").when(c >= 0.50, "fair")
            .when(c >= 0.30, "poor").otherwise("incompatible"))


def unmatched(target: list[str], references: DataFrame, pairs: DataFrame) -> DataFrame:
    """(dataset, side, col_name) of the columns that found no partner."""
    sets = references.select("dataset").distinct()
    one = (sets.withColumn("col_name", F.explode(F.array(*[F.lit(c) for c in target])))
           .join(pairs.select("dataset", F.col("left").alias("col_name")), ["dataset", "col_name"], "left_anti"))
    two = (references.select("dataset", "col_name")
           .join(pairs.select("dataset", F.col("right").alias("col_name")), ["dataset", "col_name"], "left_anti"))
    return (one.withColumn("side", F.lit("target"))
            .unionByName(two.withColumn("side", F.lit("reference"))))


def suggest_mapping(target: list[str], references: DataFrame, top_n: int = 5) -> DataFrame:
    """Best right-hand names per target column: 0.6 spelling + 0.5 for the same group.

    Spelling is compared once per distinct pair of names; the number of pairs is
    the width of one table times the distinct names of the catalogue.
    """
    spark = references.sparkSession
    left = with_groups(spark.createDataFrame([(c,) for c in target], "col_name string")).collect()
    sides = F.array(*[F.struct(F.lit(x["col_name"]).alias("name"), F.lit(x["grp"]).alias("grp")) for x in left])
    distinct = with_groups(references.select("col_name").distinct())
    scored = (distinct.withColumn("l", F.explode(sides))
              .withColumn("fuzzy", nm.fuzzy_similarity(F.col("l.name"), F.col("col_name")))
              .withColumn("score", F.col("fuzzy") * 0.6 + F.when(
                  (F.col("l.grp") == F.col("grp")) & (F.col("grp") != "unknown"), 0.5).otherwise(0.0))
              .where("score >= 0.3")
              .select(F.col("l.name").alias("left"), "col_name", "score"))
    w = Window.partitionBy("dataset", "left").orderBy(F.desc("score"), "position")
    return (references.select("dataset", "position", "col_name").join(scored, "col_name")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
            .select("dataset", "left", F.col("col_name").alias("right"), "score", "rank"))


def dataset_features(catalog: DataFrame) -> DataFrame:
    """One row per data set: counts, flags, domain, identifier columns.

    ``catalog`` has dataset, col_name, dtype (``string`` or a number type).
    """
    flags = {k: F.bool_or(nm.has_any(F.col("col_name"), w)).cast("int") for k, w in nm.DATASET_FLAGS.items()}
    hits = {d: F.bool_or(nm.has_any(F.col("col_name"), w)) for d, (_, w) in nm.DOMAINS.items()}
    out = catalog.groupBy("dataset").agg(
        F.count("*").alias("n_cols"), F.count_if(F.col("dtype") != "string").alias("n_numerical"),
        F.count_if(F.col("dtype") == "string").alias("n_categorical"),
        F.count_if(nm.has_any(F.col("col_name"), ["id", "number", "hash"])).alias("n_id_cols"),
        *[c.alias(k) for k, c in flags.items()], *[c.alias(f"_d_{k}") for k, c in hits.items()])
    domain = F.lit(None).cast("string")
    for score in sorted({s for s, _ in nm.DOMAINS.values()}, reverse=True):
        for d, (s, _) in nm.DOMAINS.items():
            if s == score:
                domain = F.coalesce(domain, F.when(F.col(f"_d_{d}"), F.lit(d)))
    return out.withColumn("domain", F.coalesce(domain, F.lit("unknown"))).drop(*[f"_d_{d}" for d in nm.DOMAINS])


def temporal_flags(catalog: DataFrame) -> DataFrame:
    n = F.col("col_name")
    has = lambda *w: nm.has_any(n, list(w))
    rules = {
        "has_timestamp": has("timestamp", "datetime", "tx_time"), "has_date": has("date") & ~has("update"),
        "has_time": has("time", "heure") & ~has("timestamp"), "has_hour": has("hour", "heure"),
        "has_weekday": has("weekday", "day_of_week", "dayofweek"), "has_month": has("month", "mois")}
    return catalog.groupBy("dataset").agg(*[F.bool_or(c).cast("int").alias(k) for k, c in rules.items()])


def dataset_similarity(target_features: dict, features: DataFrame, sims: DataFrame) -> DataFrame:
    """Weighted likeness of every reference to one target table.

    ``target_features`` holds n_cols, n_numerical, domain, fraud_rate and the flags;
    ``features`` the same per reference; ``sims`` the column similarity.
    """
    t = target_features
    col_sim = F.when(F.col("similarity") >= 0.95, F.least(F.lit(1.0), F.col("similarity") * 1.05)).otherwise(
        F.col("similarity"))
    related = nm.RELATED_DOMAINS.get(t["domain"], [])
    domain = (F.when(F.col("domain") == t["domain"], 1.0)
              .when(F.col("domain").isin(related) if related else F.lit(False), 0.6).otherwise(0.0))
    same = sum(((F.col(k) == t[k]).cast("int") for k in nm.DATASET_FLAGS), F.lit(0)) / len(nm.DATASET_FLAGS)
    rate, mine = F.col("fraud_rate"), F.lit(float(t["fraud_rate"]))
    near = F.when((mine > 0) & (rate > 0), F.greatest(F.lit(0.0), 1 - F.abs(mine - rate) / F.greatest(mine, rate))
                  ).otherwise(0.5)
    mix = 1 - F.abs(F.lit(t["n_numerical"] / t["n_cols"]) - F.col("n_numerical") / F.col("n_cols"))
    return (features.join(sims.select("dataset", "similarity"), "dataset")
            .select("dataset", "domain",
                    (col_sim * 0.5 + domain * 0.2 + same * 0.15 + near * 0.1 + mix * 0.05).alias("likeness")))


def best_models(likeness: DataFrame, performance: DataFrame, k: int = 5) -> DataFrame:
    """Top-k references by 0.9 likeness + 0.1 F1."""
    return (likeness.join(performance, "dataset")
            .withColumn("combined", F.col("likeness") * 0.9 + F.col("test_f1") * 0.1)
            .orderBy(F.desc("combined"), "dataset").limit(k))


def registry_match(sims: DataFrame, registry: DataFrame, size: int, rate: float, k: int = 1) -> DataFrame:
    """Registry choice: similarity adjusted by table size, +5 % for a close fraud rate."""
    n = F.col("dataset_size")
    ratio = F.least(n, F.lit(size)) / F.greatest(n, F.lit(size))
    score = F.col("similarity") * (0.9 + ratio * 0.1) * F.when(F.abs(F.col("fraud_rate") - rate) < 0.05, 1.05).otherwise(1.0)
    return (sims.join(registry, "dataset").withColumn("score", score).where("score > 0")
            .orderBy(F.desc("score"), "dataset").limit(k))
