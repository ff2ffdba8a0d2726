"""Results that must not depend on sizes, partitions, NaN or NULL labels."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import boosting, engineering, evaluate, profile, registry
from ledgerwatch.plans.base import lines


def test_training_does_not_depend_on_input_partitions(spark, sf):
    li = lines(spark, sf).select("line_id", "is_fraud", "l_quantity", "l_discount", "l_tax")
    odd = li.limit(3).select(F.concat("line_id", F.lit("x")).alias("line_id"), F.lit(None).cast("int").alias("is_fraud"), "l_quantity", "l_discount", "l_tax")
    found = []
    for n in (2, 7):
        df = li.union(odd).repartition(n)
        fitted = engineering.fit_rules(df.where("is_fraud is not null").drop("line_id"), "is_fraud")
        model = boosting.train(df, "is_fraud", "line_id", fitted, {"n_estimators": 4, "max_depth": 3}, measure=False, use=["l_quantity", "l_discount", "l_tax"])
        found.append(model.trees.featureImportances.toArray().tolist())
    assert found[0] == found[1]


def test_split_ranks_small_classes_like_large_ones(spark, monkeypatch):
    data = [(f"k{i}", random.Random(i).choice(["a", "b", "c", "d", None])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, y string")
    want = {r["k"]: r["fold"] for r in evaluate.stratified_split(df, "y", "k", [0.2, 0.3, 0.5]).collect()}
    monkeypatch.setattr(evaluate, "NAMED_CLASSES", 2)
    got = {r["k"]: r["fold"] for r in evaluate.stratified_split(df, "y", "k", [0.2, 0.3, 0.5]).collect()}
    assert got == want and {want[k] for k, y in data if y is None} == {None}


def test_usage_average_over_the_whole_log(spark):
    rng = random.Random(5)
    log = [(f"u{rng.randint(0, 3)}", f"2024-01-{1 + k % 28:02d} 00:00:00", k, rng.choice([None, 1e6, 0.2, rng.random()])) for k in range(900)]
    df = spark.createDataFrame(log, "key string, t string, i int, s double").withColumn("t", F.to_timestamp("t"))
    want, n = defaultdict(lambda: None), defaultdict(int)
    for key, _, _, s in sorted(log, key=lambda x: (x[1], x[2])):
        n[key] += 1
        if s is not None:
            want[key] = s if want[key] is None else want[key] * 0.7 + s * 0.3
    for r in registry.usage(df, "key", "t", "i", "s").collect():
        assert r["usage_count"] == n[r["key"]] and r["avg_similarity_score"] == pytest.approx(want[r["key"]], rel=1e-9)


def test_nan_is_missing_in_profiles_and_correlations(spark):
    nan = float("nan")
    data = [(1.0, 2.0), (2.0, nan), (nan, 1.0), (3.0, 7.0), (4.0, 6.0), (None, 3.0)]
    df = spark.createDataFrame(data, "x double, y double")
    got = {r["name"]: r for r in profile.column_profile(df).collect()}
    assert (got["x"]["missing"], got["x"]["n_unique"], got["x"]["mean"], got["x"]["max"]) == (2, 4, 2.5, 4.0)
    r = profile.correlation_matrix(df, ["x", "y"]).first()["r"]
    pairs = [(1.0, 2.0), (3.0, 7.0), (4.0, 6.0)]
    mx, my = (sum(c) / 3 for c in zip(*pairs, strict=True))
    want = sum((a - mx) * (b - my) for a, b in pairs) / math.sqrt(sum((a - mx) ** 2 for a, _ in pairs) * sum((b - my) ** 2 for _, b in pairs))
    assert r == pytest.approx(want)


def test_wide_tables_are_counted_exactly(spark):
    df = spark.range(3000).select(*[(F.col("id") % (2000 + k)).alias(f"c{k}") for k in range(32)])
    assert {r["name"]: r["n_unique"] for r in profile.column_profile(df).collect()} == {f"c{k}": 2000 + k for k in range(32)}
