"""The trainer over binned blocks against MLlib's trainer on the same rows in the same partitions."""

import re

import pytest
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerwatch.operators import automl, boosting, engineering, evaluate, trees
from ledgerwatch.operators.columns import align


def rows(spark, n=3000):
    """Numbers, ties, constants, negative values, a repeated key and a missing label."""
    x = spark.range(n).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1000))).select(
        F.concat(F.lit("k"), F.when(F.col("id") > n - 4, F.lit(7)).otherwise(F.col("id"))).alias("key"),
        F.pmod(F.col("id") * 37, F.lit(101)).cast("double").alias("a"), (F.col("h") / 10 - 40).alias("b"), F.lit(3.0).alias("same"),
        (F.col("h") % 3).cast("double").alias("three"), F.lit(0.0).alias("none"),
        F.when(F.col("id") == 11, F.lit(None)).otherwise(((F.pmod(F.col("id") * 37, F.lit(101)) > 60) & (F.col("h") > 300)).cast("int")
                                                         + (F.col("h") % 50 == 0).cast("int") > 0).cast("int").alias("y"))
    return x.withColumns({"b2": F.col("b") * F.col("b"), "c": F.sqrt(F.col("a"))})


FEATURES = ["a", "b", "same", "three", "none", "b2", "c"]


def made(x, keep):
    return align(x, FEATURES, keep)


def mllib(dealt, params, weight, seed=42):
    x = dealt.withColumns({"label": F.col("y").cast("double"), "weight": F.when(F.col("y") == 1, weight).otherwise(1.0), "v": F.col("_fold") == 1})
    v = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x)
    return boosting.classifier(params, seed, "v").fit(v.select("features", "label", "weight", "v"))


def fitted(data, params):
    est = boosting.classifier(params)
    return trees.model(data, est, trees.grow(data, est, validate=True))


def same_trees(a, b):
    assert a.getNumTrees == b.getNumTrees and a.treeWeights == b.treeWeights
    nodes = [re.split(r"(-?[\d.]+(?:E-?\d+)?)", m.toDebugString.split("\n", 1)[1]) for m in (a, b)]
    assert nodes[0][0::2] == nodes[1][0::2]
    assert [float(x) for x in nodes[0][1::2]] == pytest.approx([float(x) for x in nodes[1][1::2]], rel=1e-9, abs=1e-12)
    assert a.featureImportances.toArray() == pytest.approx(b.featureImportances.toArray(), rel=1e-9)


@pytest.mark.parametrize("per,params", [(65_536, {"n_estimators": 5, "max_depth": 4}), (400, {"n_estimators": 5, "max_depth": 3, "subsample": 1.0}),
                                        (500, {"n_estimators": 3, "max_depth": 0, "colsample_bytree": 1.0})])
def test_trees_equal_those_of_mllib(spark, monkeypatch, per, params):
    monkeypatch.setattr(boosting, "ROWS_PER_FIT_PARTITION", per)
    monkeypatch.setattr(trees, "SCORE_EVERY", 2)
    layout = boosting.lay_out(rows(spark), "y", "key")
    data = trees.binned(layout.dealt.withColumn("_held", F.col("_fold") == 1), made, FEATURES, "y", "_held", 42, layout.weight)
    same_trees(fitted(data, params), mllib(layout.dealt, params, layout.weight))
    data.unpersist()
    layout.release()


def test_split_candidates_equal_those_of_mllib_when_rows_are_sampled(spark, monkeypatch):
    monkeypatch.setattr(boosting, "ROWS_PER_FIT_PARTITION", 5000)
    layout = boosting.lay_out(rows(spark, 40_000), "y", "key")
    data = trees.binned(layout.dealt.withColumn("_held", F.col("_fold") == 1), made, FEATURES, "y", "_held", 42, layout.weight)
    same_trees(fitted(data, {"n_estimators": 3, "max_depth": 4}),
               mllib(layout.dealt, {"n_estimators": 3, "max_depth": 4}, layout.weight))
    data.unpersist()
    layout.release()


def test_groups_of_partitions_and_gathered_sums_give_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(boosting, "ROWS_PER_FIT_PARTITION", 100)
    layout = boosting.lay_out(rows(spark), "y", "key")
    monkeypatch.setattr(trees, "GROUPS", 6)
    monkeypatch.setattr(trees, "GATHER", 2)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 30)
    data = trees.binned(layout.dealt.withColumn("_held", F.col("_fold") == 1), made, FEATURES, "y", "_held", 42, layout.weight)
    assert 2 < data.groups < layout.partitions and data.df.count() > layout.partitions
    params = {"n_estimators": 3, "max_depth": 3}
    same_trees(fitted(data, params), mllib(layout.dealt, params, layout.weight))
    data.unpersist()
    layout.release()


def test_training_keeps_no_object_per_row_and_no_row_in_memory(spark, monkeypatch):
    """The old trainer held every row as an object in storage memory and read it back with Java serialisation."""
    monkeypatch.setattr(GBTClassifier, "fit", lambda *a, **k: pytest.fail("rows as objects"))
    stored, kind = [], type(spark.range(1))
    persist = kind.persist

    def noted(df, level=StorageLevel.MEMORY_AND_DISK_DESER):
        stored.append((df.columns, level))
        return persist(df, level)

    monkeypatch.setattr(kind, "persist", noted)
    df = rows(spark)
    m = boosting.train(df, "y", "key", engineering.FittedFeatures([], FEATURES), {"n_estimators": 3, "max_depth": 3})
    assert m.trees.getNumTrees == 3 and 0 < m.performance["test_auc"] <= 1
    blocks = [level for cols, level in stored if "codes" in cols]
    assert blocks == [StorageLevel.DISK_ONLY]


def test_uniform_numbers_and_samples_are_those_of_the_jvm(spark):
    for seed in (1, -7, 42):
        jvm = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        want = [jvm.nextDouble() for _ in range(300)]
        for start, n in ((0, 300), (0, 1), (3, 250), (128, 2)):
            assert list(trees.uniform(seed, start, n, 16)) == want[start:start + n]


def test_search_equals_a_search_with_mllib_and_stores_narrow_rows_on_disk(spark, monkeypatch):
    df = rows(spark, 1500)
    f = engineering.FittedFeatures([], FEATURES)
    base = {"n_estimators": 3, "max_depth": 3}
    v = evaluate.stratified_split(boosting.spread(df.where("y is not null")), "y", "key", [1 / 3] * 3, 42, "fold").select("y", "fold", *FEATURES).persist()
    want = []
    for rate in (0.1, 0.3):
        scores = None
        for k in range(3):
            x = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(v.withColumn("label", F.col("y").cast("double")))
            model = boosting.classifier({**base, "learning_rate": rate}).fit(evaluate.add_class_weight(x.where(F.col("fold") != k), "label"))
            part = boosting.probability(model, v.where(F.col("fold") == k), FEATURES, ["y", "fold"], "p")
            scores = part if scores is None else scores.unionByName(part)
        got = evaluate.fold_summary(evaluate.binned_metrics(scores, ["fold"], "y"), []).first()
        want.append([got[f"{w}_test_{n}"] for w in ("mean", "std") for n in ("f1", "precision", "recall", "roc_auc")])
    monkeypatch.setattr(GBTClassifier, "fit", lambda *a, **k: pytest.fail("rows as objects"))
    got = boosting.grid_search(df.where("y is not null"), "y", "key", f, {}, {"learning_rate": [0.1, 0.3]}, folds=3, base=base).where("stage = 2").collect()
    assert [list(x)[2:] for x in sorted(got, key=lambda x: x["params"]["learning_rate"])] == [pytest.approx(w, abs=1e-9) for w in want]
    v.unpersist()


def test_both_fits_of_a_table_read_the_same_blocks(spark, monkeypatch):
    made_blocks, binned = [], trees.binned
    monkeypatch.setattr(trees, "binned", lambda *a, **k: made_blocks.append(binned(*a, **k)) or made_blocks[-1])
    m = automl.fit_table(rows(spark, 1200), "key", "y", params={"n_estimators": 3, "max_depth": 3}, min_cumulative=0.5, min_features=2).model
    assert len(made_blocks) == 1 and len(m.columns) < len(m.features.outputs)
    # the second fit equals one on blocks of its own columns only
    layout = boosting.lay_out(rows(spark, 1200).where("y is not null"), "y", "key")
    own = boosting.train(None, "y", "key", engineering.FittedFeatures(m.features.steps, m.features.inputs, m.features.categorical, m.features.fill, code_maps=m.features.code_maps),
                         {"n_estimators": 3, "max_depth": 3}, use=m.columns, measure=False, layout=layout)
    same_trees(m.trees, own.trees)
    layout.release()


def test_split_of_a_large_table_hashes_rows_once_and_counts_its_folds(spark, monkeypatch):
    df, parts = rows(spark), [0.2, 0.3, 0.5]
    want = sorted(map(tuple, evaluate.stratified_split(df, "y", "key", parts).select("key", "y", "a", "fold").collect()), key=str)
    monkeypatch.setattr(evaluate, "is_small", lambda x: False)
    stored, kind = [], type(df)
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda x, level: stored.append((x.columns, level)) or persist(x, level))
    counts = {}
    got = evaluate.stratified_split(df, "y", "key", parts, tally=counts, hashed_as="h")
    assert stored == [(["y", "_h"], StorageLevel.DISK_ONLY)]
    assert sorted(map(tuple, got.select("key", "y", "a", "fold").collect()), key=str) == want
    assert counts == {(x["y"], x["fold"]): x["n"] for x in got.where("y is not null").groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    assert got.where(F.col("h") != evaluate.split_hash("key")).count() == 0
