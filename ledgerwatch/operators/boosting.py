"""Class-weighted boosted trees: training, search, evaluation, saving, scoring."""

from __future__ import annotations

import json
from itertools import product
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions import features as ft
from ledgerwatch.operators import engineering, evaluate, trees
from ledgerwatch.operators.columns import align
from ledgerwatch.session import is_small, spread

# Default parameters and the tree parameter each one sets here.
# L1/L2 penalties have no counterpart in these trees and are not offered.
DEFAULTS = {"max_depth": 6, "learning_rate": 0.1, "n_estimators": 300, "subsample": 0.8, "colsample_bytree": 0.8,
            "gamma": 0.3, "min_child_weight": 5}

#: Training rows per partition of the fit. The trees sample rows by partition and position, so the
#: layout is a function of the counted training rows alone: rows dealt by a hash of their key into
#: ceil(rows / ROWS_PER_FIT_PARTITION) partitions, ordered by that hash and key. The same rows give the
#: same trees whatever the partitioning of the input, and the partitions grow with the rows.
ROWS_PER_FIT_PARTITION = 65_536


def fit_partitions(n_rows: int) -> int:
    """Partitions of a fit over so many training rows (at least one)."""
    return max(1, -(-int(n_rows) // ROWS_PER_FIT_PARTITION))


def classifier(params: dict | None = None, seed: int = 42, validation: str | None = None) -> GBTClassifier:
    """Row weights already scale the impurity, so gamma becomes a small minimum gain."""
    p = {**DEFAULTS, **(params or {})}
    c = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=int(p["max_depth"]), stepSize=float(p["learning_rate"]),
                      maxIter=int(p["n_estimators"]), subsamplingRate=float(p["subsample"]), minInstancesPerNode=int(p["min_child_weight"]),
                      minInfoGain=float(p["gamma"]) / 1000, featureSubsetStrategy=str(float(p["colsample_bytree"])), seed=seed)
    return c.setValidationIndicatorCol(validation) if validation else c


def probability(fitted: GBTClassificationModel, rows: DataFrame, columns: list[str], keep: list[str], name: str) -> DataFrame:
    """``keep`` columns and the probability of the positive class."""
    v = rows.withColumn("features", array_to_vector(F.array(*columns)))
    return fitted.transform(v).select(*keep, vector_to_array("probability")[1].alias(name))


@dataclass
class FraudModel:
    """Fitted features + trees + the numbers measured on the held-out rows."""

    features: engineering.FittedFeatures
    trees: GBTClassificationModel
    columns: list[str]
    performance: dict = field(default_factory=dict)

    def probabilities(self, df: DataFrame, keep: list[str], name: str = "fraud_probability") -> DataFrame:
        x = align(self.features.transform(spread(df), keep), self.columns, keep)
        return probability(self.trees, x, self.columns, keep, name)

    def score(self, df: DataFrame, keep: list[str], threshold: float = 0.5) -> DataFrame:
        """Ids, probability, 0/1 decision and risk level."""
        p = self.probabilities(df, keep)
        return p.withColumns({"fraud_prediction": ft.predicted("fraud_probability", threshold), "risk_level": ft.risk_level("fraud_probability")})

    def importances(self) -> DataFrame:
        """(dataset, feature, importance) of the trees; as many rows as features."""
        spark = SparkSession.active()
        rows = [("model", c, float(v)) for c, v in zip(self.columns, self.trees.featureImportances.toArray())]
        return spark.createDataFrame(rows, "dataset string, feature string, importance double")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.features.save(spark, f"{path}/features")
        self.trees.write().overwrite().save(f"{path}/trees")
        doc = json.dumps({"columns": self.columns, "performance": self.performance})
        spark.createDataFrame([(doc,)], "value string").write.mode("overwrite").text(f"{path}/performance")

    @staticmethod
    def load(path: str) -> "FraudModel":
        spark = SparkSession.active()
        doc = json.loads(spark.read.text(f"{path}/performance").first()["value"])
        return FraudModel(engineering.FittedFeatures.load(spark, f"{path}/features"), GBTClassificationModel.load(f"{path}/trees"), **doc)


@dataclass
class Layout:
    """A labelled table split into folds, with its training rows dealt and ordered for the trees.

    ``dealt`` holds the columns of the table, not the features made of them: a row takes a fraction of the
    width of its feature vector in the shuffle, in the sort and on disk. Several fits may share it.
    """

    split: DataFrame
    dealt: DataFrame
    weight: float
    partitions: int
    small: bool
    held: list = field(default_factory=list)
    blocks: tuple[engineering.FittedFeatures, list[str], trees.Binned] | None = None

    def release(self) -> None:
        for d in self.held:
            d.unpersist()

    def binned(self, features: engineering.FittedFeatures, columns: list[str], label: str, key: str, seed: int) -> trees.Binned:
        """The rows as blocks of ``columns``: those of all features are made once and read by every fit on these features."""
        names = [*features.outputs, *(c for c in columns if c not in features.outputs)]

        def made(rows: DataFrame, keep: list[str]) -> DataFrame:
            return align(features.transform(rows, keep), names, keep)

        if self.blocks is None or self.blocks[0] is not features or self.blocks[1] != names:
            held = (F.col("_fold") == 1).alias("_held")
            if features.by_row:
                data = trees.binned(self.dealt.withColumn("_held", held), made, names, label, "_held", seed, self.weight)
            else:  # features that come by a join move rows, so these are dealt after it
                joined = made(self.split.where("_fold > 0"), [key, label, "_fold"]).select(key, label, held, *names)
                joined = dealt_rows(joined, key, seed, self.partitions).persist(StorageLevel.DISK_ONLY)
                data = trees.binned(joined, lambda rows, keep: rows.select(*keep, *names), names, label, "_held", seed, self.weight)
                self.held.append(joined)
            self.held.append(data)
            self.blocks = (features, names, data)
        at = {c: i for i, c in enumerate(names)}
        return self.blocks[2].of([at[c] for c in columns])


def lay_out(df: DataFrame, label: str, key: str, seed: int = 42, test: float = 0.2, validation: float = 0.15,
            unread: list[str] | None = None) -> Layout:
    """Split 80/20 per class, hold out part of the training rows for early stopping, deal the training rows.
    Columns ``unread`` are left out of the dealt rows."""
    df = df.where(F.col(label).isNotNull())
    small = is_small(df)
    base = spread(df).persist() if small else df  # small inputs are read several times below
    counts: dict[tuple, int] = {}
    split = evaluate.stratified_split(base, label, key, [test, (1 - test) * validation, (1 - test) * (1 - validation)], seed, "_fold", counts, "_h")
    split = split.persist() if small else split
    fit = F.col("_fold") > 0
    rows, neg, pos = (sum(n for (y, fold), n in counts.items() if fold and wanted(y)) for wanted in (lambda y: True, lambda y: y == 0, lambda y: y == 1))
    # row sampling of the trees follows partitions and their order: both are fixed by the key and the row count
    n = fit_partitions(rows)
    rows = split.where(fit).drop(*[c for c in unread or [] if c not in (label, key)])
    split = split.drop("_h")
    dealt = dealt_rows(rows, key, seed, n).persist(StorageLevel.MEMORY_AND_DISK if small else StorageLevel.DISK_ONLY)
    return Layout(split, dealt, neg / max(pos, 1), n, small, [dealt] + ([base, split] if small else []))


def dealt_rows(rows: DataFrame, key: str, seed: int, partitions: int) -> DataFrame:
    """Rows dealt by the hash of their key, which ``_h`` holds if there is such a column."""
    rows = rows if "_h" in rows.columns else rows.withColumn("_h", evaluate.split_hash(key, seed))
    return rows.repartition(partitions, "_h").sortWithinPartitions("_h", key).drop("_h")


def train(df: DataFrame, label: str, key: str, features: engineering.FittedFeatures | None = None, params: dict | None = None,
          seed: int = 42, test: float = 0.2, validation: float = 0.15, use: list[str] | None = None, measure: bool = True,
          roles: dict[str, list[str]] | None = None, layout: Layout | None = None) -> FraudModel:
    """Split 80/20 per class, hold out part of the training rows for early stopping, fit
    features on training rows only, then measure on the test rows. ``layout`` is the table
    already split and dealt by `lay_out` with the same label, key, seed and shares."""
    own = layout is None
    if own:
        named = [c for k, cs in (roles or {}).items() if k != "id" for c in cs]
        unread = [c for c in (roles or {}).get("id", []) if c not in named] if features is None else None
        layout = lay_out(df, label, key, seed, test, validation, unread)
    split, dealt = layout.split, layout.dealt
    features = engineering.fit_rules(dealt.drop(key, "_fold"), label, roles) if features is None else features
    columns = use or features.outputs

    data = layout.binned(features, columns, label, key, seed)
    est = classifier(params, seed)
    grown = trees.grow(data, est, validate=True)
    model = FraudModel(features, trees.model(data, est, grown), columns)
    if measure:
        t = align(features.transform(split.where("_fold = 0"), [label]), columns, [label])
        t = probability(model.trees, t, columns, [label], "p")
        t = t.withColumn("pred", ft.predicted("p")).persist(StorageLevel.MEMORY_AND_DISK if layout.small else StorageLevel.DISK_ONLY)
        c = evaluate.confusion(t, label, "pred").first().asDict()
        m = evaluate.ranking_metrics(t, label, "p").first()
        t.unpersist()
        # rows of the other folds are scored from their blocks
        a = evaluate.count_metrics(trees.score_counts(data, [grown], evaluate.SCORE_BINS), ["config"]).first()
        model.performance = {**c, "train_f1": a["f1"], "test_f1": c["f1"], "test_auc": m["roc_auc"], "avg_precision": m["average_precision"],
                             "n_features": len(columns), "n_trees": len(grown)}
    if own:
        layout.release()
    return model


def fold_counts(v: DataFrame, make, columns: list[str], label: str, configs: list[dict], folds: int, seed: int) -> tuple[DataFrame, list[trees.Binned]]:
    """(config, fold, _bin, _pos, _neg): every configuration fitted on all folds but one, with class weights counted
    on those training folds only, and scored on the fold left out. The rows are binned once per fold left out, for all
    configurations. Fits are eager; the scoring of all of them is one lazy union over the blocks, which are returned too."""
    out, blocks = None, []
    for k in range(folds):
        data = trees.binned(v.withColumn("_held", F.col("fold") == k), make, columns, label, "_held", seed)
        grown = [trees.grow(data, classifier(cfg, seed), validate=False) for cfg in configs]
        part = trees.score_counts(data, grown, evaluate.SCORE_BINS, held=True).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
        blocks.append(data)
    return out, blocks


def grid_search(df: DataFrame, label: str, key: str, features: engineering.FittedFeatures, stage1: dict[str, list], around: dict[str, list],
                folds: int = 5, sample: float = 0.35, base: dict | None = None, seed: int = 42) -> DataFrame:
    """Two-stage search with stratified folds.

    Stage one tries the given grid on a stratified sample; stage two varies the winner (best mean F1 of
    the positive class) with ``around`` on all rows. Every fold of every configuration is scored into one
    table, and F1, precision, recall and ROC-AUC of all of them come from one binned count of it. One row
    per configuration: stage, params, mean and deviation over folds of each metric.
    """
    columns = features.outputs
    names = ("f1", "precision", "recall", "roc_auc")

    def run(rows: DataFrame, grid: dict[str, list], start: dict, stage: int):
        folded = evaluate.stratified_split(spread(rows), label, key, [1 / folds] * folds, seed, "fold")
        # rows without a label are in no fold
        v = align(features.transform(folded.where(F.col("fold").isNotNull()), [label, "fold"]), columns, [label, "fold"]).persist(StorageLevel.DISK_ONLY)
        keys = list(grid)
        configs = [{**start, **dict(zip(keys, values))} for values in product(*[grid[k] for k in keys])] or [dict(start)]
        counts, blocks = fold_counts(v, lambda x, keep: x.select(*keep, *columns), columns, label, configs, folds, seed)
        metrics = evaluate.count_metrics(counts, ["config", "fold"])
        got = {r["config"]: r for r in evaluate.fold_summary(metrics, ["config"], names).collect()}
        for data in [v, *blocks]:
            data.unpersist()
        return [(stage, {k: float(val) for k, val in cfg.items()}, *[got[i][f"{w}_test_{n}"] if i in got else None
                                                                      for w in ("mean", "std") for n in names])
                for i, cfg in enumerate(configs)]

    start = {k: float(v) for k, v in {**DEFAULTS, **(base or {})}.items()}
    first = run(evaluate.stratified_sample(df, label, key, sample, seed), stage1, start, 1)
    best = max(first, key=lambda x: -1.0 if x[2] is None else x[2])[1]
    second = run(df, around, best, 2)
    schema = "stage int, params map<string,double>, " + ", ".join(f"{w}_test_{n} double" for w in ("mean", "std") for n in names)
    return df.sparkSession.createDataFrame(first + second, schema)


def ensemble_scores(df: DataFrame, keep: list[str], models: list[tuple[FraudModel, float]], threshold: float = 0.5) -> DataFrame:
    """Weighted mean of several models, variance and stability.

    Each model adds one column to the same rows, so no join is needed.
    """
    base, ps = {c: f"_b_{c}" for c in df.columns}, []
    out = spread(df)
    for i, (m, _) in enumerate(models):
        out = out.withColumns({b: F.col(c) for c, b in base.items()})
        out = m.probabilities(out, [*base.values(), *ps], f"_p{i}").withColumnsRenamed({b: c for c, b in base.items()})
        ps.append(f"_p{i}")
    e = ft.ensemble(ps, [w for _, w in models])
    scored = out.select(*keep, *[v.alias(k) for k, v in e.items()])
    return scored.withColumns({"fraud_prediction": ft.predicted("fraud_probability", threshold), "risk_level": ft.risk_level("fraud_probability")})


def save_ensemble(path: str, models: list[tuple[str, FraudModel, float]]) -> DataFrame:
    """Writes every base model and a manifest (name, similarity, weight)."""
    spark = SparkSession.active()
    total = sum(w for _, _, w in models)
    for name, m, _ in models:
        m.save(f"{path}/models/{name}")
    manifest = spark.createDataFrame([(n, float(w), float(w / total), m.performance.get("test_f1")) for n, m, w in models],
                                     "model_name string, similarity double, weight double, test_f1 double")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def load_ensemble(path: str) -> list[tuple[FraudModel, float]]:
    spark = SparkSession.active()
    rows = spark.read.schema("model_name string, similarity double, weight double, test_f1 double").json(f"{path}/manifest").orderBy(F.desc("similarity"), "model_name").collect()
    return [(FraudModel.load(f"{path}/models/{x['model_name']}"), x["similarity"]) for x in rows]
