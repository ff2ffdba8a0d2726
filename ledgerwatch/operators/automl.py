"""One call from a raw labelled table to a model, and one that applies it to a raw table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.operators import boosting, columns, selection, target


@dataclass
class TableModel:
    """The model, its label column in the source, and the columns that scoring reads."""

    model: boosting.FraudModel
    label: str
    reads: dict[str, str]


def encoded_label(df: DataFrame, label: str, name: str) -> DataFrame:
    """The label as 0/1 in ``name``, by the rule for its type; the source column goes."""
    kind = df.schema[label].dataType
    if isinstance(kind, T.BooleanType):
        out = df.withColumn(name, F.col(label).cast("int"))
    elif isinstance(kind, T.StringType):
        out = target.encode_text_target(df, label, name)
    else:
        out = target.encode_numeric_target(df, label, name)
    return out.drop(label)


def fit_table(df: DataFrame, key: str, label: str | None = None, params: dict | None = None, seed: int = 42,
              min_cumulative: float = 0.95, min_features: int = 10) -> TableModel:
    """Finds and encodes the label, drops rows without one and identifier columns, engineers
    features on the training rows, keeps those that carry the importance, and trains on them.

    ``key`` names a row; it is never a feature.  Performance is in ``model.performance``.
    """
    label = target.detect_target(df.drop(key)) if label is None else label
    name = "target" if "target" not in df.columns or label == "target" else f"{label}_encoded"
    rows = columns.drop_missing_label(df, label)
    rows = encoded_label(rows, label, f"_{name}").withColumnRenamed(f"_{name}", name)
    used = columns.training_columns(rows.drop(key, name))
    rows = rows.select(key, name, *used)
    layout = boosting.lay_out(rows, name, key, seed)  # both fits read the same rows in the same order
    trial = boosting.train(rows, name, key, params=params, seed=seed, measure=False, layout=layout)
    ranked = selection.intelligent(trial.importances().withColumn("dataset", F.lit(label)), min_cumulative, min_features)
    use = [r["feature"] for r in ranked.orderBy("rank").select("feature").collect()]  # at most one row per feature
    model = boosting.train(rows, name, key, trial.features, params, seed, use=use or None, layout=layout)
    layout.release()
    return TableModel(model, label, {f.name: f.dataType.simpleString() for f in rows.select(*used).schema})


def apply_table(df: DataFrame, fitted: TableModel, key: str, keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Scores a raw table: a label that leaked into it and identifiers that the model does not
    read are removed, missing columns are filled like missing values."""
    rest = df.drop(fitted.label)
    others = rest.drop(key, *fitted.reads)
    known = columns.without_ids(target.drop_leaked_target(others) if others.columns else others).columns
    wanted = [c for c in rest.columns if c in fitted.reads or c in known or c in (keep or [])]
    ready = rest.select(key, *[c for c in wanted if c != key])
    ready = ready.withColumns({c: F.lit(None).cast(kind) for c, kind in fitted.reads.items() if c not in ready.columns})
    return fitted.model.score(ready, [key, *(c for c in keep or [] if c != key)], threshold)
