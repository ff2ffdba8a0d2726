"""Distributed isolation forest.

Missing values (NULL, NaN) take the column's exact median first. Each tree sees at most 256
rows drawn by a hash of the row key; trees are built in parallel, the finished forest
(bounded by trees x 511 nodes) is broadcast, and rows are scored where they are, with all
their columns: no join back, so NULL keys and repeated keys keep their rows. A tree's path
lengths are normalised by the average path of its own number of rows, so a table of fewer
rows than the sample, or a tree that drew fewer, is scored on its own scale.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.functions import features as ft
from ledgerwatch.operators.ordering import exact_quantiles
from ledgerwatch.session import cut_lineage, spread

TREES, SAMPLE = 100, 256


def _average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 2.0)
    c = 2.0 * (np.log(big - 1.0) + 0.5772156649015329) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, c))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> pd.DataFrame:
    """One tree as a node table; a leaf's ``value`` is its path length, an inner node's the cut."""
    nodes: list[list] = []

    def place(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([at, -1, 0.0, -1, -1])
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes[at][2] = depth + float(_average_path(len(rows)))
            return at
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = x[rows, f] < cut
        if left.all() or not left.any():
            left = x[rows, f] <= lo[f]
        nodes[at][1:3] = [f, cut]
        nodes[at][3] = place(rows[left], depth + 1)
        nodes[at][4] = place(rows[~left], depth + 1)
        return at

    place(np.arange(len(x)), 0)
    return pd.DataFrame(nodes, columns=["node", "feature", "value", "lower", "upper"])


def medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact median of every column over its present values (NaN counts as missing); 0.0 without any."""
    clean = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols])
    got = exact_quantiles(clean, {c: [0.5] for c in cols})
    return {c: (got[c][0] if got.get(c) and got[c][0] is not None else 0.0) for c in cols}


def filled(cols: list[str], fill: dict[str, float]) -> list:
    """The feature columns as doubles, missing values replaced by their medians."""
    return [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(fill.get(c, 0.0)))).alias(c) for c in cols]


def fit_forest(df: DataFrame, key: str, cols: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42,
               fill: dict[str, float] | None = None) -> list:
    """Node tables of all trees, on the driver: at most trees x (2 x sample - 1) small rows; every
    node row also carries the number of rows its tree was grown from."""
    fill = medians(df, cols) if fill is None else fill
    n = df.count()
    want = int(sample * 1.5)
    copies = max(1, min(trees, math.ceil(trees * want / max(n, 1))))
    share = min(1.0, trees * want / (max(n, 1) * copies))
    h = F.xxhash64(F.col(key), F.lit(seed))
    first = F.pmod(F.shiftright(h, 20), F.lit(trees))
    rows = (df.where(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
            .select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: F.pmod(first + j, F.lit(trees)))).alias("tree"),
                    h.alias("_h"), *filled(cols, fill)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 1_000_003 + tree)
        pdf = pdf.sort_values(["_h", *cols], kind="stable")
        order = rng.permutation(len(pdf))[:sample]
        x = pdf[cols].to_numpy(dtype=float)[np.sort(order)]
        out = _grow(x, rng, int(math.ceil(math.log2(max(len(x), 2)))))
        out.insert(0, "tree", tree)
        out["size"] = len(x)
        return out

    grown = rows.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, value double, lower int, upper int, size int")
    return grown.orderBy("tree", "node").collect()


def raw_scores(df: DataFrame, forest: list, key: str, cols: list[str], fill: dict[str, float] | None = None) -> DataFrame:
    """The rows of `df` with `raw` = 2^(-mean over trees of path / average path of the tree's rows);
    larger is more unusual. Every column is kept, so nothing is joined back."""
    frame = pd.DataFrame(forest, columns=["tree", "node", "feature", "value", "lower", "upper", "size"])
    tables = [g[["feature", "value", "lower", "upper"]].to_numpy(dtype=float) for _, g in frame.groupby("tree")]
    normal = [max(float(_average_path(int(g["size"].iloc[0]))), 1e-12) for _, g in frame.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast((tables, normal))
    fill = medians(df, cols) if fill is None else fill
    feats = [f"_iso_{i}" for i in range(len(cols))]
    width = len(df.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tabs, norms = shared.value
        for b in batches:
            x = np.column_stack([b.column(width + i).to_numpy(zero_copy_only=False) for i in range(len(feats))]) if feats else np.zeros((b.num_rows, 0))
            total = np.zeros(b.num_rows)
            row = np.arange(b.num_rows)
            for t, c in zip(tabs, norms):
                at = np.zeros(b.num_rows, dtype=int)
                while True:
                    f = t[at, 0].astype(int)
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = x[row, np.maximum(f, 0)] < t[at, 1]
                    at = np.where(inner, np.where(go_left, t[at, 2], t[at, 3]).astype(int), at)
                total += t[at, 1] / c
            raw = np.power(2.0, -total / max(len(tabs), 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(raw)], names=[*b.schema.names[:width], "raw"])

    ready = spread(df).select(*df.columns, *[c.alias(n) for c, n in zip(filled(cols, fill), feats)])
    schema = T.StructType([*df.schema.fields, T.StructField("raw", T.DoubleType())])
    return ready.mapInArrow(score, schema)


def anomaly_scores(df: DataFrame, key: str, cols: list[str], contamination: float = 0.01, trees: int = TREES, seed: int = 42) -> DataFrame:
    """The rows of `df` with anomaly_score in [0, 1] and is_anomaly. Scores are written once, because
    range and cut-off are taken over all of them."""
    fill = medians(df, cols)
    raw = cut_lineage(raw_scores(df, fit_forest(df, key, cols, trees, seed=seed, fill=fill), key, cols, fill))
    e = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    if e["lo"] is None:
        return raw.drop("raw").withColumns({"anomaly_score": F.lit(None).cast("double"), "is_anomaly": F.lit(None).cast("int")})
    cut = exact_quantiles(raw, {"raw": [1 - contamination]})["raw"][0]
    return raw.select(*df.columns, ft.min_max("raw", e["lo"], e["hi"]).alias("anomaly_score") if e["hi"] > e["lo"] else F.lit(0.0).alias("anomaly_score"),
                      ft.above("raw", cut).alias("is_anomaly"))


def add_anomaly(rows: DataFrame, key: str, cols: list[str], probability: str = "fraud_probability", contamination: float = 0.01,
                weight_model: float = 0.7, weight_anomaly: float = 0.3, seed: int = 42) -> DataFrame:
    """Scores the rows in place (they hold the features and the model's probability) and blends both."""
    a = anomaly_scores(rows, key, cols, contamination, seed=seed)
    return a.withColumn("combined_score", ft.blended(probability, "anomaly_score", weight_model, weight_anomaly))
