"""Severity of toxicity by cumulative-link (proportional odds) regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector shared by all ordered thresholds. Features are
all words of the fitted rows that LEAST labelled documents hold (counted over all labelled rows), however many they are;
their value is log(1 + count). The fit uses at most SAMPLE labelled rows, those with the smallest hash of their id,
so what reaches the driver is bounded by the words of so many rows; words of other rows only have no weight. Scoring covers every row and whole text, without a shuffle.

The labels know toxic and quality only; grade 0 is not toxic, 1 toxic, 2 toxic and of low quality. The
result carries the expected grade, and `toxic` where P(grade >= 1) reaches one half.

Defined cases: null or empty texts have no features and get the intercept's severity; labels without
toxicity, without document or with a null id do not train (several labels of one id: the highest grade); with fewer
than two grades among the labels every document gets that grade (or 0); repeated rows are scored one by one; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import arrow_rows, settled

LEAST = 2
SAMPLE = 20_000
GRADES = 3
BROADCAST_ROWS = 1_000_000
HELD = 200_000
PART = 500_000


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 30.0))


def grade(toxic: str = "toxic", quality: str = "quality"):
    return F.when(F.col(toxic) == 0, 0).when(F.col(quality) == 0, 2).otherwise(1)


def split(text: str | None) -> list[str]:
    """Lower-case words without the signs around them."""
    return [w for w in (x.strip("!?.,;:*&%$#\"'()|[]{}<>-_") for x in (text or "").lower().split()) if w]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flush():
        rows = list(counts.items())
        counts.clear()
        for k in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k:k + 50_000], strict=True)], names=["word", "n"])

    for b in arrow_rows(batches):
        for text in b.column(0).to_pylist():
            counts.update(set(split(text)))
        if len(counts) > HELD:
            yield from flush()
    yield from flush()


def vectors(texts: list[str | None], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows as (row, column, value)."""
    row, col, val = [], [], []
    for k, text in enumerate(texts):
        for j, n in Counter(index[w] for w in split(text) if w in index).items():
            row.append(k)
            col.append(j)
            val.append(n)
    return np.array(row, np.int64), np.array(col, np.int64), np.log1p(np.array(val, float))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(y: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, features: int, grades: int = GRADES,
        penalty: float = 1e-3, rounds: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a ridge by Adam steps; thresholds stay ordered through positive gaps."""
    share = np.clip(np.cumsum(np.bincount(y, minlength=grades))[:-1] / len(y), 1e-4, 1 - 1e-4)
    cut = np.log(share / (1 - share))
    z = np.concatenate([np.zeros(features), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    m, v = np.zeros_like(z), np.zeros_like(z)
    n = len(y)
    parts = [slice(k, k + PART) for k in range(0, len(row), PART)]  # no temporary array of all values
    for t in range(1, rounds + 1):
        w, gaps = z[:features], np.exp(np.clip(z[features + 1:], -10, 5))
        cuts = z[features] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.zeros(n)
        for b in parts:
            eta += np.bincount(row[b], weights=val[b] * w[col[b]], minlength=n)
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = edge[y + 1] - eta, edge[y] - eta
        p_hi, p_lo = np.where(np.isinf(hi), 1.0, sigmoid(np.where(np.isinf(hi), 0, hi))), np.where(np.isinf(lo), 0.0, sigmoid(np.where(np.isinf(lo), 0, lo)))
        p = np.maximum(p_hi - p_lo, 1e-12)
        d_hi, d_lo = p_hi * (1 - p_hi) / p, p_lo * (1 - p_lo) / p
        g_eta = d_hi - d_lo  # derivative of -log p by eta
        g_w = penalty * w
        for b in parts:
            g_w += np.bincount(col[b], weights=val[b] * g_eta[row[b]], minlength=features) / n
        g_cut = (np.bincount(y, weights=-d_hi, minlength=grades)[:-1] + np.bincount(y, weights=d_lo, minlength=grades)[1:]) / n
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([g_w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        z = z - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(np.clip(z[features + 1:], -10, 5))
    return z[:features], z[features] + np.concatenate([[0.0], np.cumsum(gaps)])


def train(labelled: DataFrame, least: int = LEAST, sample: int = SAMPLE) -> Model:
    """Model from rows (id, text, grade)."""
    rows = labelled.select("id", "text", "grade").filter("grade is not null and id is not null")
    total = rows.agg(F.sum((F.col("grade") == 0).cast("bigint")).alias("c"), F.sum((F.col("grade") > 0).cast("bigint")).alias("t")).first()
    if not total["c"] or not total["t"]:
        level = rows.agg(F.max("grade")).first()[0] or 0
        return Model(thresholds=np.array([30.0 if k >= level else -30.0 for k in range(GRADES - 1)]))
    # only hashes below a cut that about a fifth more rows than needed pass: no task sends its whole top to the driver
    cut = min(int(min(1.0, 1.2 * sample / (total["c"] + total["t"])) * 2.0**64) - (1 << 63), (1 << 63) - 1)
    chosen = settled(rows.select(F.xxhash64("id").alias("h"), F.col("grade").cast("int").alias("grade"), "text").filter(F.col("h") <= cut).orderBy("h", "grade").limit(sample).repartition(16, "h"))
    counted = lambda df: df.select("text").mapInArrow(_document_frequencies, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = sorted(r["word"] for r in counted(rows).filter(F.col("n") >= least).join(counted(chosen).select("word"), "word", "left_semi").select("word").collect())
    shared = rows.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in arrow_rows(batches):
            lists = [[x for w, n in Counter(w for w in split(t) if w in index).items() for x in (index[w], n)] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["h", "grade", "x"])

    kept = chosen.mapInArrow(reduced, "h bigint, grade int, x array<int>").select("grade", "x").toArrow().combine_chunks()
    y, x = kept.column("grade").to_numpy().astype(np.int64), kept.column("x")
    row = np.repeat(np.arange(len(y), dtype=np.int32), pc.list_value_length(x).to_numpy() // 2)
    flat = pc.list_flatten(x).to_numpy().reshape(-1, 2)
    weights, cuts = fit(y, row, flat[:, 0], np.log1p(flat[:, 1].astype(np.float32)), len(words))
    return Model(words, weights, cuts)


def expected(model: Model, texts: list[str | None], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(expected grade, P(grade >= 1)) of texts."""
    row, col, val = vectors(texts, index)
    eta = np.bincount(row, weights=val * model.weights[col], minlength=len(texts)) if len(row) else np.zeros(len(texts))
    above = 1.0 - sigmoid(model.thresholds[None, :] - eta[:, None])
    return above.sum(axis=1), above[:, 0]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_severity, p_toxic, toxic) of every row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((model, {w: k for k, w in enumerate(model.words)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_, index = shared.value
        for b in arrow_rows(batches):
            severity, p = expected(model_, b.column(1).to_pylist(), index)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(severity), pa.array(p), pa.array(p >= 0.5)],
                                             names=["doc_id", "expected_severity", "p_toxic", "toxic"])

    return narrow.mapInArrow(run, f"doc_id {kind}, expected_severity double, p_toxic double, toxic boolean")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, grade): labels broadcast up to BROADCAST_ROWS rows, joined by shuffle beyond."""
    graded = (labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(grade()).alias("grade")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(graded) if labels.count() <= BROADCAST_ROWS else graded, "id")
