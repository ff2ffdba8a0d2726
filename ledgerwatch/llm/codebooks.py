"""Vector code compression: product-quantisation codebooks trained by integer k-means rounds, with the
nearest entry found through memoised grid cells.

Every valid entry x becomes floor(scale * x); a vector is cut into `parts` consecutive parts (part p
holds positions p * d // parts up to (p + 1) * d // parts). The codebook of each part position starts
as that part of the `entries` rows with the smallest vec_id. Each round assigns every part to its
nearest entry (squared distance, ties to the lower index) and moves each used entry to the
componentwise floor(sum / count) of its parts; unused entries stay. A final pass assigns again.

Assignment (the named method): the part's coarse grid cell (floor of every component by `cell`) is a
box; for each entry the smallest and largest squared distance to that box are known, and only entries
whose smallest distance does not exceed the smallest largest distance can be nearest for any point of
the box. That candidate list is memoised per cell within a task and round, and only those candidates
are evaluated exactly. The result is exact whatever the cell size; the cell only trades memo hits
against candidates.

Spark does the rounds: the table is settled once in the shared checkpoint folder, each round is one
pass in which every task adds its parts per (part, entry) before the shuffle (at most parts * entries
* (width + 1) rows per task), and only the codebook (parts * entries * width integers) reaches the
driver. Label totals are a grouped sum joined back (broadcast only below a counted bound).

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped; shorter
vectors are padded with zero entries up to the longest; rows with a null vec_id take part and sort
after all ids when the first entries are chosen, equal ids by their vector; with fewer valid rows than
`entries` the codebooks have as many entries as rows; an empty table gives an empty result; labels
that are null form one group; other input columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import bounded, fresh, settled
from ledgerwatch.llm.whitening import finite_vector, integers

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Width of a grid cell in integer units of every component.
CELL = 512
#: Cells whose candidate lists a task remembers before it starts anew.
MEMO = 200_000
#: Components of larger magnitude are compared in Python integers (exact beyond int64 products).
SAFE = 1 << 28


def bounds(d: int, parts: int) -> list[tuple[int, int]]:
    return [(p * d // parts, (p + 1) * d // parts) for p in range(parts)]


class Assigner:
    """Nearest entry of every part, through candidate lists memoised by grid cell."""

    def __init__(self, book: list[np.ndarray], cell: int):
        self.book, self.cell = book, cell
        self.memo: list[dict[bytes, np.ndarray]] = [{} for _ in book]
        self.evaluated = 0  # exact distance evaluations, for tests

    def candidates(self, p: int, cells: np.ndarray) -> np.ndarray:
        """(cells, entries) mask of entries that can be nearest somewhere in each cell's box."""
        memo, c = self.memo[p], self.book[p]
        if len(memo) > MEMO:
            memo.clear()
        keys = [row.tobytes() for row in cells]
        new = [i for i, k in enumerate(keys) if k not in memo]
        if new:
            lo = cells[new] * self.cell
            hi = lo + (self.cell - 1)
            below = np.maximum(lo[:, None, :] - c[None, :, :], 0)
            above = np.maximum(c[None, :, :] - hi[:, None, :], 0)
            near = ((below + above).astype(object if self.wide else np.int64) ** 2).sum(axis=2)
            far = np.maximum((c[None, :, :] - lo[:, None, :]).astype(object if self.wide else np.int64) ** 2,
                             (c[None, :, :] - hi[:, None, :]).astype(object if self.wide else np.int64) ** 2).sum(axis=2)
            keep = near <= far.min(axis=1, keepdims=True)
            for j, i in enumerate(new):
                memo[keys[i]] = keep[j]
        return np.array([memo[k] for k in keys]).reshape(len(keys), len(c))

    def nearest(self, p: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry for every row of v; ties to the lower index."""
        c = self.book[p]
        if len(v) == 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.wide = bool(np.abs(v).max(initial=0) >= SAFE or np.abs(c).max(initial=0) >= SAFE)
        cells, inverse = np.unique(np.floor_divide(v, self.cell), axis=0, return_inverse=True)
        mask = self.candidates(p, cells)[inverse.reshape(-1)]
        rows, ents = np.nonzero(mask)
        self.evaluated += len(rows)
        diff = v[rows] - c[ents]
        dist = (diff.astype(object) ** 2).sum(axis=1) if self.wide else (diff * diff).sum(axis=1)
        best = np.full(len(v), None if self.wide else np.iinfo(np.int64).max, dtype=object if self.wide else np.int64)
        index = np.zeros(len(v), dtype=np.int64)
        # candidates come row by row in entry order, so the first minimum is the lower index
        order = np.lexsort((ents, dist.astype(float) if self.wide else dist, rows)) if not self.wide else None
        if order is None:
            for r, e, dd in zip(rows, ents, dist):
                if best[r] is None or dd < best[r]:
                    best[r], index[r] = dd, e
        else:
            r_sorted = rows[order]
            first = np.ones(len(order), dtype=bool)
            first[1:] = r_sorted[1:] != r_sorted[:-1]
            pick = order[first]
            index[rows[pick]] = ents[pick]
            best[rows[pick]] = dist[pick]
        return index, best


def _matrix(b: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return np.asarray(b.column(b.schema.get_field_index(name)).flatten(), dtype=np.int64).reshape(b.num_rows, d)


def _round(book: list[np.ndarray], d: int, parts: int, cell: int, q: str):
    """One training pass: per task, (p, e, j, v) sums of assigned parts (j = -1: their count)."""
    cuts = bounds(d, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Assigner(book, cell)
        sums = [np.zeros(c.shape, dtype=object) for c in book]
        counts = [np.zeros(len(c), dtype=np.int64) for c in book]
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b, q, d)
            for p, (s, e) in enumerate(cuts):
                idx, _ = a.nearest(p, m[:, s:e])
                counts[p] += np.bincount(idx, minlength=len(book[p]))
                for k in np.unique(idx):
                    sums[p][k] += m[idx == k, s:e].astype(object).sum(axis=0) if e > s else 0
        out = {"p": [], "e": [], "j": [], "v": []}
        for p in range(len(book)):
            for k in range(len(book[p])):
                if counts[p][k]:
                    for j in range(-1, book[p].shape[1]):
                        out["p"].append(p)
                        out["e"].append(k)
                        out["j"].append(j)
                        out["v"].append(int(counts[p][k]) if j < 0 else int(sums[p][k][j]))
        if out["p"]:
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("p", pa.int32()), ("e", pa.int32()), ("j", pa.int32()),
                                                                     ("v", pa.decimal128(38, 0))]))

    return run


def _final(book: list[np.ndarray], d: int, parts: int, cell: int, q: str, keep: list[str]):
    """Last pass: code and error of every row, other columns passed through."""
    cuts = bounds(d, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Assigner(book, cell)
        for b in batches:
            m = _matrix(b, q, d)
            codes = np.zeros((b.num_rows, len(cuts)), dtype=np.int64)
            error = np.zeros(b.num_rows, dtype=object)
            for p, (s, e) in enumerate(cuts):
                codes[:, p], dist = a.nearest(p, m[:, s:e])
                error = error + dist.astype(object)
            code = ["".join(f"{int(k):02x}" for k in row) for row in codes]
            cols = [b.column(b.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(code, pa.string()), pa.array([int(x) for x in error], pa.int64())],
                                             names=[*keep, "code", "error"])

    return run


def book_text(book: list[np.ndarray]) -> str:
    """All entries' integer components by part, entry, position, joined by commas."""
    return ",".join(str(int(v)) for c in book for row in c for v in row)


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
             scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             cell: int = CELL) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows with vec_id, label, code, error; final codebooks). See the module text for defined cases."""
    spark = df.sparkSession
    q, i, lab = fresh(df, "q"), fresh(df, "id"), fresh(df, "label")
    has_label = label in df.columns
    rows = (df.select(F.col(id_col).cast("long").alias(i),
                      (F.col(label) if has_label else F.lit(None)).cast("long").alias(lab), F.col(vector).alias(q))
            .filter(finite_vector(F.col(q))).select(i, lab, integers(F.col(q), scale).alias(q)))
    d = rows.agg(F.max(F.size(q))).first()[0]
    empty = spark.createDataFrame([], f"vec_id long, label long, code string, error long")
    if d is None:
        return empty, []
    rows = settled(rows.select(i, lab, F.concat(q, F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(q))).alias(q)))
    first = rows.orderBy(F.col(i).asc_nulls_last(), F.col(q)).limit(entries).select(q).collect()
    start = np.array([r[0] for r in first], dtype=np.int64).reshape(len(first), d)
    book = [start[:, s:e].copy() for s, e in bounds(d, parts)]
    for _ in range(rounds):
        sums = (rows.select(q).mapInArrow(_round(book, d, parts, cell, q), "p int, e int, j int, v decimal(38,0)")
                .groupBy("p", "e", "j").agg(F.sum("v").alias("v")).collect())
        acc: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums:
            acc.setdefault((r["p"], r["e"]), {})[r["j"]] = int(r["v"])
        for (p, e), got in acc.items():
            n = got[-1]
            book[p][e] = [got[j] // n for j in range(book[p].shape[1])]
    out = rows.mapInArrow(_final(book, d, parts, cell, q, [i, lab]), f"{i} long, {lab} long, code string, error long")
    return out.withColumnRenamed(i, "vec_id").withColumnRenamed(lab, "label"), book


def codes(df: DataFrame, **kw) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every valid row."""
    out, book = compress(df, **kw)
    digest = hashlib.sha256(book_text(book).encode()).hexdigest()
    out = settled(out)
    totals = out.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = out.join(bounded(totals).withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l")), "left")
    return joined.select("vec_id", "code", "error", F.col("label_error").cast("long").alias("label_error"),
                         F.lit(digest).alias("codebooks_sha256"))
