"""Substring dedup: remove every word covered by a 13-word window whose word sequence also starts in a
document with a smaller doc_id, found by recompression.

Recompression (per document, in a Python task, with names that are global without a dictionary):
level 0 is the words, each named by a 64-bit hash of its bytes. Every level first names each maximal
run of one symbol by (symbol, run length), then splits the symbols into a left and a right half by a
hash bit of the level and names every adjacent (left, right) pair by (left, right). Names are hashes
of their parts, so equal substrings get equal interior symbols in every document, on every executor,
without a shuffle.

For every block (symbol) the tasks also track the words its formation depended on: a run or a single
block depends on its neighbours (is the run maximal?), a pair on its two halves, an unpaired block on
the neighbour it might have paired with; the edge of a document is a dependency on a word outside
every window. A block is *interior* to a window when all words it depended on lie inside the window;
such a block appears with the same name and offset in every occurrence of that window.

Every window is represented by one block interior to it: the one whose name in context, a hash of all words
the block depended on, is smallest (a window without interior block represents itself by the hash of its
words). Equal windows have equal interior blocks and so the same representative name. The tasks hand on each
document's distinct representative names, about one for three words; Spark finds the smallest and largest document
of every name in one shuffle by name. Only windows whose representative occurs in two documents are verified: the
documents join their repeated names, a task sends the hashes of the windows of one representative as one row, and
the smallest document per (name, window hash), 128 bits together, decides. The texts are shuffled once: the join
with the names and the last join with the removed windows read the same exchange. Nothing else is written.
Rows of one name meet in one sorted, spillable task, at most one row (and `width` window hashes) per document.

Defined cases: a null text has no words; a document with fewer than `width` words has no window and
keeps everything; a null doc_id is neither smaller nor larger than any id, so its document neither
loses nor causes removals; rows that repeat a doc_id are not smaller than each other; repeats inside
one document do not count; an empty table gives an empty result; other input columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.llm.common import arrow_rows, gather, mix, signed

WIDTH = 13
#: Level of the symbols whose documents Spark looks up (0: words).
LEVEL = 2
P1 = np.uint64(0x9E3779B97F4A7C15)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P1_INVERSE = np.uint64(pow(int(P1), -1, 1 << 64))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Parse:
    """Blocks of one level: name, first word, end word (exclusive), dependency range [lo, hi]."""

    def __init__(self, sym: np.ndarray, start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.sym, self.start, self.end, self.lo, self.hi = sym, start, end, lo, hi

    @classmethod
    def of_words(cls, ws: list[bytes]) -> Parse:
        n = len(ws)
        sym = np.array([xxhash.xxh3_64_intdigest(w) for w in ws], dtype=np.uint64)
        idx = np.arange(n, dtype=np.int64)
        return cls(sym, idx, idx + 1, idx.copy(), idx.copy())

    def runs(self, n_words: int) -> Parse:
        """Each maximal run becomes one block named by (symbol, length); all depend on both neighbours."""
        m = len(self.sym)
        if m == 0:
            return self
        first = np.ones(m, dtype=bool)
        first[1:] = self.sym[1:] != self.sym[:-1]
        f = np.flatnonzero(first)
        last = np.append(f[1:] - 1, m - 1)
        k = (last - f + 1).astype(np.uint64)
        sym = np.where(k > 1, mix(self.sym[f] * P1 + k * P2 + np.uint64(1)), self.sym[f])
        lo = np.minimum(np.minimum.reduceat(self.lo, f), np.where(f > 0, self.lo[np.maximum(f - 1, 0)], -1))
        hi = np.maximum(np.maximum.reduceat(self.hi, f), np.where(last < m - 1, self.hi[np.minimum(last + 1, m - 1)], n_words))
        return Parse(sym, self.start[f], self.end[last], lo, hi)

    def pairs(self, level: int, n_words: int) -> Parse:
        """Each adjacent (left half, right half) pair becomes one block named by both symbols."""
        m = len(self.sym)
        if m == 0:
            return self
        left = (mix(self.sym ^ np.uint64(0xA5A5A5A5 + level)) & np.uint64(1)) == 0
        pair = np.zeros(m, dtype=bool)  # pair[i]: block i starts a pair with i + 1
        pair[:-1] = left[:-1] & ~left[1:]
        second = np.zeros(m, dtype=bool)
        second[1:] = pair[:-1]
        keep = ~second
        f = np.flatnonzero(keep)
        paired = pair[f]
        g = np.minimum(f + 1, m - 1)
        sym = np.where(paired, mix(self.sym[f] * P1 + self.sym[g] * P2 + np.uint64(2 + level)), self.sym[f])
        end = np.where(paired, self.end[g], self.end[f])
        # a pair depends on its halves, an unpaired left block on its right neighbour, an unpaired right
        # block on its left neighbour; the edge of the document is a word outside every window
        before = np.where(f > 0, self.lo[np.maximum(f - 1, 0)], -1)
        after = np.where(f < m - 1, self.hi[np.minimum(f + 1, m - 1)], n_words)
        lo = np.where(paired, np.minimum(self.lo[f], self.lo[g]), np.where(left[f], self.lo[f], np.minimum(self.lo[f], before)))
        hi = np.where(paired, np.maximum(self.hi[f], self.hi[g]), np.where(left[f], np.maximum(self.hi[f], after), self.hi[f]))
        return Parse(sym, self.start[f], end, lo, hi)


def refined(p: Parse, level: int, n_words: int) -> Parse:
    for k in range(level):
        p = p.runs(n_words).pairs(k, n_words)
    return p


def parse(ws: list[bytes], level: int) -> Parse:
    return refined(Parse.of_words(ws), level, len(ws))


def useful(p: Parse, width: int, n_words: int) -> np.ndarray:
    """Blocks that can be interior to some window: their dependencies fit in one window of the text."""
    return (p.lo >= 0) & (p.hi < n_words) & (p.hi - p.lo + 1 <= width)


def contexts(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the words lo to hi (inclusive), from prefix sums of word hashes times powers of an odd number."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(np.full(len(h), P1)))])
    back = np.cumprod(np.full(len(h), P1_INVERSE))
    return mix((sums[hi + 1] - sums[lo]) * back[lo] + (hi - lo + 1).astype(np.uint64) * P2)


def representatives(ws: list[bytes], level: int, width: int) -> np.ndarray:
    """Name of the representative of every window: the smallest of its interior blocks, or of itself without one."""
    n = len(ws) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    words_ = Parse.of_words(ws)
    p = refined(words_, level, len(ws))
    k = np.flatnonzero(useful(p, width, len(ws)))
    lo, hi = p.lo[k], p.hi[k]
    name = contexts(words_.sym, lo, hi)
    order = np.argsort(name)[::-1]  # the smallest name of a window is written last
    first = np.maximum(hi - width + 1, 0)[order]
    count = np.minimum(lo, n - 1)[order] - first + 1
    at = gather(np.arange(n), first, count)
    out, have = np.zeros(n, np.uint64), np.zeros(n, bool)
    out[at], have[at] = np.repeat(name[order], count), True
    bare = np.flatnonzero(~have)
    out[bare] = contexts(words_.sym, bare, bare + width - 1)
    return out


def _names(level: int, width: int):
    """Per row: (doc, th, name) of every distinct representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches, size=4 << 20):
            found = [np.unique(representatives(words(t), level, width)) for t in b.column(2).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(signed(np.concatenate(found)))], names=["doc", "th", "name"])

    return run


def _windows(level: int, width: int):
    """Per run of windows with one repeated representative: (name, doc, th, target, pos, hashes of the windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches, rows=1024, size=4 << 20):
            row, names, targets, pos, hashes, length = [], [], [], [], [], []
            for r, (t, below, above) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "below", "above")), strict=True)):
                ws = words(t)
                rep = representatives(ws, level, width)
                known = np.array(below + above, dtype=np.int64).view(np.uint64)
                order = np.argsort(known)
                at = np.minimum(np.searchsorted(known[order], rep), len(known) - 1)
                s = np.flatnonzero(known[order][at] == rep)
                if not len(s):
                    continue
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(s) > 1) | (rep[s][1:] != rep[s][:-1])]))
                row.append(np.full(len(cut), r))
                names.append(rep[s[cut]])
                targets.append(order[at[s[cut]]] < len(below))
                pos.append(s[cut])
                length.append(np.diff(np.append(cut, len(s))))
                hashes += window_hashes_at(ws, width, s)
            if not row:
                continue
            take = pa.array(np.concatenate(row))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(length))), pa.int32()), pa.array(signed(np.array(hashes, dtype=np.uint64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(names))), b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(targets)),
                 pa.array(np.concatenate(pos).astype(np.int32)), lists], names=["name", "doc", "th", "target", "pos", "hashes"])

    return run


def window_hashes_at(ws: list[bytes], width: int, pos: np.ndarray) -> list[int]:
    """64-bit hashes of the words of the windows, joined by one space."""
    line = memoryview(b" ".join(ws))
    end = np.cumsum([len(w) + 1 for w in ws]) - 1
    start = np.append(0, end[:-1] + 1)
    return [xxhash.xxh3_64_intdigest(line[a:b]) for a, b in zip(start[pos].tolist(), end[pos + width - 1].tolist(), strict=True)]


def kept_words(ws: list[bytes], starts: list[int], width: int) -> tuple[list[bytes], int]:
    """Words outside every removed window, and how many were removed."""
    cover = np.zeros(len(ws) + 1, dtype=np.int64)
    for s in starts:
        cover[s] += 1
        cover[min(s + width, len(ws))] -= 1
    gone = np.cumsum(cover[:len(ws)]) > 0
    return [w for w, g in zip(ws, gone) if not g], int(gone.sum())


def _final(width: int, id_col: str, text: str, starts: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches, text=text):
            ids, texts, ss = b.column(id_col).to_pylist(), b.column(text).to_pylist(), b.column(starts).to_pylist()
            n_words, n_removed, sha = [], [], []
            for t, s in zip(texts, ss):
                ws = words(t)
                kept, gone = kept_words(ws, s or [], width)
                n_words.append(len(ws))
                n_removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def rows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, th, text): a row is known by its id and a hash of its text, so repeated ids with other texts stay apart."""
    return df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
                     F.col(text).alias("text"))


def removed_starts(docs: DataFrame, width: int = WIDTH, level: int = LEVEL) -> DataFrame:
    """(doc, th, starts): first words of the windows of each of `rows` that repeat from a smaller doc; doc is not null."""
    same = Window.partitionBy("name")
    names = docs.mapInArrow(_names(level, width), "doc long, th long, name long")
    shared = names.withColumns({"lo": F.min("doc").over(same), "top": F.max("doc").over(same)}).filter("lo < top")
    smaller = F.col("lo") < F.col("doc")
    marks = shared.groupBy("doc", "th").agg(F.collect_list(F.when(smaller, F.col("name"))).alias("below"),
                                            F.collect_list(F.when(~smaller, F.col("name"))).alias("above"))
    # marks are lists that grow with a document's repeats: a shuffle join, whose exchange of the texts `report` reads again
    found = docs.join(marks, ["doc", "th"]).mapInArrow(
        _windows(level, width), "name long, doc long, th long, target boolean, pos int, hashes array<bigint>")
    each = found.repartition("name").select("name", "doc", "th", "target", "pos", F.posexplode("hashes").alias("k", "h"))
    first = F.min("doc").over(Window.partitionBy("name", "h"))
    hits = each.withColumn("first", first).filter("target and first < doc")
    return hits.groupBy("doc", "th").agg(F.collect_list(F.col("pos") + F.col("k")).alias("starts"))


def report(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, level: int = LEVEL) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every input row."""
    all_ = rows(df, id_col, text)
    docs = all_.filter("doc is not null")
    joined = docs.join(removed_starts(docs, width, level), ["doc", "th"], "left")
    alone = all_.filter("doc is null").withColumn("starts", F.lit(None).cast("array<int>"))
    made = [x.mapInArrow(_final(width, "doc", "text", "starts"), "doc_id long, n_words long, n_removed long, kept_sha256 string") for x in (joined, alone)]
    return made[0].unionByName(made[1])
