"""Jaccard join of documents on word n-gram sets by a partitioned universe (pigeonhole).

A set of n-gram hashes is cut into segments by a second hash; the number of segments follows the size band.
Two sets that link differ in at most H elements, so among more than H segments some are equal in both. In
bands up to SMALL elements half as many segments are used and each also offers its one-deletion
neighbourhood: such a segment still meets if it differs by one element (weight 2 in the count). The index is the
shuffle of (signature, document) rows; a document enters its own band and, if a partner may be
larger, the next one. Empty segments are offered only by documents that need them to pass H.

Allocation by cost. A document's weight beyond H is slack. After the first round a document leaves its most
populous buckets unprobed up to half its slack and probes the others, cheapest first; since a
linked pair shares more buckets than both halves together, none is lost. Within a bucket everybody is first
compared with its smallest member only (the hub); members of one component need no further comparison, so
a group of near copies costs as many comparisons as it has members, never all pairs.

Candidates of probed buckets are compared blockwise where the bucket lies (at most BLOCK probing documents in a
task, further ones in further blocks) by a histogram of SKETCH cells, whose distance is a lower bound of the
difference of the sets; pairs above H never leave the task. The others are verified, nearest first, on the words of both texts. Links are not listed beyond what connects the
components; the result is one row per document with its class.

Defined cases: null texts and texts without words have an empty set and link with nothing; with fewer words than n
the whole sequence is the only element; equal sets link; rows that repeat an id count as one document (their
links are joined); a null id has a null component; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.llm.common import BROADCAST_ROWS, arrow_rows, bounded, fresh, mix, released, settled, signed, small_batches, smallest_reachable, window_hashes, word_hashes, words, written

WORDS = 5
#: Similarity as a fraction: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
SMALL = 128
RATIO = 1.6
SEEN_SETS = 500_000
SKETCH = 256
BLOCK = 2000
NEAREST_ROUNDS = 2


def largest_partner(n: int) -> int:
    return n * DENOMINATOR // NUMERATOR


def largest_difference(total: int) -> int:
    """Most elements in which two linked sets with together `total` elements differ."""
    return total * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


@lru_cache(maxsize=1)
def edges() -> list[int]:
    """First size of every band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


@lru_cache(maxsize=4096)
def band_of(n: int) -> int:
    return int(np.searchsorted(np.array(edges()), n, side="right")) - 1


@lru_cache(maxsize=256)
def plan(band: int) -> tuple[int, bool]:
    """(number of segments, whether they offer one-deletion neighbourhoods)."""
    top = edges()[band + 1] - 1
    most = largest_difference(2 * top)
    if top <= SMALL:
        return max(1, -(-(most + 1) // 2) + (most >= 4)), True
    return int(1.08 * (most + 1)) + 3, False


class Outline:
    """Segments of one set, prepared once for all bands."""

    def __init__(self, h: np.ndarray):
        place = np.unique(mix(h ^ np.uint64(0x5851F42D4C957F2D)))  # mix is one to one
        self.n = len(place)
        self.place = place >> np.uint64(32)
        self.value = mix(place + np.uint64(0x14057B7EF767814F))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value, dtype=np.uint64)])
        self.cuts: dict[int, tuple] = {}

    def identity(self) -> tuple[int, int]:
        """128 bits of the set."""
        second = mix(self.value ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) if self.n else 0
        return int(self.total[-1]), int(second)

    def bands(self) -> list[int]:
        own = band_of(self.n)
        return [own, own + 1] if largest_partner(self.n) >= edges()[own + 1] else [own]

    def need(self, band: int) -> int:
        return largest_difference(self.n + min(edges()[band + 1] - 1, largest_partner(self.n))) + 1

    def segments(self, band: int):
        if band not in self.cuts:
            count, _ = plan(band)
            seg = (self.place * np.uint64(count)) >> np.uint64(32)
            start = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
            self.cuts[band] = count, seg, start, np.append(start[1:], self.n)
        return self.cuts[band]

    def weight(self, band: int) -> int:
        _, _, start, end = self.segments(band)
        return int(np.minimum(end - start, 2).sum()) if plan(band)[1] else len(start)

    def signatures(self, band: int) -> np.ndarray:
        """Bit 0 tells odd from even bands; with neighbourhoods bits 1 to 7 are the segment."""
        count, seg, start, end = self.segments(band)
        deletions = plan(band)[1]
        which = seg[start]
        total = self.total[end] - self.total[start]
        if deletions:
            length = np.repeat(end - start, end - start)
            total = np.concatenate([total, np.repeat(total, end - start)[length > 1] - self.value[length > 1]])
            which = np.concatenate([which, seg[length > 1]])
        if self.weight(band) < self.need(band):  # it needs its empty segments too
            every = np.arange(count, dtype=np.uint64)
            empty = np.setdiff1d(every, seg[start])
            if deletions:
                empty = np.concatenate([empty, seg[start][end - start == 1]])
            which, total = np.concatenate([which, empty]), np.concatenate([total, np.zeros(len(empty), np.uint64)])
        out = mix(mix(total + np.uint64(0x9E3779B97F4A7C15)) + which * np.uint64(0xD1342543DE82EF95) + np.uint64(band))
        if deletions:
            out = (out & ~np.uint64(255)) | (which << np.uint64(1))
        return np.unique((out & ~np.uint64(1)) | np.uint64(band & 1))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in arrow_rows(batches, size=4 << 20):
        h, count = word_hashes(b.column(1))
        end = np.cumsum(count)
        yield b, [window_hashes(h[e - n:e], WORDS) for n, e in zip(count, end, strict=True)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, sets in _hashed(batches):
        size, low, high, band, spare, sketch = [], [], [], [], [], []
        for h in sets:
            o = Outline(h)
            a, c = o.identity()
            size.append(o.n)
            sketch.append(np.minimum(np.bincount((o.value >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH), 255).astype(np.uint8).tobytes())
            low.append(a)
            high.append(c)
            band.append(band_of(o.n) if o.n else 0)
            # half the slack of the own and of the next band; none where neighbourhoods are used
            spare.append([0 if plan(k)[1] else max(0, (o.weight(k) - o.need(k)) // 2) for k in o.bands()] if o.n else [])
        arrays = [b.column(0), pa.array(size, pa.int64()), pa.array(signed(np.array(low, np.uint64))),
                  pa.array(signed(np.array(high, np.uint64))), pa.array(band, pa.int32()), pa.array(spare, pa.list_(pa.int32())), pa.array(sketch, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "n", "low", "high", "band", "spare", "sketch"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    for b, sets in _hashed(batches):
        ids, found = b.column(0).to_numpy(zero_copy_only=False), []
        if len(seen) > SEEN_SETS:
            seen.clear()
        for k, h in enumerate(sets):
            o = Outline(h)
            same = o.identity()
            if o.n and same not in seen:  # equal sets are one class already
                seen.add(same)
                found += [(k, o.signatures(band)) for band in o.bands()]
        if found:
            docs = np.repeat(ids[[k for k, _ in found]], [len(s) for _, s in found])
            rows = pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([s for _, s in found]))), pa.array(docs, b.column(0).type)], names=["sig", "doc"])
            for at in range(0, rows.num_rows, 200_000):
                yield rows.slice(at, 200_000)


def linked(a: str | None, b: str | None) -> bool:
    """Exact test on the words themselves: words are numbered, an n-gram is its number in base of the words."""
    w, known = (words(a), words(b)), {}
    if not w[0] or not w[1]:
        return False
    ids = [np.array([known.setdefault(x, len(known)) for x in side], dtype=np.uint64) for side in w]
    if min(map(len, w)) >= WORDS and len(known) ** WORDS < 1 << 64:
        x, y = (np.unique(_numbers(side, len(known))) for side in ids)
        nx, ny, both = len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))
    else:
        x, y = ({tuple(side[k:k + WORDS]) for k in range(max(1, len(side) - WORDS + 1))} for side in w)
        nx, ny, both = len(x), len(y), len(x & y)
    return DENOMINATOR * both >= NUMERATOR * (nx + ny - both)


def _numbers(ids: np.ndarray, base: int) -> np.ndarray:
    n = len(ids) - WORDS + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        out = out * np.uint64(base) + ids[k:k + n]
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, block, side, doc, n, component, sketch) in order, probing documents (side 0) first in
    their block; yields (a, b, d) of pairs in different classes that the histograms do not exclude."""
    key, probes = None, []
    for whole in batches:
        for b in (whole.slice(k, 4096) for k in range(0, whole.num_rows, 4096)):
            sig, block, side, doc, n, cls = (b.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            cells = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(-1, SKETCH)
            cut = np.concatenate([[0], np.flatnonzero((np.diff(sig) != 0) | (np.diff(block) != 0) | (np.diff(side) != 0)) + 1, [len(sig)]])
            found = []
            for at, end in zip(cut[:-1], cut[1:], strict=True):
                here = (sig[at], block[at])
                if here != key:
                    key, probes = here, []
                part = (doc[at:end], n[at:end], cls[at:end], cells[at:end])
                if side[at] == 0:
                    probes.append(part)
                elif probes:
                    found += _compared([np.concatenate(x) for x in zip(*probes, strict=True)], part)
            if found:
                x, y, d = (np.concatenate(z) for z in zip(*found, strict=True))
                kind = b.column(3).type
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), kind), pa.array(np.maximum(x, y), kind), pa.array(d, pa.int32())], names=["a", "b", "d"])


def _compared(probes, members) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    doc, n, cls, cells = members
    for k in range(len(probes[0])):
        small, large = np.minimum(n, probes[1][k]), np.maximum(n, probes[1][k])
        at = np.flatnonzero((cls != probes[2][k]) & (NUMERATOR * large <= DENOMINATOR * small))
        if len(at):
            away = np.abs(cells[at].astype(np.int16) - probes[3][k].astype(np.int16)).sum(axis=1, dtype=np.int32)
            ok = away <= (n[at] + probes[1][k]) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
            if ok.any():
                out.append((np.full(int(ok.sum()), probes[0][k]), doc[at[ok]], away[ok]))
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, side, text) in the order of (a, b, side); yields the linked (a, b)."""
    key, sides = None, ([], [])

    def settle():
        return key is not None and any(linked(x, y) for x in sides[0] for y in sides[1])

    kind = None
    for b in arrow_rows(batches, size=4 << 20):
        kind, out = b.column(0).type, []
        for a, c, side, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if (a, c) != key:
                if settle():
                    out.append(key)
                key, sides = (a, c), ([], [])
            sides[side].append(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], kind), pa.array([y for _, y in out], kind)], names=["a", "b"])
    if settle():
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], kind), pa.array([key[1]], kind)], names=["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link; docs has (doc, text), the pairs are settled."""
    ends = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("doc"), F.lit(0).alias("side")),
                                                    F.struct(F.col("b").alias("doc"), F.lit(1).alias("side")))).alias("x")).select("x.doc", "a", "b", "x.side")
    kind = dict(docs.dtypes)["doc"]
    if 2 * pairs.count() <= BROADCAST_ROWS:
        met = docs.join(F.broadcast(ends), "doc")
    else:
        ids = settled(ends.select("doc").distinct())
        met = docs.join(bounded(ids), "doc", "left_semi").join(ends, "doc")
    met = met.select("a", "b", "side", "text")
    return settled(met.repartition("a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(released(_verify), f"a {kind}, b {kind}"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc"]
    known = written(rows.mapInArrow(released(_describe), f"doc {kind}, n bigint, low bigint, high bigint, band int, spare array<int>, sketch binary"))
    real = known.filter("doc is not null and n > 0")
    equal = real.groupBy("n", "low", "high").agg(F.min("doc").alias("rep"), F.count("*").alias("c")).filter("c > 1")
    # equal sets are one class from the start; an id with several sets joins their classes
    firsts = real.join(equal, ["n", "low", "high"], "left").select(F.col("doc").alias("node"), F.coalesce("rep", "doc").alias("rep"))
    # labels name the documents that are not the smallest of their class, so they are few and mostly broadcast
    label = settled(firsts.groupBy("node").agg(F.min("rep").alias("component"), F.max("rep").alias("other")).filter("component < node"))
    several = label.filter("component < other").select("node", F.col("component").alias("a"))
    copies = label.filter("component = other").select(F.col("node").alias("doc"))

    # the index: buckets of more than one document, each member beside the bucket's smallest; the smallest of equal sets
    # stands for them all
    texts = rows.filter("doc is not null")
    if copies.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(copies), "doc", "left_anti").select("doc", "text")
    bucket = Window.partitionBy("sig")
    index = (texts.mapInArrow(released(_index), f"sig bigint, doc {kind}")
             .withColumns({"hub": F.min("doc").over(bucket), "c": F.count("*").over(bucket)})
             .filter("c > 1 and doc <> hub"))
    shared = written(index.select("sig", "doc", "hub", F.col("c").cast("int").alias("c")))
    odd = (F.col("sig") % 2 != 0).cast("int")
    met = settled(shared.groupBy("doc", "hub").agg(F.sum(1 - odd).alias("even"), F.sum(odd).alias("odd")))

    # first round: everybody against the hub that it meets most often
    label = label.filter("component < node").select("node", "component")
    if not several.isEmpty():
        label = _relabelled(label, settled(firsts.join(several, "node").select("a", F.col("rep").alias("b")).filter("a <> b")))
        label = settled(label.distinct())  # an id with several sets may name the class of one of them
    best = met.groupBy("doc").agg(F.max(F.struct((F.col("even") + F.col("odd")).alias("k"), (-F.col("hub")).alias("h"), "hub"))["hub"].alias("hub"))
    apart = settled(_with_labels(best, label).filter("ca <> cb").select(F.col("doc").alias("a"), F.col("hub").alias("b")))
    label = _merged(label, verified(texts, apart))

    # later: documents that still meet other classes in more buckets than they may leave unprobed
    one = real.groupBy("doc").agg(F.min("band").alias("band"), F.min(F.get("spare", F.lit(0))).alias("own"),
                                  F.min(F.coalesce(F.get("spare", F.lit(1)), F.lit(0))).alias("next"))
    allowed = one.select("doc", F.explode(F.array(
        F.struct((F.col("band") % 2 != 0).alias("odd"), F.col("own").alias("spare")),
        F.struct((F.col("band") % 2 == 0).alias("odd"), F.col("next").alias("spare")))).alias("x")).select("doc", "x.*")
    loud = _with_labels(met, label).filter("ca <> cb").groupBy("doc").agg(F.sum("even").alias("even"), F.sum("odd").alias("odd"))
    loud = loud.select("doc", F.explode(F.array(*(F.struct(F.lit(c == "odd").alias("odd"), F.col(c).alias("loud")) for c in ("even", "odd")))).alias("x")).select("doc", "x.*")
    open_ = settled(loud.join(allowed, ["doc", "odd"]).filter("loud > spare"))
    if not open_.isEmpty():
        near = written(_probed(shared, open_, real, label))
        for turn in range(NEAREST_ROUNDS + 1):
            left = _with_labels(near.withColumnsRenamed({"a": "doc", "b": "hub"}), label).filter("ca <> cb").select(F.col("doc").alias("a"), F.col("hub").alias("b"), "d")
            if turn < NEAREST_ROUNDS:  # the nearest candidate of each document joins most classes; the last round takes all that is left
                left = left.groupBy("a").agg(F.min(F.struct("d", "b"))["b"].alias("b"))
            left = settled(left.select("a", "b"))
            if left.isEmpty():
                break
            label = _merged(label, verified(texts, left))
    out = known.join(label.withColumnRenamed("node", "doc"), "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _with_labels(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (doc, hub, ...) with the classes ca and cb of both."""
    label = bounded(label)
    a = label.select(F.col("node").alias("doc"), F.col("component").alias("ca"))
    b = label.select(F.col("node").alias("hub"), F.col("component").alias("cb"))
    return pairs.join(a, "doc", "left").join(b, "hub", "left").withColumns({"ca": F.coalesce("ca", "doc"), "cb": F.coalesce("cb", "hub")})


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the links (a, b): components of the classes that they join."""
    met = _with_labels(links.select(F.col("a").alias("doc"), F.col("b").alias("hub")), label)
    return _relabelled(label, settled(met.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))))


def _relabelled(label: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labels after the classes (a, b) of every settled pair became one."""
    if pairs.isEmpty():
        return label
    found = settled(smallest_reachable(pairs).filter("a <> c"))
    old = label.join(bounded(found).select(F.col("a").alias("component"), F.col("c").alias("to")), "component", "left")
    return settled(old.select("node", F.coalesce("to", "component").alias("component")).union(found.select("a", "c")))


def _probed(shared: DataFrame, open_: DataFrame, real: DataFrame, label: DataFrame) -> DataFrame:
    """Candidate pairs (a, b, d) of open documents from the buckets that they have to probe, cheapest first."""
    mine = shared.withColumn("odd", F.col("sig") % 2 != 0).join(bounded(open_), ["doc", "odd"])
    mine = _with_labels(mine, label).filter("ca <> cb")
    order = F.row_number().over(Window.partitionBy("doc", "odd").orderBy("c", "sig"))
    probes = settled(mine.withColumn("r", order).filter(F.col("r") <= F.col("loud") - F.col("spare")).select("sig", "doc", "hub"))
    sigs = settled(probes.groupBy("sig").agg(F.first("hub").alias("hub"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    members = (shared.select("sig", "doc").join(bounded(sigs.select("sig", "blocks")), "sig")
               .union(sigs.select("sig", F.col("hub").alias("doc"), "blocks")).select("sig", each, F.lit(1).alias("side"), "doc"))
    asking = (probes.join(bounded(sigs.select("sig", "blocks")), "sig")
              .select("sig", F.pmod(F.hash("doc"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "doc"))
    facts = (real.select("doc", "n", "sketch").distinct().join(bounded(label).withColumnRenamed("node", "doc"), "doc", "left")
             .withColumn("component", F.coalesce("component", "doc")))
    rows = members.union(asking).join(facts, "doc").select("sig", "block", "side", "doc", "n", "component", "sketch")
    kind = dict(shared.dtypes)["doc"]
    met = rows.repartition("sig", "block").sortWithinPartitions("sig", "block", "side").mapInArrow(released(_near), f"a {kind}, b {kind}, d int")
    return met.groupBy("a", "b").agg(F.min("d").alias("d"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with the smallest id of each class only; rows without id stay."""
    i = fresh(docs, "id")
    drop = classes(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(i)).distinct()
    return docs.join(drop, docs[id_col] == drop[i], "left_anti")
