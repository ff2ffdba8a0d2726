"""Language-model scoring by a probabilistic suffix tree over words.

Symbols are words and one end per text. Level 1 holds the contexts of one word, level k those of k words. A
context is a candidate if it occurs LEAST times in training; it becomes a state if its
next-symbol distribution diverges from that of its suffix by DIVERGENCE (mean log10 ratio) or if a longer state needs it as
suffix. A state keeps the next symbols that follow it LEAST times, discounted by DISCOUNT; the
mass left goes to its suffix's distribution in proportion, the root being the add-half unigram model with
one unknown word, so every state's distribution sums to one. A token is scored in the longest state that
ends before it. LEAST is a count, not a share: the model of a text does not depend on the size of the corpus around it,
and states and entries grow with the corpus.

All counts are Spark aggregations over the whole training text. Up to ARRAY_TOKENS training tokens (so at most half as
many entries a level) the tree is arrays that are broadcast. Beyond, contexts and entries are Spark tables keyed by
64 bits of hash: divergence is a grouped aggregate, and the score of a text is the sum of the weights of its grams (see
_weights). Longer grams are counted, and grams of a text looked up, only where a bit sketch of the kept ones has their bit; the
sketch lets grams through in vain, more of them as it fills, and never holds one back. The weights of the most frequent
grams (at most HOT) are broadcast; a document sends one row per other gram that it has, in PASSES passes, each with its
share of the hashes. Tables and shuffle files are freed as soon as they are read no more.

Defined cases: null and empty texts consist of the end only; words are told apart by 64 bits of hash; without
training rows every count is 0; rows that repeat id and text repeat their scores; a null id is
counted as id '' for the split; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerwatch.llm.common import arrow_rows, emptied, freed_shuffles, mix, signed, written

DEPTH = 2
LEAST = 2
#: Training tokens up to which the tree is held as arrays.
ARRAY_TOKENS = 1_000_000
#: Weights of grams that are broadcast (25 bytes each).
HOT = 500_000
#: Bits of the largest sketch (16 MB).
MOST_BITS = 1 << 27
#: Bytes of text whose grams a task combines at a time.
CHUNK = 16 << 20
#: Passes over the texts that score them, each with the grams of its share of the hashes; shuffle files of a pass are freed before the next.
PASSES = 3
DIVERGENCE = 0.02
DISCOUNT = 0.5
END = np.uint64(0x9D5C3B1F7A2E4680)
HELD = 1_500_000


@dataclass
class Level:
    """Contexts of one length: `keys` are (context one level below, last word), sorted."""
    keys: np.ndarray
    count: np.ndarray
    suffix: np.ndarray
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    log_p: np.ndarray = field(default_factory=lambda: np.zeros(0))
    log_rest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    state: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


@dataclass
class Tree:
    """head: sorted hashes of the words seen LEAST times with their counts; levels of contexts. A tree of tables has
    no head and a table of weights (g, n, known, base, best)."""
    head: np.ndarray
    count: np.ndarray
    tokens: int
    distinct: int
    levels: list[Level] = field(default_factory=list)
    weights: DataFrame | None = None
    depth: int = 0

    def root(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))


def find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions in a sorted table, -1 where absent."""
    if not len(table) or not len(x):
        return np.full(len(x), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to CHUNK bytes of text, so that a task combines what its rows repeat."""
    held, total = [], 0
    for b in arrow_rows(batches, rows=1 << 20, size=CHUNK):
        size = pc.sum(pc.binary_length(b.column(b.schema.get_field_index("text")))).as_py() or 0
        if held and total + size > CHUNK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
        held.append(b)
        total += size
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _laid(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, hashes, length): the symbols of the texts laid end to end as positions in `hashes`, and how many each text has."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pieces.flatten().dictionary_encode()
    hashes = np.append(pd.util.hash_array(flat.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False), END)
    real = np.asarray(pc.binary_length(flat.dictionary)) > 0  # space at the ends of a text splits off empty pieces
    codes = flat.indices.to_numpy(zero_copy_only=False)
    kept = real[codes]
    row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(pieces)))
    length = np.bincount(row[kept], minlength=len(texts))
    return np.insert(codes[kept].astype(np.int64), np.cumsum(length), len(hashes) - 1), hashes, length + 1


def _each(texts: pa.Array) -> list[np.ndarray]:
    codes, hashes, length = _laid(texts)
    return np.split(hashes[codes], np.cumsum(length)[:-1])


def joined(older: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the gram of `older` and one more symbol."""
    return mix(older * np.uint64(0x9E3779B97F4A7C15) + last)


@F.pandas_udf(LongType())
def _joined(older: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series(signed(joined(older.to_numpy(np.int64).view(np.uint64), last.to_numpy(np.int64).view(np.uint64))))


def contexts(tree: Tree, ids: np.ndarray, upto: int) -> list[np.ndarray]:
    """For every level: index of the candidate context that ends at each token, -1 without one."""
    out, before = [], None
    for level in tree.levels[:upto]:
        if before is None:
            now = np.where(ids >= 0, find(level.keys, np.maximum(ids, 0).astype(np.uint64)), -1)
        else:
            now = np.full(len(ids), -1, dtype=np.int64)
            ok = np.flatnonzero((before[:-1] >= 0) & (ids[1:] >= 0)) + 1
            now[ok] = find(level.keys, joint(before[ok - 1], ids[ok]))
        out.append(now)
        before = now
    return out


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _counted(keys_of) -> object:
    """Sums of the keys that `keys_of(text symbols)` gives, combined per task up to a bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def rows(found):
            for k in range(0, len(found[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(signed(found[0][k:k + 100_000])), pa.array(found[1][k:k + 100_000])], names=["k", "n"])

        for b in arrow_rows(batches, rows=2048, size=4 << 20):
            found = [keys_of(s) for s in _each(b.column(0))]
            parts.append(np.unique(np.concatenate(found), return_counts=True))
            held += len(parts[-1][0])
            if held > HELD:
                parts = [_sums(parts)]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield from rows(parts[0])
                    parts, held = [], 0
        if parts:
            yield from rows(_sums(parts))
    return run


def _table(rows: DataFrame, keys_of) -> DataFrame:
    return rows.select("text").mapInArrow(_counted(keys_of), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))


def _collect(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bounded (k, n) as arrays sorted by the unsigned key."""
    got = df.select("k", "n").toPandas()
    k = got["k"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(k)
    return k[order], got["n"].to_numpy(dtype=np.int64)[order]


def train(rows: DataFrame, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """(tree, counts (k, n) of all words) from the training rows (text)."""
    spark = rows.sparkSession
    seen, counts = _seen(rows)
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = int(whole["n"]), int(whole["v"])
    if tokens > ARRAY_TOKENS:
        tree = Tree(np.zeros(0, np.uint64), np.zeros(0, np.int64), tokens, distinct)
        tree.weights, tree.depth = _weights(rows, seen, counts, tree, depth), depth
        return tree, counts
    head, n = _collect(counts.filter(F.col("n") >= LEAST))
    tree = Tree(head, n, tokens, distinct)
    for k in range(depth):
        if k == 0:
            use = np.flatnonzero((n >= LEAST) & (head != END))
            level = Level(use.astype(np.uint64), n[use], np.full(len(use), -1))
        else:
            below = tree.levels[-1]
            use = np.flatnonzero((below.numbers >= LEAST) & (tree.head[(below.entries & np.uint64(0xFFFFFFFF)).astype(np.int64)] != END))
            keys = below.entries[use]
            older, last = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
            up = find(below.keys, last) if k == 1 else find(below.keys, joint(below.suffix[older], last))
            level = Level(keys, below.numbers[use], up)
        tree.levels.append(level)
        shared = spark.sparkContext.broadcast(tree)

        def following(s: np.ndarray, k=k, shared=shared) -> np.ndarray:
            t = shared.value
            ids = find(t.head, s)
            ctx = contexts(t, ids, k + 1)[k]
            ok = np.flatnonzero((ctx[:-1] >= 0) & (ids[1:] >= 0))
            return joint(ctx[ok], ids[ok + 1])

        level.entries, level.numbers = _collect(_table(rows, following).filter(F.col("n") >= LEAST))
        _judge(tree, k)
    needed = np.zeros(0, bool)
    for k in range(depth - 1, -1, -1):  # suffixes of states are states
        level = tree.levels[k]
        if k < depth - 1:
            up = tree.levels[k + 1]
            needed = np.bincount(up.suffix[up.state], minlength=len(level.keys)) > 0
            level.state = level.state | needed
    return tree, counts


def _batches(names: list[str], *columns: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Record batches of hashes (uint64) and numbers; None is a column of nulls."""
    size = max(len(c) for c in columns if c is not None)
    for k in range(0, size, 100_000):
        part = [None if c is None else c[k:k + 100_000] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.nulls(min(100_000, size - k), pa.int64()) if c is None else pa.array(signed(c) if c.dtype == np.uint64 else c) for c in part], names=names)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n) of the pairs of neighbours and (a, null, n) of the symbols, combined per chunk."""
    for b in _chunks(batches):
        codes, hashes, _ = _laid(b.column(0))
        n = np.bincount(codes, minlength=len(hashes))
        used = np.flatnonzero(n)
        yield from _batches(["a", "b", "n"], hashes[used], None, n[used])
        inside = codes[:-1] != len(hashes) - 1
        key, n = np.unique(joint(codes[:-1][inside], codes[1:][inside]), return_counts=True)
        yield from _batches(["a", "b", "n"], hashes[(key >> np.uint64(32)).astype(np.int64)], hashes[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)], n)


def _seen(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of neighbours seen LEAST times (a, b, n) and counts (k, n) of all symbols, from one pass."""
    with freed_shuffles(rows.sparkSession):
        found = rows.select("text").mapInArrow(_pairs, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
        seen = written(found.filter(F.col("b").isNull() | (F.col("n") >= LEAST)))
        counts = written(seen.filter("b is null").select(F.col("a").alias("k"), "n"))
    return seen.filter("b is not null"), counts


def _sketch(grams: DataFrame) -> np.ndarray:
    """One bit set per hash g in a bounded bit array: a gram whose bit is not set is not among them."""
    bits = int(min(max(grams.count(), 1) * 64 - 1, MOST_BITS - 1)).bit_length()
    bits = max(bits, 20)
    place = F.shiftrightunsigned("g", 64 - bits)
    inner = bits - 10

    def block(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << inner, np.uint8)
        out[np.asarray(t.column("at"))] = 1
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    found = grams.select(F.shiftrightunsigned(place, inner).alias("block"), place.bitwiseAND(F.lit((1 << inner) - 1)).alias("at")).groupBy("block").applyInArrow(block, "block bigint, bits binary")
    out = np.zeros((1024, (1 << inner) // 8), np.uint8)
    for r in found.collect():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _may_hold(sketch: np.ndarray, g: np.ndarray) -> np.ndarray:
    place = g >> np.uint64(64 - (len(sketch).bit_length() + 2))
    return (sketch[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _longer(shared, k: int) -> object:
    """(ctx, suf, sym, n) of grams of k + 1 symbols whose first and last k symbols may be kept, combined per chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for b in _chunks(batches):
            codes, hashes, length = _laid(b.column(0))
            place = _places(length)
            g, suf = hashes[codes], None
            for _ in range(k - 1):
                suf, g = g, np.append(g[:1], joined(g[:-1], hashes[codes[1:]]))
            held = (place >= k - 1) & _may_hold(sketch, g)
            at = np.flatnonzero(held[1:] & held[:-1] & (place[1:] >= k)) + 1
            if not len(at):
                continue
            ctx, first, inverse = np.unique(g[at - 1], return_index=True, return_inverse=True)
            # suf holds grams of k - 1 symbols by their last one
            key, n = np.unique(joint(inverse, codes[at]), return_counts=True)
            c = (key >> np.uint64(32)).astype(np.int64)
            yield from _batches(["ctx", "suf", "sym", "n"], ctx[c], suf[at[first] - 1][c], hashes[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)], n)
    return run


def _places(length: np.ndarray) -> np.ndarray:
    """Position of every symbol in its text."""
    return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


def _unit(tree: Tree, n: Column) -> Column:
    return F.log10((n + 0.5) / F.lit(tree.tokens + 0.5 * (tree.distinct + 1)))


def _weights(rows: DataFrame, seen: DataFrame, counts: DataFrame, tree: Tree, depth: int) -> DataFrame:
    """(g, n, known, base, best): what each gram adds to the scores of a text, more than one row a gram.

    With u the log10 probability of a symbol on a level, u is log_p for an entry of a state and log_rest plus the u of the
    level below otherwise, and the suffix of a state's entry is an entry of a state. So every state adds its log_rest where it
    stands before a symbol, and every entry adds log_p - (log_p of its suffix) - log_rest; a symbol adds its unigram value,
    above that of an unknown one, which scoring adds for all."""
    spark = rows.sparkSession
    none = _unit(tree, F.lit(0))
    log_p, rest = F.log10((F.col("n") - DISCOUNT) / F.col("count")), F.greatest(1 - F.col("mine"), F.lit(1e-12))
    levels, states = [], []
    with freed_shuffles(spark):
        known = counts.filter(F.col("n") >= LEAST)
        found = seen.join(known.select(F.col("k").alias("b"), F.col("n").alias("un")), "b").join(known.select(F.col("k").alias("a"), F.col("n").alias("count")), "a")
        found = found.select(F.col("a").alias("ctx"), F.lit(0).cast("bigint").alias("suf"), F.col("b").alias("sym"), "n", "count", "un", F.lit(0).cast("bigint").alias("uc"))
        for k in range(1, depth + 1):
            if k > 1:
                below = levels[-1]
                shared = spark.sparkContext.broadcast(_sketch(below))
                grams = rows.select("text").mapInArrow(_longer(shared, k), "ctx bigint, suf bigint, sym bigint, n bigint").groupBy("ctx", "suf", "sym").agg(F.sum("n").alias("n"))
                grams = written(grams.filter(F.col("n") >= LEAST))
                shared.destroy()
                found = grams.join(below.select(F.col("ctx").alias("suf"), "sym", F.col("n").alias("un"), F.col("count").alias("uc")), ["suf", "sym"])
                found = found.join(below.select(F.col("g").alias("ctx"), F.col("n").alias("count")), "ctx")
            levels.append(written(found.select("ctx", "suf", "sym", "n", "count", "un", "uc", _joined("ctx", "sym").alias("g"))))
            emptied(seen if k == 1 else grams)
        ups = [_unit(tree, F.col("un")) if k == 1 else F.log10((F.col("un") - DISCOUNT) / F.col("uc")) for k in range(1, depth + 1)]
        needed = None
        for entries, up in zip(levels[::-1], ups[::-1], strict=True):  # suffixes of states are states
            p = F.pow(F.lit(10.0), "log_p")
            judged = entries.select("ctx", "suf", "count", log_p.alias("log_p"), up.alias("up")).groupBy("ctx", "suf", "count").agg(
                F.sum(p).alias("mine"), F.sum(F.pow(F.lit(10.0), "up")).alias("theirs"), F.sum(p * (F.col("log_p") - F.col("up"))).alias("gain"))
            judged = judged.withColumn("log_rest", F.log10(rest) - F.log10(F.greatest(1 - F.col("theirs"), F.lit(1e-12))))
            judged = judged.withColumn("state", F.col("gain") + rest * F.col("log_rest") >= DIVERGENCE)
            if needed is not None:
                judged = judged.join(needed, "ctx", "left").withColumn("state", F.col("state") | F.col("needed").isNotNull())
            states.append(written(judged.filter("state").select("ctx", "suf", "count", "log_rest")))
            needed = states[-1].select(F.col("suf").alias("ctx"), F.lit(True).alias("needed")).distinct()
        weights = counts.select(F.col("k").alias("g"), "n", F.lit(1).alias("known"), (_unit(tree, F.col("n")) - none).alias("base")).withColumn("best", F.col("base"))
        for entries, up, own in zip(levels, ups, states[::-1], strict=True):
            zero = (F.lit(0).alias("known"), F.lit(0.0).alias("base"))
            of_state = own.select(F.col("ctx").alias("g"), F.col("count").alias("n"), *zero, F.col("log_rest").alias("best"))
            of_entry = entries.join(own.select("ctx", "log_rest"), "ctx").select("g", "n", *zero, (log_p - up - F.col("log_rest")).alias("best"))
            part = written(of_state.unionByName(of_entry))
            emptied(entries)
            emptied(own)
            weights = weights.unionByName(part)
    return weights


def _parted(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights of the most frequent grams, at most HOT: those above the lowest count whose grams and all of higher counts are so few; and the others."""
    level = F.floor(F.log2("n") * 4).cast("int")
    total, least = 0, None
    for r in sorted(weights.groupBy(level.alias("l")).agg(F.count("*").alias("c")).collect(), key=lambda r: -r["l"]):
        total += r["c"]
        if total > HOT:
            break
        least = r["l"]
    return (weights.limit(0), weights) if least is None else (weights.filter(level >= least), weights.filter(level < least))


def _scored_grams(shared, depth: int, none: float, turn: int) -> object:
    """One summary row per text and one row per gram of this pass that may have a weight and is not broadcast: (id, th, w,
    base, score, tokens, known). The first pass gives the tokens and their values as unknown words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, hot, known, base, best = shared.value
        for b in arrow_rows(batches, rows=1 << 20, size=CHUNK // 3):
            codes, hashes, length = _laid(b.column(2))
            size, place, row = len(length), _places(length), np.repeat(np.arange(len(length)), length)
            tokens = length if turn == 0 else np.zeros_like(length)
            sums = [tokens * none, tokens * none, np.zeros(size)]
            sent, of_row = [joined(np.arange(size, dtype=np.uint64), hashes[codes[np.cumsum(length) - length]])], [np.arange(size)]
            g, before = hashes[codes], np.ones(len(codes), bool)
            for k in range(depth + 1):
                if k:
                    g = np.append(g[:1], joined(g[:-1], hashes[codes[1:]]))
                may = before & (place >= k) & _may_hold(sketch, g)
                at = np.flatnonzero(may & ((g >> np.uint64(8)) % np.uint64(PASSES) == turn))
                grams, inverse = np.unique(g[at], return_inverse=True) if k else (hashes, codes[at])
                found = find(hot, grams)[inverse]
                here, where = found[found >= 0], row[at[found >= 0]]
                if len(here):
                    for total, values in zip(sums, (base, best, known), strict=True):
                        total += np.bincount(where, weights=values[here], minlength=size)
                sent.append(g[at[found < 0]])
                of_row.append(row[at[found < 0]])
                before = np.append(False, may[:-1])  # a longer gram with a weight starts with one
            of_row, sent, number = np.concatenate(of_row), np.concatenate(sent), sum(map(len, sent))
            order = np.argsort(of_row, kind="stable")
            for k in range(0, number, 100_000):
                part = order[k:k + 100_000]
                own, of = part < size, of_row[part]
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(signed(sent[part])), *(pa.array(np.where(own, x[of], 0.0)) for x in sums[:2]),
                     pa.array(np.where(own, tokens[of], 0)), pa.array(np.where(own, sums[2][of], 0).astype(np.int64))], names=["id", "th", "w", "base", "score", "tokens", "known"])
    return run


def _scores(rows: DataFrame, kind: str, tree: Tree) -> DataFrame:
    """(id, th, tokens, known, base, score, copies) of every id and text, by the tables of the tree."""
    spark = rows.sparkSession
    hot, others = _parted(tree.weights)
    with freed_shuffles(spark):
        top = hot.groupBy("g").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("best").alias("best")).toPandas()
        sketch = _sketch(tree.weights)
    g = top.pop("g").to_numpy(np.int64).view(np.uint64)
    order = np.argsort(g)
    shared = spark.sparkContext.broadcast((sketch, g[order], *(top.pop(c).to_numpy(kind)[order] for c, kind in (("known", np.int8), ("base", float), ("best", float)))))
    del sketch, g, top
    pa.default_memory_pool().release_unused()
    none = float(np.log10(0.5 / (tree.tokens + 0.5 * (tree.distinct + 1))))
    values = others.select(F.col("g").alias("w"), F.col("known").alias("seen"), F.col("base").alias("one"), "best")
    sums, found = ("tokens", "known", "base", "score", "copies"), None
    for turn in range(PASSES):
        parts = rows.mapInArrow(_scored_grams(shared, tree.depth, none, turn), f"id {kind}, th bigint, w bigint, base double, score double, tokens bigint, known bigint")
        met = parts.join(values.filter(F.shiftrightunsigned("w", 8) % PASSES == turn), "w", "left")
        with freed_shuffles(spark):
            part = written(met.groupBy("id", "th").agg(
                F.sum("tokens").alias("tokens"), F.sum(F.col("known") + F.coalesce("seen", F.lit(0))).alias("known"), F.sum(F.col("base") + F.coalesce("one", F.lit(0.0))).alias("base"),
                F.sum(F.col("score") + F.coalesce("best", F.lit(0.0))).alias("score"), F.sum((F.col("tokens") > 0).cast("bigint")).alias("copies")))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("id", "th").agg(*(F.sum(c).alias(c) for c in sums))


def probability(tree: Tree, k: int, ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """log10 P(symbol | context of level k), -1 for the root; symbols are in the head."""
    if k < 0:
        return tree.root(tree.count[sym])
    level = tree.levels[k]
    at = find(level.entries, joint(ctx, sym))
    out = np.where(at >= 0, level.log_p[np.maximum(at, 0)], 0.0) if len(level.log_p) else np.zeros(len(ctx))
    miss = np.flatnonzero(at < 0)
    if len(miss):
        out[miss] = level.log_rest[ctx[miss]] + probability(tree, k - 1, level.suffix[ctx[miss]], sym[miss])
    return out


def _judge(tree: Tree, k: int) -> None:
    """Distributions of a level's contexts and the divergence test against their suffixes."""
    level = tree.levels[k]
    ctx, sym = (level.entries >> np.uint64(32)).astype(np.int64), (level.entries & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = len(level.keys)
    p = (level.numbers - DISCOUNT) / level.count[ctx]
    level.log_p = np.log10(p)
    up = probability(tree, k - 1, level.suffix[ctx], sym)
    mine = np.bincount(ctx, weights=p, minlength=size)
    theirs = np.bincount(ctx, weights=10.0 ** up, minlength=size)
    rest, other = np.maximum(1.0 - mine, 1e-12), np.maximum(1.0 - theirs, 1e-12)
    level.log_rest = np.log10(rest) - np.log10(other)
    gain = np.bincount(ctx, weights=p * (level.log_p - up), minlength=size) + rest * level.log_rest
    level.state = gain >= DIVERGENCE


def _scored(shared) -> object:
    """One summary row per text and one row per rare word: (id, th, w, rare, n, base, score, tokens, known)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        root = tree.root(tree.count)
        for b in arrow_rows(batches, rows=1024, size=4 << 20):
            row, w, rare, n, base, score, total, known = [], [], [], [], [], [], [], []
            for r, s in enumerate(_each(b.column(2))):
                ids = find(tree.head, s)
                have = ids >= 0
                flat = root[ids[have]].sum()
                best = np.zeros(len(s))
                best[have] = root[ids[have]]
                level_of, state = np.full(len(s), -1), np.full(len(s), -1)
                for k, ctx in enumerate(contexts(tree, ids, len(tree.levels))):
                    ok = np.flatnonzero(ctx[:-1] >= 0)
                    ok = ok[tree.levels[k].state[ctx[ok]]]
                    level_of[ok + 1], state[ok + 1] = k, ctx[ok]
                for k, level in enumerate(tree.levels):
                    at = np.flatnonzero((level_of == k) & have)
                    if len(at):
                        best[at] = probability(tree, k, state[at], ids[at])
                    at = np.flatnonzero((level_of == k) & ~have)  # rare words: the mass left along the suffixes
                    here, j = state[at], k
                    while j >= 0 and len(at):
                        best[at] += tree.levels[j].log_rest[here]
                        here, j = tree.levels[j].suffix[here], j - 1
                tail, m = np.unique(s[~have], return_counts=True)
                row.append(np.full(1 + len(tail), r))
                w += [np.array([np.uint64(r * 0x9E3779B97F4A7C15 & (2**64 - 1)) ^ s[0]], dtype=np.uint64), tail]
                zero = np.zeros(len(tail))
                rare += [[False], np.ones(len(tail), bool)]
                n += [[0], m]
                base += [[flat], zero]
                score += [[best.sum()], zero]
                total += [[len(s)], zero]
                known += [[have.sum()], zero]
            at = pa.array(np.concatenate(row))
            cat = lambda x, kind: pa.array(np.concatenate(x), kind)
            out = pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(signed(np.concatenate(w))), cat(rare, pa.bool_()), cat(n, pa.int64()),
                 cat(base, pa.float64()), cat(score, pa.float64()), cat([np.asarray(x, np.int64) for x in total], pa.int64()),
                 cat([np.asarray(x, np.int64) for x in known], pa.int64())],
                names=["id", "th", "w", "rare", "n", "base", "score", "tokens", "known"])
            for k in range(0, out.num_rows, 100_000):
                yield out.slice(k, 100_000)
    return run


def score(docs: DataFrame, tree: Tree, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, th bigint, w bigint, rare boolean, n bigint, base double, score double, tokens bigint, known bigint"
    if tree.weights is not None:
        per = _scores(rows, kind, tree)
    else:
        parts = rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(tree)), schema)
        unit = _unit(tree, F.col("n"))
        values = counts.select(F.col("k").alias("w"), F.lit(True).alias("seen"), unit.alias("one"), unit.alias("best"))
        met = parts.join(values, "w", "left")
        none = _unit(tree, F.lit(0))
        extra = F.when(F.col("rare"), F.col("n") * F.coalesce("one", none)).otherwise(0.0)
        more = F.when(F.col("rare"), F.col("n") * F.coalesce("best", none)).otherwise(0.0)
        seen = F.when(F.col("rare") & F.coalesce("seen", F.lit(False)), F.col("n")).otherwise(0)
        per = met.groupBy("id", "th").agg(
            F.sum("tokens").alias("tokens"), F.sum(F.col("known") + seen).alias("known"), F.sum(F.col("base") + extra).alias("base"),
            F.sum(F.col("score") + more).alias("score"), F.sum((~F.col("rare")).cast("bigint")).alias("copies"))
    each = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))  # rows that repeat id and text
    k = F.col("copies")
    return each.select(F.col("id").alias("doc_id"), F.expr("tokens div copies").alias("n_tokens"), F.expr("known div copies").alias("n_known"),
                       F.lit(tree.tokens).cast("bigint").alias("train_tokens"), (F.col("base") / k).alias("base_score"), (F.col("score") / k).alias("score"))
