"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

Texts become sequences of lower-cased words in which a number is <num>, a unit after a number <unit> and a
capitalised word inside a sentence <name>; in unsegmented scripts every letter is a word. What stands before an item is not
known, so a window that starts with a capitalised first word is offered with the word and with <name>. Windows of WINDOW tokens (whole items where these are shorter, down
to SHORTEST) of documents and items are joined by hash and then by their template. Matches of a document and an item
are gathered on their diagonal (difference of positions). A diagonal is a leak if

* RUN windows (or all of a shorter item) agree in their slots' values too: `verbatim`, or
* that many agree as templates and the slots are consistent, each value of the item standing for one
  value of the document and the reverse: `reparameterised`.

Items below SHORTEST tokens, and those without a window of LITERALS words beside placeholders, are too general for
templates; they are searched whole and word by word (`verbatim` only), numbers and names included.

Benchmark windows are broadcast as sorted hashes while their counted number stays below BROADCAST_WINDOWS, so
that only hits leave the scan; beyond that all windows are joined by shuffle. Hits are bounded by the
items' windows for each passage, no pairs of documents are made, and equal hits of a diagonal are pre-aggregated.

Defined cases: null and empty texts match nothing, as do texts without words; windows with fewer than LITERALS words beside
placeholders are ignored in items that have others; repeated ids or items count as one; empty tables give
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import arrow_rows, bounded, fresh, released, settled, signed, small_batches, window_hashes

WINDOW = 8
SHORTEST = 6
LITERALS = 4
RUN = 6
BROADCAST_WINDOWS = 2_000_000
# Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
UNSEGMENTED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af"
TOKEN = re.compile(rf"\d+(?:[.,:]\d+)*|(?=[^\W\d_])[{UNSEGMENTED}]|[^\W\d_{UNSEGMENTED}]+|[%€$£]|[.!?。！？\n]")
# Words and signs of measure that follow a number, and English number words.
UNITS = frozenset("""% € $ £ mm cm m km kg g mg t l ml kb mb gb s ms min h kmh mph hz kw kwh v w
 second seconds minute minutes hour hours day days week weeks month months year years inch inches foot feet yard yards mile miles
 meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms ounce ounces pound pounds ton tons
 liter liters litre litres gallon gallons degree degrees percent dollar dollars cent cents euro euros""".split())
NUMBERS = frozenset("""zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
 eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million""".split())
TITLE, NUMBER, END, UNIT = 1, 2, 4, 8
SLOTS = {NUMBER: "<num>", UNIT: "<unit>", TITLE: "<name>"}
CACHE = 300_000


class Codes(dict):
    """Token -> 60 bits of hash and four flags, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        flags = (TITLE if len(token) > 1 and token[0].isupper() and token[1:].islower() else 0) | (
            NUMBER if token[0].isdigit() or low in NUMBERS else 0) | (END if token in ".!?。！？\n" else 0) | (UNIT if low in UNITS else 0)
        self[token] = code = (xxhash.xxh3_64_intdigest(low) & ~15) | flags
        return code


class Template:
    """Tokens of one text with slot kinds and a hash for each."""

    def __init__(self, text: str | None, codes: Codes):
        if len(codes) > CACHE:
            codes.clear()
        tokens = TOKEN.findall(text) if text else []
        code = np.array([codes[t] for t in tokens], dtype=np.uint64)
        flag = (code & np.uint64(15)).astype(np.int64)
        start = np.concatenate([[True], (flag[:-1] & END) > 0]) if len(flag) else np.zeros(0, bool)
        stays = (flag & END) == 0
        at = np.flatnonzero(stays)
        flag, start, code = flag[at], start[at], code[at]
        kind = np.where(flag & NUMBER, NUMBER, 0)
        after = np.concatenate([[False], kind[:-1] == NUMBER]) if len(kind) else np.zeros(0, bool)
        kind = np.where((kind == 0) & ((flag & UNIT) > 0) & after, UNIT, kind)
        kind = np.where((kind == 0) & ((flag & TITLE) > 0) & ~start, TITLE, kind)
        # signs of measure that follow no number are no words
        word = ~((flag == UNIT) & (kind == 0) & np.array([tokens[k] in "%€$£" for k in at], dtype=bool)) if len(at) else np.zeros(0, bool)
        self.at, self.kind = at[word], kind[word]
        self.plain = code[word] & ~np.uint64(15)
        self.hash = np.where(self.kind > 0, self.kind.astype(np.uint64), self.plain)
        self.first = (start & ((flag & TITLE) > 0))[word] & (self.kind == 0)  # may be a name or not
        self.tokens = tokens

    def __len__(self) -> int:
        return len(self.at)

    def window(self, k: int, size: int, named: bool = False) -> tuple[str, list[str]]:
        """Template text and slot values of a window, its first word as <name> if `named`; a negative size takes words only."""
        if size < 0:
            return " ".join(self.tokens[j].lower() for j in self.at[k:k - size]), []
        words, slots = [], []
        for j in range(k, k + size):
            token, kind = self.tokens[self.at[j]], TITLE if named and j == k else int(self.kind[j])
            if kind:
                words.append(SLOTS[kind])
                slots.append(token.lower())
            else:
                words.append(token.lower())
        return " ".join(words), slots

    def hashes(self, size: int) -> list[tuple[bool, np.ndarray, np.ndarray]]:
        """(first word as <name>, positions, hashes) of the windows with enough words beside placeholders; a negative
        size gives all windows of words."""
        if len(self) < abs(size):
            return []
        if size < 0:
            h = window_hashes(self.plain, -size)
            if size > -WINDOW:  # such an item is one window: its first occurrence is enough
                h, use = np.unique(h, return_index=True)
                return [(False, use, h)]
            return [(False, np.arange(len(h)), h)]
        plain = np.concatenate([[0], np.cumsum(self.kind == 0)])
        plain = plain[size:] - plain[:-size]
        use = np.flatnonzero(plain >= min(LITERALS, size))
        out = [(False, use, window_hashes(self.hash, size)[use])]
        use = np.flatnonzero(self.first[:len(plain)] & (plain - 1 >= min(LITERALS, size)))
        if len(use):
            each = self.hash[use[:, None] + np.arange(size)]
            each[:, 0] = TITLE
            out.append((True, use, window_hashes(each.ravel(), size)[::size]))
        return out


def _windows(sizes: list[int], wanted) -> object:
    """Rows of the windows whose hash is wanted (None: all), of every size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, keep = Codes(), wanted.value if wanted is not None else None
        for b in arrow_rows(batches, size=4 << 20):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = Template(text, codes)
                for size in sizes:
                    for named, at, h in t.hashes(size):
                        if keep is not None and len(at):
                            hit = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h if len(keep) else np.zeros(len(h), bool)
                            at, h = at[hit], h[hit]
                        rows += [(i, size, int(k), x, *t.window(k, size, named)) for k, x in zip(at, signed(h).tolist(), strict=True)]
            for k in range(0, len(rows), 20_000):
                ids, *rest = zip(*rows[k:k + 20_000], strict=True)
                arrays = [pa.array(ids, b.column(0).type), *(pa.array(x, kind) for x, kind in zip(
                    rest, (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string())), strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "size", "pos", "h", "template", "slots"])
    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size of the windows of every item with words, negative where it has to be searched word by word."""
    codes = Codes()
    for b in arrow_rows(batches):
        out = []
        for text in b.column(1).to_pylist():
            t = Template(text, codes)
            n = min(len(t), WINDOW)
            out.append(n if len(t) >= SHORTEST and len(t.hashes(n)[0][1]) else -n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], names=["id", "size"])


def _schema(kind: str) -> str:
    return f"id {kind}, size int, pos int, h bigint, template string, slots array<string>"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, item_windows, kind): one row per document and leaked item."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")).filter("id is not null")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    of_item, of_doc = dict(items.dtypes)["id"], dict(rows.dtypes)["id"]
    length = settled(items.mapInArrow(released(_sizes), f"id {of_item}, size int").filter("size <> 0").distinct())
    sizes = sorted(r["size"] for r in length.select("size").distinct().collect())
    mine = items.mapInArrow(released(_windows(sizes, None)), _schema(of_item)).join(length, ["id", "size"], "left_semi")
    mine = settled(mine.select(F.col("id").alias("item"), "size", F.col("pos").alias("ipos"), "h", "template", F.col("slots").alias("islots")).distinct())
    total = mine.select("item", "size", "ipos").distinct().groupBy("item").agg(F.count("*").alias("item_windows"), F.min("size").alias("least"))
    wanted = None
    if mine.count() <= BROADCAST_WINDOWS:
        h = np.unique(mine.select("h").distinct().toPandas()["h"].to_numpy(dtype=np.int64).view(np.uint64))
        wanted = spark.sparkContext.broadcast(h)
    hits = rows.mapInArrow(released(_windows(sizes, wanted)), _schema(of_doc)).withColumnRenamed("id", "doc")
    met = hits.join(mine, ["h", "size", "template"]).select(
        "doc", "item", (F.col("pos") - F.col("ipos")).alias("off"), "ipos", "islots", "slots", (F.col("slots") == F.col("islots")).alias("same"))
    met = settled(met.distinct())
    lines = met.groupBy("doc", "item", "off").agg(
        F.count_distinct("ipos").alias("n"), F.count_distinct(F.when(F.col("same"), F.col("ipos"))).alias("equal"))
    pairs = (met.select("doc", "item", "off", F.explode(F.arrays_zip("islots", "slots")).alias("x"))
             .select("doc", "item", "off", "x.islots", "x.slots").distinct())
    there = pairs.groupBy("doc", "item", "off", "islots").agg(F.count("*").alias("c")).groupBy("doc", "item", "off").agg(F.max("c").alias("one"))
    back = pairs.groupBy("doc", "item", "off", "slots").agg(F.count("*").alias("c")).groupBy("doc", "item", "off").agg(F.max("c").alias("other"))
    key = ["doc", "item", "off"]
    need = F.when(F.col("least") < 0, F.col("item_windows")).otherwise(F.least(F.lit(RUN), F.col("item_windows")))
    judged = (lines.join(there, key, "left").join(back, key, "left").join(total, "item")
              .withColumn("verbatim", F.col("equal") >= need)
              .withColumn("consistent", (F.coalesce("one", F.lit(1)) == 1) & (F.coalesce("other", F.lit(1)) == 1) & (F.col("n") >= need))
              .filter("verbatim or consistent"))
    return (judged.groupBy("doc", "item").agg(F.max("n").alias("windows"), F.first("item_windows").alias("item_windows"), F.max("verbatim").alias("v"))
            .select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "windows", "item_windows",
                    F.when(F.col("v"), "verbatim").otherwise("reparameterised").alias("kind")))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table without the documents that leak an item; rows without id stay."""
    i = fresh(docs, "id")
    bad = settled(leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(i)).distinct())
    return docs.join(bounded(bad), docs[id_col] == F.col(i), "left_anti")
