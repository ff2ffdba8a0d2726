"""Language identification by rank-order n-gram profiles.

Training counts words per language, then n-grams (1 to 3 letters, words padded with blanks) of the distinct
words, over all training rows; a language's profile is its RANKS most frequent n-grams. A document's own
n-grams are ranked alike, and the out-of-place distance sums how far each lies from its rank in the
profile (RANKS when it is absent). The least distance wins; score = 1 - distance / largest possible distance.
Counts break ties by the n-gram, distances by the name of the language, so results do not depend on partitions.

Only the profiles (languages x RANKS short strings) reach the driver and the workers. Words of a
partition are combined before the shuffle, so a language that holds most rows is no hot key.

Defined cases: a null text or one without a letter gives `und` and score 0; rows without language do not
train; without any training row every prediction is `und`; rows are predicted one by one, so repeated ids
repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.llm.common import arrow_rows, fresh, gather, released, small_batches

RANKS = 400
GRAM = 3
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Distinct words that a worker holds before it passes its partial counts on.
HELD = 300_000
#: Distinct words or n-grams that a scorer remembers (some 500 bytes each, with the n-grams of the word).
REMEMBERED = 150_000


def grams(word: str) -> list[str]:
    w = f" {word} "
    return [w[k:k + n] for n in range(1, GRAM + 1) for k in range(len(w) - n + 1) if n > 1 or w[k] != " "]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    names = ["lang", "word", "n"]

    def flush():
        rows = ((lang, w, n) for lang, c in counts.items() for w, n in c.items())
        while part := list(islice(rows, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part, strict=True)], names=names)
        counts.clear()

    for b in arrow_rows(batches, size=4 << 20):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        if sum(map(len, counts.values())) > HELD:
            yield from flush()
    yield from flush()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            for g in grams(word):
                counts[lang, g] += n
        rows = [(lang, g, n) for (lang, g), n in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "gram", "n"])


def train(rows: DataFrame, ranks: int = RANKS) -> dict[str, list[str]]:
    """Profiles by language from rows (lang, text)."""
    use = rows.select("lang", "text").filter("lang is not null and text is not null")
    small_batches(rows.sparkSession)
    words = (use.mapInArrow(released(_word_counts), "lang string, word string, n bigint")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    counted = words.mapInArrow(released(_gram_counts), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("r", order).filter(F.col("r") <= ranks).orderBy("lang", "r").collect()
    found: dict[str, list[str]] = {}
    for row in top:
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


def _appended(array: np.ndarray, used: int, values) -> np.ndarray:
    """The array with values from position `used` on, grown by doubling."""
    while used + len(values) > len(array):
        array = np.concatenate([array, np.zeros(max(1024, len(array)), array.dtype)])
    array[used:used + len(values)] = values
    return array


class Scorer:
    """Nearest profile of a text; remembers the n-grams of words up to a bound."""

    def __init__(self, profiles: dict[str, list[str]], ranks: int = RANKS):
        self.profiles, self.ranks, self.langs = profiles, ranks, sorted(profiles)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.flat, self.size, self.start, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        own = sorted({g for p in self.profiles.values() for g in p})
        self.ids.update((g, k) for k, g in enumerate(own))
        self.places = np.full((len(self.langs), len(own)), self.ranks, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            for r, g in enumerate(self.profiles[lang]):
                self.places[k, self.ids[g]] = r
        self.known = len(own)
        self.codes = np.zeros(max(1024, 2 * len(own)), dtype=np.int64)
        self.codes[:len(own)] = [self.code(g) for g in own]

    @staticmethod
    def code(gram: str) -> int:
        """Order of n-grams as a number: 21 bits per letter, shorter ones first."""
        out = 0
        for c in gram.ljust(GRAM, "\0"):
            out = out << 21 | ord(c)
        return out

    def learn(self, new: list[str]) -> None:
        """Adds words: their n-grams lie one word after the other in `flat`."""
        found, size = [], []
        for word in new:
            self.words[word] = len(self.words)
            own = grams(word)
            for g in own:
                k = self.ids.get(g)
                if k is None:
                    k = self.ids[g] = len(self.ids)
                    if k == len(self.codes):
                        self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
                    self.codes[k] = self.code(g)
                found.append(k)
            size.append(len(own))
        self.flat = _appended(self.flat, self.used, found)
        self.size = _appended(self.size, len(self.words) - len(new), size)
        self.start = _appended(self.start, len(self.words) - len(new), self.used + np.cumsum(size) - size)
        self.used += len(found)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        if len(self.words) > REMEMBERED or len(self.ids) > REMEMBERED:
            self.reset()
        counts = Counter(LETTERS.findall(text.lower()))
        if not counts:
            return UNKNOWN, 0.0
        at = [self.words.get(w) for w in counts]
        if None in at:
            self.learn([w for w, k in zip(counts, at, strict=True) if k is None])
            at = [self.words[w] for w in counts]
        at = np.array(at)
        size = self.size[at]
        each = np.repeat(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)), size)
        total = np.bincount(gather(self.flat, self.start[at], size), weights=each)
        seen = np.flatnonzero(total)
        if len(seen) > self.ranks:  # those at the last place or above it; ties are ordered below
            cut = np.partition(total[seen], len(seen) - self.ranks)[len(seen) - self.ranks]
            seen = seen[total[seen] >= cut]
        top = seen[np.lexsort((self.codes[seen], -total[seen]))][:self.ranks]
        place = np.full((len(self.langs), len(top)), self.ranks, dtype=np.int64)
        own = top < self.known
        place[:, own] = self.places[:, top[own]]
        away = np.where(place == self.ranks, self.ranks, np.abs(place - np.arange(len(top)))).sum(axis=1)
        best = int(away.argmin())
        return self.langs[best], 1.0 - float(away[best]) / (self.ranks * len(top))


def predict(docs: DataFrame, profiles: dict[str, list[str]], text_col: str = "text", keep: list[str] | None = None,
            lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The columns of `keep` (default: all) with predicted language and score, which replace columns of their names; no shuffle."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (lang_name, score_name)]
    text = fresh(docs, "text")
    frame = docs.select(*keep, F.col(text_col).alias(text))
    schema = frame.drop(text).schema.add(lang_name, "string").add(score_name, "double")
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(profiles)
        for b in arrow_rows(batches, text=text, size=4 << 20):
            found = [scorer(t) for t in b.column(at).to_pylist()]
            made = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(b.columns[:at] + made, names=[*b.schema.names[:at], lang_name, score_name])

    small_batches(docs.sparkSession)
    return frame.mapInArrow(released(run), schema)
