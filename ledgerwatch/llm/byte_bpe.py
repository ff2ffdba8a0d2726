"""Byte-level BPE: encoding on length-bucketed padded matrices, decoding by gathering token bytes.

A batch's distinct pre-tokens are bucketed by byte length into one matrix of ids each. Every round looks
up neighbours in a hashed pair table, merges the leftmost pair of minimum rank in every row and closes the
gap, so a bucket of length n needs at most n-1 rounds whatever its number of rows. Pre-tokens above
LONG bytes would need as many rounds as bytes for one row; they are merged by a heap over a linked list
with the same order (rank, then position).

The vocabulary (rank file of at most VOCABULARY_BYTES) is read by the driver and sent to the workers; what a
worker remembers of pre-tokens is bounded. Rows are encoded where they lie: no shuffle.

Defined cases: null and empty texts give no ids and decode to no bytes; special tokens are ordinary text;
rows, ties and repeated ids are handled row by row; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import arrow_rows, gather, released, small_batches

VOCABULARY_BYTES = 32 << 20
LONG = 1024
CELLS = 1 << 20
PIECES = 150_000
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64, blank, rank per line)."""
    data = Path(path).read_bytes()
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path}: larger than {VOCABULARY_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class PairTable:
    """Open addressing over (left id, right id) -> merged id."""

    def __init__(self, ranks: dict[bytes, int]):
        key, value = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                right = ranks.get(token[cut:]) if left is not None else None
                if right is not None:
                    key.append(left << 32 | right)
                    value.append(rank)
        key, value = np.array(key, dtype=np.uint64), np.array(value, dtype=np.int32)
        bits = max(4, int(len(key) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE)
        slot, left = self.slots(key), np.arange(len(key))
        while len(left):
            free = left[self.values[slot[left]] == NONE]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = key[free[first]], value[free[first]]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def slots(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the two do not merge; negative ids are padding."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        slot = self.slots(key)
        out = np.where(self.keys[slot] == key, self.values[slot], NONE)
        todo = np.flatnonzero((self.keys[slot] != key) & (self.values[slot] != NONE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            hit = self.keys[slot[todo]] == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (self.values[slot[todo]] != NONE)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class Encoder:
    """Ids of texts; remembers at most PIECES pre-tokens between calls."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = PIECES):
        self.ranks, self.find, self.limit = ranks, regex.compile(pattern).findall, pieces
        self.pairs = PairTable(ranks)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.reset()

    def reset(self) -> None:
        self.known, self.start, self.count = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def merge_matrix(self, ids: np.ndarray) -> list[np.ndarray]:
        """Final ids of every row of a full matrix."""
        out: list[np.ndarray] = [None] * len(ids)
        rows = np.arange(len(ids))
        rank = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            if not rank.shape[1]:
                for r, line in zip(rows, ids, strict=True):
                    out[r] = line
                break
            at = rank.argmin(axis=1)  # the first minimum: the leftmost pair
            best = rank[np.arange(len(rows)), at]
            done = best == NONE
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k]
            go = np.flatnonzero(~done)
            if not len(go):
                break
            rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
            line = np.arange(len(go))
            ids[line, at] = best
            keep = np.ones(ids.shape, dtype=bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(len(go), -1)
            rank = rank[keep[:, 1:]].reshape(len(go), -1)  # the merged pair's own rank goes
            for column in (at - 1, at):
                k = np.flatnonzero((column >= 0) & (column < rank.shape[1]))
                rank[k, column[k]] = self.pairs(ids[k, column[k]], ids[k, column[k] + 1])
        return out

    def merge_long(self, ids: list[int]) -> np.ndarray:
        """One very long pre-token: a heap of (rank, position) over a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), k) for k, r in enumerate(first) if r != NONE]
        rank = first.tolist() + [int(NONE)]
        heapq.heapify(heap)
        alive = [True] * n
        known = {}

        def pair(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.pairs(np.array([a], np.int32), np.array([b], np.int32))[0])
            return known[a, b]

        while heap:
            r, k = heapq.heappop(heap)
            if not alive[k] or rank[k] != r:
                continue
            gone = after[k]
            ids[k], alive[gone], after[k] = r, False, after[gone]
            if after[k] < n:
                before[after[k]] = k
            for j in (before[k], k):
                if j >= 0:
                    rank[j] = pair(ids[j], ids[after[j]]) if after[j] < n else int(NONE)
                    if rank[j] != NONE:
                        heapq.heappush(heap, (rank[j], j))
        return np.array([t for t, here in zip(ids, alive, strict=True) if here], dtype=np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pre-tokens, bucketed by their length in bytes."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        found: list[np.ndarray] = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            whole = self.ranks.get(b)
            if whole is not None:
                found[k] = np.array([whole], dtype=np.int32)
            elif len(b) > LONG:
                found[k] = self.merge_long(self.bytes[np.frombuffer(b, np.uint8)].tolist())
            else:
                buckets.setdefault(len(b), []).append(k)
        for length, members in buckets.items():
            step = max(1, CELLS // length)
            for at in range(0, len(members), step):
                part = members[at:at + step]
                matrix = np.frombuffer(b"".join(raw[k] for k in part), np.uint8).reshape(len(part), length)
                for k, ids in zip(part, self.merge_matrix(self.bytes[matrix]), strict=True):
                    found[k] = ids
        if found:
            count = np.array([len(x) for x in found], dtype=np.int64)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, *found])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.known) > self.limit:
            self.reset()
        known, new, lines = self.known, [], []
        for text in texts:
            pieces = self.find(text) if text else []
            line = [known.get(p) for p in pieces]
            if None in line:
                for k, at in enumerate(line):
                    if at is None:
                        p = pieces[k]
                        line[k] = known.get(p)
                        if line[k] is None:
                            line[k] = known[p] = len(known)
                            new.append(p)
            lines.append(np.array(line, dtype=np.int64))
        self.learn(new)
        at = np.concatenate(lines) if lines else np.zeros(0, np.int64)
        ids = gather(self.flat, self.start[at], self.count[at])
        per = np.array([self.count[x].sum() for x in lines], dtype=np.int64)
        return ids, per


_made: dict[tuple, Encoder] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> Encoder:
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(ranks, pattern)
    return _made[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for b in arrow_rows(batches, size=4 << 20):  # the ids of a batch take some ten times its text
            ids, per = encoder(b.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return narrow.mapInArrow(released(run), f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes of the ids, without a check that they are valid UTF-8."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = sorted(shared.value.items(), key=lambda x: x[1])
        size = np.zeros(by_id[-1][1] + 1, dtype=np.int64)
        size[[i for _, i in by_id]] = [len(t) for t, _ in by_id]
        flat = np.frombuffer(b"".join(t for t, _ in by_id), dtype=np.uint8)
        start = np.cumsum(size) - size
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                column = b.column(1)
                ids = np.asarray(column.flatten())
                per = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
                ends = np.concatenate([[0], np.cumsum(per)])
                length = np.concatenate([[0], np.cumsum(size[ids])])[ends].astype(np.int32)
                data = gather(flat, start[ids], size[ids]).tobytes()
                binary = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(length.tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([b.column(0), column, binary], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(released(run), f"doc_id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded texts."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encode(docs, ranks, pattern, id_col, text_col), ranks).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
