"""What the tasks of the tree trainer compute on blocks of binned rows.

Python workers import this module, so it needs numpy and pyarrow only and costs them little memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1


# ---- random numbers of the JVM --------------------------------------------------------------------------------

def _murmur(data: bytes, seed: int) -> int:
    """32-bit MurmurHash3 of eight bytes."""
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    h = seed & 0xFFFFFFFF
    for (k,) in struct.iter_unpack("<I", data):
        k = (rot((k * 0xCC9E2D51) & 0xFFFFFFFF, 15) * 0x1B873593) & 0xFFFFFFFF
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & 0xFFFFFFFF
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF
    return h ^ (h >> 16)


def _step(x: int) -> int:
    x ^= (x << 21) & MASK
    x ^= x >> 35
    return x ^ ((x << 4) & MASK)


class XorShift:
    """Spark's XORShiftRandom."""

    def __init__(self, seed: int):
        data = struct.pack(">q", seed)
        low = _murmur(data, 0x3C074A61)
        self.state = (_murmur(data, low) << 32) | low

    def bits(self, n: int) -> int:
        self.state = _step(self.state)
        return self.state & ((1 << n) - 1)

    def integer(self) -> int:
        x = self.bits(32)
        return x - (1 << 32) if x >= 1 << 31 else x

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0 ** -53


class JavaRandom:
    """Longs of java.util.Random."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        x = self.state >> 16
        return x - (1 << 32) if x >= 1 << 31 else x

    def long(self) -> int:
        x = ((self._next() << 32) + self._next()) & MASK
        return x - (1 << 64) if x >= 1 << 63 else x


@cache
def _jumps(k: int) -> np.ndarray:
    """Tables of 2^k steps of the generator, which is linear over bits: (byte of the state, value) -> state."""
    table = np.zeros((8, 256), dtype=np.uint64)
    before = None if k == 0 else _jumps(k - 1)
    for byte in range(8):
        for bit in range(8):
            x = 1 << (8 * byte + bit)
            x = _step(x) if before is None else _jump(_jump(x, before), before)
            table[byte, 1 << bit] = x
        for v in range(1, 256):
            low = v & -v
            table[byte, v] = table[byte, low] ^ table[byte, v ^ low]
    return table


def _jump(x: int, table: np.ndarray) -> int:
    out = 0
    for byte in range(8):
        out ^= int(table[byte, (x >> (8 * byte)) & 255])
    return out


def uniform(seed: int, start: int, n: int, lanes: int = 8192) -> np.ndarray:
    """Doubles ``start`` to ``start + n - 1`` of XORShiftRandom(seed): lanes of the sequence run side by side."""
    x, k, skip = XorShift(seed).state, 0, 2 * start
    while skip:
        if skip & 1:
            x = _jump(x, _jumps(k))
        skip, k = skip >> 1, k + 1
    lanes = min(lanes, 1 << max(0, (n - 1).bit_length()))
    power = max(1, (2 * -(-n // lanes) - 1).bit_length())  # steps of a lane, a power of two
    state = np.array([x], dtype=np.uint64)
    at = power
    while len(state) < lanes:
        table = _jumps(at)
        ahead = np.zeros_like(state)
        for byte in range(8):
            ahead ^= table[byte][((state >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.intp)]
        state, at = np.concatenate([state, ahead]), at + 1
    used = -(-n // (1 << (power - 1)))
    state = state[:max(1, used)]
    out = np.empty(((1 << (power - 1)), len(state)))
    left, right, last = np.uint64(21), np.uint64(35), np.uint64(4)
    high, low = np.uint64((1 << 26) - 1), np.uint64((1 << 27) - 1)
    for i in range(len(out)):
        state = state ^ (state << left)
        state ^= state >> right
        state ^= state << last
        first = (state & high) << np.uint64(27)
        state = state ^ (state << left)
        state ^= state >> right
        state ^= state << last
        out[i] = first + (state & low)
    return out.T.reshape(-1)[:n] * 2.0 ** -53


# ---- blocks ---------------------------------------------------------------------------------------------------

BLOCK = "grp int, held boolean, part int, start long, n int, y binary, codes binary, widths binary, place binary, margin binary"


def _packed(column: np.ndarray) -> tuple[int, bytes]:
    """Bits of a code (1, 4, 8 or 16) and the packed column."""
    top = int(column.max()) if len(column) else 0
    if top <= 1:
        return 1, np.packbits(column.astype(np.uint8)).tobytes()
    if top <= 15:
        c = column.astype(np.uint8)
        c = np.append(c, np.uint8(0)) if len(c) % 2 else c
        return 4, (c[0::2] | (c[1::2] << 4)).tobytes()
    return (8, column.astype(np.uint8).tobytes()) if top <= 255 else (16, column.astype(np.uint16).tobytes())


def _bytes(bits: int, n: int) -> int:
    return {1: (n + 7) // 8, 4: (n + 1) // 2, 8: n, 16: 2 * n}[bits]


def _unpacked(bits: int, data: memoryview, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, np.uint16)
    raw = np.frombuffer(data, np.uint8)
    if bits == 8:
        return raw
    if bits == 1:
        return np.unpackbits(raw, count=n)
    out = np.empty(2 * len(raw), dtype=np.uint8)
    out[0::2], out[1::2] = raw & 15, raw >> 4
    return out[:n]


class Block:
    """Rows of one partition that follow each other: labels, the distinct code columns, and their place by feature."""

    def __init__(self, row: dict, picked: list[int] | None = None):
        self.group, self.held, self.part, self.start, self.n = (row[k] for k in ("grp", "held", "part", "start", "n"))
        self.y = np.unpackbits(np.frombuffer(row["y"], np.uint8), count=self.n)
        self.place = np.frombuffer(row["place"], np.uint16)
        self.place = self.place if picked is None else self.place[picked]
        self.widths = np.frombuffer(row["widths"], np.uint8)
        self.ends = np.cumsum([0, *(_bytes(int(b), self.n) for b in self.widths)])
        self.codes, self.known = memoryview(row["codes"]), {}
        self.margin = np.frombuffer(row["margin"]) if row["margin"] else None

    def column(self, at: int) -> np.ndarray:
        if at not in self.known:
            self.known[at] = _unpacked(int(self.widths[at]), self.codes[self.ends[at]:self.ends[at + 1]], self.n)
        return self.known[at]

    def feature(self, f: int) -> np.ndarray:
        return self.column(int(self.place[f]))


def pack(group: int, held: bool, part: int, start: int, y: np.ndarray, columns: list[np.ndarray]) -> dict:
    seen: dict[tuple, int] = {}
    place = np.empty(len(columns), dtype=np.uint16)
    for f, c in enumerate(columns):
        place[f] = seen.setdefault(_packed(c), len(seen))
    return {"grp": group, "held": held, "part": part, "start": start, "n": len(y), "y": np.packbits(y).tobytes(), "codes": b"".join(b for _, b in seen),
            "widths": bytes(w for w, _ in seen), "place": place.tobytes(), "margin": None}


@dataclass
class Plain:
    """A grown tree as the tasks need it: splits, depth, and the value of every place times the tree's weight."""

    splits: list[tuple[int, int, int]]
    depth: int
    values: np.ndarray

    def score(self, block: Block) -> np.ndarray:
        return self.values[places(block, self.splits, self.depth)]


def places(block: Block, splits: list[tuple[int, int, int]], depth: int) -> np.ndarray:
    """Node of every row after ``depth`` levels, counted from the left; a row of a leaf above goes left from there."""
    place = np.zeros(block.n, dtype=np.uint8 if depth <= 8 else np.uint16 if depth <= 16 else np.uint32)
    by_level: dict[int, list] = {}
    for node, f, at in splits:
        by_level.setdefault(node.bit_length() - 1, []).append((node, f, at))
    for level in range(depth):
        right = None
        for node, f, at in by_level.get(level, []):
            here = block.feature(f) > at
            if level:
                here &= place == node - (1 << level)
            right = here if right is None else np.logical_or(right, here, out=right)
        place <<= 1
        if right is not None:
            place |= right
    return place


def margins(block: Block, trees: list[Plain]) -> np.ndarray:
    m = np.zeros(block.n) if block.margin is None else block.margin.copy()
    for t in trees:
        m += t.score(block)
    return m


def blocks(batches: Iterable[pa.RecordBatch], picked: list[int] | None, held: bool | None = None) -> Iterator[Block]:
    for b in batches:
        for i in range(b.num_rows):
            if held is None or b.column(1)[i].as_py() == held:
                yield Block({c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}, picked)


def sums_row(group: int, loss: float, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([loss]), pa.array([total.tobytes()], pa.binary())], names=["grp", "loss", "sums"])
