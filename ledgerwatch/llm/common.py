"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1
#: Words whose hash a Python worker remembers before it starts anew (below 100 MB).
WORD_CACHE = 400_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    have = {c.lower() for c in df.columns}
    name = f"llm_{name}"
    while name.lower() in have:
        name += "_"
    return name


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes:
    """64-bit hashes of words, remembered up to a fixed number per worker."""

    def __init__(self, limit: int = WORD_CACHE):
        self.seen: dict[bytes, int] = {}
        self.limit = limit

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        seen, new = self.seen, xxhash.xxh3_64_intdigest
        if len(seen) > self.limit:
            seen.clear()
        out = [seen.get(w) for w in tokens]
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    w = tokens[i]
                    out[i] = seen[w] = new(w)
        return np.array(out, dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in a row, number of words of each text): the hashes of WordHashes over `words`,
    computed once per distinct word of the array."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pieces.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
    real = np.asarray(pc.binary_length(flat.dictionary)) > 0  # space at the ends of a text splits off empty pieces
    codes = flat.indices.to_numpy(zero_copy_only=False)
    kept = real[codes]
    row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(pieces)))
    return hashes[codes[kept]], np.bincount(row[kept], minlength=len(texts))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of `size` words; a shorter sequence is one window, none gives none."""
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), dtype=np.uint64)
    for k in range(min(size, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    return mix(out)


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start[0]:start[0]+count[0]], flat[start[1]:...], ... in a row."""
    total = int(count.sum())
    first = np.cumsum(count) - count
    return flat[np.repeat(start - first, count) + np.arange(total)]


def arrow_rows(batches: Iterator[pa.RecordBatch], rows: int = 4096, text: str = "text",
               size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that their texts stay below `size` bytes unless one row is larger."""
    for b in batches:
        column = b.column(b.schema.get_field_index(text))
        lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0))
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (total + n > size or i - start >= rows):
                yield b.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < b.num_rows:
            yield b.slice(start)


def released(run: Callable) -> Callable:
    """The task function, which hands unused memory back at its end: the worker lives on, idle or in another stage."""
    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)
    return task


#: Bytes of rows that Spark hands a Python worker at a time; each batch lies in the executor and in the worker, going and coming.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch where the session sets no bound (Spark's own: 64 MB, or 10,000 whole texts)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: read again after the loss of an executor, not computed again."""
    return cut_lineage(df)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def components(nodes: DataFrame, edges: DataFrame, every: int = 2) -> DataFrame:
    """(node, component): smallest node reachable over undirected edges (a, b); nodes has `node`."""
    found = smallest_reachable(edges).select(F.col("a").alias("node"), "c")
    return nodes.join(found, "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(a, c): for every node of the undirected edges (a, b) the smallest node it reaches.

    Alternates minimum over neighbours and pointer jumping, so the number of rounds grows with the
    logarithm of the longest chain; every round is joins and one grouped minimum and is
    checkpointed. A node that has many edges is pre-aggregated before its shuffle. Up to LOCAL_EDGES edges
    the rounds would be many jobs over next to no rows: one task joins them.
    """
    if edges.count() <= LOCAL_EDGES:
        kind = dict(edges.dtypes)["a"]
        return edges.select("a", "b").coalesce(1).mapInArrow(_joined, f"a {kind}, c {kind}")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settled(both.filter("a <> b").distinct())
    label = settled(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("c")))
    while True:
        pulled = (both.join(label.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b")
                  .groupBy("a").agg(F.min("cb").alias("m")))
        near = label.join(pulled, "a").select("a", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        # what a node learns, its former root learns too; then everybody jumps to its root's label
        told = (near.groupBy(F.col("old").alias("a")).agg(F.min("c").alias("m")))
        near = (near.join(told, "a", "left").select("a", "old", F.least("c", "m").alias("c")))
        jump = near.select(F.col("a").alias("c"), F.col("c").alias("cc"))
        new = settled(near.join(jump, "c", "left").select("a", "old", F.least("c", "cc").alias("c")))
        changed = new.filter("c < old").limit(1).count()
        label = new.select("a", "c")
        if not changed:
            return label


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component) of every node of the edges."""
    root, kind = {}, None

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for b in batches:
        kind = b.column(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(root.setdefault(x, x)), top(root.setdefault(y, y))
            root[max(x, y)] = min(x, y)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), kind), pa.array([top(x) for x in root], kind)], names=["a", "c"])


#: Edges up to which one task joins them (some 30 MB).
LOCAL_EDGES = 200_000
#: Narrow sides up to so many rows are sent to every executor (16 to 32 bytes a row).
BROADCAST_ROWS = 300_000


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a settled narrow side for broadcast if its counted rows stay below the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def written(df: DataFrame) -> DataFrame:
    """Parquet table in the shared checkpoint folder, for results too wide or long for a checkpoint."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        return settled(df)
    path = f"{folder}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions inside delete their shuffle files at their end; their result must be written or collected, not kept as a plan."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def emptied(df: DataFrame) -> None:
    """Frees the files of a table from `written` that is read no more."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    if len(folders) == 1 and (folder := folders.pop()).rpartition("/")[2].startswith("llm-"):
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)
