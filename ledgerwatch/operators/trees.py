"""Boosted trees over binned rows kept on disk.

MLlib's trainer keeps one object per training row, with four bytes per feature, in the storage memory of the
executors and writes those that do not fit with Java serialisation, so beyond the memory every level of every
tree reads and rebuilds all of them.  Here a partition of training rows is one block of byte codes (equal
columns of a block once, few bins packed), stored on disk and read as arrays: a level of a tree is one pass over
the blocks that adds up gradient histograms, and scores so far are made again from the codes.

Split candidates, row samples, feature samples, gains, stopping and pruning follow MLlib's rules and random
numbers, so the trees are those that `GBTClassifier.fit` grows on the same rows in the same partitions; the
result is a `GBTClassificationModel`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.operators.blocks import BLOCK, JavaRandom, Plain, XorShift, blocks, margins, pack, places, sums_row, uniform

#: Most rows of a block; a partition of the fit rarely holds more.
BLOCK_ROWS = 131_072
#: Trees after which the scores so far are written beside the codes instead of being made again in every pass.
SCORE_EVERY = 16
#: Groups of partitions that are summed up by one task each (the square root of the partitions, if more). Groups
#: depend on the partitions only and sums are added in their order, so the trees do not depend on cores or timing.
GROUPS = 128
#: Sums of a pass that reach the driver; those of more groups are added up in this many tasks first.
GATHER = 512
#: Blocks handed to a Python worker at a time, in bytes.
BATCH_BYTES = "4194304"
SUMS = "grp int, loss double, sums binary"
EPSILON = 2.0 ** -52


# ---- split candidates -----------------------------------------------------------------------------------------

def sampled_positions(counts: list[int], fraction: float, seed: int) -> list[list[int]]:
    """Positions that ``RDD.sample`` takes out of partitions of so many rows."""
    draws, out = JavaRandom(XorShift(seed).integer()), []
    for n in counts:
        rng, got = XorShift(draws.long()), []
        if fraction <= 0.4:
            log = math.log1p(-fraction)
            at = int(math.log(max(rng.double(), 5e-11)) / log)
            while at < n:
                got.append(at)
                at += 1 + int(math.log(max(rng.double(), 5e-11)) / log)
        else:
            got = [i for i in range(n) if rng.double() <= fraction]
        out.append(got)
    return out


def candidates(values: np.ndarray, weights: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Thresholds between sampled values, about equal weight between them."""
    some = values != 0.0
    at, where = np.unique(values[some], return_inverse=True)
    if not len(at):
        return np.empty(0)
    weight = np.bincount(where, weights[some])
    missing = expected - weight.sum()
    if missing > EPSILON * int(some.sum()) * 100:
        k = int(np.searchsorted(at, 0.0))
        at, weight = np.insert(at, k, 0.0), np.insert(weight, k, missing)
    if len(at) - 1 <= most:
        return (at[:-1] + at[1:]) / 2.0
    stride = expected / (most + 1)
    found, seen, target = [], float(weight[0]), stride
    for i in range(1, len(at)):
        before, seen = seen, seen + float(weight[i])
        if abs(before - target) < abs(seen - target):
            found.append((at[i - 1] + at[i]) / 2.0)
            target += stride
    return np.array(found)


# ---- blocks ----------------------------------------------------------------------------------------------------

def _binner(thresholds: list[np.ndarray], per_group: int) -> Callable:
    def code(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of thresholds below each value; comparing whole columns is faster than searching by value."""
        if len(at) > 64:
            return np.searchsorted(at, x).astype(np.uint8 if len(at) < 256 else np.uint16)
        out, above = np.zeros(len(x), np.uint8), np.empty(len(x), bool)
        for t in at:
            out += np.greater(x, t, out=above).view(np.uint8)
        return out

    schema = pa.schema([("grp", pa.int32()), ("held", pa.bool_()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int32()),
                        *[(c, pa.binary()) for c in ("y", "codes", "widths", "place", "margin")]])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        parts: dict[bool, list] = {False: [], True: []}
        size, start = {False: 0, True: 0}, {False: 0, True: 0}

        def flush(held: bool) -> pa.RecordBatch:
            got, parts[held] = parts[held], []
            y = np.concatenate([g[0] for g in got])
            row = pack(part // per_group, held, part, start[held], y, [np.concatenate([g[1][f] for g in got]) for f in range(len(thresholds))])
            start[held], size[held] = start[held] + len(y), 0
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            held = b.column(0).to_numpy(zero_copy_only=False)
            y = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            codes = [code(b.column(2 + f).to_numpy(zero_copy_only=False), t) for f, t in enumerate(thresholds)]
            for side in (False, True):
                rows = np.flatnonzero(held == side)
                if len(rows):
                    parts[side].append((y, codes) if len(rows) == len(y) else (y.take(rows), [c.take(rows) for c in codes]))
                    size[side] += len(rows)
                if size[side] >= BLOCK_ROWS:
                    yield flush(side)
        for side in (False, True):
            if size[side]:
                yield flush(side)

    return bins


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the bytes of a batch for plans made and run inside; a bound that the session sets is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(name)


@dataclass
class Binned:
    """Training and held-out rows as blocks, with what was counted and fitted on the way."""

    df: DataFrame
    thresholds: list[np.ndarray]
    positive_weight: float
    weight: float  # of all training rows
    held_weight: float
    groups: int
    picked: list[int] | None = None

    def of(self, features: list[int]) -> Binned:
        """The same blocks with some of their features, in the order given."""
        return replace(self, thresholds=[self.thresholds[f] for f in features], picked=features)

    def unpersist(self) -> None:
        self.df.unpersist()


def binned(raw: DataFrame, make: Callable[[DataFrame, list[str]], DataFrame], columns: list[str], label: str, held: str,
           seed: int, positive_weight: float | None = None, bins: int = 32) -> Binned:
    """Blocks of the rows of ``raw``, which are stored.

    ``held`` is a boolean column, true for rows that are not trained on; ``make(rows, keep)`` adds the feature
    columns row by row.  Without a given weight positive rows weigh negatives / max(positives, 1) of the training rows.
    """
    y = F.col(label)
    got = (raw.groupBy(F.spark_partition_id().alias("part"), F.col(held).alias("held"))
           .agg(F.count("*").alias("n"), F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")).collect())
    if any(x["pos"] + x["neg"] != x["n"] for x in got):
        raise ValueError(f"labels of {label} must be 0 or 1")
    fit, held_out = [x for x in got if not x["held"]], [x for x in got if x["held"]]
    n, pos, neg, out_pos, out_neg = (sum(x[k] for x in rows) for rows, k in ((fit, "n"), (fit, "pos"), (fit, "neg"), (held_out, "pos"), (held_out, "neg")))
    if not n:
        raise ValueError("there are no training rows")
    weight = neg / max(pos, 1) if positive_weight is None else positive_weight
    parts = max(x["part"] for x in got) + 1
    counts = [0] * parts
    for x in fit:
        counts[x["part"]] = x["n"]
    # the sample is drawn by position before features are made, so only its rows are
    need = max(bins * bins, 10_000)
    fraction = need / n if need < n else 1.0
    rows = raw.where(~F.col(held))
    if fraction < 1.0:
        ids = [((p << 33) + i,) for p, at in enumerate(sampled_positions(counts, fraction, seed)) for i in at]
        chosen = raw.sparkSession.createDataFrame(ids, "_id long")
        rows = rows.withColumn("_id", F.monotonically_increasing_id()).join(F.broadcast(chosen), "_id", "left_semi")
    table = make(rows, [label]).toArrow()
    w = np.where(table.column(0).to_numpy() == 1, weight, 1.0)
    whole = float(np.cumsum(w)[-1]) if fraction == 1.0 else neg + pos * weight
    thresholds = [candidates(table.column(1 + f).to_numpy(), w, fraction * whole, min(bins, n) - 1) for f in range(len(columns))]
    cells = make(raw, [held, label]).select(held, F.col(label).cast("int"), *columns)
    per_group = -(-parts // max(GROUPS, math.isqrt(parts)))
    groups = -(-parts // per_group)
    df = cells.mapInArrow(_binner(thresholds, per_group), BLOCK)
    if per_group > 1:
        df = df.repartitionById(groups, F.col("grp")).sortWithinPartitions("part", "held", "start")
    return Binned(df.persist(StorageLevel.DISK_ONLY), thresholds, weight, whole, out_neg + out_pos * weight, groups)


# ---- trees ----------------------------------------------------------------------------------------------------

@dataclass
class Node:
    """A node while a tree grows: weight, sum and sum of squares of the labels, rows, and its split."""

    id: int
    stats: tuple | None = None  # (weight, sum, squares, rows)
    impurity: float = 0.0
    gain: float = math.nan
    valid: bool = True
    value: float | None = None
    feature: int = -1
    at: int = -1
    left: Node | None = None
    right: Node | None = None

    @property
    def level(self) -> int:
        return self.id.bit_length() - 1

    @property
    def prediction(self) -> float:
        if self.value is not None:
            return self.value
        return self.stats[1] / self.stats[0] if self.stats[0] else 0.0

    def splits(self) -> list[tuple[int, int, int]]:
        """(node, feature, last code that goes left) of every split below, upper levels first."""
        out, level = [], [self]
        while level:
            inner = [x for x in level if x.left is not None]
            out += [(x.id, x.feature, x.at) for x in inner]
            level = [y for x in inner for y in (x.left, x.right)]
        return out

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else [*self.left.leaves(), *self.right.leaves()]


def _variance(weight, total, squares):
    """Impurity of label sums; 0 without weight."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight == 0, 0.0, (squares - total * total / weight) / weight)


def plain(root: Node, weight: float) -> Plain:
    """A grown tree as the tasks need it."""
    leaves = root.leaves()
    depth = max(x.level for x in leaves)
    values = np.zeros(1 << depth)
    for x in leaves:
        values[(x.id - (1 << x.level)) << (depth - x.level)] = x.prediction * weight
    return Plain(root.splits(), depth, values)


def _pass(data: Binned, trees: list[Plain], splits: list, depth: int, nodes: list[int], features: list[int], seed: int, rate: float, error: bool
          ) -> tuple[np.ndarray, float]:
    """One pass: (feature, node, bin, statistic) sums over the sampled training rows in ``nodes`` of the growing tree
    and the summed loss of the held-out rows, under the trees so far."""
    weight, picked, size = data.positive_weight, data.picked, max((len(t) + 1 for t in data.thresholds), default=1)
    slots = np.full(1 << depth, len(nodes), dtype=np.intp)
    for i, node in enumerate(nodes):
        slots[node - (1 << depth)] = i

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, loss = -1, np.zeros((len(features), len(nodes) * size, 4)), 0.0
        for b in blocks(batches, picked):
            if b.group != group:
                if group >= 0:
                    yield sums_row(group, loss, total)
                group, total, loss = b.group, np.zeros_like(total), 0.0
            sign = b.y * 2.0 - 1.0
            row_weight = np.where(b.y == 1, weight, 1.0)
            if b.held:
                if error:
                    loss += float((row_weight * 2.0 * np.logaddexp(0.0, -2.0 * sign * margins(b, trees))).sum())
                continue
            if not nodes:
                continue
            at = slots[places(b, splits, depth)]
            use = at < len(nodes)
            if rate < 1.0:
                use &= uniform(seed + b.part + 1, b.start, b.n) < rate
            use = np.flatnonzero(use)  # taking rows by number is faster than by mask
            if trees or b.margin is not None:
                with np.errstate(over="ignore"):
                    goal = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margins(b, trees)))
            else:
                goal = sign
            base, w, goal = at.take(use) * size, row_weight.take(use), goal.take(use)
            weighted = w * goal
            squared = weighted * goal
            found: dict[int, np.ndarray] = {}
            for i, f in enumerate(features):
                p = int(b.place[f])
                if p not in found:
                    cell = base + b.column(p).take(use)
                    found[p] = np.stack([np.bincount(cell, v, len(nodes) * size) for v in (w, weighted, squared, None)], axis=1)
                total[i] += found[p]
        if group >= 0:
            yield sums_row(group, loss, total)

    spark = data.df.sparkSession
    with small_batches(spark):
        got = data.df.mapInArrow(sums, SUMS)
        if data.groups > GATHER:
            got = (got.repartition(GATHER, F.floor(F.col("grp") / -(-data.groups // GATHER))).sortWithinPartitions("grp")
                   .mapInArrow(_added(-(-data.groups // GATHER)), SUMS))
        got = sorted(got.collect(), key=lambda x: x["grp"])
    total, loss = np.zeros((len(features), len(nodes), size, 4)), 0.0
    for x in got:
        total += np.frombuffer(x["sums"]).reshape(total.shape)
        loss += x["loss"]
    return total, loss


def _added(per: int) -> Callable:
    """Adds up the sums of ``per`` groups that follow each other."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, loss = -1, None, 0.0
        for b in batches:
            for g, lost, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = np.frombuffer(sums.as_py())
                if g // per != group:
                    if group >= 0:
                        yield sums_row(group, loss, total)
                    group, total, loss = g // per, np.zeros_like(x), 0.0
                total, loss = total + x, loss + lost
        if group >= 0:
            yield sums_row(group, loss, total)

    return add


def _choose(node: Node, sums: np.ndarray, subset: list[int], thresholds: list[np.ndarray], least: tuple[int, float, float], split: bool) -> None:
    """Best split of a node from its sums (feature in the order of the subset, bin, statistic); the first of equals.
    ``least`` rows, weight and gain make a split; only the sums are kept unless ``split``."""
    best = None
    for f, cells in zip(subset, sums):
        k = len(thresholds[f])
        if not k:
            continue
        run = np.cumsum(cells[:k + 1], axis=0)
        left, whole = run[:k], run[k]
        right = whole - left
        if node.stats is None:  # the root takes its sums from the first split looked at
            first = left[0] + right[0]
            node.stats = tuple(first[:3]) + (int(left[0, 3]) + int(right[0, 3]),)
            node.impurity = float(_variance(*first[:3]))
        total = left[:, 0] + right[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = node.impurity - left[:, 0] / total * _variance(*left[:, :3].T) - right[:, 0] / total * _variance(*right[:, :3].T)
        poor = (np.minimum(left[:, 3], right[:, 3]) < least[0]) | (np.minimum(left[:, 0], right[:, 0]) < least[1]) | (gain < least[2])
        gain = np.where(poor, -np.finfo(float).max, gain)
        i = int(np.argmax(gain))
        if best is None or gain[i] > best[0] or (math.isnan(gain[i]) and not math.isnan(best[0])):
            best = (float(gain[i]), f, i, left[i], right[i], not poor[i])
    if best is None:  # no feature has a threshold
        whole = sums[0].sum(axis=0)
        node.stats = node.stats or tuple(whole[:3]) + (int(whole[3]),)
        node.impurity, node.gain, node.valid = float(_variance(*node.stats[:3])), -np.finfo(float).max, False
        return
    node.gain, node.valid = best[0], best[5]
    if split and best[5] and not best[0] <= 0:
        node.feature, node.at = best[1], best[2]
        node.left, node.right = (Node(2 * node.id + i, tuple(x[:3]) + (int(x[3]),), float(_variance(*x[:3]))) for i, x in enumerate(best[3:5]))


def _subset(count: int, k: int, seed: int) -> list[int]:
    """Reservoir sample of ``k`` feature numbers."""
    out, rng = list(range(k)), XorShift(seed)
    for item in range(k, count):
        at = int(rng.double() * (item + 1))
        if at < k:
            out[at] = item
    return out


def _grow(data: Binned, est: GBTClassifier, trees: list[Plain], seed: int, go_on: Callable[[float], bool] | None) -> Node | None:
    """One tree on the gradients under the trees so far. ``go_on`` is asked with the loss of the held-out rows under
    those, known after the first pass; nothing is returned if it says no."""
    count, depth, room = len(data.thresholds), est.getMaxDepth(), est.getMaxMemoryInMB() * 1024 * 1024
    k = min(count, math.ceil(float(est.getFeatureSubsetStrategy()) * count))
    least = (est.getMinInstancesPerNode(), est.getMinWeightFractionPerNode() * data.weight, est.getMinInfoGain())
    rng, root = JavaRandom(seed), Node(1)
    stack = [root]
    while stack:
        group, used = [], 0
        while stack:
            subset = _subset(count, k, rng.long()) if k != count else list(range(count))
            need = 8 * 3 * sum(len(data.thresholds[f]) + 1 for f in subset)
            if used and used + need > room:
                break
            group.append((stack.pop(0), subset))
            used += need
        splits, sums = root.splits(), {}
        for level in sorted({x.level for x, _ in group}):  # a group cut by its size may hold nodes of two levels
            here = [(x, s) for x, s in group if x.level == level]
            features = sorted({f for _, s in here for f in s})
            got, loss = _pass(data, trees, splits, level, [x.id for x, _ in here], features, seed, est.getSubsamplingRate(), go_on is not None)
            if go_on is not None and not go_on(loss):
                return None
            go_on = None
            for i, (x, s) in enumerate(here):
                sums[x.id] = got[[features.index(f) for f in s], i]
        for x, subset in group:
            _choose(x, sums[x.id], subset, data.thresholds, least, x.level < depth)
            for child in (x.left, x.right):
                if child is not None and child.level < depth and abs(child.impurity) >= EPSILON:
                    stack.insert(0, child)
    return _pruned(root)


def _pruned(x: Node) -> Node:
    """Leaves of one value become one."""
    if x.left is not None:
        left, right = _pruned(x.left), _pruned(x.right)
        if left.left is None and right.left is None and left.prediction == right.prediction:
            x.value, x.left, x.right = left.prediction, None, None
    return x


def _scored(data: Binned, trees: list[Plain]) -> Binned:
    """The same blocks with the scores so far beside the codes."""
    names, picked = [c.split()[0] for c in BLOCK.split(", ")], data.picked

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [margins(x, trees).tobytes() for x in blocks([b], picked)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.binary())], names=names)

    with small_batches(data.df.sparkSession):
        out = replace(data, df=data.df.mapInArrow(add, BLOCK).persist(StorageLevel.DISK_ONLY))
        out.df.count()
    return out


def grow(data: Binned, est: GBTClassifier, validate: bool) -> list[tuple[Node, float]]:
    """(tree, weight) of the boosted trees; with ``validate`` growth ends when the loss of the held-out rows stops
    falling, and trees after the smallest loss are left out."""
    seed, rate, most, tol = est.getSeed(), est.getStepSize(), est.getMaxIter(), est.getValidationTol()
    best, kept = math.inf, 0

    def better(loss: float) -> bool:
        nonlocal best, kept
        loss /= data.held_weight
        if kept and best - loss < tol * max(loss, 0.01):
            return False
        if not kept or loss < best:
            best, kept = loss, len(out)
        return True

    state, recent, out = data, [], []
    judge = better if validate and data.held_weight > 0 else None
    while len(out) < most:
        tree = _grow(state, est, recent, seed + len(out), judge if out else None)
        if tree is None:
            break
        out.append((tree, rate if out else 1.0))
        recent.append(plain(*out[-1]))
        if len(recent) == SCORE_EVERY and len(out) < most:
            before, state, recent = state, _scored(state, recent), []
            if before is not data:
                before.unpersist()
    else:
        if judge is not None:
            judge(_pass(state, recent, [], 0, [], [], seed, 1.0, True)[1])
    if state is not data:
        state.unpersist()
    return out[:kept] if judge is not None else out


def model(data: Binned, est: GBTClassifier, trees: list[tuple[Node, float]]) -> GBTClassificationModel:
    """The grown trees as MLlib's model."""
    spark = data.df.sparkSession
    gateway, ml = spark.sparkContext._gateway, spark._jvm.org.apache.spark.ml
    variance = spark._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def doubles(values):
        out = gateway.new_array(gateway.jvm.double, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return out

    def node(x: Node):
        stats = variance(doubles(x.stats[:3]), int(x.stats[3]))
        if x.left is None:
            return ml.tree.LeafNode(float(x.prediction), float(x.impurity) if x.valid else -1.0, stats)
        split = ml.tree.ContinuousSplit(x.feature, float(data.thresholds[x.feature][x.at]))
        return ml.tree.InternalNode(float(x.prediction), float(x.impurity), float(x.gain), node(x.left), node(x.right), split, stats)

    count = len(data.thresholds)
    roots = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    for i, (x, _) in enumerate(trees):
        roots[i] = ml.regression.DecisionTreeRegressionModel(node(x), count)
    est._transfer_params_to_java()
    made = ml.classification.GBTClassificationModel(est.uid, roots, doubles([w for _, w in trees]), count, 2)
    made = est._java_obj.copyValues(made, est._java_obj.extractParamMap())
    return est._copyValues(GBTClassificationModel(made))


def score_counts(data: Binned, forests: list[list[tuple[Node, float]]], bins: int, held: bool | None = None) -> DataFrame:
    """(config, _bin, _pos, _neg): rows (the held-out ones, the training rows or all) per forest and bin of their
    probability, by label."""
    ready, picked = [[plain(*t) for t in f] for f in forests], data.picked

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(ready), bins, 2), dtype=np.int64)
        for b in blocks(batches, picked, held):
            for i, f in enumerate(ready):
                p = 1.0 / (1.0 + np.exp(-2.0 * margins(b, f)))
                cell = np.clip(np.floor(p * bins), 0, bins - 1).astype(np.intp) * 2 + (b.y == 0)
                found[i] += np.bincount(cell, minlength=2 * bins).reshape(bins, 2)
        config, at = np.nonzero(found.sum(axis=2))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(config, pa.int32()), pa.array(at, pa.int32()), *(pa.array(found[config, at, j]) for j in (0, 1))],
                                             names=["config", "_bin", "_pos", "_neg"])

    got = data.df.mapInArrow(count, "config int, _bin int, _pos long, _neg long")
    return got.groupBy("config", "_bin").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
