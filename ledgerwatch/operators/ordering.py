"""Order statistics, global ranks and running totals that never need one task
to hold all rows.

Small inputs (a checked row count) take the short built-in route; larger ones
narrow or range-partition the values first.  Both routes give the same result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.session import cut_lineage

ROW_LIMIT = 100_000
BINS = 1024


@dataclass
class _Target:
    """The ``k``-th smallest (from 0) of column ``value`` among its non-null rows."""

    value: str
    k: int
    lo: float = 0.0
    hi: float = 0.0
    below: int = 0
    inside: int = 0
    answer: float | None = None

    @property
    def interval(self) -> tuple:
        return self.value, self.lo, self.hi


def order_statistics(df: DataFrame, wanted: list[tuple[Column, int]],
                     row_limit: int = ROW_LIMIT, known: list[tuple] | None = None) -> list:
    """k-th smallest values; each wanted item is (numeric column, k from 0).

    ``known`` gives (lower bound, upper bound, non-null count) per item when the
    caller has them, which saves the pass that measures them.
    Every pass is one map-side-combined histogram per open interval, so the
    driver sees at most ``BINS`` counts for each of them.
    """
    if not wanted:
        return []
    columns: dict[str, tuple[str, Column]] = {}
    targets = []
    for v, k in wanted:
        name, _ = columns.setdefault(str(v), (f"v{len(columns)}", v))
        targets.append(_Target(name, k))
    vals = df.select(*[c.alias(n) for n, c in columns.values()])
    if known is None:
        ends = vals.agg(*[F.struct(F.min(n), F.max(n), F.count(n)).alias(n) for n in vals.columns]).first()
        known = [tuple(ends[t.value]) for t in targets]
    for t, (lo, hi, n) in zip(targets, known):
        t.lo, t.hi, t.inside = lo, hi, n
        if t.inside == 0 or not 0 <= t.k < t.inside:
            raise ValueError(f"rank {t.k} is outside the {t.inside} values")
    while True:
        for t in targets:
            if t.answer is None and t.lo == t.hi:
                t.answer = t.lo
        pending = [t for t in targets if t.answer is None]
        if not pending:
            return [t.answer for t in targets]
        small = [t for t in pending if t.inside <= row_limit]
        _finish(vals, small)
        _narrow(vals, [t for t in pending if t.inside > row_limit])


def _intervals(items: list[_Target]) -> dict[tuple, list[_Target]]:
    out: dict[tuple, list[_Target]] = {}
    for t in items:
        out.setdefault(t.interval, []).append(t)
    return out


def _within(key: tuple) -> Column:
    value, lo, hi = key
    return F.col(value).between(F.lit(lo), F.lit(hi))


def _members(vals: DataFrame, groups: dict[tuple, list[_Target]], extra=None) -> DataFrame:
    """(g, v, ...): the values inside each open interval; ``g`` is the number of the interval as text.

    Unpivoting instead of filtering keeps an expensive value expression evaluated once and makes no object per row.
    """
    cells = vals.select(*[F.when(_within(k), F.col(k[0])).alias(str(i)) for i, k in enumerate(groups)])
    long = cells.unpivot([], cells.columns, "g", "v").where(F.col("v").isNotNull())
    if extra is None:
        return long
    cell = F.lit(None)
    for i, (_, lo, hi) in reversed(list(enumerate(groups))):
        cell = F.when(F.col("g") == str(i), extra(F.col("v"), lo, hi)).otherwise(cell)
    return long.withColumn("cell", cell.cast("int"))


def _finish(vals: DataFrame, items: list[_Target]) -> None:
    """The intervals hold at most the row limit each: sort them and read the ranks."""
    groups = _intervals(items)
    if not groups:
        return
    ranks = F.array(*[F.array(*[F.lit(t.k - t.below) for t in ts]) for ts in groups.values()])
    got = (_members(vals, groups).groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("s"))
           .select(F.col("g").cast("int").alias("g"), F.transform(ranks[F.col("g").cast("int")], lambda k: F.get("s", k)).alias("a")).collect())
    answers = {r["g"]: r["a"] for r in got}
    for i, ts in enumerate(groups.values()):
        for t, a in zip(ts, answers[i]):
            t.answer = a


def _narrow(vals: DataFrame, items: list[_Target]) -> None:
    groups = _intervals(items)
    if not groups:
        return

    def cell(v, lo, hi):
        width = (hi - lo) / BINS
        if math.isinf(hi - lo):  # infinite ends are cells of their own; too wide an interval is cut at zero
            n = F.when(v == -math.inf, 0).when(v == math.inf, 3).when(v < 0, 1).otherwise(2)
        elif width == 0:  # neighbouring numbers
            n = F.when(v == F.lit(lo), 0).otherwise(1)
        else:
            n = F.least(F.lit(BINS - 1), F.floor((v - F.lit(lo)) / F.lit(width)).cast("int"))
        return n

    hist: dict[int, list] = {}
    for r in (_members(vals, groups, cell).groupBy("g", "cell")
              .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()):
        hist.setdefault(int(r["g"]), []).append(r)
    for i, ts in enumerate(groups.values()):
        bins = sorted(hist[i], key=lambda r: r["cell"])
        for t in ts:
            before = t.below
            for r in bins:
                if t.k < before + r["n"]:
                    if len(bins) == 1 and (t.lo, t.hi) == (r["lo"], r["hi"]):
                        raise RuntimeError(f"the interval {t.lo} to {t.hi} does not shrink")
                    t.lo, t.hi, t.below, t.inside = r["lo"], r["hi"], before, r["n"]
                    break
                before += r["n"]


def exact_quantiles(df: DataFrame, probs: dict[str, list[float]],
                    row_limit: int = ROW_LIMIT) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column, as plain numbers on the driver."""
    cols = list(probs)
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in cols}
    ends = df.agg(*[F.struct(F.min(value[c]), F.max(value[c]), F.count(value[c])).alias(c) for c in cols]).first()
    counts = {c: ends[c][2] for c in cols}
    out: dict[str, list] = {c: [None] * len(probs[c]) for c in cols}
    direct = [c for c in cols if 0 < counts[c] <= row_limit]
    if direct:
        row = df.agg(*[F.percentile(value[c], F.array(*[F.lit(float(p)) for p in probs[c]])).alias(c)
                       for c in direct]).first()
        for c in direct:
            out[c] = list(row[c])
    wanted, place, known = [], [], []
    for c in cols:
        if counts[c] > row_limit:
            for j, p in enumerate(probs[c]):
                pos = p * (counts[c] - 1)
                lo, hi = math.floor(pos), math.ceil(pos)
                place.append((c, j, len(wanted), pos - lo, hi > lo))
                wanted.append((value[c], lo))
                if hi > lo:
                    wanted.append((value[c], hi))
                known += [tuple(ends[c])] * (len(wanted) - len(known))
    if wanted:
        got = order_statistics(df, wanted, row_limit, known)
        for c, j, at, part, two in place:
            out[c][j] = got[at] + (got[at + 1] - got[at]) * part if two and got[at] != got[at + 1] else got[at]
    return out


def approx_quantiles(df: DataFrame, probs: dict[str, list[float]], accuracy: int = 10_000):
    """One-pass sketch version for exploratory runs; not used where parity matters."""
    row = df.agg(*[F.percentile_approx(c, [float(p) for p in ps], accuracy).alias(c)
                   for c, ps in probs.items()]).first()
    return {c: list(row[c]) for c in probs}


def at_most(df: DataFrame, n: int) -> bool:
    """True when the frame has at most ``n`` rows; reads no more than needed."""
    return df.limit(n + 1).count() <= n


def running_totals(df: DataFrame, order_cols: list, measures: dict[str, Column],
                   row_limit: int = ROW_LIMIT) -> DataFrame:
    """Inclusive running total of each measure in a global, unique order.

    Beyond the checked limit the rows are range-partitioned and written once;
    each partition adds up its own rows and the few per-partition totals are
    shifted on the driver.
    """
    named = df
    if at_most(df, row_limit):
        w = Window.orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
        return named.withColumns({k: F.sum(m).over(w) for k, m in measures.items()})
    keep = df.columns
    tmp = {f"_m_{k}": m for k, m in measures.items()}
    ranged = cut_lineage(df.withColumns(tmp).orderBy(*order_cols)
                         .withColumn("_part", F.spark_partition_id()))
    per_part = (ranged.groupBy("_part").agg(*[F.sum(f"_m_{k}").alias(k) for k in measures])
                .orderBy("_part").collect())
    base, shifts = {k: 0 for k in measures}, []
    for r in per_part:
        shifts.append((r["_part"], *[str(base[k]) for k in measures]))
        base = {k: base[k] + (r[k] or 0) for k in measures}
    types = {f.name: f.dataType.simpleString() for f in
             ranged.agg(*[F.sum(f"_m_{k}").alias(k) for k in measures]).schema}
    shift = df.sparkSession.createDataFrame(
        shifts, "_part int, " + ", ".join(f"`_b_{k}` string" for k in measures))
    shift = shift.withColumns({f"_b_{k}": F.col(f"_b_{k}").cast(types[k]) for k in measures})
    w = Window.partitionBy("_part").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.withColumns({k: F.sum(f"_m_{k}").over(w) for k in measures})
            .join(F.broadcast(shift), "_part")
            .select(*keep, *[(F.col(k) + F.col(f"_b_{k}")).alias(k) for k in measures]))


def global_rank(df: DataFrame, order_cols: list, name: str = "rank",
                row_limit: int = ROW_LIMIT) -> DataFrame:
    """1-based position in a global, unique order."""
    return running_totals(df, order_cols, {name: F.lit(1).cast("bigint")}, row_limit)
