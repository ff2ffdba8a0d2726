"""Table profiles: every statistic of every column in one aggregate pass."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.operators.ordering import exact_quantiles


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def kind(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(t, T.IntegralType):
        return "integer"
    return "boolean" if isinstance(t, T.BooleanType) else "other"


def clean_number(c: str | Column) -> Column:
    """The number as a double; NaN is missing like NULL."""
    return F.nanvl((F.col(c) if isinstance(c, str) else c).cast("double"), F.lit(None))


def without_nan(df: DataFrame) -> DataFrame:
    """The table with NULL for every NaN."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def safe_corr(x: str, y: str) -> Column:
    """Pearson r over rows where both are present; NULL when either is constant."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def melt(row: DataFrame, fields: dict[str, dict[str, Column]]) -> DataFrame:
    """One-row aggregate to one row per key of ``fields``."""
    cells = [F.struct(F.lit(k).alias("name"), *[c.alias(n) for n, c in v.items()]) for k, v in fields.items()]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def melt_numbers(df: DataFrame, cols: list[str], *others: Column) -> DataFrame:
    """(name, x, ...): one row per row and numeric column.

    Aggregating this by name keeps the generated code small however wide the table
    is, and map-side combining leaves one row per column and task to shuffle.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("name"), clean_number(c).alias("x")) for c in cols])
    return df.select(*others, F.explode(cells).alias("c")).select(*[o for o in df.select(*others).columns], "c.name", "c.x")


def value_hash(c: str) -> Column:
    """128 bits (two longs) of a value; -0.0 and 0.0 hash alike, as they group alike."""
    v = F.col(c)
    return F.struct(F.xxhash64(F.lit("a"), v).alias("h1"), F.xxhash64(F.lit("b"), v).alias("h2"))


def distinct_counts(df: DataFrame, exact: bool = True, cols: list[str] | None = None) -> DataFrame:
    """(name, n_unique) per column, NULL not counted.

    The exact form reads the table once: every row gives one narrow (column, 128-bit value hash)
    cell per present value, which Spark deduplicates inside each task before its one shuffle, then
    counts per column; whole rows are never copied per column. Equal values of a column hash alike,
    so the count is exact up to 128-bit collisions.
    """
    cols = list(df.columns) if cols is None else cols
    if not cols:
        return df.sparkSession.createDataFrame([], "name string, n_unique long")
    if not exact:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return melt(row, {c: {"n_unique": F.col(c)} for c in cols})
    plain = df.select(*[(F.col(c) + F.lit(0.0)).alias(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c)
                        for c in cols])
    cells = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), value_hash(c).alias("h"))) for i, c in enumerate(cols)])
    one = (plain.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x"))
           .select("x.i", "x.h").distinct().groupBy("i").agg(F.count("*").alias("n_unique")))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "i int, name string")
    return (names.join(F.broadcast(one), "i", "left")
            .select("name", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique")))


def unique_shares(df: DataFrame, cols: list[str], above: float = 0.95) -> dict[str, float]:
    """Distinct values per row of each column, for comparing with ``above``: where the range of a whole-number
    column holds too few values to pass it, the range is the answer and nothing is counted."""
    whole = [c for c in cols if isinstance(df.schema[c].dataType, T.IntegralType)]
    row = df.agg(F.count("*").alias("n"), *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"r{i}") for i, c in enumerate(whole)]).first()
    n, out = row["n"], {}
    if not n:
        return dict.fromkeys(cols, 0.0)
    for i, c in enumerate(whole):
        lo, hi = row[f"r{i}"]
        most = 0 if lo is None else hi - lo + 1
        if most / n <= above:
            out[c] = most / n
    rest = [c for c in cols if c not in out]
    if rest:
        out |= {x["name"]: x["n_unique"] / n for x in distinct_counts(df, True, rest).collect()}
    return out


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """name, position, dtype, n_rows, n_unique, missing, missing_pct, mean, std, min, max.

    NaN counts as missing.  Distinct counts are exact unless a sketch is asked for.
    """
    df = without_nan(df)
    nums = numeric_columns(df)
    counts = melt(df.agg(F.count("*").alias("n_rows"), *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(df.columns)]),
                  {f.name: {"position": F.lit(i), "dtype": F.lit(kind(f.dataType)), "n_rows": F.col("n_rows"), "present": F.col(f"n_{i}")}
                   for i, f in enumerate(df.schema)})
    out = counts.join(F.broadcast(distinct_counts(df, exact)), "name")
    if nums:
        row = df.agg(*[f(clean_number(c)).alias(f"{k}_{i}") for i, c in enumerate(nums)
                       for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
        stats = melt(row, {c: {k: F.col(f"{k}_{i}") for k in ("mean", "std", "min", "max")} for i, c in enumerate(nums)})
        out = out.join(F.broadcast(stats), "name", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("mean", "std", "min", "max")})
    gone = F.col("n_rows") - F.col("present")
    return out.select("name", "position", "dtype", "n_rows", "n_unique", gone.alias("missing"), (F.try_divide(gone, F.col("n_rows")) * 100).alias("missing_pct"),
                      "mean", "std", "min", "max")


def sample_values(df: DataFrame, cols: list[str], n: int = 5) -> DataFrame:
    """The n smallest distinct values of each column, as text."""
    parts = [df.select(F.col(c).alias("_v")).where("_v is not null").distinct().orderBy("_v").limit(n)
             .select(F.lit(c).alias("name"), F.col("_v").cast("string").alias("value")) for c in cols]
    return reduce(DataFrame.unionByName, parts)


def feature_summary(profile: DataFrame) -> DataFrame:
    num = F.col("dtype").isin("integer", "float")
    return profile.agg(
        F.count_if(num).alias("numerical_features"),
        F.count_if(~num & (F.col("n_unique") == 2)).alias("binary_features"),
        F.count_if(~num & (F.col("n_unique") != 2) & (F.col("n_unique") <= 50)).alias("categorical_features"),
        F.count_if(~num & (F.col("n_unique") > 50)).alias("high_cardinality_features"),
        F.count_if(F.col("missing") > 0).alias("features_with_missing"),
        F.sum("missing").alias("total_missing"), F.avg("n_unique").alias("avg_unique_values"))


def missing_and_duplicates(df: DataFrame) -> DataFrame:
    """Share of missing cells and share of rows that repeat an earlier row."""
    miss = df.agg(F.count("*").alias("n"), sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).alias("m"))
    kinds = df.groupBy(*df.columns).agg(F.count("*").alias("c")).agg(F.count("*").alias("d"))
    return miss.join(F.broadcast(kinds)).select(
        F.col("n").alias("n_rows"), F.try_divide(F.col("m"), F.col("n") * len(df.columns)).alias("missing_rate"),
        (1 - F.try_divide("d", "n")).alias("duplicate_rate"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"), F.max("n").alias("hi"), F.min("n").alias("lo"))
    return g.join(F.broadcast(total)).select(
        F.col(label).alias("label"), "n", (F.col("n") / F.col("t")).alias("ratio"),
        (F.col("hi") / F.col("lo")).alias("imbalance_ratio"))


#: A variance at most this share of the squared scale of a column counts as zero (a constant column).
CONSTANT = 1e-18


def _masked_parts(d: int):
    """Per task: (k, v) sums of the matrices of `masked_gram`, flattened one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((d, d))
        s, q, p = n.copy(), n.copy(), n.copy()
        c3, c4 = np.zeros(d), np.zeros(d)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)])
            m = ~np.isnan(x)
            x0 = np.where(m, x, 0.0)
            mf = m.astype(float)
            n += mf.T @ mf
            s += x0.T @ mf
            q += (x0 * x0).T @ mf
            p += x0.T @ x0
            c3 += (x0 ** 3).sum(axis=0)
            c4 += (x0 ** 4).sum(axis=0)
        vals = np.concatenate([n.ravel(), s.ravel(), q.ravel(), p.ravel(), c3, c4])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vals), dtype=np.int32)), pa.array(vals)], names=["k", "v"])

    return run


def masked_gram(df: DataFrame, cols: list[str]) -> dict[str, np.ndarray]:
    """Sums over the present values of `cols` (NULL, NaN and infinities are gaps), in two passes and
    without one row per cell: the means, then per task the matrices n (rows where both are present),
    s (sum of x_i where x_j is present), q (sum of x_i squared where x_j is present), p (sum of
    x_i x_j) and per column the sums of third and fourth powers, of values centred at the means.
    Spark adds the task matrices (d * d numbers each); only those reach the driver."""
    d = len(cols)
    clean = df.select(*[F.when(F.abs(clean_number(c)) < F.lit(float("inf")), clean_number(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    first = clean.agg(*[F.avg(f"_c{i}").alias(f"m{i}") for i in range(d)], *[F.max(F.abs(f"_c{i}")).alias(f"a{i}") for i in range(d)]).first()
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([first[f"a{i}"] or 0.0 for i in range(d)])
    centred = clean.select(*[(F.col(f"_c{i}") - F.lit(float(mean[i]))).alias(f"_c{i}") for i in range(d)])
    got = dict(centred.mapInArrow(_masked_parts(d), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect())
    flat = np.array([got.get(k, 0.0) for k in range(4 * d * d + 2 * d)])
    mats = [flat[i * d * d:(i + 1) * d * d].reshape(d, d) for i in range(4)]
    return {"n": mats[0], "s": mats[1], "q": mats[2], "p": mats[3], "c3": flat[4 * d * d:4 * d * d + d],
            "c4": flat[4 * d * d + d:], "scale": scale}


def gram_corr(g: dict[str, np.ndarray], i: int, j: int) -> float | None:
    """Pearson r of columns i and j over rows where both are present; None if either is constant there."""
    n = g["n"][i, j]
    if n == 0:
        return None
    mx, my = g["s"][i, j] / n, g["s"][j, i] / n
    vx, vy = g["q"][i, j] / n - mx * mx, g["q"][j, i] / n - my * my
    if vx <= CONSTANT * max(g["scale"][i] ** 2, 1e-300) or vy <= CONSTANT * max(g["scale"][j] ** 2, 1e-300):
        return None
    return float(max(-1.0, min(1.0, (g["p"][i, j] / n - mx * my) / math.sqrt(vx * vy))))


def target_correlations(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """|r| with the label per numeric column; a constant column gives NULL."""
    g = masked_gram(df.withColumn("_y", F.col(label).cast("double")), [*cols, "_y"])
    y = len(cols)
    rows = [(c, i, None if (v := gram_corr(g, i, y)) is None else abs(v)) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "name string, position int, correlation double")


def moments(df: DataFrame, cols: list[str], corrected: bool = False) -> DataFrame:
    """name, n, variance, std, skewness, kurtosis (excess).

    Population skewness and kurtosis by default; ``corrected`` gives the
    sample-size-corrected forms. All columns come from one `masked_gram` pass; a column without
    values has NULL everywhere, one value has NULL variance, a constant column NULL shape numbers.
    """
    g = masked_gram(df, cols)
    rows = []
    for i, c in enumerate(cols):
        n = g["n"][i, i]
        if n == 0:
            rows.append((c, 0.0, None, None, None, None))
            continue
        a, b = g["s"][i, i] / n, g["q"][i, i] / n
        m2 = b - a * a
        m3 = g["c3"][i] / n - 3 * a * b + 2 * a ** 3
        m4 = g["c4"][i] / n - 4 * a * g["c3"][i] / n + 6 * a * a * b - 3 * a ** 4
        flat = m2 <= CONSTANT * max(g["scale"][i] ** 2, 1e-300)
        var = None if n < 2 else max(m2, 0.0) * n / (n - 1)
        skew = None if flat else m3 / m2 ** 1.5
        kurt = None if flat else m4 / (m2 * m2) - 3.0
        if corrected and skew is not None:
            skew = skew * math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else None
        if corrected and kurt is not None:
            kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6) if n > 3 else None
        f = lambda v: None if v is None else float(v)
        rows.append((c, float(n), f(var), None if var is None else math.sqrt(var), f(skew), f(kurt)))
    return df.sparkSession.createDataFrame(rows, "name string, n double, variance double, std double, skewness double, kurtosis double")


def spread(df: DataFrame, col: str, prefix: str, parts=("max", "min", "mean")) -> list[Column]:
    how = {"max": F.max, "min": F.min, "mean": F.avg}
    return [F.coalesce(how[p](col), F.lit(0.0)).alias(f"{prefix}_{p}") for p in parts]


def meta_features(df: DataFrame, label: str) -> DataFrame:
    """The 18 numbers that describe a labelled table, one row."""
    nums = [c for c in numeric_columns(df) if c != label]
    base = missing_and_duplicates(df)
    rate = df.agg(F.avg(F.col(label).cast("double")).alias("fraud_rate"))
    corr = target_correlations(df, label, nums).agg(*spread(df, "correlation", "correlation"))
    mom = moments(df, nums).agg(*spread(df, "variance", "variance"), *spread(df, "skewness", "skewness"),
                                *spread(df, "kurtosis", "kurtosis", ("max", "mean")))
    one = base.join(F.broadcast(rate)).join(F.broadcast(corr)).join(F.broadcast(mom))
    return one.select(F.col("n_rows").alias("rows"), F.lit(len(df.columns)).alias("columns"), "fraud_rate",
                      "missing_rate", "duplicate_rate", F.lit(len(numeric_columns(df))).alias("numeric_columns"),
                      F.lit(len(text_columns(df))).alias("categorical_columns"),
                      *[c for c in one.columns if c.split("_")[0] in ("correlation", "variance", "skewness", "kurtosis")])


def amount_patterns(df: DataFrame, cols: list[str], limit: int | None = None) -> DataFrame:
    """Distribution record of the amount columns, of the first `limit` only if given."""
    cols = cols[:limit]
    q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    aggs, fields = [], {}
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                             F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("g1"),
                             F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives")).alias(c))
        n, p = F.col(f"{c}.n"), c
        fields[c] = {"mean": F.col(f"{p}.mean"), "median": F.lit(q[c][1]), "std": F.col(f"{p}.std"),
                     "min": F.col(f"{p}.min"), "max": F.col(f"{p}.max"), "q25": F.lit(q[c][0]), "q75": F.lit(q[c][2]),
                     "skewness": F.col(f"{p}.g1") * F.try_divide(F.sqrt(n * (n - 1)), n - 2),
                     "has_zeros": F.col(f"{p}.zeros"), "has_negatives": F.col(f"{p}.negatives")}
    return melt(df.agg(*aggs), fields)


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, value, n) for several columns in one shuffle; values as text, no missing."""
    return (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))
                                          for c in cols])).alias("x"))
            .where("x.value is not null").groupBy("x.name", "x.value").agg(F.count("*").alias("n")))


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per column.  Each partition first keeps its own k,
    so a column with very many values never meets in one task."""
    order = [F.desc("n"), "value"]
    part = Window.partitionBy("name", "_p").orderBy(*order)
    local = (counts.withColumn("_p", F.pmod(F.xxhash64("value"), F.lit(64)))
             .withColumn("_i", F.row_number().over(part)).where(F.col("_i") <= k))
    w = Window.partitionBy("name").orderBy(*order)
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_p", "_i")


def categorical_patterns(df: DataFrame, cols: list[str], limit: int | None = None) -> DataFrame:
    """n_unique, mode, mode share, five most frequent values, high-cardinality flag; of the first `limit` columns only if given."""
    cols = cols[:limit]
    counts = value_counts(df, cols)
    n = df.agg(F.count("*").alias("n_rows"))
    stats = counts.groupBy("name").agg(F.count("*").alias("n_unique"), F.sum("n").alias("present"))
    top = (top_values(counts, 5).groupBy("name")
           .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("t")))
    return (stats.join(top, "name").join(F.broadcast(n)).select(
        "name", "n_unique", F.col("t")[0]["value"].alias("most_common"),
        (F.col("t")[0]["n"] / F.col("present")).alias("most_common_pct"),
        F.array_join(F.col("t.value"), "|").alias("top_5_values"),
        (F.col("n_unique") > F.col("n_rows") * 0.5).cast("int").alias("is_high_cardinality")))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) for a before b; a constant column gives NULL.

    Each pair uses the rows where both are present; all pairs come from the matrices of one
    `masked_gram` pass, with or without gaps.
    """
    g = masked_gram(df, cols)
    rows = [(cols[i], cols[j], gram_corr(g, i, j)) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def rate_by(df: DataFrame, by: str | Column, label: str, name: str) -> DataFrame:
    by = F.col(by) if isinstance(by, str) else by
    return df.groupBy(by.alias(name)).agg(F.count("*").alias("n"), F.avg(label).alias("fraud_rate"))


def drop_constant(df: DataFrame) -> DataFrame:
    nums = numeric_columns(df)
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in nums]).first()
    return df.drop(*[c for c in nums if row[c] == 0])


def drop_empty(df: DataFrame, keep: tuple = (), also: tuple = ()) -> DataFrame:
    """Drops columns that are all zero, all empty or all missing, then a named list."""
    aggs = []
    for f in df.schema:
        filled = (F.col(f.name) != "") if isinstance(f.dataType, T.StringType) else (
            F.col(f.name) != 0 if is_numeric(f.dataType) else F.col(f.name).isNotNull())
        aggs.append(F.count_if(filled).alias(f.name))
    row = df.agg(*aggs).first()
    return df.drop(*[c for c in df.columns if c not in keep and row[c] == 0], *also)
