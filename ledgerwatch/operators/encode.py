"""Imputation, label codes and scaling.  Statistics are fitted once over the whole
table and applied as literals or small joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import features as ft
from ledgerwatch.operators.ordering import at_most, exact_quantiles, global_rank

BROADCAST_CODES = 100_000
LITERAL_CODES = 1_000


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    med = exact_quantiles(df, {c: [0.5] for c in cols})
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)),
                                         F.lit(med[c][0])) for c in cols})


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent value per column, smallest value on ties; one pass for all columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                         for c in cols])).alias("x")).where("x.v is not null")
    counts = long.groupBy("x.c", "x.v").agg(F.count("*").alias("n"))
    most = counts.groupBy("c").agg(F.max("n").alias("n"))
    tied = (counts.join(F.broadcast(most), ["c", "n"])
            .groupBy("c").agg(F.min("v").alias("v")).collect())
    found = {x["c"]: x["v"] for x in tied}
    return {c: found.get(c) for c in cols}


def impute_mode(df: DataFrame, cols: list[str]) -> DataFrame:
    m = modes(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m[c] if m[c] is not None else "Unknown")) for c in cols})


def fit_label_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code): position of the text among the sorted distinct texts."""
    long = (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value"))
        for c in cols])).alias("x")).select("x.*").distinct())
    ranked = global_rank(long, ["column", "value"], "pos")
    first = ranked.groupBy("column").agg(F.min("pos").alias("first"))
    return (ranked.join(F.broadcast(first), "column")
            .select("column", "value", (F.col("pos") - F.col("first")).alias("code")))


def small_code_maps(codes: DataFrame) -> dict[str, dict[str, int]] | None:
    """The code table as plain dictionaries when it has at most ``LITERAL_CODES`` rows."""
    rows = codes.limit(LITERAL_CODES + 1).collect()
    if len(rows) > LITERAL_CODES:
        return None
    out: dict[str, dict[str, int]] = {}
    for x in rows:
        out.setdefault(x["column"], {})[x["value"]] = int(x["code"])
    return out


def code_from_map(c: str, mapping: dict[str, int], unseen: int = -1):
    pairs = F.create_map(*[F.lit(v) for kv in sorted(mapping.items()) for v in kv])
    return F.coalesce(pairs[F.coalesce(F.col(c).cast("string"), F.lit("nan"))], F.lit(unseen))


def apply_label_codes(df: DataFrame, codes: DataFrame, cols: list[str], suffix: str = "",
                      unseen: int = -1) -> DataFrame:
    """Replaces each text by its fitted code.  The code table is broadcast only when
    its checked size allows it; otherwise it is an ordinary equi-join."""
    small = at_most(codes, BROADCAST_CODES)
    out = df
    for c in cols:
        side = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        side = F.broadcast(side) if small else side
        key = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        out = (out.join(side, key == F.col(f"_v_{c}"), "left")
               .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"_c_{c}"), F.lit(unseen)))
               .drop(f"_v_{c}", f"_c_{c}"))
    return out


def scale_min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    e = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols]).first()
    return df.withColumns({f"{c}_norm": ft.min_max(F.col(c).cast("double"), float(e[c]["lo"]), float(e[c]["hi"]))
                           for c in cols})


def scale_standard(df: DataFrame, cols: list[str]) -> DataFrame:
    """Population deviation, as in common machine-learning scalers."""
    s = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).first()
    return df.withColumns({f"{c}_std": ft.zscore(c, s[c]["m"], s[c]["s"] or 1.0) for c in cols})


def scale_robust(df: DataFrame, cols: list[str]) -> DataFrame:
    q = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    return df.withColumns({f"{c}_robust": ft.zscore(c, q[c][1], (q[c][2] - q[c][0]) or 1.0) for c in cols})


def add_zscore(df: DataFrame, col: str) -> DataFrame:
    s = df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).first()
    if not s["s"]:
        return df
    z = ft.zscore(col, s["m"], s["s"])
    return df.withColumns({"amount_zscore": z, "is_high_amount": ft.flag(z > 2)})
