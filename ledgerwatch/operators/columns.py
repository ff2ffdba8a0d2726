"""Choosing, dropping, aligning and renaming columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.functions.features import to_number
from ledgerwatch.operators.profile import distinct_counts, unique_shares

# Name parts of identifier and time columns, and the names that are safe despite them.
SCORING_DROP = ["id", "timestamp", "date", "heure"]
TRAINING_DROP = ["id", "_id", "identifier", "uuid", "guid", "timestamp", "time", "date", "datetime", "created", "modified", "updated"]
SAFE = ["weekday", "daytime", "holiday", "day_of"]
ID_KEEP = ["id", "number", "hash", "timestamp"]


def _hit(name: str, words: list[str]) -> bool:
    return any(w in name.lower() for w in words)


def without_ids(df: DataFrame) -> DataFrame:
    """Scoring side: drops identifier and time columns by name."""
    return df.drop(*[c for c in df.columns if _hit(c, SCORING_DROP)])


def id_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if _hit(c, ID_KEEP)]


def training_columns(df: DataFrame, unique_above: float = 0.95, exact: bool = True) -> list[str]:
    """Training side: drops by name (with safe names) or because nearly every value is unique.

    Only whole-number and text columns can be identifiers by uniqueness, and all that
    their range does not rule out are counted in one pass.
    """
    named = [c for c in df.columns if _hit(c, TRAINING_DROP) and not _hit(c, SAFE)]
    rest = [f for f in df.schema if f.name not in named and isinstance(f.dataType, (T.IntegralType, T.StringType))]
    dense: list[str] = []
    if rest and exact:
        share = unique_shares(df, [f.name for f in rest], unique_above)
        dense = [c for c, x in share.items() if x > unique_above]
    elif rest:
        n = df.count()
        uniq = {r["name"]: r["n_unique"] for r in distinct_counts(df, exact, [f.name for f in rest]).collect()}
        dense = [f.name for f in rest if n and uniq[f.name] / n > unique_above]
    return [c for c in df.columns if c not in named and c not in dense]


def drop_and_coerce(df: DataFrame, exclude: list[str]) -> DataFrame:
    """Drops a named list; text survivors become numbers, unreadable text 0."""
    kept = df.drop(*exclude)
    text = [f.name for f in kept.schema if isinstance(f.dataType, T.StringType)]
    return kept.withColumns({c: to_number(c) for c in text}) if text else kept


def align(df: DataFrame, wanted: list[str], keep: list[str] | None = None) -> DataFrame:
    """Columns of the model in its order: missing ones 0, surplus ones dropped."""
    return df.select(*(keep or []), *[F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in wanted])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def split_timestamp(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({f"{ts}_date": F.to_date(ts), f"{ts}_time": F.date_format(ts, "HH:mm:ss")})


def drop_missing_label(df: DataFrame, label: str) -> DataFrame:
    return df.na.drop(subset=[label])


def amount_columns_to_transform(df: DataFrame, amounts: list[str]) -> dict[str, str]:
    """Amount column -> ``full``, ``squared`` (already a z-score) or ``skip`` (text, or a flag)."""
    types = {f.name: f.dataType for f in df.schema}
    flags = [c for c in amounts if c.lower().startswith("is_") or "flag" in c.lower()]
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in flags]).first() if flags else {}
    out = {}
    for c in amounts:
        low = c.lower()
        if isinstance(types[c], T.StringType):
            out[c] = "skip"
        elif "zscore" in low or "z_score" in low:
            out[c] = "squared"
        elif c in flags and counts[c] <= 5:
            out[c] = "skip"
        else:
            out[c] = "full"
    return out


# Name parts used to infer the output columns.
CUSTOMER_NAMES = ("customer_id cust_id customer_ref cust_ref client_id client_ref custid clientid account_id accountid").split()
CUSTOMER_NOT = "age tenure days months years amount balance type region status date time".split()
TRANSACTION_NAMES = "transaction_id tx_id trans_id transid txid transaction_number tx_number reference ref id".split()


def output_roles(df: DataFrame) -> dict[str, str | None]:
    """Customer, transaction and time column by name and uniqueness, one counting pass."""
    cust = [c for c in df.columns if _hit(c, CUSTOMER_NAMES) and not _hit(c, CUSTOMER_NOT)]
    tx = [c for c in df.columns if _hit(c, TRANSACTION_NAMES)]
    both = list(dict.fromkeys(cust + tx))
    share = {}
    if both:
        n = df.count()
        uniq = {r["name"]: r["n_unique"] for r in distinct_counts(df, True, both).collect()}
        share = {c: uniq[c] / n if n else 0.0 for c in both}
    customer = next((c for c in cust if 0.01 <= share[c] <= 0.90), None)
    transaction = next((c for c in tx if c != customer and share[c] > 0.85), None)
    time = next((f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
                 or any(w in f.name.lower() for w in ("date", "time"))), None)
    return {"customer": customer, "transaction": transaction, "timestamp": time}
