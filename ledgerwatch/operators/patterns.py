"""Suspicious-behaviour detectors over one customer's transaction history.

Production defaults are the parameters of each keyword argument; fixtures pass
smaller ones.  All of them use the keyed helpers, so a customer holding a large
share of the rows is processed in time chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.features import flag
from ledgerwatch.operators import keyed
from ledgerwatch.operators.ordering import global_rank, order_statistics

HOUR = 3_600_000_000
DAY = 24 * HOUR


def smurfing(df: DataFrame, cust: str, ts: str, amount: str, lo: float = 30_000, hi: float = 150_000,
             days: int = 10, min_tx: int = 15, hot_rows: int = keyed.HOT_ROWS) -> DataFrame:
    """Many mid-sized amounts within the look-back; adds smurf_count, smurf_total, is_smurfing."""
    small = F.col(amount).between(lo, hi)
    out = keyed.rolling_totals(df, cust, ts, days * DAY, {
        "smurf_count": small.cast("bigint"),
        "smurf_total": F.when(small, F.col(amount)).otherwise(0).cast("decimal(20,4)")}, hot_rows)
    return out.withColumn("is_smurfing", flag(small & (F.col("smurf_count") >= min_tx)))


def dormant_wakeup(df: DataFrame, cust: str, ts: str, tie: str, amount: str, gap_days: float = 90,
                   min_amount: float = 500_000, hot_rows: int = keyed.HOT_ROWS) -> DataFrame:
    out = keyed.previous_value(df, cust, ts, tie, keyed.micros(ts), "_before", hot_rows)
    gap = keyed.micros(ts) - F.col("_before")
    return (out.withColumn("gap_seconds", F.floor(gap / 1_000_000))
            .withColumn("is_dormant_wakeup", flag((gap >= int(gap_days * DAY)) & (F.col(amount) >= min_amount)))
            .drop("_before"))


def unusual_amount(df: DataFrame, cust: str, ts: str, tie: str, amount: str, factor: float = 10,
                   hot_rows: int = keyed.HOT_ROWS) -> DataFrame:
    """Amount at least ``factor`` times the customer's mean so far."""
    out = keyed.prior_totals(df, cust, ts, tie, {"_n": F.lit(1).cast("bigint"),
                                                 "_s": F.col(amount).cast("decimal(20,4)")}, hot_rows)
    mean = F.col("_s").cast("double") / F.col("_n")
    return (out.withColumn("prior_mean", mean)
            .withColumn("is_unusual_amount", flag(F.col(amount) >= mean * factor)).drop("_n", "_s"))


def beneficiary_concentration(df: DataFrame, cust: str, ts: str, tie: str, beneficiary: str, days: int = 21,
                              min_tx: int = 10, hot_rows: int = keyed.HOT_ROWS) -> DataFrame:
    """Many transactions in the look-back that reach at most two beneficiaries."""
    out = keyed.rolling_totals(df, cust, ts, days * DAY, {"window_count": F.lit(1).cast("bigint")}, hot_rows)
    out = keyed.rolling_at_most_two(out, cust, ts, tie, beneficiary, days * DAY, "_two", hot_rows)
    return out.withColumn("is_concentrated", flag(F.col("_two") & (F.col("window_count") >= min_tx))).drop("_two")


def burst(df: DataFrame, cust: str, ts: str, condition: Column, days: int = 7, min_tx: int = 5,
          hot_rows: int = keyed.HOT_ROWS) -> DataFrame:
    """Rows meeting the condition of which enough lie within the look-back."""
    out = keyed.rolling_totals(df, cust, ts, days * DAY, {"burst_count": flag(condition).cast("bigint")}, hot_rows)
    return out.withColumn("is_burst", flag(condition & (F.col("burst_count") >= min_tx)))


def high_velocity(df: DataFrame, cust: str, ts: str, hours: int = 6, min_tx: int = 8,
                  hot_rows: int = keyed.HOT_ROWS) -> DataFrame:
    out = keyed.rolling_totals(df, cust, ts, hours * HOUR, {"velocity": F.lit(1).cast("bigint")}, hot_rows)
    return out.withColumn("is_high_velocity", flag(F.col("velocity") >= min_tx))


def newest_renumbered(df: DataFrame, ts: str, tie: str, n: int, name: str = "seq") -> DataFrame:
    """The n newest rows with sequential ids 1..n in time order."""
    total = df.count()
    if total > n:
        cut = order_statistics(df, [(keyed.micros(ts), total - n)])[0]
        kept = df.where(keyed.micros(ts) >= cut)
        extra = kept.count() - n
    else:
        kept, extra = df, 0
    ranked = global_rank(kept, [ts, tie], name)
    return ranked.where(F.col(name) > extra).withColumn(name, F.col(name) - extra)
