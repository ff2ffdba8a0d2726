"""Fixture mapping: the driver tables in the roles of the fraud domain, plus the
registry of named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def r(c: Column | str, digits: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def big(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


def events(spark, d) -> DataFrame:
    """Events as transactions: value is the amount, k the second amount, error the label."""
    return (table(spark, d, "events")
            .withColumns({"k": F.get_json_object("props", "$.k").cast("int"),
                          "is_error": (F.col("event_type") == "error").cast("int")}))


EV = """ev AS (SELECT *, CAST(props->>'k' AS INT) AS k, CAST(event_type = 'error' AS INT) AS is_error FROM events)"""


def lines(spark, d) -> DataFrame:
    """Order lines with the learnable label and a text key that is unique per row."""
    li = table(spark, d, "lineitem")
    return li.withColumns({
        "is_fraud": ((F.col("l_quantity") > 45) & (F.col("l_discount") >= 0.06)).cast("int"),
        "line_id": F.concat_ws("-", *[F.col(c).cast("string") for c in
                                      ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                               F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))})


LI = """li AS (SELECT *, CAST(l_quantity > 45 AND l_discount >= 0.06 AS INT) AS is_fraud,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice*100) AS BIGINT)) AS line_id
  FROM lineitem)"""


def rule_scores(df: DataFrame) -> DataFrame:
    """Three rule-based probabilities on order lines, standing in for model outputs
    where a query checks the arithmetic after the model."""
    return df.withColumns({
        "p1": F.col("l_quantity") / 50.0,
        "p2": F.col("l_discount") * 10.0,
        "p3": (F.col("l_quantity") / 50.0) * (F.col("l_discount") * 10.0)})


RS = LI + """, rs AS (SELECT *, l_quantity/50.0::DOUBLE AS p1, l_discount*10.0::DOUBLE AS p2,
  (l_quantity/50.0::DOUBLE)*(l_discount*10.0::DOUBLE) AS p3 FROM li)"""


# ---- a catalogue of feeds: every user is one data set, its columns are the names its events report
FEED_WORDS = [
    "amount", "montant", "tx_amt", "timestamp", "date", "client_id", "customer_ref", "card_type",
    "is_fraud", "dest_country", "balance_after", "merchant_category", "currency", "device_id", "iban",
    "hour", "weekday", "policy_months", "wallet", "atm_cash", "email", "ratio_squared", "qty_2", "label"]
FEED_JOINS = ["_", " ", "-"]


def feed_columns(spark, d) -> DataFrame:
    """(dataset, col_name, position, n_rows, n_unique, dtype): one row per data set and
    column; data set = user, so the catalogue grows with the users."""
    ev = events(spark, d)
    word = F.element_at(F.array(*[F.lit(w) for w in FEED_WORDS]), (F.col("k") % len(FEED_WORDS)) + 1)
    sep = F.element_at(F.array(*[F.lit(s) for s in FEED_JOINS]),
                       (F.floor(F.col("k") / len(FEED_WORDS)) % 3).cast("int") + 1)
    named = ev.withColumn("col_name", F.concat("event_type", sep, word))
    return (named.groupBy(F.col("user_id").alias("dataset"), "col_name")
            .agg(F.count("*").alias("n_rows"), F.min("event_id").alias("position"),
                 F.count_distinct("value").alias("n_unique"), F.min("k").alias("min_k"))
            .withColumn("dtype", F.when(F.col("min_k") % 2 == 0, "double").otherwise("string"))
            .drop("min_k"))


FC = EV + f""", fc AS (SELECT user_id AS dataset,
   event_type || (['_',' ','-'])[CAST(floor(k/{len(FEED_WORDS)}) AS INT) % 3 + 1]
     || ({FEED_WORDS!r})[k % {len(FEED_WORDS)} + 1] AS col_name,
   count(*) AS n_rows, min(event_id) AS position, count(DISTINCT value) AS n_unique,
   CASE WHEN min(k) % 2 = 0 THEN 'double' ELSE 'string' END AS dtype
   FROM ev GROUP BY 1, 2)"""


def importance_table(spark, d) -> DataFrame:
    """(dataset, feature, importance): data set = supplier; the importance of a feature is
    its share of the supplier's revenue."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    suffix = F.element_at(F.array(*[F.lit(s) for s in FEATURE_ENDINGS]), F.col("l_linenumber").cast("int"))
    per = (li.join(part, li.l_partkey == part.p_partkey)
           .groupBy(F.col("l_suppkey").alias("dataset"),
                    F.concat(F.lower("p_type"), suffix).alias("feature"))
           .agg(F.sum("l_extendedprice").alias("v")))
    total = per.groupBy("dataset").agg(F.sum("v").alias("t"))
    return per.join(total, "dataset").select("dataset", "feature", F.round(F.col("v") / F.col("t"), 9).alias("importance"))


FEATURE_ENDINGS = ["_log", "_bin", "_x_qty", "_hour", "_is_high", "_sqrt", "_raw"]

IM = f"""im0 AS (SELECT l_suppkey AS dataset,
    lower(p_type) || ({FEATURE_ENDINGS!r})[l_linenumber] AS feature, sum(l_extendedprice) AS v
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
 im AS (SELECT dataset, feature, round(v / sum(v) OVER (PARTITION BY dataset), 9) AS importance FROM im0)"""


def grid_table(spark, d) -> DataFrame:
    """Grid-search records: data set = brand, one configuration per part, its scores from
    the part's order lines."""
    part, li = table(spark, d, "part"), table(spark, d, "lineitem")
    s = li.groupBy("l_partkey").agg(
        F.round(F.avg(F.col("l_discount") * 10), 9).alias("mean_test_f1"),
        F.round(F.avg(F.col("l_tax") * 12.5), 9).alias("mean_test_precision"),
        F.round(F.avg(F.col("l_quantity") / 50), 9).alias("mean_test_recall"),
        F.round(F.lit(0.5) + F.avg(F.col("l_quantity") / 100), 9).alias("mean_test_roc_auc"),
        F.round(F.coalesce(F.stddev_samp("l_discount"), F.lit(0.0)), 9).alias("std_test_f1"))
    return (part.join(s, part.p_partkey == s.l_partkey)
            .select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("config_id"),
                    (F.lit(3) + F.col("p_size") % 8).alias("max_depth"),
                    (F.lit(0.01) * (F.lit(1) + F.col("p_partkey") % 30)).alias("learning_rate"),
                    (F.lit(0.5) + F.lit(0.05) * (F.col("p_partkey") % 11)).alias("subsample"),
                    (F.lit(0.1) * (F.col("p_partkey") % 6)).alias("gamma"),
                    (F.lit(50) * (F.lit(1) + F.col("p_size") % 10)).alias("n_estimators"),
                    "mean_test_f1", "mean_test_precision", "mean_test_recall", "mean_test_roc_auc",
                    "std_test_f1"))


GR = """gr0 AS (SELECT l_partkey, round(avg(l_discount*10),9) AS mean_test_f1, round(avg(l_tax*12.5::DOUBLE),9) AS mean_test_precision,
    round(avg(l_quantity/50),9) AS mean_test_recall, round(0.5+avg(l_quantity/100),9) AS mean_test_roc_auc,
    round(coalesce(stddev_samp(l_discount),0),9) AS std_test_f1 FROM lineitem GROUP BY 1),
 gr AS (SELECT p_brand AS dataset, p_partkey AS config_id, 3 + p_size % 8 AS max_depth,
    0.01::DOUBLE*(1 + p_partkey % 30) AS learning_rate, 0.5::DOUBLE + 0.05::DOUBLE*(p_partkey % 11) AS subsample,
    0.1::DOUBLE*(p_partkey % 6) AS gamma, 50*(1 + p_size % 10) AS n_estimators,
    mean_test_f1, mean_test_precision, mean_test_recall, mean_test_roc_auc, std_test_f1
    FROM part JOIN gr0 ON p_partkey = l_partkey)"""
