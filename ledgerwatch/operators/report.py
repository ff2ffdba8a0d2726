"""Reports over scored transactions and the threshold choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import features as ft
from ledgerwatch.operators.ordering import exact_quantiles
from ledgerwatch.operators.profile import safe_corr


def prediction_report(scored: DataFrame, p: str = "fraud_probability") -> DataFrame:
    """One row of statistics over a scored table (fraud_prediction, risk_level and, when
    present, prediction_variance / prediction_stability / is_anomaly)."""
    q = exact_quantiles(scored, {p: [0.5, 0.9, 0.95, 0.99]})[p]
    x, hit = F.col(p), F.col("fraud_prediction") == 1
    aggs = [F.count("*").alias("n_total"), F.count_if(hit).alias("n_fraud"), F.avg(x).alias("p_mean"),
            F.stddev_samp(x).alias("p_std"), F.max(x).alias("p_max"),
            *[F.count_if(F.col("risk_level") == lv).alias(f"n_{lv.lower()}") for lv in ("HIGH", "MEDIUM", "LOW")],
            F.count_if((x >= 0.8) & hit).alias("high_conf_fraud"), F.count_if((x <= 0.2) & ~hit).alias("high_conf_legit"),
            F.count_if((x > 0.2) & (x < 0.8)).alias("medium_conf")]
    if "prediction_stability" in scored.columns:
        aggs += [F.avg("prediction_stability").alias("mean_stability"), F.avg("prediction_variance").alias("mean_variance"),
                 F.count_if(F.col("prediction_stability") < 0.7).alias("n_unstable")]
    if "is_anomaly" in scored.columns:
        aggs += [F.count_if(F.col("is_anomaly") == 1).alias("n_anomaly"),
                 F.count_if(hit & (F.col("is_anomaly") == 1)).alias("fraud_and_anomaly"),
                 safe_corr("fraud_prediction", "is_anomaly").alias("corr_anomaly")]
    out = scored.agg(*aggs)
    rate = F.try_divide("n_fraud", "n_total")
    conf = F.try_divide(F.col("high_conf_fraud") + F.col("high_conf_legit"), F.col("n_total"))
    advice = {"advise_investigation": rate > 0.1, "advise_retraining": conf < 0.5}
    if "prediction_stability" in scored.columns:
        advice["advise_more_models"] = F.col("mean_stability") < 0.7
    if "is_anomaly" in scored.columns:
        advice["patterns_well_learned"] = F.col("fraud_and_anomaly") < F.col("n_fraud") * 0.3
    return out.withColumns({"fraud_rate": rate, "high_conf_rate": conf,
                            **{k: F.lit(v) for k, v in zip(("p_median", "p90", "p95", "p99"), q)},
                            **{k: ft.flag(c) for k, c in advice.items()}})


def summary_metrics(scored: DataFrame) -> DataFrame:
    """The summary sheet: (metric, value) rows."""
    row = scored.agg(F.count("*").cast("double").alias("total_transactions"),
                     F.count_if(F.col("fraud_prediction") == 1).cast("double").alias("frauds_detected"),
                     F.try_divide(F.count_if(F.col("fraud_prediction") == 1), F.count("*")).alias("fraud_rate"),
                     F.avg("fraud_probability").alias("mean_probability"), F.max("fraud_probability").alias("max_probability"),
                     F.count_if(F.col("risk_level") == "HIGH").cast("double").alias("high_risk"),
                     F.count_if(F.col("risk_level") == "MEDIUM").cast("double").alias("medium_risk"),
                     F.count_if(F.col("risk_level") == "LOW").cast("double").alias("low_risk"))
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def ensemble_record(scored: DataFrame) -> DataFrame:
    """Performance record of an ensemble: tiers at 0.7 and 0.5 on the combined score."""
    c = F.col("combined_score")
    return scored.agg(
        F.count("*").alias("total_transactions"), F.count_if(F.col("fraud_prediction") == 1).alias("fraud_detected"),
        F.avg("fraud_probability").alias("avg_probability"), F.avg(c).alias("avg_combined_score"),
        F.count_if(F.col("is_anomaly") == 1).alias("anomalies"), F.count_if(c >= 0.7).alias("high_risk"),
        F.count_if((c >= 0.5) & (c < 0.7)).alias("medium_risk"), F.count_if(c < 0.5).alias("low_risk"))


def unlabelled_summary(scored: DataFrame) -> DataFrame:
    c = F.col("fraud_probability_calibrated")
    hit = F.count_if(F.col("fraud_prediction") == 1)
    return scored.agg(
        F.count("*").alias("total_transactions"), hit.alias("frauds_detected"), (F.try_divide(hit, F.count("*")) * 100).alias("fraud_rate"),
        F.count_if(c >= 0.7).alias("high_risk"), F.count_if((c >= 0.5) & (c < 0.7)).alias("medium_risk"),
        F.count_if(c < 0.5).alias("low_risk"), F.count_if(F.col("anomaly_score") > 0.5).alias("anomalies_detected"),
        (1 - F.avg("prediction_variance")).alias("prediction_stability"))


def adaptive_thresholds(scored: DataFrame, score: str = "combined_score") -> dict:
    """Lowers (high, medium) from (0.50, 0.40) in steps of 0.05 until 3-8 % of the rows
    reach the medium threshold; above the range the current pair stays.

    All candidate cut-offs are counted in one pass; the choice needs seven numbers.
    When six rounds do not reach 3 % the last pair tried is returned as not converged.
    """
    pairs = []
    high, medium = 50, 40
    for _ in range(6):
        pairs.append((high, medium))
        if (high, medium) == (15, 10):
            break
        high, medium = max(high - 5, 15), max(medium - 5, 10)
    row = scored.agg(F.count("*").alias("n"),
                     *[F.count_if(F.col(score) >= m / 100).alias(f"m{i}") for i, (_, m) in enumerate(pairs)]).first()
    for i, (h, m) in enumerate(pairs):
        share = row[f"m{i}"] / row["n"] if row["n"] else 0.0
        if share >= 0.03:
            return {"high": h / 100, "medium": m / 100, "share": share, "rounds": i + 1, "converged": True}
    return {"high": h / 100, "medium": m / 100, "share": share, "rounds": len(pairs), "converged": False}


def tiered_output(scored: DataFrame, customer: str | None, transaction: str, timestamp: str | None,
                  high: float, medium: float) -> DataFrame:
    """The delivered table: ids, probabilities, scores, tier and 0/1 decision."""
    level = ft.tier("combined_score", high, medium)
    cols = [] if customer is None else [F.col(customer).alias("Customer_ID")]
    cols.append(F.col(transaction).alias("Transaction_ID"))
    if timestamp is not None:
        cols.append(F.col(timestamp).alias("Timestamp"))
    named = {"Fraud_Probability": "fraud_probability", "Prediction_Variance": "prediction_variance",
             "Prediction_Stability": "prediction_stability", "Anomaly_Score": "anomaly_score", "Is_Anomaly": "is_anomaly",
             "Combined_Score": "combined_score", "Fraud_Probability_Calibrated": "fraud_probability_calibrated"}
    return scored.select(*cols, *[F.col(v).alias(k) for k, v in named.items()], level.alias("Risk_Level"),
                         (level != "LOW").cast("int").alias("Fraude"))


def top_frauds(scored: DataFrame, key: str, n: int = 10, p: str = "fraud_probability") -> DataFrame:
    return scored.orderBy(F.desc(p), key).limit(n)


def high_risk(scored: DataFrame, key: str, p: str = "fraud_probability") -> DataFrame:
    return scored.where(F.col("risk_level") == "HIGH").orderBy(F.desc(p), key)
