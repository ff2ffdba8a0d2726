"""Queries that train, score, save, stream and move data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwatch.functions import features as ft
from ledgerwatch.operators import automl, boosting, engineering, isolation, report
from ledgerwatch.operators import registry as rg
from ledgerwatch.operators import versions as vs
from ledgerwatch.operators import evaluate as ev
from ledgerwatch.operators import matching as mt
from ledgerwatch.operators import selection as sl
from ledgerwatch.plans.base import (EV, GR, IM, LI, RS, big, events, feed_columns, grid_table, importance_table, lines,
                                    query, r, rule_scores, table)
from ledgerwatch.plans.catalogue import TARGET_COLUMNS, feed_rates
from ledgerwatch.plans.scoring import EN, scored
from ledgerwatch.sources import readers, writers
from ledgerwatch.streaming import jobs

QUICK = {"n_estimators": 10, "max_depth": 4}
AMOUNTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ROLES = {"id": ["l_orderkey", "l_partkey", "l_suppkey", "line_id"], "amount": AMOUNTS, "time": ["l_shipdate"],
         "categorical": ["l_returnflag", "l_linestatus"], "numeric": ["l_linenumber"]}


def rules(df):
    return engineering.fit_rules(df, "is_fraud", ROLES)


def quick_model(df, seed: int = 42, measure: bool = False, trees: int = 10) -> boosting.FraudModel:
    return boosting.train(df, "is_fraud", "line_id", None, {**QUICK, "n_estimators": trees}, seed, measure=measure, roles=ROLES)


@query("f24_rule_engineering", f"""WITH {LI}, q AS (SELECT quantile_cont(l_extendedprice,0.05) AS a, quantile_cont(l_extendedprice,0.95) AS b, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem)
 SELECT line_id, l_linenumber::DOUBLE AS l_linenumber, round(ln(1+l_extendedprice),4) AS l_extendedprice_log, greatest(0, least(9, ceil((l_extendedprice-mn)/((mx-mn)/10))-1))::DOUBLE AS l_extendedprice_bin,
 (l_extendedprice > b)::INT::DOUBLE AS l_extendedprice_is_high, (l_extendedprice < a)::INT::DOUBLE AS l_extendedprice_is_low, month(l_shipdate)::DOUBLE AS transaction_month, (isodow(l_shipdate)-1)::DOUBLE AS transaction_weekday,
 (dense_rank() OVER (ORDER BY l_returnflag)-1)::DOUBLE AS l_returnflag, (dense_rank() OVER (ORDER BY l_linestatus)-1)::DOUBLE AS l_linestatus FROM li, q""")
def f24(spark, d):
    li = lines(spark, d)
    x = rules(li).transform(li, ["line_id"])
    return x.select("line_id", "l_linenumber", r("l_extendedprice_log").alias("l_extendedprice_log"), "l_extendedprice_bin", "l_extendedprice_is_high",
                    "l_extendedprice_is_low", "transaction_month", "transaction_weekday", "l_returnflag", "l_linestatus")


FLAGS = {"polynomial": 0.9, "interaction": 0.9, "binning": 0.9, "log_transform": 0.9, "aggregation": 0.9}


@query("f23_flag_engineering", f"""WITH {EV}, q AS (SELECT list_distinct(quantile_cont(value,[0.0,0.2,0.4,0.6,0.8,1.0])) AS e FROM ev)
 SELECT event_id, round(value*value,4) AS value_squared, round(value*value*value/1e3,4) AS value_cubed_k, round(value*k,4) AS value_x_k, round(value*hour(ts),4) AS value_x_hour,
 greatest(0, len(list_filter(e, lambda x: x < value)) - 1)::DOUBLE AS value_bin, round(value/(k+1e-6),2) AS value_div_k, round(sin(2*pi()*hour(ts)/24),4) AS hour_sin, round(cos(2*pi()*(isodow(ts)-1)/7),4)+0.0 AS weekday_cos,
 (isodow(ts)>=6)::INT::DOUBLE AS is_weekend, (hour(ts)>=22 OR hour(ts)<=6)::INT::DOUBLE AS is_night, (hour(ts) BETWEEN 9 AND 17)::INT::DOUBLE AS is_business_hours,
 (count(*) OVER (PARTITION BY user_id))::DOUBLE AS user_id_tx_count, round(avg(value) OVER (PARTITION BY user_id),8) AS user_id_avg_amount FROM ev, q""")
def f23(spark, d):
    e = events(spark, d).withColumns({"hour": F.hour("ts"), "weekday": F.weekday("ts")}).select("event_id", "user_id", "value", "k", "hour", "weekday")
    f = engineering.fit_flags(e.drop("event_id"), FLAGS, ["value", "k"], ["hour", "weekday"], "user_id")
    x = f.transform(e, ["event_id"])
    dig = {"value_div_k": 2, "user_id_avg_amount": 8}
    return x.select("event_id", r(F.col("value_cubed") / 1e3).alias("value_cubed_k"), (r("weekday_cos") + 0.0).alias("weekday_cos"), *[r(c, dig.get(c, 4)).alias(c) for c in (
        "value_squared", "value_x_k", "value_x_hour", "value_bin", "value_div_k", "hour_sin", "is_weekend", "is_night", "is_business_hours", "user_id_tx_count", "user_id_avg_amount")])


def table_model(spark, d) -> automl.TableModel:
    """The whole path from a raw labelled table: label, identifiers dropped, features engineered on
    training rows, kept by cumulative importance, trees trained on those."""
    return automl.fit_table(lines(spark, d), "line_id", "is_fraud", params=QUICK)


@query("l1_train_boosted_trees")
def l1(spark, d):
    m = table_model(spark, d).model
    keys = ["test_auc", "test_f1", "train_f1", "precision", "recall", "avg_precision", "n_features", "n_trees"]
    return spark.createDataFrame([(k, float(m.performance[k])) for k in keys], "metric string, value double")


@query("l2_default_parameters", "SELECT 'lineitem' AS source, count(*) AS n_rows, 6 AS max_depth, 300 AS n_estimators, 0.1::DOUBLE AS learning_rate, 0.8::DOUBLE AS subsample, 5 AS min_child_weight FROM lineitem")
def l2(spark, d):
    c = boosting.classifier()
    return table(spark, d, "lineitem").agg(F.lit("lineitem").alias("source"), F.count("*").alias("n_rows"), F.lit(c.getMaxDepth()).alias("max_depth"), F.lit(c.getMaxIter()).alias("n_estimators"),
                                           F.lit(c.getStepSize()).alias("learning_rate"), F.lit(c.getSubsamplingRate()).alias("subsample"), F.lit(c.getMinInstancesPerNode()).alias("min_child_weight"))


@query("l3_grid_search")
def l3(spark, d):
    li = lines(spark, d)
    f = engineering.FittedFeatures([], AMOUNTS)
    return boosting.grid_search(li, "is_fraud", "line_id", f, {"max_depth": [2, 4]}, {"learning_rate": [0.1, 0.3]}, folds=3, base={"n_estimators": 3})


FOLD_SQL = f"""WITH {RS}, s AS (SELECT 1 AS config, l_orderkey % 3 AS fold, is_fraud AS label, p1 AS p FROM rs
   UNION ALL SELECT 2, l_orderkey % 3, is_fraud, p2 FROM rs UNION ALL SELECT 3, l_orderkey % 3, is_fraud, p3 FROM rs),
 c AS (SELECT config, fold, CAST(least(greatest(floor(p * 1000), 0), 999) AS INT) AS bin, count(*) FILTER (WHERE label = 1) AS pos,
   count(*) FILTER (WHERE label = 0) AS neg FROM s WHERE p IS NOT NULL AND label IN (0, 1) GROUP BY 1, 2, 3),
 w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY config, fold ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM c),
 m AS (SELECT config, fold, sum(CASE WHEN bin >= 500 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN bin >= 500 THEN neg ELSE 0 END) AS fp,
   sum(CASE WHEN bin < 500 THEN pos ELSE 0 END) AS fn, sum(pos * nb + 0.5 * pos * neg) AS pairs, sum(pos) AS np_, sum(neg) AS nn FROM w GROUP BY 1, 2),
 q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
   CASE WHEN np_ > 0 AND nn > 0 THEN pairs / (np_ * nn) END AS roc_auc FROM m),
 f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM q)
SELECT config, round(avg(f1),6) AS mean_test_f1, round(stddev_pop(f1),6) AS std_test_f1, round(avg(precision),6) AS mean_test_precision, round(stddev_pop(precision),6) AS std_test_precision, round(avg(recall),6) AS mean_test_recall, round(stddev_pop(recall),6) AS std_test_recall, round(avg(roc_auc),6) AS mean_test_roc_auc, round(stddev_pop(roc_auc),6) AS std_test_roc_auc FROM f GROUP BY config"""


@query("l3_fold_metrics", FOLD_SQL)
def l3_fold_metrics(spark, d):
    """The fold evaluator of the grid search on a fixed score table: three rule scores as configurations,
    folds by order key."""
    rs = rule_scores(lines(spark, d))
    fold = (F.col("l_orderkey") % 3).alias("fold")
    s = (rs.select(F.lit(1).alias("config"), fold, F.col("is_fraud").alias("label"), F.col("p1").alias("p"))
         .unionByName(rs.select(F.lit(2).alias("config"), fold, F.col("is_fraud").alias("label"), F.col("p2").alias("p")))
         .unionByName(rs.select(F.lit(3).alias("config"), fold, F.col("is_fraud").alias("label"), F.col("p3").alias("p"))))
    names = ("f1", "precision", "recall", "roc_auc")
    out = ev.fold_summary(ev.binned_metrics(s, ["config", "fold"]), ["config"], names)
    return out.select("config", *[r(f"{w}_test_{n}", 6).alias(f"{w}_test_{n}") for n in names for w in ("mean", "std")])


@query("l4_model_importances")
def l4(spark, d):
    return sl.with_cumulative(quick_model(lines(spark, d)).importances())


@query("l5_predict_probability")
def l5(spark, d):
    li = lines(spark, d)
    return quick_model(li).probabilities(li, ["line_id", "is_fraud"])


@query("l6_apply_pipeline")
def l6(spark, d):
    return automl.apply_table(lines(spark, d), table_model(spark, d), "line_id", ["l_suppkey", "l_shipdate"])


@query("l6_decisions", f"WITH {LI} SELECT line_id, is_fraud AS fraud_prediction FROM li")
def l6_decisions(spark, d):
    """Decisions of the model fitted on the raw table by `fit_table`; the label is a rule of two columns
    that the trees learn, so they must equal it row for row."""
    return l6(spark, d).select("line_id", "fraud_prediction")


def segment_models(spark, d):
    """Three models, each trained on the lines of one return flag, with their similarities."""
    li = lines(spark, d)
    return [(f"segment_{f}", quick_model(li.where(F.col("l_returnflag") == f), seed=i, trees=5), w)
            for i, (f, w) in enumerate((("A", 0.9), ("N", 0.8), ("R", 0.7)))]


@query("l7_model_ensemble")
def l7m(spark, d):
    return boosting.ensemble_scores(lines(spark, d), ["line_id"], [(m, w) for _, m, w in segment_models(spark, d)])


@query("l8_isolation_forest")
def l8(spark, d):
    li = lines(spark, d)
    s = rule_scores(li).select("line_id", *AMOUNTS, F.col("p3").alias("fraud_probability"))
    return isolation.add_anomaly(s, "line_id", AMOUNTS).select("line_id", "fraud_probability", "anomaly_score", "is_anomaly", "combined_score")


@query("l15_ensemble_for_new_table")
def l15(spark, d):
    """Ensemble for a new table, committed as one version: the bundle (base models, similarities,
    weights, methods), the registry row of the ensemble and the usage of its base models change
    together; the query reads the bundle and usage back from the committed version."""
    reg = feed_rates(spark, d).select("dataset", F.col("n_rows").alias("dataset_size"), "fraud_rate")
    sims = mt.similarity(TARGET_COLUMNS, feed_columns(spark, d))
    top = mt.registry_match(sims, reg, 60, 0.15, 3)
    total = top.agg(F.sum("score").alias("t"))
    bundle = top.join(F.broadcast(total)).select(F.col("dataset").alias("base_model"), "similarity", "score", (F.col("score") / F.col("t")).alias("weight"),
                                                 F.lit("ensemble,anomaly,calibration").alias("methods"))
    row = bundle.agg(F.lit("ensemble_new_table").alias("model_name"), F.count("*").alias("n_base_models"),
                     F.sum(F.col("weight") * F.col("similarity")).alias("similarity"), F.lit(True).alias("is_active"))
    log = bundle.select(F.col("base_model").cast("string").alias("model_name"), F.current_timestamp().alias("used_at"),
                        F.col("base_model").cast("string").alias("i"), F.col("similarity").alias("s"))
    use = rg.usage(log, "model_name", "used_at", "i", "s")
    root = writers.scratch(spark, "l15-registry")
    version = vs.commit(spark, root, {"bundle": bundle, "registry": row, "usage": use})
    back = vs.read(spark, root, "bundle", version).withColumn("_m", F.col("base_model").cast("string"))
    used = vs.read(spark, root, "usage", version).select(F.col("model_name").alias("_m"), "usage_count")
    return back.join(used, "_m", "left").select("base_model", "similarity", "score", "weight", "methods",
                                                F.lit(version).alias("version"), "usage_count")


# ---- sources and sinks -------------------------------------------------------------------------------------

LINE_SQL = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, epoch_us(l_shipdate) AS ship_us FROM lineitem"


def line_cols(df):
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
                     F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ship_us"))


@query("s1_csv_scan", LINE_SQL)
def s1(spark, d):
    li = table(spark, d, "lineitem")
    p = writers.write_as(li, writers.scratch(spark, "csv"), "csv")
    return line_cols(readers.read_csv(spark, p, li.schema))


@query("s2_json_scan", LINE_SQL)
def s2(spark, d):
    li = table(spark, d, "lineitem")
    p = writers.write_as(li, writers.scratch(spark, "json"), "json")
    return line_cols(readers.read_json(spark, p, li.schema, records=False))


@query("s3_parquet_materialised", LINE_SQL)
def s3(spark, d):
    li = table(spark, d, "lineitem")
    base = writers.scratch(spark, "mat")
    writers.write_as(li, f"{base}/csv", "csv")
    readers.read_materialized(spark, f"{base}/csv", f"{base}/parquet", li.schema)
    return line_cols(readers.read_materialized(spark, f"{base}/csv", f"{base}/parquet", li.schema))


@query("s4_dispatch_by_extension", "SELECT 'parquet' AS fmt, count(*) AS n, round(sum(value),2) AS total FROM events UNION ALL SELECT 'orc', count(*), round(sum(value),2) FROM events")
def s4(spark, d):
    e = table(spark, d, "events")
    p = writers.write_as(e, writers.scratch(spark, "events") + ".orc", "orc")
    one = lambda x, f: x.agg(F.lit(f).alias("fmt"), F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))
    return one(readers.read_any(spark, f"{d}/events.parquet"), "parquet").unionByName(one(readers.read_any(spark, p), "orc"))


@query("s5_nested_documents", f"WITH {IM} SELECT CAST(dataset AS VARCHAR) AS dataset, feature, round(importance,6) AS importance FROM im")
def s5(spark, d):
    p = writers.write_importance_documents(importance_table(spark, d), writers.scratch(spark, "importance"))
    return readers.read_importance_documents(spark, p).withColumn("importance", r("importance", 6))


@query("s6_tables_as_source", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def s6(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("ledgerwatch_history")
    return readers.read_table(spark, "ledgerwatch_history").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


SCORE_SQL = f"WITH {EN} SELECT line_id, round(fp,6) AS fraud_probability, pr AS fraud_prediction, rl AS risk_level FROM en"


def delivered(spark, d):
    return scored(spark, d).select("line_id", r("fraud_probability", 6).alias("fraud_probability"), "fraud_prediction", "risk_level")


@query("s7_csv_sink", SCORE_SQL)
def s7(spark, d):
    p = writers.write_predictions(delivered(spark, d), writers.scratch(spark, "pred"))
    return readers.read_csv(spark, p, "line_id string, fraud_probability double, fraud_prediction int, risk_level string")


@query("s8_report_sink", f"""WITH {EN}, e AS (SELECT line_id, round(fp,6) AS p, pr FROM en), t AS (SELECT * FROM e ORDER BY p DESC, line_id LIMIT 10)
 SELECT count(*) AS total_transactions, CAST(sum(pr) AS BIGINT) AS frauds_detected, round(avg(p),5) AS mean_probability, (SELECT string_agg(line_id,'|' ORDER BY p DESC, line_id) FROM t) AS top_10 FROM e""")
def s8(spark, d):
    p = writers.write_report(delivered(spark, d), writers.scratch(spark, "report"), "line_id", {"model": "rules", "mode": "ensemble"})
    doc = spark.read.json(f"{p}/report")
    return doc.select("summary_statistics.total_transactions", "summary_statistics.frauds_detected", r("summary_statistics.mean_probability", 5).alias("mean_probability"),
                      F.array_join("top_10_frauds.line_id", "|").alias("top_10"))


@query("s9_three_sheets", f"""WITH {EN} SELECT 'all' AS sheet, coalesce(rl,'none') AS risk_level, count(*) AS n FROM en GROUP BY 2 UNION ALL SELECT 'high', 'HIGH', count(*) FROM en WHERE rl='HIGH' UNION ALL SELECT 'summary', 'none', 8""")
def s9(spark, d):
    p = writers.write_three_sheets(delivered(spark, d), writers.scratch(spark, "sheets"), "line_id")
    a = spark.read.parquet(f"{p}/all_predictions").groupBy(F.coalesce("risk_level", F.lit("none")).alias("risk_level")).agg(F.count("*").alias("n"))
    h = spark.read.parquet(f"{p}/high_risk").groupBy("risk_level").agg(F.count("*").alias("n"))
    s = spark.read.parquet(f"{p}/summary").agg(F.lit("none").alias("risk_level"), F.count("*").alias("n"))
    tag = lambda x, t: x.select(F.lit(t).alias("sheet"), "risk_level", "n")
    return tag(a, "all").unionByName(tag(h, "high")).unionByName(tag(s, "summary"))


@query("s10_format_switch", " UNION ALL ".join(f"SELECT '{f}' AS fmt, count(*) AS n, round(sum(value),2) AS total FROM events" for f in ("csv", "json", "parquet", "orc")))
def s10(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    out = None
    for fmt in ("csv", "json", "parquet", "orc"):
        p = writers.write_as(e, writers.scratch(spark, fmt), fmt)
        x = readers.read_any(spark, p, e.schema, fmt).agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))
        out = x if out is None else out.unionByName(x)
    return out


@query("s11_grid_records", f"WITH {GR} SELECT dataset, config_id, CAST(max_depth AS DOUBLE) AS max_depth, round(learning_rate,6) AS learning_rate, round(mean_test_f1,6) AS mean_test_f1 FROM gr")
def s11(spark, d):
    p = writers.write_grid(grid_table(spark, d), writers.scratch(spark, "grid"), ["max_depth", "learning_rate", "subsample", "gamma", "n_estimators"])
    g = spark.read.schema("dataset string, config_id bigint, params map<string,double>, mean_test_f1 double").json(p)
    return g.select("dataset", "config_id", F.col("params")["max_depth"].alias("max_depth"), r(F.col("params")["learning_rate"], 6).alias("learning_rate"), r("mean_test_f1", 6).alias("mean_test_f1"))


@query("s12_save_load_pipeline")
def s12(spark, d):
    li = lines(spark, d)
    m = quick_model(li)
    p = writers.scratch(spark, "model")
    m.save(p)
    a = m.probabilities(li, ["line_id"]).withColumnRenamed("fraud_probability", "before")
    b = boosting.FraudModel.load(p).probabilities(li, ["line_id"])
    return a.join(b, "line_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("before") - F.col("fraud_probability"))).alias("max_difference"))


@query("s13_save_load_ensemble")
def s13(spark, d):
    li = lines(spark, d)
    p = writers.scratch(spark, "ensemble")
    boosting.save_ensemble(p, segment_models(spark, d)[:2])
    s = boosting.ensemble_scores(li, ["line_id"], boosting.load_ensemble(p))
    return s.agg(F.count("*").alias("n"), F.avg("fraud_probability").alias("mean_probability"), F.avg("prediction_stability").alias("mean_stability"))


@query("s14_batch_equals_whole")
def s14(spark, d):
    """Scores are the same whatever the partitioning: the difference is zero."""
    li = lines(spark, d)
    m = quick_model(li)
    a = m.probabilities(li, ["line_id"]).withColumnRenamed("fraud_probability", "whole")
    b = m.probabilities(li.repartition(13, "l_suppkey"), ["line_id"])
    return a.join(b, "line_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("whole") - F.col("fraud_probability"))).alias("max_difference"))


# ---- streaming ----------------------------------------------------------------------------------------------

def event_stream(spark, d):
    return jobs.file_stream(spark, d, table(spark, d, "events").schema, "events.parquet")


def event_model(spark, d) -> boosting.FraudModel:
    e = events(spark, d).withColumn("y", (F.col("value") > 100).cast("int"))
    f = engineering.FittedFeatures([{"name": "value_log", "kind": "log", "a": "value"}, {"name": "hour", "kind": "hour", "a": "ts"}], ["value"])
    return boosting.train(e, "y", "event_id", f, {"n_estimators": 3, "max_depth": 3}, measure=False)


@query("st1_streaming_scores")
def st1(spark, d):
    m = event_model(spark, d)
    p = writers.scratch(spark, "st1")
    jobs.run_available(jobs.scored_stream(event_stream(spark, d), m, ["event_id", "user_id", "ts"]), f"{p}/out", f"{p}/check")
    return spark.read.parquet(f"{p}/out")


@query("st2_streaming_alert_counts", """WITH e AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS w, CASE WHEN least(value/300,1) <= 0.3 THEN 'LOW' WHEN least(value/300,1) <= 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM events)
 SELECT epoch_us(w) AS window_us, risk_level, count(*) AS n FROM e WHERE w + INTERVAL 5 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1,2""")
def st2(spark, d):
    p = writers.scratch(spark, "st2")
    jobs.run_available(jobs.alert_counts(event_stream(spark, d), jobs.probability_tier("value", 300.0)), f"{p}/out", f"{p}/check")
    return spark.read.parquet(f"{p}/out").select(F.unix_micros("window_start").alias("window_us"), "risk_level", "n")


@query("st3_streaming_velocity", """WITH e AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h) AS w FROM events, range(6) r(h)), g AS (SELECT user_id, w, count(*) AS n FROM e GROUP BY 1,2)
 SELECT epoch_us(w) AS window_us, user_id, n FROM g WHERE n >= 3 AND w + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def st3(spark, d):
    p = writers.scratch(spark, "st3")
    jobs.run_available(jobs.velocity_alerts(event_stream(spark, d), "user_id", min_tx=3), f"{p}/out", f"{p}/check")
    return spark.read.parquet(f"{p}/out").select(F.unix_micros("window_start").alias("window_us"), "user_id", "n")


def flagship(spark, d):
    """Score all lines with trained trees and deliver the tiered table."""
    li = lines(spark, d)
    m = quick_model(li)
    s = m.score(li, ["line_id", "l_suppkey", "l_shipdate"])
    s = s.withColumns({"prediction_variance": F.lit(0.0), "prediction_stability": F.lit(1.0), "anomaly_score": F.lit(0.0), "is_anomaly": F.lit(0),
                       "combined_score": F.col("fraud_probability"), "fraud_probability_calibrated": ft.calibrated("fraud_probability")})
    t = report.adaptive_thresholds(s)
    return report.tiered_output(s, "l_suppkey", "line_id", "l_shipdate", t["high"], t["medium"])
