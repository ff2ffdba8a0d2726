"""Queries for behaviour patterns, evaluation, scoring arithmetic and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwatch.functions import features as ft
from ledgerwatch.operators import evaluate as ev_
from ledgerwatch.operators import keyed, patterns, report
from ledgerwatch.plans.base import EV, LI, RS, big, events, lines, query, r, rule_scores, table


@query("w1_customer_stats", """SELECT event_id, count(*) OVER w AS tx_count, round(avg(value) OVER w,4) AS avg_amount
 FROM events WINDOW w AS (PARTITION BY user_id)""")
def w1(spark, d):
    out = keyed.attach_group_stats(events(spark, d), "user_id", {"tx_count": F.count("*"), "avg_amount": F.avg("value")})
    return out.select("event_id", "tx_count", r("avg_amount").alias("avg_amount"))


@query("w3_newest_renumbered", """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000)""")
def w3(spark, d):
    return patterns.newest_renumbered(events(spark, d), "ts", "event_id", 5000).select("event_id", "seq")


@query("w6_smurfing", """SELECT event_id, CAST(count(*) FILTER (value BETWEEN 5 AND 60) OVER w AS BIGINT) AS smurf_count,
 round(coalesce(sum(value) FILTER (value BETWEEN 5 AND 60) OVER w,0),2) AS smurf_total,
 CAST(value BETWEEN 5 AND 60 AND count(*) FILTER (value BETWEEN 5 AND 60) OVER w >= 12 AS INT) AS is_smurfing
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW)""")
def w6(spark, d):
    return patterns.smurfing(events(spark, d), "user_id", "ts", "value", 5, 60, 5, 12).select(
        "event_id", "smurf_count", r("smurf_total", 2).alias("smurf_total"), "is_smurfing")


@query("w7_dormant_wakeup", """WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
 SELECT event_id, CAST(floor(gap/1000000) AS BIGINT) AS gap_seconds, CAST(coalesce(gap >= 2*86400000000 AND value >= 20, false) AS INT) AS is_dormant_wakeup FROM g""")
def w7(spark, d):
    return patterns.dormant_wakeup(events(spark, d), "user_id", "ts", "event_id", "value", 2, 20).select(
        "event_id", "gap_seconds", "is_dormant_wakeup")


@query("w8_unusual_amount", """WITH g AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)
 SELECT event_id, round(m,8) AS prior_mean, CAST(coalesce(value >= 5*m, false) AS INT) AS is_unusual_amount FROM g""")
def w8(spark, d):
    return patterns.unusual_amount(events(spark, d), "user_id", "ts", "event_id", "value", 5).select(
        "event_id", r("prior_mean", 8).alias("prior_mean"), "is_unusual_amount")


@query("w9_beneficiary_concentration", f"""WITH {LI}, j AS (SELECT line_id, o_custkey, l_shipdate, l_suppkey FROM li JOIN orders ON l_orderkey = o_orderkey)
 SELECT line_id, count(*) OVER w AS window_count, CAST(count(DISTINCT l_suppkey) OVER w <= 2 AND count(*) OVER w >= 2 AS INT) AS is_concentrated
 FROM j WINDOW w AS (PARTITION BY o_custkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL 21 DAY PRECEDING AND CURRENT ROW)""")
def w9(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = lines(spark, d).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("line_id", "o_custkey", "l_shipdate", "l_suppkey")
    return patterns.beneficiary_concentration(j, "o_custkey", "l_shipdate", "line_id", "l_suppkey", 21, 2).select(
        "line_id", "window_count", "is_concentrated")


@query("w10_burst", """SELECT event_id, CAST(count(*) FILTER (event_type='error') OVER w AS BIGINT) AS burst_count,
 CAST(event_type='error' AND count(*) FILTER (event_type='error') OVER w >= 5 AS INT) AS is_burst
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""")
def w10(spark, d):
    return patterns.burst(events(spark, d), "user_id", "ts", F.col("event_type") == "error").select("event_id", "burst_count", "is_burst")


@query("w11_high_velocity", """SELECT event_id, count(*) OVER w AS velocity, CAST(count(*) OVER w >= 4 AS INT) AS is_high_velocity
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""")
def w11(spark, d):
    return patterns.high_velocity(events(spark, d), "user_id", "ts", 6, 4).select("event_id", "velocity", "is_high_velocity")


# ---- splits and evaluation ----------------------------------------------------------------------

def split_sql(*cuts: float) -> str:
    case = " ".join(f"WHEN rk <= floor({c}::DOUBLE*n+0.5) THEN {i}" for i, c in enumerate(cuts))
    return f"""WITH {LI}, h AS (SELECT line_id, is_fraud, ('0x' || substr(md5(line_id || ':42'),1,13))::BIGINT AS h FROM li),
 k AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY h) AS rk, count(*) OVER (PARTITION BY is_fraud) AS n FROM h)
 SELECT line_id, is_fraud, CASE {case} ELSE {len(cuts)} END AS fold FROM k"""


@query("t16_stratified_split", split_sql(0.2))
def t16(spark, d):
    return ev_.stratified_split(lines(spark, d), "is_fraud", "line_id", [0.2, 0.8]).select("line_id", "is_fraud", "fold")


@query("t17_three_way_split", split_sql(0.7, 0.85))
def t17(spark, d):
    return ev_.stratified_split(lines(spark, d), "is_fraud", "line_id", [0.7, 0.15, 0.15]).select("line_id", "is_fraud", "fold")


@query("t17_stratified_sample", f"SELECT line_id, is_fraud FROM ({split_sql(0.35)}) WHERE fold = 0")
def t17b(spark, d):
    return ev_.stratified_sample(lines(spark, d), "is_fraud", "line_id").select("line_id", "is_fraud")


@query("t18_class_weight", f"""WITH {LI}, w AS (SELECT count(*) FILTER (is_fraud=0)*1.0::DOUBLE/greatest(count(*) FILTER (is_fraud=1),1) AS w FROM li)
 SELECT is_fraud, round(CASE WHEN is_fraud=1 THEN any_value(w) ELSE 1 END,6) AS weight, count(*) AS n FROM li, w GROUP BY 1""")
def t18(spark, d):
    return (ev_.add_class_weight(lines(spark, d), "is_fraud").groupBy("is_fraud").agg(r(F.max("weight"), 6).alias("weight"), F.count("*").alias("n")))


SC = RS + """, sc AS (SELECT *, p3 AS p, CAST(p3 >= 0.5 AS INT) AS pred FROM rs)"""


def scored_rules(spark, d):
    return rule_scores(lines(spark, d)).withColumns({"p": F.col("p3"), "pred": ft.predicted("p3")})


CONF = """count(*) FILTER (y=1 AND z=1) AS tp, count(*) FILTER (y=0 AND z=1) AS fp, count(*) FILTER (y=1 AND z=0) AS fn, count(*) FILTER (y=0 AND z=0) AS tn"""


@query("a20_confusion", f"""WITH {SC}, c AS (SELECT {CONF.replace('y=', 'is_fraud=').replace('z=', 'pred=')} FROM sc),
 e AS (SELECT *, tp*1.0::DOUBLE/(tp+fp) AS p, tp*1.0::DOUBLE/(tp+fn) AS rc FROM c)
 SELECT tp, fp, fn, tn, round((tp+tn)*1.0::DOUBLE/(tp+fp+fn+tn),6) AS accuracy, round(p,6) AS precision, round(rc,6) AS recall, round(2*p*rc/(p+rc),6) AS f1,
 round(rc,6) AS fraud_detection_rate, round(fp*1.0::DOUBLE/greatest(fp+tn,1),6) AS false_alarm_rate FROM e""")
def a20(spark, d):
    c = ev_.confusion(scored_rules(spark, d), "is_fraud", "pred")
    return c.select("tp", "fp", "fn", "tn", *[r(x, 6).alias(x) for x in c.columns[4:]])


@query("a21_auc_average_precision", f"""WITH {SC}, g AS (SELECT p AS s, count(*) FILTER (is_fraud=1) AS pos, count(*) FILTER (is_fraud=0) AS neg FROM sc GROUP BY 1),
 k AS (SELECT *, sum(pos) OVER (ORDER BY s DESC)::DOUBLE AS tp, sum(neg) OVER (ORDER BY s DESC)::DOUBLE AS fp FROM g)
 SELECT round(sum(neg*(tp-pos/2.0::DOUBLE))/sum(pos)/sum(neg),6) AS roc_auc, round(sum(pos*tp/(tp+fp))/sum(pos),6) AS average_precision FROM k""")
def a21(spark, d):
    return ev_.ranking_metrics(scored_rules(spark, d), "is_fraud", "p").select(
        r("roc_auc", 6).alias("roc_auc"), r("average_precision", 6).alias("average_precision"))


@query("a22_precision_at_k", f"""WITH {SC}, t AS (SELECT is_fraud FROM sc ORDER BY p DESC, line_id LIMIT (SELECT least(100, floor(count(*)*0.05::DOUBLE))::BIGINT FROM sc))
 SELECT CAST(count(*) AS INT) AS k, round(sum(is_fraud)*1.0::DOUBLE/count(*),6) AS precision_at_k, round(sum(is_fraud)*1.0::DOUBLE/(SELECT sum(is_fraud) FROM sc),6) AS recall_at_k FROM t""")
def a22(spark, d):
    t = ev_.at_top_k(scored_rules(spark, d), "is_fraud", "p", "line_id")
    return t.select("k", r("precision_at_k", 6).alias("precision_at_k"), r("recall_at_k", 6).alias("recall_at_k"))


@query("a23_missed_frauds", f"""WITH {SC} SELECT count(*) AS missed, round(avg(p2),6) AS avg_p, round(min(p2),6) AS min_p, round(max(p2),6) AS max_p,
 round(CASE WHEN avg(p2) > 0.3 THEN avg(p2) END,6) AS suggested_threshold FROM sc WHERE is_fraud=1 AND p2 < 0.75""")
def a23(spark, d):
    m = ev_.missed_frauds(scored_rules(spark, d), "is_fraud", "p2", 0.75)
    return m.select("missed", *[r(x, 6).alias(x) for x in m.columns[1:]])


SWEEP = [0.15, 0.18, 0.25, 0.5, 0.7]
SWEEP_SQL = f"""{SC}, th(t) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in SWEEP)}), c AS (SELECT t AS threshold, {CONF.replace('y=', 'is_fraud=').replace('z=1', 'p>=t').replace('z=0', 'p<t')} FROM sc, th GROUP BY 1)"""


@query("a24_threshold_sweep", f"""WITH {SWEEP_SQL}, e AS (SELECT *, tp*1.0::DOUBLE/(tp+fp) AS p, tp*1.0::DOUBLE/(tp+fn) AS rc FROM c)
 SELECT threshold, tp, fp, fn, tn, round(p,6) AS precision, round(rc,6) AS recall, round(2*p*rc/(p+rc),6) AS f1 FROM e""")
def a24(spark, d):
    s = ev_.threshold_sweep(scored_rules(spark, d), "is_fraud", "p", SWEEP)
    return s.select("threshold", "tp", "fp", "fn", "tn", *[r(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query("a25_threshold_cost", f"""WITH {SWEEP_SQL} SELECT threshold, fn*50000 AS missed_loss, fp*5000 AS false_alarm_cost, fp*1000 AS review_cost, fn*50000+fp*6000 AS total_cost FROM c""")
def a25(spark, d):
    return ev_.threshold_cost(ev_.threshold_sweep(scored_rules(spark, d), "is_fraud", "p", SWEEP))


@query("a26_probability_bands", f"""WITH {SC}, b AS (SELECT CASE WHEN p2>=0.5 THEN '50-100' WHEN p2>=0.25 THEN '25-50' WHEN p2>=0.15 THEN '15-25' WHEN p2>=0.05 THEN '05-15' ELSE '00-05' END AS band
  FROM sc WHERE l_quantity > 45) SELECT band, count(*) AS n, round(count(*)*1.0::DOUBLE/sum(count(*)) OVER (),6) AS share FROM b GROUP BY 1""")
def a26(spark, d):
    df = scored_rules(spark, d).withColumn("y", (F.col("l_quantity") > 45).cast("int"))
    return ev_.probability_bands(df, "y", "p2").withColumn("share", r("share", 6))


@query("a27_leakage_probe", f"""WITH {LI}, u AS (SELECT 'l_discount' AS name, CAST(round(l_discount*100) AS INT)::VARCHAR AS value, is_fraud FROM li
 UNION ALL SELECT 'l_quantity', CAST(l_quantity AS INT)::VARCHAR, is_fraud FROM li UNION ALL SELECT 'l_returnflag', l_returnflag, is_fraud FROM li)
 SELECT name, value, count(*) AS n, round(avg(is_fraud),6) AS rate FROM u GROUP BY 1,2 HAVING avg(is_fraud) IN (0,1)""")
def a27(spark, d):
    li = lines(spark, d)
    li = li.select("is_fraud", F.round(F.col("l_discount") * 100).cast("int").alias("l_discount"), F.col("l_quantity").cast("int").alias("l_quantity"), "l_returnflag")
    return ev_.leakage_probe(li, "is_fraud", ["l_discount", "l_quantity", "l_returnflag"]).withColumn("rate", r("rate", 6))


F1_SQL = "2.0::DOUBLE*count(*) FILTER (is_fraud=1 AND pred=1)/(2*count(*) FILTER (is_fraud=1 AND pred=1)+count(*) FILTER (is_fraud=0 AND pred=1)+count(*) FILTER (is_fraud=1 AND pred=0))"


@query("l13_overfit_check", f"""WITH {SC}, f AS ({split_sql(0.2).replace('WITH ' + LI + ',', 'WITH')}), a AS (SELECT {F1_SQL} AS f1 FROM sc JOIN f USING (line_id) WHERE fold=1),
 b AS (SELECT {F1_SQL} AS f1 FROM sc JOIN f USING (line_id) WHERE fold=0)
 SELECT round(a.f1,6) AS train_f1, round(b.f1,6) AS test_f1, round(abs(a.f1-b.f1),6) AS gap, CAST(abs(a.f1-b.f1) > 0.05 AS INT) AS overfit FROM a, b""".replace("is_fraud=", "sc.is_fraud="))
def l13(spark, d):
    s = ev_.stratified_split(scored_rules(spark, d), "is_fraud", "line_id", [0.2, 0.8])
    o = ev_.overfit_check(ev_.confusion(s.where("fold = 1"), "is_fraud", "pred"), ev_.confusion(s.where("fold = 0"), "is_fraud", "pred"))
    return o.select(r("train_f1", 6).alias("train_f1"), r("test_f1", 6).alias("test_f1"), r("gap", 6).alias("gap"), "overfit")


@query("a41_regression_errors", f"""WITH {RS} SELECT 'p1' AS name, round(avg(abs(is_fraud-p1)),6) AS mae, round(sqrt(avg((is_fraud-p1)*(is_fraud-p1))),6) AS rmse,
 round(1-avg((is_fraud-p1)*(is_fraud-p1))/var_pop(is_fraud),5) AS r2 FROM rs UNION ALL SELECT 'p3', round(avg(abs(is_fraud-p3)),6), round(sqrt(avg((is_fraud-p3)*(is_fraud-p3))),6),
 round(1-avg((is_fraud-p3)*(is_fraud-p3))/var_pop(is_fraud),5) FROM rs""")
def a41(spark, d):
    e = ev_.regression_errors(rule_scores(lines(spark, d)), {"p1": ("is_fraud", "p1"), "p3": ("is_fraud", "p3")})
    return e.select("name", r("mae", 6).alias("mae"), r("rmse", 6).alias("rmse"), r("r2", 5).alias("r2"))


# ---- scoring arithmetic -------------------------------------------------------------------------

# three rule models with weights 0.9, 0.8, 0.5; anomaly stands for the normalised distance of the tax rate
EN = RS + """, en0 AS (SELECT *, (p1*0.9::DOUBLE+p2*0.8::DOUBLE+p3*0.5::DOUBLE)/(0.9::DOUBLE+0.8::DOUBLE+0.5::DOUBLE) AS fp, (p1+p2+p3)/3 AS pm FROM rs),
 en AS (SELECT *, ((p1-pm)*(p1-pm)+(p2-pm)*(p2-pm)+(p3-pm)*(p3-pm))/3 AS pv, l_tax*12.5::DOUBLE AS an, CAST(l_tax > 0.07 AS INT) AS ia,
  fp*0.7::DOUBLE+l_tax*12.5::DOUBLE*0.3::DOUBLE AS cs, 1/(1+exp(-10*(fp-0.5::DOUBLE))) AS pc, CAST(fp >= 0.5 AS INT) AS pr,
  CASE WHEN fp > 0 AND fp <= 1 THEN CASE WHEN fp <= 0.3 THEN 'LOW' WHEN fp <= 0.7 THEN 'MEDIUM' ELSE 'HIGH' END END AS rl FROM en0)"""


def scored(spark, d):
    s = rule_scores(lines(spark, d))
    s = s.withColumns(ft.ensemble(["p1", "p2", "p3"], [0.9, 0.8, 0.5]))
    s = s.withColumns({"anomaly_score": F.col("l_tax") * 12.5, "is_anomaly": ft.flag(F.col("l_tax") > 0.07)})
    return s.withColumns({"combined_score": ft.blended("fraud_probability", "anomaly_score"),
                          "fraud_probability_calibrated": ft.calibrated("fraud_probability"),
                          "fraud_prediction": ft.predicted("fraud_probability"), "risk_level": ft.risk_level("fraud_probability")})


@query("l7_ensemble_arithmetic", f"""WITH {EN} SELECT line_id, round(fp,6) AS fraud_probability, round(pv,6) AS prediction_variance, round(1-greatest(0,least(1,pv)),6) AS prediction_stability, pr AS fraud_prediction FROM en""")
def l7(spark, d):
    return scored(spark, d).select("line_id", *[r(c, 6).alias(c) for c in ("fraud_probability", "prediction_variance", "prediction_stability")], "fraud_prediction")


@query("l9_risk_level", f"""WITH {RS} SELECT line_id, CASE WHEN p2 > 0 AND p2 <= 1 THEN CASE WHEN p2 <= 0.3 THEN 'LOW' WHEN p2 <= 0.7 THEN 'MEDIUM' ELSE 'HIGH' END END AS risk_level,
 CASE WHEN p2 <= 0.3 THEN 'LOW' WHEN p2 <= 0.7 THEN 'MEDIUM' WHEN p2 <= 1 THEN 'HIGH' END AS risk_level_zero FROM rs""")
def l9(spark, d):
    return rule_scores(lines(spark, d)).select("line_id", ft.risk_level("p2").alias("risk_level"), ft.risk_level("p2", True).alias("risk_level_zero"))


@query("l10_calibration", f"""WITH {RS} SELECT line_id, round(1/(1+exp(-10*(p1-0.5::DOUBLE))),6) AS fraud_probability_calibrated FROM rs""")
def l10(spark, d):
    return rule_scores(lines(spark, d)).select("line_id", r(ft.calibrated("p1"), 6).alias("fraud_probability_calibrated"))


@query("l8_blend_arithmetic", f"WITH {EN} SELECT line_id, round(cs,6) AS combined_score FROM en")
def l8b(spark, d):
    return scored(spark, d).select("line_id", r("combined_score", 6).alias("combined_score"))


THRESH = """th AS (SELECT i, 50-5*i AS hi, 40-5*i AS me, (SELECT count(*) FILTER (cs*cs*cs >= (40-5*i)/100.0::DOUBLE)*1.0::DOUBLE/count(*) FROM en) AS share FROM range(6) r(i)),
 pick AS (SELECT hi/100.0::DOUBLE AS high, me/100.0::DOUBLE AS medium, share, i+1 AS rounds, share >= 0.03 AS ok FROM th ORDER BY (share >= 0.03) DESC, CASE WHEN share >= 0.03 THEN i ELSE -i END LIMIT 1)"""


@query("l11_adaptive_thresholds", f"""WITH {EN}, {THRESH} SELECT high, medium, round(share,6) AS share, CAST(rounds AS INT) AS rounds, CAST(ok AS INT) AS converged FROM pick""")
def l11(spark, d):
    s = scored(spark, d).withColumn("cube", F.col("combined_score") * F.col("combined_score") * F.col("combined_score"))
    t = report.adaptive_thresholds(s, "cube")
    # the counts behind the choice come from the rows; the choice itself is one row
    return s.agg(F.lit(t["high"]).alias("high"), F.lit(t["medium"]).alias("medium"),
                 r(F.count_if(F.col("cube") >= t["medium"]) / F.count("*"), 6).alias("share"),
                 F.lit(t["rounds"]).alias("rounds"), F.lit(int(t["converged"])).alias("converged"))


@query("l12_tiered_output", f"""WITH {EN} SELECT l_suppkey AS "Customer_ID", line_id AS "Transaction_ID", CAST(l_shipdate AS VARCHAR) AS "Timestamp", round(fp,6) AS "Fraud_Probability",
 round(pv,6) AS "Prediction_Variance", round(1-greatest(0,least(1,pv)),6) AS "Prediction_Stability", round(an,6) AS "Anomaly_Score", ia AS "Is_Anomaly", round(cs,6) AS "Combined_Score",
 round(pc,6) AS "Fraud_Probability_Calibrated", CASE WHEN cs >= 0.5 THEN 'HIGH' WHEN cs >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS "Risk_Level", CAST(cs >= 0.4 AS INT) AS "Fraude" FROM en""")
def l12(spark, d):
    t = report.tiered_output(scored(spark, d), "l_suppkey", "line_id", "l_shipdate", 0.5, 0.4)
    return t.withColumns({c: r(c, 6) for c in ("Fraud_Probability", "Prediction_Variance", "Prediction_Stability", "Anomaly_Score", "Combined_Score",
                                               "Fraud_Probability_Calibrated")}).withColumn("Timestamp", F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("l14_alert_policy", f"""WITH {SC} SELECT CASE WHEN p >= 0.25 THEN 'BLOCK' WHEN p >= 0.15 THEN 'REVIEW' ELSE 'PASS' END AS action, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS frauds FROM sc GROUP BY 1""")
def l14(spark, d):
    return scored_rules(spark, d).groupBy(ft.alert_action("p").alias("action")).agg(F.count("*").alias("n"), F.sum("is_fraud").cast("bigint").alias("frauds"))


@query("p12_threshold_flag", f"WITH {RS} SELECT line_id, CAST(p1 >= 0.5 AS INT) AS fraud_prediction FROM rs")
def p12(spark, d):
    return rule_scores(lines(spark, d)).select("line_id", ft.predicted("p1").alias("fraud_prediction"))


@query("p13_high_risk_sorted", f"WITH {EN} SELECT line_id, round(fp,6) AS fraud_probability FROM en WHERE rl='HIGH'")
def p13(spark, d):
    return report.high_risk(scored(spark, d), "line_id").select("line_id", r("fraud_probability", 6).alias("fraud_probability"))


@query("k1_top_frauds", f"WITH {EN} SELECT line_id, round(fp,6) AS fraud_probability FROM en ORDER BY fp DESC, line_id LIMIT 10")
def k1(spark, d):
    return report.top_frauds(scored(spark, d), "line_id").select("line_id", r("fraud_probability", 6).alias("fraud_probability"))


@query("a16_prediction_report", f"""WITH {EN}, a AS (SELECT count(*) AS n_total, count(*) FILTER (pr=1) AS n_fraud, avg(fp) AS m, stddev_samp(fp) AS s, max(fp) AS mx, quantile_cont(fp,[0.5,0.9,0.95,0.99]) AS q,
  count(*) FILTER (rl='HIGH') AS n_high, count(*) FILTER (rl='MEDIUM') AS n_medium, count(*) FILTER (rl='LOW') AS n_low, count(*) FILTER (fp>=0.8 AND pr=1) AS hf, count(*) FILTER (fp<=0.2 AND pr=0) AS hl,
  count(*) FILTER (fp>0.2 AND fp<0.8) AS mc, avg(1-pv) AS ms, avg(pv) AS mv, count(*) FILTER (1-pv<0.7) AS nu, count(*) FILTER (ia=1) AS na, count(*) FILTER (ia=1 AND pr=1) AS fa, corr(pr,ia) AS c FROM en)
 SELECT n_total, n_fraud, round(m,6) AS p_mean, round(s,6) AS p_std, round(mx,6) AS p_max, n_high, n_medium, n_low, hf AS high_conf_fraud, hl AS high_conf_legit, mc AS medium_conf, round(ms,6) AS mean_stability,
 round(mv,6) AS mean_variance, nu AS n_unstable, na AS n_anomaly, fa AS fraud_and_anomaly, round(c,6) AS corr_anomaly, round(n_fraud*1.0::DOUBLE/n_total,6) AS fraud_rate, round((hf+hl)*1.0::DOUBLE/n_total,6) AS high_conf_rate,
 round(q[1],6) AS p_median, round(q[2],6) AS p90, round(q[3],6) AS p95, round(q[4],6) AS p99, CAST(n_fraud*1.0::DOUBLE/n_total > 0.1 AS INT) AS advise_investigation, CAST((hf+hl)*1.0::DOUBLE/n_total < 0.5 AS INT) AS advise_retraining,
 CAST(ms < 0.7 AS INT) AS advise_more_models, CAST(fa < n_fraud*0.3 AS INT) AS patterns_well_learned FROM a""")
def a16(spark, d):
    rep = report.prediction_report(scored(spark, d))
    return rep.select(*[r(f.name, 6).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in rep.schema])


@query("a17_summary_sheet", f"""WITH {EN}, a AS (SELECT count(*)::DOUBLE AS total_transactions, count(*) FILTER (pr=1)::DOUBLE AS frauds_detected, count(*) FILTER (pr=1)*1.0::DOUBLE/count(*) AS fraud_rate, avg(fp) AS mean_probability,
  max(fp) AS max_probability, count(*) FILTER (rl='HIGH')::DOUBLE AS high_risk, count(*) FILTER (rl='MEDIUM')::DOUBLE AS medium_risk, count(*) FILTER (rl='LOW')::DOUBLE AS low_risk FROM en)
 SELECT metric, round(value,6) AS value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value)""")
def a17(spark, d):
    return report.summary_metrics(scored(spark, d)).withColumn("value", r("value", 6))


@query("a18_ensemble_record", f"""WITH {EN} SELECT count(*) AS total_transactions, count(*) FILTER (pr=1) AS fraud_detected, round(avg(fp),6) AS avg_probability, round(avg(cs),6) AS avg_combined_score,
 count(*) FILTER (ia=1) AS anomalies, count(*) FILTER (cs>=0.7) AS high_risk, count(*) FILTER (cs>=0.5 AND cs<0.7) AS medium_risk, count(*) FILTER (cs<0.5) AS low_risk FROM en""")
def a18(spark, d):
    return report.ensemble_record(scored(spark, d)).withColumns({c: r(c, 6) for c in ("avg_probability", "avg_combined_score")})


@query("a19_unlabelled_summary", f"""WITH {EN} SELECT count(*) AS total_transactions, count(*) FILTER (pr=1) AS frauds_detected, round(count(*) FILTER (pr=1)*100.0::DOUBLE/count(*),4) AS fraud_rate, count(*) FILTER (pc>=0.7) AS high_risk,
 count(*) FILTER (pc>=0.5 AND pc<0.7) AS medium_risk, count(*) FILTER (pc<0.5) AS low_risk, count(*) FILTER (an>0.5) AS anomalies_detected, round(1-avg(pv),6) AS prediction_stability FROM en""")
def a19(spark, d):
    return report.unlabelled_summary(scored(spark, d)).withColumns({"fraud_rate": r("fraud_rate"), "prediction_stability": r("prediction_stability", 6)})


@query("j1_keys_kept_with_scores", f"WITH {EN} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(fp,6) AS fraud_probability FROM en")
def j1(spark, d):
    return scored(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("fraud_probability", 6).alias("fraud_probability"))


@query("u1_union_of_batches", f"WITH {EN} SELECT l_returnflag, count(*) AS n, round(sum(fp),3) AS total FROM en GROUP BY 1")
def u1(spark, d):
    s = scored(spark, d).select("line_id", "l_returnflag", "fraud_probability")
    parts = [s.where(c) for c in ("l_returnflag = 'A'", "l_returnflag <> 'A'", "l_returnflag is null")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.sum("fraud_probability"), 3).alias("total"))


@query("u3_exact_duplicates", f"""WITH {EV}, g AS (SELECT user_id, event_type, k, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, event_type, k, n - 1 AS duplicates FROM g WHERE n > 1""")
def u3(spark, d):
    return events(spark, d).groupBy("user_id", "event_type", "k").agg((F.count("*") - 1).alias("duplicates")).where("duplicates > 0")
