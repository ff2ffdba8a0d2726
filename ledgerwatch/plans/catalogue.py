"""Queries over catalogues (names, importances, grids, registry) and column choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerwatch.functions import features as ft
from ledgerwatch.functions import names as nm
from ledgerwatch.operators import columns as cl
from ledgerwatch.operators import matching as mt
from ledgerwatch.operators import profile as pf
from ledgerwatch.operators import registry as rg
from ledgerwatch.operators import selection as sl
from ledgerwatch.plans.base import (EV, FC, GR, IM, LI, big, events, feed_columns, grid_table, importance_table, lines,
                                    query, r, table)

TARGET_COLUMNS = ["tx_amount", "customer_id", "timestamp", "card_type", "purchase_amount", "error_is_fraud", "click date",
                  "dest_country", "view_ts", "signup_device_id", "foo", "purchase_montant"]


# ---- names ------------------------------------------------------------------------------------------

@query("m1_normalised_names", f"WITH {FC}, {nm.sql_groups('fc')} SELECT col_name, norm FROM ng")
def m1(spark, d):
    return mt.with_groups(feed_columns(spark, d).select("col_name").distinct()).select("col_name", "norm")


@query("m2_semantic_groups", f"WITH {FC}, {nm.sql_groups('fc')} SELECT dataset, fc.col_name, grp FROM fc JOIN ng ON fc.col_name = ng.col_name")
def m2(spark, d):
    return mt.with_groups(feed_columns(spark, d)).select("dataset", "col_name", "grp")


@query("m3_fuzzy_similarity")
def m3(spark, d):
    names = feed_columns(spark, d).select("col_name").distinct()
    pairs = names.withColumn("ref", F.explode(F.array(*[F.lit(c) for c in TARGET_COLUMNS])))
    return pairs.withColumn("similarity", nm.fuzzy_similarity("ref", "col_name"))


@query("m5_short_name_threshold", f"WITH {FC} SELECT DISTINCT col_name, CASE WHEN length(col_name) < 5 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS threshold FROM fc")
def m5(spark, d):
    return feed_columns(spark, d).select("col_name", nm.short_name_threshold(F.col("col_name")).alias("threshold")).distinct()


@query("j3_column_matches")
def j3(spark, d):
    return mt.match_columns(TARGET_COLUMNS, feed_columns(spark, d))


@query("j4_unmatched_columns")
def j4(spark, d):
    fc = feed_columns(spark, d)
    return mt.unmatched(TARGET_COLUMNS, fc, mt.match_columns(TARGET_COLUMNS, fc))


@query("m4_semantic_similarity")
def m4(spark, d):
    return mt.similarity(TARGET_COLUMNS, feed_columns(spark, d)).drop("match_quality")


@query("m6_match_quality")
def m6(spark, d):
    return mt.similarity(TARGET_COLUMNS, feed_columns(spark, d)).select("dataset", "similarity", "confidence", "match_quality")


@query("m7_mapping_suggestions")
def m7(spark, d):
    return mt.suggest_mapping(TARGET_COLUMNS, feed_columns(spark, d))


@query("m8_group_fingerprint", f"""WITH {FC}, {nm.sql_groups('fc')} SELECT dataset, grp, count(*) AS n_columns, string_agg(fc.col_name, '|' ORDER BY position) AS columns
 FROM fc JOIN ng ON fc.col_name = ng.col_name GROUP BY 1,2""")
def m8(spark, d):
    g = mt.with_groups(feed_columns(spark, d)).groupBy("dataset", "grp").agg(
        F.count("*").alias("n_columns"), F.sort_array(F.collect_list(F.struct("position", "col_name"))).alias("c"))
    return g.select("dataset", "grp", "n_columns", F.array_join("c.col_name", "|").alias("columns"))


def pred_sql() -> str:
    n = "col_name"
    t = f"(lower({n}) IN ({', '.join(repr(w) for w in nm.TEMPORAL_EXACT)}) OR {nm.sql_any(n, nm.TEMPORAL)} OR grp='timestamp')"
    f = f"({nm.sql_any(n, nm.FINANCIAL)} OR grp='amount')"
    i = f"({nm.sql_any(n, nm.IDENTIFIER)} OR grp IN ('transaction_id','customer_id','account'))"
    p = f"({nm.sql_any(n, nm.TARGETISH)} OR grp IN ('fraud','status'))"
    return (f"SELECT {n}, CAST({t} AS INT) AS temporal, CAST({f} AS INT) AS financial, CAST({i} AS INT) AS identifier, "
            f"CAST({t} OR {f} OR {i} AS INT) AS non_target, CAST({p} AS INT) AS potential_target FROM ng")


@query("m9_name_predicates", f"WITH {FC}, {nm.sql_groups('fc')} {pred_sql()}")
def m9(spark, d):
    g = mt.with_groups(feed_columns(spark, d).select("col_name").distinct())
    n, grp = F.col("col_name"), F.col("grp")
    preds = {"temporal": nm.is_temporal, "financial": nm.is_financial, "identifier": nm.is_identifier, "non_target": nm.is_non_target,
             "potential_target": nm.is_potential_target}
    return g.select("col_name", *[fn(n, grp).cast("int").alias(k) for k, fn in preds.items()])


def role_sql() -> str:
    a = lambda *w: nm.sql_any("fc.col_name", list(w))
    return f"""CASE WHEN grp='unknown' THEN CASE WHEN {a('amount', 'montant', 'price', 'prix', 'value', 'balance')} THEN 'amount'
  WHEN n_unique*1.0::DOUBLE/n_rows > 0.95 OR {a('id')} THEN 'id' WHEN {a('time', 'heure', 'hour')} THEN 'time' WHEN {a('date', 'timestamp', 'datetime')} THEN 'date'
  WHEN {a('name', 'nom', 'sender', 'receiver', 'payee', 'payer')} THEN 'name' WHEN {a('country', 'pays', 'nation')} THEN 'country' WHEN {a('bank', 'banque', 'institution')} THEN 'bank'
  WHEN dtype='string' AND n_unique*1.0::DOUBLE/n_rows < 0.1 THEN 'categorical' WHEN dtype<>'string' THEN 'numeric' END
 ELSE CASE WHEN grp='transaction_id' OR contains(grp,'id') THEN 'id' WHEN grp='amount' THEN 'amount' WHEN grp='timestamp' THEN CASE WHEN {a('date')} THEN 'date' ELSE 'time' END
  WHEN grp IN ('country','location') THEN 'country' WHEN grp='account' THEN 'bank' WHEN grp IN ('card','merchant','status','channel','currency') THEN 'categorical' END END"""


@query("m10_column_roles", f"WITH {FC}, {nm.sql_groups('fc')} SELECT dataset, fc.col_name, {role_sql()} AS role FROM fc JOIN ng ON fc.col_name = ng.col_name")
def m10(spark, d):
    g = mt.with_groups(feed_columns(spark, d))
    role = nm.column_role(F.col("col_name"), F.col("grp"), F.col("n_unique") / F.col("n_rows"), F.col("dtype") == "string", F.col("dtype") != "string")
    return g.select("dataset", "col_name", role.alias("role"))


def domain_sql() -> str:
    cols = ", ".join(f"bool_or({nm.sql_any('col_name', w)}) AS d_{k}" for k, (_, w) in nm.DOMAINS.items())
    case = " ".join(f"WHEN d_{k} THEN '{k}'" for s in (3, 2) for k, (sc, _) in nm.DOMAINS.items() if sc == s)
    return cols, f"CASE {case} ELSE 'unknown' END"


FLAG_SQL = ", ".join(f"CAST(bool_or({nm.sql_any('col_name', w)}) AS INT) AS {k}" for k, w in nm.DATASET_FLAGS.items())
# domains are told by the names that carry rare values, so that not every feed names all of them
RARE = "n_rows = 1 AND position % 3 = 0"


@query("m11_domain", f"WITH {FC}, dm AS (SELECT dataset, {domain_sql()[0]} FROM fc WHERE {RARE} GROUP BY 1) SELECT dataset, {domain_sql()[1]} AS domain FROM dm")
def m11(spark, d):
    return mt.dataset_features(feed_columns(spark, d).where(RARE)).select("dataset", "domain")


@query("m12_temporal_flags", f"""WITH {FC} SELECT dataset, CAST(bool_or({nm.sql_any('col_name', ['timestamp', 'datetime', 'tx_time'])}) AS INT) AS has_timestamp,
 CAST(bool_or({nm.sql_any('col_name', ['date'])} AND NOT {nm.sql_any('col_name', ['update'])}) AS INT) AS has_date,
 CAST(bool_or({nm.sql_any('col_name', ['time', 'heure'])} AND NOT {nm.sql_any('col_name', ['timestamp'])}) AS INT) AS has_time, CAST(bool_or({nm.sql_any('col_name', ['hour', 'heure'])}) AS INT) AS has_hour,
 CAST(bool_or({nm.sql_any('col_name', ['weekday', 'day_of_week', 'dayofweek'])}) AS INT) AS has_weekday, CAST(bool_or({nm.sql_any('col_name', ['month', 'mois'])}) AS INT) AS has_month FROM fc GROUP BY 1""")
def m12(spark, d):
    return mt.temporal_flags(feed_columns(spark, d))


@query("m13_dataset_features", f"""WITH {FC}, dm AS (SELECT dataset, count(*) AS n_cols, count(*) FILTER (dtype<>'string') AS n_numerical, count(*) FILTER (dtype='string') AS n_categorical,
 count(*) FILTER ({nm.sql_any('col_name', ['id', 'number', 'hash'])}) AS n_id_cols, {FLAG_SQL}, {domain_sql()[0]} FROM fc GROUP BY 1),
 fr AS (SELECT user_id AS dataset, CAST(sum(is_error) AS BIGINT) AS fraud_count, round(avg(is_error),6) AS fraud_rate, count(*) AS n_rows FROM ev GROUP BY 1)
 SELECT dataset, n_cols, n_numerical, n_categorical, n_id_cols, {', '.join(nm.DATASET_FLAGS)}, {domain_sql()[1]} AS domain, fraud_count, fraud_rate, n_rows FROM dm JOIN fr USING (dataset)""")
def m13(spark, d):
    return mt.dataset_features(feed_columns(spark, d)).join(feed_rates(spark, d), "dataset").withColumn("fraud_rate", r("fraud_rate", 6))


def feed_rates(spark, d):
    return events(spark, d).groupBy(F.col("user_id").alias("dataset")).agg(
        F.sum("is_error").cast("bigint").alias("fraud_count"), F.avg("is_error").alias("fraud_rate"), F.count("*").alias("n_rows"))


TARGET_FEATURES = {"n_cols": len(TARGET_COLUMNS), "n_numerical": 4, "domain": "card_fraud", "fraud_rate": 0.15,
                   **{k: int(any(w in c.lower() for c in TARGET_COLUMNS for w in ws)) for k, ws in nm.DATASET_FLAGS.items()}}


def likeness(spark, d):
    fc = feed_columns(spark, d)
    feats = mt.dataset_features(fc).join(feed_rates(spark, d), "dataset")
    return mt.dataset_similarity(TARGET_FEATURES, feats, mt.similarity(TARGET_COLUMNS, fc))


@query("m14_dataset_similarity")
def m14(spark, d):
    return likeness(spark, d)


@query("j2_scores_against_registry")
def j2(spark, d):
    perf = feed_rates(spark, d).select("dataset", (1 - F.col("fraud_rate")).alias("test_f1"))
    return likeness(spark, d).join(perf, "dataset").withColumn("combined", F.col("likeness") * 0.9 + F.col("test_f1") * 0.1)


@query("m15_best_models")
def m15(spark, d):
    return mt.best_models(likeness(spark, d), feed_rates(spark, d).select("dataset", (1 - F.col("fraud_rate")).alias("test_f1")))


@query("m16_registry_match")
def m16(spark, d):
    reg = feed_rates(spark, d).select("dataset", F.col("n_rows").alias("dataset_size"), "fraud_rate")
    return mt.registry_match(mt.similarity(TARGET_COLUMNS, feed_columns(spark, d)), reg, 60, 0.15, 3)


@query("m18_dataset_comparison")
def m18(spark, d):
    fc = feed_columns(spark, d)
    pairs = mt.match_columns(TARGET_COLUMNS, fc)
    left = (mt.unmatched(TARGET_COLUMNS, fc, pairs).groupBy("dataset").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == "target", F.col("col_name")))), "|").alias("unmatched_target"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == "reference", F.col("col_name")))), "|").alias("unmatched_reference")))
    return mt.similarity(TARGET_COLUMNS, fc, pairs=pairs).join(left, "dataset", "left")


@query("m17_output_roles", """SELECT 'event_id' AS transaction_col, 'user_id' AS customer_like, 'ts' AS time_col, count(DISTINCT event_id) AS n_transactions FROM events""")
def m17(spark, d):
    e = events(spark, d).drop("k", "is_error").withColumnsRenamed({"user_id": "customer_id"})
    roles = cl.output_roles(e)
    back = {"customer_id": "user_id"}.get(roles["customer"], roles["customer"])
    return e.agg(F.lit(roles["transaction"]).alias("transaction_col"), F.lit(back).alias("customer_like"), F.lit(roles["timestamp"]).alias("time_col"),
                 F.count_distinct(roles["transaction"]).alias("n_transactions"))


@query("u2_schema_differences", f"""WITH {FC}, sizes AS (SELECT dataset, count(*) AS n FROM fc GROUP BY 1), big AS (SELECT dataset FROM sizes ORDER BY n DESC, dataset LIMIT 1),
 ref AS (SELECT col_name FROM fc WHERE dataset = (SELECT * FROM big)) SELECT dataset, count(*) FILTER (col_name IN (SELECT * FROM ref)) AS n_common,
 count(*) FILTER (col_name NOT IN (SELECT * FROM ref)) AS n_extra, (SELECT count(*) FROM ref) - count(*) FILTER (col_name IN (SELECT * FROM ref)) AS n_missing FROM fc GROUP BY 1""")
def u2(spark, d):
    fc = feed_columns(spark, d)
    widest = fc.groupBy("dataset").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dataset").first()["dataset"]
    ref = fc.where(F.col("dataset") == widest).select("col_name", F.lit(1).alias("in_ref"))
    size = ref.agg(F.count("*").alias("ref_size"))
    return (fc.join(F.broadcast(ref), "col_name", "left").groupBy("dataset").agg(F.count("in_ref").alias("n_common"), F.count("*").alias("n"))
            .join(F.broadcast(size)).select("dataset", "n_common", (F.col("n") - F.col("n_common")).alias("n_extra"),
                                            (F.col("ref_size") - F.col("n_common")).alias("n_missing")))


# ---- importances --------------------------------------------------------------------------------------

CUM = IM + """, rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY importance DESC, feature) AS rank, sum(importance) OVER (PARTITION BY dataset ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS run,
  sum(importance) OVER (PARTITION BY dataset) AS total FROM im)"""


@query("l4_importance_table", f"""WITH {CUM} SELECT dataset, feature, round(importance,6) AS importance, round(importance/total,6) AS importance_normalized, round(importance/total*100,4) AS importance_percentage, round(run/total*100,5) AS importance_cumulative FROM rk""")
def l4t(spark, d):
    c = sl.with_cumulative(importance_table(spark, d))
    return c.select("dataset", "feature", r("importance", 6).alias("importance"), r("importance_normalized", 6).alias("importance_normalized"),
                    r("importance_percentage").alias("importance_percentage"), r("importance_cumulative", 5).alias("importance_cumulative"))


@query("w4_features_needed", f"WITH {CUM} SELECT dataset, count(*) FILTER (run/total*100 < 80-1e-9) + 1 AS for_80, count(*) FILTER (run/total*100 < 95-1e-9) + 1 AS for_95 FROM rk GROUP BY 1")
def w4(spark, d):
    return sl.features_needed(sl.with_cumulative(importance_table(spark, d)))


@query("k3_top20_padded", f"""WITH {CUM}, sp AS (SELECT DISTINCT dataset, unnest(range(1,21)) AS rank FROM im)
 SELECT sp.dataset, CAST(sp.rank AS INT) AS rank, round(coalesce(rk.importance / (SELECT max(importance) FROM im WHERE im.dataset = sp.dataset),0),6) AS value FROM sp LEFT JOIN rk ON rk.dataset=sp.dataset AND rk.rank=sp.rank""")
def k3(spark, d):
    return sl.top_padded(importance_table(spark, d)).select("dataset", "rank", r("value", 6).alias("value"))


@query("k4_top_by_variance_and_correlation", f"""WITH {LI}, v AS (SELECT 'l_quantity' AS name, var_samp(l_quantity) AS v, abs(corr(l_quantity,is_fraud)) AS c FROM li UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice), abs(corr(l_extendedprice,is_fraud)) FROM li
 UNION ALL SELECT 'l_discount', var_samp(l_discount), abs(corr(l_discount,is_fraud)) FROM li UNION ALL SELECT 'l_tax', var_samp(l_tax), abs(corr(l_tax,is_fraud)) FROM li)
 (SELECT 'variance' AS method, name FROM v ORDER BY v DESC, name LIMIT 2) UNION ALL (SELECT 'correlation', name FROM v ORDER BY c DESC, name LIMIT 2)""")
def k4(spark, d):
    li, cols = lines(spark, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    a = sl.top_by_statistic(li, cols, 2).select(F.lit("variance").alias("method"), "name")
    return a.unionByName(sl.top_by_statistic(li, cols, 2, "is_fraud").select(F.lit("correlation").alias("method"), "name"))


@query("k5_importance_threshold", f"WITH {CUM}, a AS (SELECT * FROM rk WHERE importance >= 0.03) SELECT dataset, feature, rank FROM a WHERE rank <= 10")
def k5(spark, d):
    return sl.at_least(importance_table(spark, d), 0.03, 10).select("dataset", "feature", big("rank").alias("rank"))


USEFUL_SQL = "(" + " OR ".join(f"contains(feature,'{p}')" for p in sl.USEFUL) + ")"


@query("k6_transferable_features", f"""WITH {IM}, ref AS (SELECT DISTINCT feature FROM im WHERE importance >= 0.05) SELECT dataset, feature FROM im WHERE feature IN (SELECT * FROM ref) OR {USEFUL_SQL}""")
def k6(spark, d):
    im = importance_table(spark, d)
    return sl.transferable(im.select("dataset", "feature"), im.where("importance >= 0.05")).select("dataset", "feature")


K7 = f"""WITH {CUM}, s AS (SELECT dataset, coalesce(min(rank) FILTER (run >= 0.95),0) AS n1, count(*) FILTER (importance>0) AS n2, greatest(0.001, avg(importance) FILTER (importance>0) - stddev_pop(importance) FILTER (importance>0)) AS cut FROM rk GROUP BY 1),
 n AS (SELECT s.dataset, any_value(n1) AS n1, any_value(n2) AS n2, count(*) FILTER (importance >= cut) AS n3 FROM s JOIN im USING (dataset) GROUP BY 1),
 kp AS (SELECT dataset, coalesce(greatest(CASE WHEN n1>=10 AND n1<=40 THEN n1 END, CASE WHEN n2>=10 AND n2<=40 THEN n2 END, CASE WHEN n3>=10 AND n3<=40 THEN n3 END),10) AS keep FROM n)
 SELECT dataset, feature, rank FROM rk JOIN kp USING (dataset) WHERE rank <= keep"""


@query("k7_intelligent_selection", K7)
def k7(spark, d):
    return sl.intelligent(importance_table(spark, d), 0.95, 10, 40).select("dataset", "feature", big("rank").alias("rank"))


@query("k8_anova_f", f"""WITH {LI}, u AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::DOUBLE AS x, is_fraud AS y FROM li" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + """),
 g AS (SELECT name, y, count(*) AS n, sum(x) AS s, sum(x*x) AS q FROM u GROUP BY 1,2), t AS (SELECT name, sum(n) AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(s*s/n) AS b FROM g GROUP BY 1)
 SELECT name, round(((b-s*s/n)/(k-1))/((q-b)/(n-k)),3) AS f_score FROM t""")
def k8(spark, d):
    return sl.anova_f(lines(spark, d), "is_fraud", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn("f_score", r("f_score", 3))


@query("k9_score_vector_selection", f"""WITH {CUM}, f AS (SELECT dataset, feature, row_number() OVER (PARTITION BY dataset ORDER BY feature) - 1 AS position, importance FROM im), s AS (SELECT dataset, position, importance*20 AS score FROM f),
 k AS (SELECT *, count(*) FILTER (score > 0.1) OVER (PARTITION BY dataset) AS na, count(*) OVER (PARTITION BY dataset) AS w, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, position DESC) AS rk FROM s)
 SELECT k.dataset, k.position, f.feature FROM k JOIN f USING (dataset, position) WHERE na >= 10 AND rk <= least(na, w)""")
def k9(spark, d):
    f = importance_table(spark, d).withColumn("position", F.row_number().over(Window.partitionBy("dataset").orderBy("feature")) - 1)
    out = sl.by_score_vector(f.select("dataset", "position", "feature"), f.select("dataset", "position", (F.col("importance") * 20).alias("score")))
    return out.select("dataset", big("position").alias("position"), "feature")


@query("k14_apply_selection", "SELECT l_quantity, l_discount FROM lineitem")
def k14(spark, d):
    return sl.apply_selection(table(spark, d, "lineitem"), ["l_quantity", "not_there", "l_discount"])


@query("k16_selection_pipeline", f"""WITH {IM}, ref AS (SELECT DISTINCT feature FROM im WHERE importance >= 0.01), {K7.split('WITH ' + IM + ', ')[1].split(' SELECT dataset, feature, rank FROM rk')[0].replace('n1>=10', 'n1>=15').replace('n2>=10', 'n2>=15').replace('n3>=10', 'n3>=15').replace('<=40', '<=1000000').replace('THEN n3 END),10)', 'THEN n3 END),15)')}
 SELECT 'direct' AS mode, dataset, feature FROM rk JOIN kp USING (dataset) WHERE rank <= keep UNION ALL SELECT 'transfer', dataset, feature FROM im WHERE feature IN (SELECT * FROM ref) OR {USEFUL_SQL}""")
def k16(spark, d):
    im = importance_table(spark, d)
    direct = sl.intelligent(im, 0.95, 15).select(F.lit("direct").alias("mode"), "dataset", "feature")
    moved = sl.transferable(im.select("dataset", "feature"), sl.at_least(im, 0.01)).select(F.lit("transfer").alias("mode"), "dataset", "feature")
    return direct.unionByName(moved)


@query("a30_importance_statistics", f"""WITH {CUM}, u AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY importance, feature) AS up FROM rk)
 SELECT dataset, count(*) AS n_features, round(sum(importance),5) AS total, round(max(importance),6) AS top, round(avg(importance),6) AS mean, round(stddev_pop(importance),6) AS std,
 round(-sum(CASE WHEN importance>0 THEN importance*ln(importance+1e-10) END),5) AS entropy, round(sum(importance) FILTER (rank<=5)/sum(importance),5) AS top5_share, round(sum(importance) FILTER (rank<=10)/sum(importance),5) AS top10_share,
 round(greatest(0, 2*sum(up*importance)/(count(*)*sum(importance)) - (count(*)+1)*1.0::DOUBLE/count(*)),5) AS gini, count(*) FILTER (importance > 0.1::DOUBLE*total) AS num_dominant FROM u GROUP BY 1""")
def a30(spark, d):
    s = sl.importance_statistics(importance_table(spark, d))
    dig = {"top": 6, "mean": 6, "std": 6}
    return s.select("dataset", "n_features", "num_dominant", *[r(c, dig.get(c, 5)).alias(c) for c in s.columns if c not in ("dataset", "n_features", "num_dominant")])


@query("a40_engineering_flags", f"""WITH {IM} SELECT dataset, CAST(bool_or(regexp_matches(lower(feature),'_log|log_')) AS INT) AS log, CAST(bool_or(regexp_matches(lower(feature),'interaction|\\*|_x_')) AS INT) AS interaction,
 CAST(bool_or(regexp_matches(lower(feature),'hour|day|is_night|is_business')) AS INT) AS temporal, CAST(bool_or(NOT regexp_matches(feature,'_log|_sqrt|_squared|_bin|interaction')) AS INT) AS encoding,
 CAST(bool_or(regexp_matches(lower(feature),'_bin|_range|binned')) AS INT) AS binning FROM im WHERE importance > 0.025 GROUP BY 1""")
def a40(spark, d):
    return sl.engineering_flags(importance_table(spark, d).where("importance > 0.025"))


# ---- grids ---------------------------------------------------------------------------------------------

METRICS = ["mean_test_f1", "mean_test_precision", "mean_test_recall", "mean_test_roc_auc"]


@query("k2_top_configs_per_metric", f"""WITH {GR}, u AS (""" + " UNION ALL ".join(f"SELECT dataset, config_id, '{m}' AS metric, {m} AS score FROM gr" for m in METRICS) + """),
 k AS (SELECT *, row_number() OVER (PARTITION BY dataset, metric ORDER BY score DESC, config_id) AS rank FROM u) SELECT dataset, metric, config_id, rank, round(score,6) AS score FROM k WHERE rank <= 5""")
def k2(spark, d):
    return sl.top_configs(grid_table(spark, d), METRICS).select("dataset", "metric", "config_id", big("rank").alias("rank"), r("score", 6).alias("score"))


PARAMS = ["max_depth", "learning_rate", "subsample", "gamma", "n_estimators"]


def diverse_sql(params: list[str], score: str, threshold: float, k: int = 15, fallback: int = 50) -> str:
    """CTEs of the farthest-first choice by unrolled rounds; the last one, `ch`, holds the picks."""
    zs = ", ".join(f"coalesce(({p}::DOUBLE - m{i}) / CASE WHEN s{i} > 0 THEN s{i} ELSE 1 END, 0) AS z{i}" for i, p in enumerate(params))
    dist = lambda a, b: "sqrt(" + " + ".join(f"({a}.z{i} - {b}.z{i}) * ({a}.z{i} - {b}.z{i})" for i in range(len(params))) + ")"
    zcols = ", ".join(f"z{i}" for i in range(len(params)))
    out = [f"""c AS (SELECT dataset, count(*) FILTER (WHERE {score} >= {threshold}) AS n_good FROM gr GROUP BY 1),
 pool AS (SELECT gr.* FROM gr JOIN c USING (dataset) WHERE n_good >= {k} AND {score} >= {threshold}
   UNION ALL SELECT * EXCLUDE (n_good, rk) FROM (SELECT gr.*, n_good, row_number() OVER (PARTITION BY dataset ORDER BY {score} DESC, config_id) AS rk
   FROM gr JOIN c USING (dataset) WHERE n_good < {k}) WHERE rk <= {fallback}),
 st AS (SELECT dataset, {", ".join(f"avg({p}::DOUBLE) AS m{i}, stddev_pop({p}::DOUBLE) AS s{i}" for i, p in enumerate(params))} FROM pool GROUP BY 1),
 z AS (SELECT pool.dataset, config_id, {score}, {zs} FROM pool JOIN st USING (dataset)),
 p1 AS (SELECT DISTINCT ON (dataset) dataset, config_id, {zcols}, NULL::DOUBLE AS distance, 1 AS pick FROM z ORDER BY dataset, {score} DESC, config_id),
 s1 AS (SELECT z.*, {dist("z", "p")} AS d, z.config_id = p.config_id AS taken FROM z JOIN p1 p USING (dataset))"""]
    for r in range(2, k + 1):
        out.append(f"""p{r} AS (SELECT DISTINCT ON (dataset) dataset, config_id, {zcols}, d AS distance, {r} AS pick FROM s{r - 1} WHERE NOT taken ORDER BY dataset, round(d, 9) DESC, config_id)""")
        if r < k:
            out.append(f"""s{r} AS (SELECT s.dataset, s.config_id, s.{score}, {", ".join(f"s.z{i}" for i in range(len(params)))}, least(s.d, {dist("s", "p")}) AS d,
   s.taken OR s.config_id = p.config_id AS taken FROM s{r - 1} s JOIN p{r} p USING (dataset))""")
    picks = " UNION ALL ".join(f"SELECT dataset, config_id, pick, distance FROM p{r}" for r in range(1, k + 1))
    out.append(f"ch AS (SELECT pool.*, pick, distance FROM ({picks}) JOIN pool USING (dataset, config_id))")
    return ",\n ".join(out)


DIVERSE = diverse_sql(PARAMS, "mean_test_roc_auc", 0.8)


@query("k10_diverse_configs", f"""WITH {GR},\n {DIVERSE}
SELECT dataset, pick, config_id, {", ".join(PARAMS)}, round(distance, 6) AS distance FROM ch""")
def k10(spark, d):
    """Fifteen spread configurations of every data set (brand) by farthest-first rounds."""
    return (sl.diverse_per_dataset(grid_table(spark, d), PARAMS, "mean_test_roc_auc", "config_id", 0.8)
            .select("dataset", "pick", "config_id", *PARAMS, r("distance", 6).alias("distance")))


@query("k11_diversity_report", f"""WITH {GR},\n {DIVERSE},
 pr AS (SELECT a.dataset, avg(sqrt({" + ".join(f"(a.{p} - b.{p}) * (a.{p} - b.{p})" for p in PARAMS)})) AS avg_distance
   FROM ch a JOIN ch b ON a.dataset = b.dataset AND a.config_id < b.config_id GROUP BY 1)
SELECT dataset, count(*) AS n_chosen, round(coalesce(any_value(pr.avg_distance), 0), 6) AS avg_distance,
 {", ".join(f"round(stddev_pop({p}::DOUBLE), 6) AS std_{p}" for p in PARAMS)} FROM ch LEFT JOIN pr USING (dataset) GROUP BY dataset""")
def k11(spark, d):
    """Spread of every data set's chosen configurations."""
    chosen = sl.diverse_per_dataset(grid_table(spark, d), PARAMS, "mean_test_roc_auc", "config_id", 0.8)
    rep = sl.diversity_per_dataset(chosen, PARAMS)
    return rep.select("dataset", big("n_chosen").alias("n_chosen"), r("avg_distance", 6).alias("avg_distance"), *[r(f"std_{p}", 6).alias(f"std_{p}") for p in PARAMS])


@query("a28_grid_statistics", f"""WITH {GR} SELECT dataset, count(*) AS n_configs, round(max(mean_test_f1),6) AS best, round(min(mean_test_f1),6) AS worst, round(max(mean_test_f1)-min(mean_test_f1),6) AS score_range, round(avg(mean_test_f1),6) AS mean,
 round(stddev_pop(mean_test_f1),6) AS std, count(*) FILTER (std_test_f1<0.05) AS stable, count(*) FILTER (std_test_f1>0.1) AS unstable, count(*) FILTER (std_test_f1<0.03) AS low_variance,
 count(*) FILTER (std_test_f1>=0.03 AND std_test_f1<=0.07) AS medium_variance, count(*) FILTER (std_test_f1>0.07) AS high_variance FROM gr GROUP BY 1""")
def a28(spark, d):
    s = sl.grid_statistics(grid_table(spark, d))
    return s.withColumns({c: r(c, 6) for c in ("best", "worst", "score_range", "mean", "std")})


@query("a29_convergence", f"""WITH {GR}, b AS (SELECT *, max(mean_test_f1) OVER (PARTITION BY dataset) AS best FROM gr) SELECT dataset, round(stddev_pop(mean_test_f1),6) AS stability, count(*) FILTER (mean_test_f1 >= best*0.95::DOUBLE) AS near_best,
 count(*) FILTER (mean_test_f1 <= best*0.8::DOUBLE) AS poor FROM b GROUP BY 1""")
def a29(spark, d):
    return sl.convergence(grid_table(spark, d)).withColumn("stability", r("stability", 6))


@query("w2_global_rank_category", f"""WITH {GR}, k AS (SELECT dataset, config_id, row_number() OVER (ORDER BY mean_test_f1 DESC, dataset, config_id) AS target_rank FROM gr)
 SELECT *, CASE WHEN target_rank<=25 THEN 'excellent' WHEN target_rank<=50 THEN 'good' WHEN target_rank<=80 THEN 'fair' ELSE 'poor' END AS category FROM k""")
def w2(spark, d):
    return sl.global_categories(grid_table(spark, d), "mean_test_f1", ["dataset", "config_id"]).select("dataset", "config_id", "target_rank", "category")


@query("t19_fixed_range_scaling", f"""WITH {GR} SELECT config_id, round(greatest(0,least(1,(max_depth-3)/7.0::DOUBLE)),6) AS depth_unit, round(greatest(0,least(1,(learning_rate-0.05::DOUBLE)/0.15::DOUBLE)),6) AS lr_unit,
 round(0.05::DOUBLE+greatest(0,least(1,(learning_rate-0.05::DOUBLE)/0.15::DOUBLE))*0.15::DOUBLE,6) AS lr_back FROM gr""")
def t19(spark, d):
    u = ft.to_unit("learning_rate", 0.05, 0.2)
    return grid_table(spark, d).select("config_id", r(ft.to_unit("max_depth", 3, 10), 6).alias("depth_unit"), r(u, 6).alias("lr_unit"), r(ft.from_unit(u, 0.05, 0.2), 6).alias("lr_back"))


def unified(spark, d):
    """J9: one row per configuration with the numbers of its brand's importance and table."""
    grid = grid_table(spark, d)
    li, part = lines(spark, d), table(spark, d, "part")
    s = li.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("dataset")).agg(
        F.count("*").alias("n_rows"), F.avg("is_fraud").alias("fraud_rate"), F.count_distinct("l_suppkey").alias("n_features"),
        F.abs(F.corr("l_quantity", "l_discount")).alias("corr_strength"))
    return grid.join(s, "dataset").withColumns({"n_cols": F.lit(12), "missing_rate": F.lit(0.0), "cv_score": F.col("mean_test_roc_auc")})


UN = GR + f""", {LI}, st AS (SELECT p_brand AS dataset, count(*) AS n_rows, avg(is_fraud) AS fraud_rate, count(DISTINCT l_suppkey) AS n_features, abs(corr(l_quantity,l_discount)) AS corr_strength FROM li JOIN part ON l_partkey=p_partkey GROUP BY 1),
 un AS (SELECT gr.*, n_rows, fraud_rate, n_features, corr_strength, mean_test_roc_auc AS cv_score FROM gr JOIN st USING (dataset))"""


@query("j9_unified_examples", f"WITH {UN} SELECT dataset, config_id, n_rows, round(fraud_rate,6) AS fraud_rate, n_features, round(corr_strength,6) AS corr_strength, round(cv_score,6) AS cv_score FROM un")
def j9(spark, d):
    u = unified(spark, d)
    return u.select("dataset", "config_id", "n_rows", r("fraud_rate", 6).alias("fraud_rate"), "n_features", r("corr_strength", 6).alias("corr_strength"), r("cv_score", 6).alias("cv_score"))


@query("a31_derived_scores", f"""WITH {UN}, q AS (SELECT *, (1+least(n_features/50.0::DOUBLE,1)+least(fraud_rate*10,1)+1-least(corr_strength,1))/4 AS ql FROM un)
 SELECT config_id, round(n_rows*n_features/1e6,6) AS complexity_score, round(ql,6) AS dataset_quality_score, round((abs(max_depth-3)/3.0::DOUBLE+abs(learning_rate-0.1::DOUBLE)/0.1::DOUBLE+abs(n_estimators-100)/100.0::DOUBLE)/3,6) AS hyperparameter_diversity,
 round((max_depth/10.0::DOUBLE+n_estimators/500.0::DOUBLE+n_features/100.0::DOUBLE)/3,6) AS model_complexity, CASE WHEN n_rows>20000 THEN 'large' WHEN n_rows>10000 THEN 'medium' ELSE 'small' END AS size_category, 'basic' AS engineering_level,
 CASE WHEN cv_score>=0.9 THEN 'excellent' WHEN cv_score>=0.8 THEN 'good' WHEN cv_score>=0.7 THEN 'fair' ELSE 'poor' END AS score_category, CASE WHEN ql>0.7 THEN 'production' ELSE 'development' END AS recommended_use_case FROM q""")
def a31(spark, d):
    s = sl.derived_scores(unified(spark, d))
    return s.select("config_id", *[r(c, 6).alias(c) for c in ("complexity_score", "dataset_quality_score", "hyperparameter_diversity", "model_complexity")],
                    "size_category", "engineering_level", "score_category", "recommended_use_case")


@query("a39_example_summary", f"""WITH {UN} SELECT dataset, count(*) AS total_configurations, round(max(cv_score),6) AS best_score, CASE WHEN stddev_pop(cv_score) > 0.05 THEN 'hyperparameter_sensitivity' ELSE 'stable_performance' END AS focus,
 CASE WHEN any_value(fraud_rate) < 0.1 THEN 'high' ELSE 'standard' END AS attention FROM un GROUP BY 1""")
def a39(spark, d):
    return unified(spark, d).groupBy("dataset").agg(
        F.count("*").alias("total_configurations"), r(F.max("cv_score"), 6).alias("best_score"),
        F.when(F.stddev_pop("cv_score") > 0.05, "hyperparameter_sensitivity").otherwise("stable_performance").alias("focus"),
        F.when(F.max("fraud_rate") < 0.1, "high").otherwise("standard").alias("attention"))


@query("a33_dataset_signature", f"""WITH {FC}, fr AS (SELECT user_id AS dataset, avg(is_error) AS rate FROM ev GROUP BY 1) SELECT dataset, count(*) AS n_cols, md5(string_agg(col_name,',' ORDER BY col_name)) AS name_hash,
 round(any_value(rate),2) AS fraud_rate_bucket FROM fc JOIN fr USING (dataset) GROUP BY 1""")
def a33(spark, d):
    g = feed_columns(spark, d).groupBy("dataset").agg(F.count("*").alias("n_cols"), F.md5(F.array_join(F.sort_array(F.collect_list("col_name")), ",")).alias("name_hash"))
    return g.join(feed_rates(spark, d), "dataset").select("dataset", "n_cols", "name_hash", r("fraud_rate", 2).alias("fraud_rate_bucket"))


# ---- registry, users, history ------------------------------------------------------------------------------

def models(spark, d):
    """Registry: one model per supplier, its numbers from the supplier's order lines."""
    s, n, g, li = (table(spark, d, t) for t in ("supplier", "nation", "region", "lineitem"))
    perf = li.groupBy("l_suppkey").agg(F.round(F.lit(0.9) + (F.avg("l_discount") - 0.05) * 5, 9).alias("roc_auc"), F.round(F.avg("l_quantity") / 50, 9).alias("test_f1"),
                                       F.count("*").alias("dataset_size"))
    return (s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).join(perf, F.col("s_suppkey") == F.col("l_suppkey"))
            .select(F.col("s_name").alias("model_name"), F.col("r_name").alias("domain"), (F.col("s_acctbal") > 0).alias("is_active"), "roc_auc", "test_f1", "dataset_size"))


MO = """mo AS (SELECT s_name AS model_name, r_name AS domain, s_acctbal > 0 AS is_active, roc_auc, test_f1, dataset_size FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
 JOIN (SELECT l_suppkey, round(0.9::DOUBLE+(avg(l_discount)-0.05::DOUBLE)*5,9) AS roc_auc, round(avg(l_quantity)/50,9) AS test_f1, count(*) AS dataset_size FROM lineitem GROUP BY 1) ON s_suppkey=l_suppkey)"""


@query("p16_active_models", f"WITH {MO} SELECT model_name, domain, round(roc_auc,6) AS roc_auc FROM mo WHERE is_active AND roc_auc >= 0.9 AND domain = 'ASIA'")
def p16(spark, d):
    return rg.active_models(models(spark, d), "ASIA").select("model_name", "domain", r("roc_auc", 6).alias("roc_auc"))


@query("p17_search", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%00012%' OR c_mktsegment ILIKE '%house%'")
def p17(spark, d):
    c = table(spark, d, "customer")
    return rg.search(c, ["c_name", "c_mktsegment"], "00012").unionByName(
        rg.search(c, ["c_mktsegment"], "house").join(rg.search(c, ["c_name", "c_mktsegment"], "00012").select("c_custkey"), "c_custkey", "left_anti")).select("c_custkey", "c_name", "c_mktsegment")


NOW = "2001-01-01 00:00:00"


def licences(spark, d):
    """Licences: one per customer, running 400 days from the customer's latest order."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg((F.max("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("expires_at"), F.min("o_orderdate").alias("created_at"))
    return (table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
            .select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("license_type"), "expires_at", "created_at", (F.col("c_acctbal") > 0).alias("is_active")))


LC = """lc AS (SELECT c_custkey AS user_id, c_mktsegment AS license_type, x AS expires_at, m AS created_at, c_acctbal > 0 AS is_active FROM customer JOIN (SELECT o_custkey, max(o_orderdate) + INTERVAL 400 DAY AS x, min(o_orderdate) AS m FROM orders GROUP BY 1) ON c_custkey=o_custkey)"""


def now():
    return F.to_timestamp(F.lit(NOW))


@query("p18_time_predicates", f"""WITH {LC} SELECT user_id, CAST(expires_at < TIMESTAMP '{NOW}' AS INT) AS is_expired, CAST(is_active AND expires_at >= TIMESTAMP '{NOW}' AS INT) AS is_valid,
 CAST(greatest(0, floor((epoch_us(expires_at)-epoch_us(TIMESTAMP '{NOW}'))/86400000000)) AS INT) AS days_remaining FROM lc""")
def p18(spark, d):
    return rg.licence_times(licences(spark, d), "expires_at", now()).select("user_id", "is_expired", "is_valid", "days_remaining")


@query("p18_recent_rows", f"SELECT 7 AS days, count(*) FILTER (o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS n FROM orders UNION ALL SELECT 30, count(*) FILTER (o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY) FROM orders")
def p18r(spark, d):
    o = table(spark, d, "orders")
    one = lambda k: rg.recent(o, "o_orderdate", now(), k).agg(F.lit(k).alias("days"), F.count("*").alias("n"))
    return one(7).unionByName(one(30))


@query("a35_run_report", "SELECT count(*) FILTER (o_orderstatus='F') AS n_success, count(*) FILTER (o_orderstatus<>'F') AS n_failed, round(avg(o_totalprice/1e6) FILTER (o_orderstatus='F'),6) AS mean_f1, round(avg(1-o_totalprice/1e7) FILTER (o_orderstatus='F'),6) AS mean_auc, round(sum(o_totalprice),0) AS total_time FROM orders")
def a35(spark, d):
    h = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("success"), (F.col("o_totalprice") / 1e6).alias("test_f1"), (1 - F.col("o_totalprice") / 1e7).alias("test_auc"),
                                         F.col("o_totalprice").alias("training_time"))
    x = rg.run_report(h)
    return x.select("n_success", "n_failed", r("mean_f1", 6).alias("mean_f1"), r("mean_auc", 6).alias("mean_auc"), r("total_time", 0).alias("total_time"))


@query("a36_dashboard_kpis", "SELECT count(*) AS total_runs, count(*) FILTER (o_orderstatus='F') AS successful, round(count(*) FILTER (o_orderstatus='F')*100.0::DOUBLE/count(*),4) AS success_rate, count(DISTINCT o_custkey) AS users FROM orders")
def a36(spark, d):
    ok = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").agg(F.count("*").alias("total_runs"), ok.alias("successful"), r(ok / F.count("*") * 100).alias("success_rate"), F.count_distinct("o_custkey").alias("users"))


@query("a37_licences_by_type", f"WITH {LC} SELECT license_type, count(*) AS n, count(*) FILTER (is_active) AS active, count(*) FILTER (expires_at < TIMESTAMP '{NOW}') AS expired FROM lc GROUP BY 1")
def a37(spark, d):
    x = rg.licence_times(licences(spark, d), "expires_at", now())
    return x.groupBy("license_type").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"), F.sum("is_expired").alias("expired"))


@query("j5_users_licences_history", f"""WITH {LC} SELECT c_custkey, license_type, CAST(is_active AS INT) AS is_active, count(o_orderkey) AS n_runs, count(o_orderkey) FILTER (o_orderstatus='F') AS n_success FROM customer LEFT JOIN lc ON user_id=c_custkey
 LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1,2,3""")
def j5(spark, d):
    runs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_runs"), F.count_if(F.col("o_orderstatus") == "F").alias("n_success"))
    lic = licences(spark, d).select(F.col("user_id").alias("c_custkey"), "license_type", F.col("is_active").cast("int").alias("is_active"))
    return (table(spark, d, "customer").select("c_custkey").join(lic, "c_custkey", "left").join(runs, "c_custkey", "left")
            .select("c_custkey", "license_type", "is_active", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("n_success", F.lit(0)).alias("n_success")))


@query("j6_daily_counts", "WITH s AS (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-02-04', INTERVAL 1 DAY))::DATE AS day) SELECT strftime(day,'%Y-%m-%d') AS day, count(event_id) AS n FROM s LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY 1")
def j6(spark, d):
    return rg.daily_counts(events(spark, d), "ts", F.to_date(F.lit("2024-02-04"))).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("j7_nearest_reference", """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), s AS (SELECT s_suppkey, CAST(floor(abs(s_acctbal)) AS BIGINT) AS m FROM supplier)
 SELECT user_id, n, arg_min(s_suppkey, (abs(ln(n+1.0::DOUBLE)-ln(m+1.0::DOUBLE)), s_suppkey)) AS nearest FROM u, s GROUP BY 1,2""")
def j7(spark, d):
    u = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    s = table(spark, d, "supplier").select("s_suppkey", F.floor(F.abs("s_acctbal")).cast("bigint").alias("m"))
    return rg.nearest_by_log(u, s, "n", "m", "user_id", "s_suppkey").select("user_id", "n", "nearest")


@query("j8_registry_upsert", f"""WITH {MO}, nw AS (SELECT model_name, NULL::VARCHAR AS domain, true AS is_active, roc_auc + 0.01::DOUBLE AS roc_auc FROM mo WHERE dataset_size % 2 = 0 UNION ALL SELECT c_name, c_mktsegment, true, 0.95::DOUBLE FROM customer WHERE c_acctbal < 0)
 SELECT coalesce(nw.model_name, mo.model_name) AS model_name, coalesce(nw.domain, mo.domain) AS domain, CAST(coalesce(nw.is_active, mo.is_active) AS INT) AS is_active, round(coalesce(nw.roc_auc, mo.roc_auc),6) AS roc_auc FROM mo FULL OUTER JOIN nw ON mo.model_name=nw.model_name""")
def j8(spark, d):
    old = models(spark, d)
    new = (old.where("dataset_size % 2 = 0").select("model_name", F.lit(None).cast("string").alias("domain"), F.lit(True).alias("is_active"), (F.col("roc_auc") + 0.01).alias("roc_auc"))
           .unionByName(table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("model_name"), F.col("c_mktsegment").alias("domain"), F.lit(True).alias("is_active"), F.lit(0.95).alias("roc_auc"))))
    u = rg.upsert(old.select("model_name", "domain", "is_active", "roc_auc"), new, "model_name")
    return u.select("model_name", "domain", F.col("is_active").cast("int").alias("is_active"), r("roc_auc", 6).alias("roc_auc"))


@query("w5_usage_average", """WITH RECURSIVE k AS (SELECT user_id, event_id, ts, value/500 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 a AS (SELECT user_id, i, s AS m FROM k WHERE i = 1 UNION ALL SELECT k.user_id, k.i, 0.7::DOUBLE*a.m + 0.3::DOUBLE*k.s FROM a JOIN k ON k.user_id=a.user_id AND k.i=a.i+1),
 n AS (SELECT user_id, count(*) AS usage_count, max(ts) AS last FROM events GROUP BY 1) SELECT n.user_id, usage_count, epoch_us(last) AS last_used_us, round(m,6) AS avg_similarity_score FROM n JOIN a ON a.user_id=n.user_id AND a.i=n.usage_count""")
def w5(spark, d):
    u = rg.usage(events(spark, d).withColumn("s", F.col("value") / 500), "user_id", "ts", "event_id", "s")
    return u.select("user_id", "usage_count", F.unix_micros(F.col("last_used_at").cast("timestamp")).alias("last_used_us"), r("avg_similarity_score", 6).alias("avg_similarity_score"))


@query("k12_pagination", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def k12(spark, d):
    """Page 3 of 20 rows, read as a key range found in a stored page index."""
    orders, keys = table(spark, d, "orders"), [("o_orderdate", True), ("o_orderkey", False)]
    return rg.keyset_page(orders, keys, rg.page_index(orders, keys, 20), 3, 20).select("o_orderkey", "o_totalprice")


@query("k13_registry_listing", f"WITH {MO} SELECT domain, model_name FROM mo ORDER BY domain, model_name LIMIT 10")
def k13(spark, d):
    return models(spark, d).orderBy("domain", "model_name").limit(10).select("domain", "model_name")


@query("k15_available_models", f"""WITH {MO}, loc AS (SELECT model_name FROM mo WHERE dataset_size % 2 = 1 UNION SELECT c_name FROM customer WHERE c_acctbal < 0), al AS (SELECT model_name FROM loc UNION SELECT model_name FROM mo WHERE is_active)
 SELECT al.model_name, domain, round(test_f1,6) AS test_f1, round(roc_auc,6) AS test_auc FROM al LEFT JOIN mo USING (model_name)""")
def k15(spark, d):
    m = models(spark, d)
    local = m.where("dataset_size % 2 = 1").select("model_name").unionByName(table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("model_name")))
    names = local.unionByName(m.where("is_active").select("model_name")).distinct()
    return names.join(m, "model_name", "left").select("model_name", "domain", r("test_f1", 6).alias("test_f1"), r("roc_auc", 6).alias("test_auc")).orderBy("model_name")


# ---- column choices --------------------------------------------------------------------------------------------

@query("p1_drop_by_name", "SELECT event_type, value, props, ts FROM events")
def p1(spark, d):
    return cl.without_ids(table(spark, d, "events"))


@query("p2_drop_identifiers", "SELECT l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_orderkey, l_partkey FROM lineitem")
def p2(spark, d):
    li = lines(spark, d).drop("is_fraud")
    return li.select(*cl.training_columns(li))


@query("p3_drop_and_coerce", "SELECT o_orderkey, o_totalprice, coalesce(TRY_CAST(o_orderpriority AS DOUBLE),0) AS o_orderpriority, 0.0::DOUBLE AS o_orderstatus FROM orders")
def p3(spark, d):
    return cl.drop_and_coerce(table(spark, d, "orders"), ["o_orderdate", "o_custkey"])


@query("p5_keep_identifiers", "SELECT event_id, user_id FROM events")
def p5(spark, d):
    e = table(spark, d, "events")
    return e.select(*cl.id_columns(e))


@query("p7_amount_guard", f"WITH {EV} SELECT event_id, round(value*value,4) AS value_squared, round(((k-50)/30.0::DOUBLE)*((k-50)/30.0::DOUBLE),4) AS k_zscore_squared FROM ev")
def p7(spark, d):
    e = events(spark, d).withColumns({"k_zscore": (F.col("k") - 50) / 30.0, "is_error_flag": F.col("is_error"), "amount_text": F.col("event_type")})
    todo = cl.amount_columns_to_transform(e, ["value", "k_zscore", "is_error_flag", "amount_text"])
    return e.select("event_id", *[r(F.col(c) * F.col(c)).alias(f"{c}_squared") for c, how in todo.items() if how != "skip"])


@query("p8_align_schema", f"WITH {EV} SELECT event_id, value, 0.0::DOUBLE AS missing_feature, k::DOUBLE AS k FROM ev")
def p8(spark, d):
    return cl.align(events(spark, d), ["value", "missing_feature", "k"], keep=["event_id"])


@query("p9_rename", "SELECT event_id AS tx_id, user_id AS cust_id, value AS tx_amount FROM events")
def p9(spark, d):
    return cl.rename(table(spark, d, "events").select("event_id", "user_id", "value"), {"event_id": "tx_id", "user_id": "cust_id", "value": "tx_amount"})


@query("p10_split_timestamp", "SELECT event_id, strftime(ts,'%Y-%m-%d') AS ts_date, strftime(ts,'%H:%M:%S') AS ts_time FROM events")
def p10(spark, d):
    return cl.split_timestamp(events(spark, d), "ts").select("event_id", F.date_format("ts_date", "yyyy-MM-dd").alias("ts_date"), "ts_time")


@query("p11_drop_missing_label", f"WITH {EV} SELECT event_id, is_error FROM ev WHERE k % 10 <> 0")
def p11(spark, d):
    e = events(spark, d).select("event_id", F.when(F.col("k") % 10 != 0, F.col("is_error")).alias("is_error"))
    return cl.drop_missing_label(e, "is_error")


@query("p19_describe_amount_like", "SELECT 'l_extendedprice' AS name, round(avg(l_extendedprice),3) AS mean, round(stddev_samp(l_extendedprice),3) AS std, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value FROM lineitem")
def p19(spark, d):
    li = table(spark, d, "lineitem")
    cols = [c for c in pf.numeric_columns(li) if any(w in c for w in ("amount", "price", "value", "proba", "predict"))]
    p = pf.column_profile(li.select(*cols))
    return p.select("name", r("mean", 3).alias("mean"), r("std", 3).alias("std"), F.col("min").alias("min_value"), F.col("max").alias("max_value"))
