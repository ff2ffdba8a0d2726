"""Queries for table profiles, class balance, correlations and label detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwatch.functions import features as ft
from ledgerwatch.functions import names as nm
from ledgerwatch.operators import profile as pf
from ledgerwatch.operators import target as tg
from ledgerwatch.plans.base import EV, LI, big, events, lines, query, r, table

# lineitem with the derived label as its last column
LT = """lt AS (SELECT *, CAST(l_quantity > 45 AND l_discount >= 0.06 AS INT) AS is_fraud FROM lineitem)"""
LT_TYPES = dict(l_orderkey="integer", l_partkey="integer", l_suppkey="integer", l_linenumber="integer",
                l_quantity="float", l_extendedprice="float", l_discount="float", l_tax="float",
                l_returnflag="string", l_linestatus="string", l_shipdate="other", is_fraud="integer")
LT_NUM = [c for c, t in LT_TYPES.items() if t in ("integer", "float")]
LT_X = [c for c in LT_NUM if c != "is_fraud"]


def labelled(spark, d):
    return lines(spark, d).drop("line_id")


def union(rows) -> str:
    return " UNION ALL ".join(rows)


def profile_sql(types: dict, source: str) -> str:
    one = []
    for i, (c, t) in enumerate(types.items()):
        num = (f"avg({c}), stddev_samp({c}), min({c})::DOUBLE, max({c})::DOUBLE" if t in ("integer", "float")
               else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE")
        one.append(f"SELECT '{c}' AS name, {i} AS position, '{t}' AS dtype, count(*) AS n_rows, count(DISTINCT {c}) AS n_unique, "
                   f"count(*)-count({c}) AS missing, (count(*)-count({c}))*100.0::DOUBLE/count(*) AS missing_pct, "
                   + ", ".join(f"{e} AS {a}" for e, a in zip(num.replace("), ", ")|").replace("DOUBLE, ", "DOUBLE|").split("|"),
                                                             ("mean", "std", "min", "max"))) + f" FROM {source}")
    return union(one)


PROFILE_SQL = profile_sql(LT_TYPES, "lt")


@query("a1_column_profile", f"""WITH {LT}, p AS ({PROFILE_SQL}) SELECT name, position, dtype, n_rows, n_unique, missing, round(missing_pct,4) AS missing_pct,
 round(mean,4) AS mean, round(std,4) AS std, round("min",4) AS min_value, round("max",4) AS max_value FROM p""")
def a1(spark, d):
    p = pf.column_profile(labelled(spark, d))
    return p.select("name", "position", "dtype", big("n_rows").alias("n_rows"), big("n_unique").alias("n_unique"), big("missing").alias("missing"),
                    r("missing_pct").alias("missing_pct"), r("mean").alias("mean"), r("std").alias("std"),
                    r("min").alias("min_value"), r("max").alias("max_value"))


@query("a1_sample_values", union(f"SELECT '{c}' AS name, value FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value, {c} AS v FROM lineitem ORDER BY v LIMIT 5)"
                                 for c in ("l_returnflag", "l_linenumber", "l_suppkey")))
def a1s(spark, d):
    return pf.sample_values(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber", "l_suppkey"])


@query("a2_feature_summary", f"""WITH {LT}, p AS ({PROFILE_SQL}), q AS (SELECT *, dtype IN ('integer','float') AS num FROM p)
 SELECT count(*) FILTER (num) AS numerical_features, count(*) FILTER (NOT num AND n_unique=2) AS binary_features,
 count(*) FILTER (NOT num AND n_unique<>2 AND n_unique<=50) AS categorical_features, count(*) FILTER (NOT num AND n_unique>50) AS high_cardinality_features,
 count(*) FILTER (missing>0) AS features_with_missing, CAST(sum(missing) AS BIGINT) AS total_missing, round(avg(n_unique),4) AS avg_unique_values FROM q""")
def a2(spark, d):
    return pf.feature_summary(pf.column_profile(labelled(spark, d))).withColumn("avg_unique_values", r("avg_unique_values"))


@query("a3_missing_duplicates", f"""WITH {EV}, e AS (SELECT user_id, event_type, CASE WHEN k%10=0 THEN NULL ELSE k END AS k FROM ev)
 SELECT count(*) AS n_rows, round((count(*)-count(k))*1.0::DOUBLE/(count(*)*3),6) AS missing_rate,
 round(1-(SELECT count(*) FROM (SELECT DISTINCT * FROM e))*1.0::DOUBLE/count(*),6) AS duplicate_rate FROM e""")
def a3(spark, d):
    e = events(spark, d).select("user_id", "event_type", F.when(F.col("k") % 10 != 0, F.col("k")).alias("k"))
    return pf.missing_and_duplicates(e).select("n_rows", r("missing_rate", 6).alias("missing_rate"), r("duplicate_rate", 6).alias("duplicate_rate"))


@query("a4_class_balance", f"""WITH {LI}, g AS (SELECT is_fraud AS label, count(*) AS n FROM li GROUP BY 1)
 SELECT label, n, round(n*1.0::DOUBLE/(SELECT sum(n) FROM g),6) AS ratio, round((SELECT max(n)*1.0::DOUBLE/min(n) FROM g),4) AS imbalance_ratio FROM g""")
def a4(spark, d):
    return pf.class_balance(lines(spark, d), "is_fraud").select("label", "n", r("ratio", 6).alias("ratio"), r("imbalance_ratio").alias("imbalance_ratio"))


CORR_SQL = union(f"SELECT '{c}' AS name, {i} AS position, abs(corr({c}, is_fraud)) AS correlation FROM lt" for i, c in enumerate(LT_X))


@query("a5_target_correlation", f"""WITH {LT}, c AS ({CORR_SQL}), t AS (SELECT *, row_number() OVER (ORDER BY correlation DESC, name) AS rk FROM c WHERE position < 10)
 SELECT name, round(correlation,6) AS correlation, CAST(rk <= 5 AS INT) AS in_top5, (SELECT round(max(correlation),6) FROM c) AS correlation_max,
 (SELECT round(min(correlation),6) FROM c) AS correlation_min, (SELECT round(avg(correlation),6) FROM c) AS correlation_mean FROM t""")
def a5(spark, d):
    c = pf.target_correlations(labelled(spark, d), "is_fraud", LT_X)
    from pyspark.sql import Window
    s = c.agg(*pf.spread(c, "correlation", "correlation"))
    top = c.where("position < 10").withColumn("rk", F.row_number().over(Window.orderBy(F.desc("correlation"), "name")))
    return top.join(F.broadcast(s)).select("name", r("correlation", 6).alias("correlation"), (F.col("rk") <= 5).cast("int").alias("in_top5"),
                                           *[r(f"correlation_{x}", 6).alias(f"correlation_{x}") for x in ("max", "min", "mean")])


def moment_sql(corrected: bool) -> str:
    sk = "skewness({c})" if corrected else "skewness({c})*(count({c})-2)/sqrt(count({c})*1.0::DOUBLE*(count({c})-1))"
    ku = "kurtosis({c})" if corrected else "kurtosis_pop({c})"
    return union(f"SELECT '{c}' AS name, var_samp({c}) AS variance, stddev_samp({c}) AS std, {sk.format(c=c)} AS skewness, {ku.format(c=c)} AS kurtosis FROM lt" for c in LT_X)


@query("a6_moments", f"""WITH {LT}, m AS ({moment_sql(False)}) SELECT name, round(variance,3) AS variance, round(skewness,5) AS skewness, round(kurtosis,5) AS kurtosis FROM m""")
def a6(spark, d):
    return pf.moments(labelled(spark, d), LT_X).select("name", r("variance", 3).alias("variance"), r("skewness", 5).alias("skewness"), r("kurtosis", 5).alias("kurtosis"))


@query("a7_meta_features", f"""WITH {LT}, c AS ({CORR_SQL}), m AS ({moment_sql(False)})
 SELECT (SELECT count(*) FROM lt) AS rows, 12 AS columns, (SELECT round(avg(is_fraud),6) FROM lt) AS fraud_rate, 0.0::DOUBLE AS missing_rate,
 (SELECT round(1-(SELECT count(*) FROM (SELECT DISTINCT * FROM lt))*1.0::DOUBLE/count(*),6) FROM lt) AS duplicate_rate, 9 AS numeric_columns, 2 AS categorical_columns,
 (SELECT round(max(correlation),5) FROM c) AS correlation_max, (SELECT round(min(correlation),5) FROM c) AS correlation_min, (SELECT round(avg(correlation),5) FROM c) AS correlation_mean,
 round(max(variance)/1e6,4) AS variance_max, round(min(variance),5) AS variance_min, round(avg(variance)/1e6,4) AS variance_mean, round(max(skewness),5) AS skewness_max,
 round(min(skewness),5) AS skewness_min, round(avg(skewness),5) AS skewness_mean, round(max(kurtosis),5) AS kurtosis_max, round(avg(kurtosis),5) AS kurtosis_mean FROM m""")
def a7(spark, d):
    m = pf.meta_features(labelled(spark, d), "is_fraud")
    dig = {"fraud_rate": 6, "missing_rate": 6, "duplicate_rate": 6}
    out = []
    for c in m.columns:
        if c in ("rows", "columns", "numeric_columns", "categorical_columns"):
            out.append(c)
        elif c in ("variance_max", "variance_mean"):
            out.append(r(F.col(c) / 1e6).alias(c))
        else:
            out.append(r(c, dig.get(c, 5)).alias(c))
    return m.select(*out)


def amount_sql(cols, source):
    return union(f"""SELECT '{c}' AS name, round(avg({c}),3) AS mean, round(median({c}),4) AS median, round(stddev_samp({c}),3) AS std, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value,
 round(quantile_cont({c},0.25),4) AS q25, round(quantile_cont({c},0.75),4) AS q75, round(skewness({c}),5) AS skewness, count(*) FILTER ({c}=0) AS has_zeros, count(*) FILTER ({c}<0) AS has_negatives FROM {source}""" for c in cols)


@query("a8_amount_patterns", amount_sql(["l_extendedprice", "l_quantity", "l_tax"], "lineitem"))
def a8(spark, d):
    p = pf.amount_patterns(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"])
    return p.select("name", r("mean", 3).alias("mean"), r("median").alias("median"), r("std", 3).alias("std"), F.col("min").alias("min_value"),
                    F.col("max").alias("max_value"), r("q25").alias("q25"), r("q75").alias("q75"), r("skewness", 5).alias("skewness"),
                    "has_zeros", "has_negatives")


CATS = ["l_returnflag", "l_linestatus", "l_shipdate"]


@query("a9_categorical_patterns", "WITH " + ", ".join(f"""g{i} AS (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1),
 t{i} AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rk FROM g{i})""" for i, c in enumerate(CATS)) + " " + union(
    f"""SELECT '{c}' AS name, (SELECT count(*) FROM g{i}) AS n_unique, (SELECT value FROM t{i} WHERE rk=1) AS most_common,
 round((SELECT n FROM t{i} WHERE rk=1)*1.0::DOUBLE/(SELECT sum(n) FROM g{i}),6) AS most_common_pct, (SELECT string_agg(value,'|' ORDER BY rk) FROM t{i} WHERE rk<=5) AS top_5_values,
 CAST((SELECT count(*) FROM g{i}) > (SELECT count(*) FROM lineitem)*0.5 AS INT) AS is_high_cardinality""" for i, c in enumerate(CATS)))
def a9(spark, d):
    return pf.categorical_patterns(table(spark, d, "lineitem"), CATS).withColumn("most_common_pct", r("most_common_pct", 6))


@query("a10_target_indicator", f"""WITH {LI} SELECT 'is_fraud' AS fraud_col_name, CAST(sum(is_fraud) AS BIGINT) AS fraud_count, round(avg(is_fraud),6) AS fraud_rate,
 count(*) AS n_samples, round((1-avg(is_fraud))/avg(is_fraud),4) AS class_imbalance FROM li""")
def a10(spark, d):
    li = lines(spark, d)
    name = tg.first_match(li, "metadata")
    return li.agg(F.lit(name).alias("fraud_col_name"), F.sum(name).cast("bigint").alias("fraud_count"), r(F.avg(name), 6).alias("fraud_rate"),
                  F.count("*").alias("n_samples"), r((1 - F.avg(name)) / F.avg(name)).alias("class_imbalance"))


@query("a11_fraud_rate_by_time", f"""WITH {EV}, e AS (SELECT *, CAST(value > 150 AND (hour(ts) >= 22 OR hour(ts) <= 6) AS INT) AS y FROM ev)
 SELECT 'hour' AS time_column, CAST(hour(ts) AS INT) AS time_value, count(*) AS n, round(avg(y),6) AS fraud_rate FROM e GROUP BY 2
 UNION ALL SELECT 'weekday', CAST(isodow(ts)-1 AS INT), count(*), round(avg(y),6) FROM e GROUP BY 2""")
def a11(spark, d):
    e = events(spark, d)
    e = e.withColumn("y", ((F.col("value") > 150) & (ft.is_night(F.hour("ts")) == 1)).cast("int"))
    parts = F.array(*[F.struct(F.lit(n).alias("time_column"), c.alias("time_value"))
                      for n, c in (("hour", F.hour("ts")), ("weekday", F.weekday("ts")))])
    return (e.select("y", F.explode(parts).alias("t")).groupBy("t.time_column", "t.time_value")
            .agg(F.count("*").alias("n"), r(F.avg("y"), 6).alias("fraud_rate")))


@query("a12_fraud_rate_by_amount_bin", f"""WITH {EV}, g AS (SELECT min(value) AS mn, max(value) AS mx FROM ev)
 SELECT CAST(greatest(0, least(9, ceil((value-mn)/((mx-mn)/10))-1)) AS INT) AS amount_bin, count(*) AS n, round(avg(is_error),6) AS fraud_rate FROM ev, g GROUP BY 1""")
def a12(spark, d):
    ev = events(spark, d)
    e = ev.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    return pf.rate_by(ev, ft.equal_width_bin("value", e["lo"], e["hi"]), "is_error", "amount_bin").withColumn("fraud_rate", r("fraud_rate", 6))


CM_PAIRS = [(a, b) for i, a in enumerate(LT_NUM) for b in LT_NUM[i + 1:]]
CM_SQL = union(f"SELECT '{a}' AS a, '{b}' AS b, corr({a},{b}) AS r FROM lt" for a, b in CM_PAIRS)


@query("a13_correlation_matrix", f"""WITH {LT}, m AS ({CM_SQL}) SELECT a, b, round(r,5)+0.0 AS r, CAST(abs(r) > 0.8 AS INT) AS redundant,
 (SELECT round(min(r),5) FROM m) AS min_r, (SELECT round(max(r),5) FROM m) AS max_r, (SELECT round(avg(r),5) FROM m) AS mean_r FROM m""")
def a13(spark, d):
    m = pf.correlation_matrix(labelled(spark, d), LT_NUM)
    s = m.agg(r(F.min("r"), 5).alias("min_r"), r(F.max("r"), 5).alias("max_r"), r(F.avg("r"), 5).alias("mean_r"))
    return m.join(F.broadcast(s)).select("a", "b", (r("r", 5) + 0.0).alias("r"), (F.abs("r") > 0.8).cast("int").alias("redundant"), "min_r", "max_r", "mean_r")


@query("a14_correlation_strength", f"""WITH {LT}, m AS ({CM_SQL}) SELECT round(avg(abs(r)),6) AS without_diagonal,
 round((2*sum(abs(r))+{len(LT_NUM)})/({len(LT_NUM)}*{len(LT_NUM)}),6) AS with_diagonal FROM m""")
def a14(spark, d):
    n = len(LT_NUM)
    return pf.correlation_matrix(labelled(spark, d), LT_NUM).agg(
        r(F.avg(F.abs("r")), 6).alias("without_diagonal"), r((F.sum(F.abs("r")) * 2 + n) / (n * n), 6).alias("with_diagonal"))


@query("a15_mean_moments", f"""WITH {LT}, m AS ({moment_sql(True)}) SELECT round(avg(std),3) AS numeric_mean_std, round(avg(skewness),5) AS numeric_mean_skewness,
 round(avg(kurtosis),5) AS numeric_mean_kurtosis, round(max(variance)/1e6,4) AS numeric_variance_max, round(avg(variance)/1e6,4) AS numeric_variance_mean FROM m""")
def a15(spark, d):
    return pf.moments(labelled(spark, d), LT_X, corrected=True).agg(
        r(F.avg("std"), 3).alias("numeric_mean_std"), r(F.avg("skewness"), 5).alias("numeric_mean_skewness"),
        r(F.avg("kurtosis"), 5).alias("numeric_mean_kurtosis"), r(F.max("variance") / 1e6).alias("numeric_variance_max"),
        r(F.avg("variance") / 1e6).alias("numeric_variance_mean"))


@query("a32_structure_recommendations", f"""WITH {LT}, p AS ({PROFILE_SQL}), g AS (SELECT count(*) AS n FROM lt GROUP BY is_fraud)
 SELECT CAST((SELECT max(n)*1.0::DOUBLE/min(n) FROM g) > 10 AS INT) AS scale_pos_weight_needed, CAST(count(*) > 50 AS INT) AS feature_selection_needed,
 CAST(max(missing) > 0 AS INT) AS missing_imputation_needed, CAST(count(*) FILTER (dtype NOT IN ('integer','float') AND n_unique<>2 AND n_unique<=50) > 0 AS INT) AS encoding_needed,
 CAST(count(*) FILTER (dtype IN ('integer','float') AND (contains(name,'amount') OR contains(name,'value') OR contains(name,'sum'))) > 0 AS INT) AS outlier_detection_needed FROM p""")
def a32(spark, d):
    df = labelled(spark, d)
    p = pf.column_profile(df)
    s = pf.feature_summary(p)
    amounts = p.agg(F.count_if(F.col("dtype").isin("integer", "float") & nm.has_any(F.col("name"), ["amount", "value", "sum"])).alias("amounts"))
    b = pf.class_balance(df, "is_fraud").agg(F.max("imbalance_ratio").alias("imb"))
    yes = lambda c: c.cast("int")
    return s.join(F.broadcast(amounts)).join(F.broadcast(b)).select(
        yes(F.col("imb") > 10).alias("scale_pos_weight_needed"), yes(F.lit(len(df.columns) > 50)).alias("feature_selection_needed"),
        yes(F.col("features_with_missing") > 0).alias("missing_imputation_needed"), yes(F.col("categorical_features") > 0).alias("encoding_needed"),
        yes(F.col("amounts") > 0).alias("outlier_detection_needed"))


@query("a38_value_counts", union(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2"
                                 for c in ("l_returnflag", "l_linestatus", "l_linenumber")))
def a38(spark, d):
    return pf.value_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("p4_select_by_type", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus FROM lineitem")
def p4(spark, d):
    li = table(spark, d, "lineitem")
    nums, texts = pf.numeric_columns(li), pf.text_columns(li)
    return li.select(*[c for c in nums if c in ("l_orderkey", "l_linenumber", "l_quantity")], *texts)


@query("p14_drop_empty_columns", "SELECT event_id, value FROM events")
def p14(spark, d):
    e = events(spark, d).select("event_id", "value", "user_id", F.lit(0).alias("zero"), F.lit("").alias("blank"), F.lit(None).cast("double").alias("nothing"))
    return pf.drop_empty(e, keep=("event_id",), also=("user_id",))


@query("p15_drop_constant_columns", "SELECT event_id, value, event_type FROM events")
def p15(spark, d):
    return pf.drop_constant(events(spark, d).select("event_id", "value", "event_type", F.lit(7).alias("seven")))


# ---- label detection ---------------------------------------------------------------------------

def keyword_sql(rules) -> str:
    low = "lower(name)"
    return " + ".join(f"""CASE WHEN starts_with({low},'{w}') OR starts_with({low},'is_{w}') THEN {p * 2.0}::DOUBLE
 WHEN contains({low},'_{w}') THEN {p * 1.5}::DOUBLE WHEN contains({low},'{w}') THEN {float(p)}::DOUBLE ELSE 0 END""" for w, p in rules.keywords.items())


CAND_SQL = union(f"SELECT '{c}' AS name, {i} AS position, '{t}' AS dtype, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lt WHERE {c} IS NOT NULL GROUP BY 4"
                 for i, (c, t) in enumerate(LT_TYPES.items()))


def target_sql(rules, where: str = "true") -> str:
    texts = ", ".join(f"'{t}'" for t in rules.text_labels)
    return f"""WITH {LT}, vc AS ({CAND_SQL}), cand AS (SELECT name, position, dtype, count(*) AS u, min(n)*1.0::DOUBLE/sum(n) AS s, bool_or(lower(value) IN ({texts})) AS lab
   FROM vc GROUP BY 1,2,3 HAVING count(*) BETWEEN 2 AND 20), cn AS (SELECT name AS col_name FROM cand), {nm.sql_groups('cn')},
 sc AS (SELECT cand.*, grp, CASE WHEN u=2 THEN 300 WHEN u<=5 THEN 200 WHEN u<=10 THEN 100 ELSE 50 END
  + CASE WHEN s>=0.001 AND s<=0.05 THEN 400 WHEN s>0.05 AND s<=0.15 THEN 250 WHEN s>0.15 AND s<=0.3 THEN 100 WHEN s>0.3 AND s<=0.45 THEN 20 ELSE 0 END
  + CASE WHEN position=11 THEN 150 WHEN position>=9 THEN 75 WHEN position>=7 THEN 30 ELSE 0 END
  + CASE WHEN dtype='integer' THEN 50 WHEN dtype='string' AND lab THEN 100 ELSE 0 END AS stat_score, {keyword_sql(rules)} AS pts FROM cand JOIN ng ON ng.col_name=name),
 fin AS (SELECT *, CASE WHEN {nm.sql_any('name', rules.penalty)} THEN floor(pts*0.5::DOUBLE) ELSE pts END AS name_score FROM sc WHERE {where})
 SELECT name, u AS n_unique, stat_score, name_score, CAST(floor(stat_score*0.7::DOUBLE + name_score*0.3::DOUBLE) AS INT) AS score FROM fin"""


NON_TARGET_SQL = f"""NOT (lower(name) IN ({', '.join(repr(w) for w in nm.TEMPORAL_EXACT)}) OR {nm.sql_any('name', nm.TEMPORAL)} OR grp='timestamp'
 OR {nm.sql_any('name', nm.FINANCIAL)} OR grp='amount' OR {nm.sql_any('name', nm.IDENTIFIER)} OR grp IN ('transaction_id','customer_id','account'))"""


@query("t1_hybrid_target", target_sql(tg.TRAIN, NON_TARGET_SQL))
def t1(spark, d):
    return tg.score_targets(labelled(spark, d), tg.TRAIN).select("name", "n_unique", "stat_score", "name_score", "score")


@query("t2_leakage_guard", target_sql(tg.GUARD))
def t2(spark, d):
    return tg.score_targets(labelled(spark, d), tg.GUARD).select("name", "n_unique", "stat_score", "name_score", "score")


@query("t2_drop_leaked_target", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def t2d(spark, d):
    kept = tg.drop_leaked_target(labelled(spark, d))
    return kept.select(*[c for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "is_fraud") if c in kept.columns])


@query("t3_service_analysis")
def t3(spark, d):
    df = labelled(spark, d)
    s = tg.score_targets(df, tg.SERVICE).limit(3)
    miss = pf.column_profile(df, exact=False).agg(F.sum("missing").alias("missing_count"))
    return s.join(F.broadcast(miss)).select("name", "score", "n_unique", (F.col("score") >= 100).cast("int").alias("is_labeled"),
                                            r(F.col("min_share") * 100, 2).alias("fraud_rate"), "missing_count")


@query("t4_keyword_target", f"""WITH {LT}, vc AS ({CAND_SQL}), cand AS (SELECT name, position, dtype, count(*) AS u FROM vc GROUP BY 1,2,3 HAVING count(*) <= 5),
 cn AS (SELECT name AS col_name FROM cand), {nm.sql_groups('cn')}, sc AS (SELECT name, u, greatest(CASE WHEN grp='fraud' THEN 100 END, CASE WHEN u>=2 THEN
  CASE {' '.join(f"WHEN contains(lower(name),'{w}') THEN {p}" for w, p in tg.KEYWORD_TARGETS.items())} END + CASE WHEN u=2 THEN 20 ELSE 0 END + CASE WHEN dtype='string' THEN 10 ELSE 0 END END) AS score
  FROM cand JOIN ng ON ng.col_name=name) SELECT name, u AS n_unique, score FROM sc WHERE score IS NOT NULL""")
def t4(spark, d):
    return tg.keyword_targets(labelled(spark, d)).select("name", "n_unique", "score")


@query("t5_first_match_target", f"WITH {LT} SELECT v AS variant, 'is_fraud' AS name, (SELECT CAST(sum(is_fraud) AS BIGINT) FROM lt) AS positives FROM (VALUES ('structure'),('examples'),('metadata'),('unified')) t(v)")
def t5(spark, d):
    df = labelled(spark, d)
    found = {v: tg.first_match(df, v) for v in tg.FIRST_MATCH}
    row = df.agg(*[F.sum(c).cast("bigint").alias(v) for v, c in found.items()])
    return pf.melt(row, {v: {"col": F.lit(c), "positives": F.col(v)} for v, c in found.items()}).select(
        F.col("name").alias("variant"), F.col("col").alias("name"), "positives")


@query("t6_encode_text_target", """WITH m AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*), 1 LIMIT 1)
 SELECT event_id, CASE WHEN regexp_matches(event_type, 'yes|oui|si|true|vrai|1|fraud|fraudulent|anomaly|suspicious|positive|pos|high|bad|alert') THEN 1
 WHEN regexp_matches(event_type, 'no|non|false|faux|0|normal|legitimate|negative|neg|low|good|ok') THEN 0 ELSE CAST(event_type = (SELECT * FROM m) AS INT) END AS target FROM events""")
def t6(spark, d):
    return tg.encode_text_target(events(spark, d), "event_type").select("event_id", "target")


@query("t7_encode_numeric_target", """WITH m AS (SELECT l_linenumber FROM lineitem GROUP BY 1 ORDER BY count(*), 1 LIMIT 1)
 SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_linenumber = (SELECT * FROM m) AS INT) AS target, CAST(l_quantity > 25 AS INT) AS two_valued FROM lineitem""")
def t7(spark, d):
    li = table(spark, d, "lineitem").withColumn("two", F.when(F.col("l_quantity") > 25, 2).otherwise(1))
    out = tg.encode_numeric_target(tg.encode_numeric_target(li, "l_linenumber"), "two", "two_valued")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "target", "two_valued")


@query("t8_yes_no_labels", f"""WITH {EV} SELECT event_id, CASE WHEN k%4=0 THEN 1 WHEN k%4=1 THEN 0 WHEN k%4=2 THEN 1 END AS label FROM ev""")
def t8(spark, d):
    ev = events(spark, d)
    text = F.element_at(F.array(F.lit(" Yes"), F.lit("NON"), F.lit("true "), F.lit("maybe")), F.col("k") % 4 + 1)
    return ev.select("event_id", tg.yes_no(text).alias("label"))


@query("t20_binary_fallback_rate", f"""WITH {LI} SELECT 'is_fraud' AS name, round(avg(is_fraud),6) AS rate FROM li""")
def t20(spark, d):
    return tg.fallback_rate(lines(spark, d), ["l_linenumber", "l_quantity", "l_discount", "is_fraud"]).withColumn("rate", r("rate", 6))
