"""Queries for the scalar features, imputation, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerwatch.functions import features as ft
from ledgerwatch.operators import encode
from ledgerwatch.operators.ordering import exact_quantiles
from ledgerwatch.plans.base import EV, LI, big, events, lines, query, r, table


def _cols(d: dict, digits: int = 4) -> list:
    return [r(c, digits).alias(k) for k, c in d.items()]


@query("f1_amount_transforms", """SELECT event_id, round(ln(1+greatest(value,0)),4) AS value_log,
 round(sqrt(greatest(value,0)),4) AS value_sqrt, round(value*value,4) AS value_squared FROM events""")
def f1(spark, d):
    return events(spark, d).select("event_id", *_cols(ft.amount_transforms("value")))


@query("f2_polynomial", """SELECT event_id, round(value*value,4) AS value_squared,
 round(value*value*value,3) AS value_cubed FROM events""")
def f2(spark, d):
    p = ft.powers("value")
    return events(spark, d).select("event_id", r(p["value_squared"]).alias("value_squared"),
                                   r(p["value_cubed"], 3).alias("value_cubed"))


@query("f3_log_if_positive", f"""WITH {EV}, g AS (SELECT min(value) > 0 AS v_ok, min(k) > 0 AS k_ok FROM ev)
 SELECT event_id, CASE WHEN v_ok THEN round(ln(1+value),4) END AS value_log,
 CASE WHEN k_ok THEN round(ln(1+k),4) END AS k_log FROM ev, g""")
def f3(spark, d):
    ev = events(spark, d)
    gate = ev.agg(F.min("value").alias("value"), F.min("k").alias("k")).first()
    log = lambda c: F.log1p(c) if gate[c] > 0 else F.lit(None).cast("double")
    return ev.select("event_id", r(log("value")).alias("value_log"), r(log("k")).alias("k_log"))


@query("f4_equal_width_bin", """WITH g AS (SELECT min(value) AS mn, max(value) AS mx FROM events)
 SELECT event_id, CAST(greatest(0, least(9, ceil((value-mn)/((mx-mn)/10))-1)) AS INT) AS value_bin FROM events, g""")
def f4(spark, d):
    ev = events(spark, d)
    e = ev.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    return ev.select("event_id", ft.equal_width_bin("value", e["lo"], e["hi"]).alias("value_bin"))


@query("f5_quantile_bin", """WITH g AS (SELECT list_distinct(quantile_cont(value, [0.0,0.2,0.4,0.6,0.8,1.0])) AS q FROM events)
 SELECT event_id, CAST(greatest(0, len(list_filter(q, lambda e: e < value)) - 1) AS INT) AS value_qbin FROM events, g""")
def f5(spark, d):
    ev = events(spark, d)
    edges = exact_quantiles(ev, {"value": [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]})["value"]
    return ev.select("event_id", ft.quantile_bin("value", edges).alias("value_qbin"))


@query("f6_high_low_flags", """WITH g AS (SELECT quantile_cont(l_extendedprice,[0.05,0.25,0.75,0.9,0.95]) AS q FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice > q[5] AS INT) AS is_high,
 CAST(l_extendedprice < q[1] AS INT) AS is_low, CAST(l_extendedprice > q[4] AS INT) AS above_q90,
 CAST(l_extendedprice > q[3] AS INT) AS above_q75, CAST(l_extendedprice < q[2] AS INT) AS below_q25 FROM lineitem, g""")
def f6(spark, d):
    li = table(spark, d, "lineitem")
    q = exact_quantiles(li, {"l_extendedprice": [0.05, 0.25, 0.75, 0.9, 0.95]})["l_extendedprice"]
    x = "l_extendedprice"
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     ft.above(x, q[4]).alias("is_high"), ft.below(x, q[0]).alias("is_low"),
                     ft.above(x, q[3]).alias("above_q90"), ft.above(x, q[2]).alias("above_q75"),
                     ft.below(x, q[1]).alias("below_q25"))


@query("f7_round_amount", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CAST(l_quantity % 10 = 0 AS INT) AS is_round_10, CAST(l_extendedprice % 1000 = 0 AS INT) AS is_round_1000 FROM lineitem""")
def f7(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ft.round_amount("l_quantity", 10).alias("is_round_10"),
        ft.round_amount("l_extendedprice").alias("is_round_1000"))


@query("f8_joined_timestamp", """SELECT event_id, epoch_us(date_trunc('second', ts)) AS joined_us,
 CAST(NULL AS BIGINT) AS bad_us FROM events""")
def f8(spark, d):
    ev = events(spark, d).withColumns({"day": F.date_format("ts", "yyyy-MM-dd"), "clock": F.date_format("ts", "HH:mm:ss")})
    return ev.select("event_id", F.unix_micros(ft.joined_timestamp("day", "clock")).alias("joined_us"),
                     F.unix_micros(ft.joined_timestamp("event_type", "clock")).alias("bad_us"))


@query("f9_time_parts", """SELECT event_id, CAST(hour(ts) AS INT) AS transaction_hour, CAST(day(ts) AS INT) AS transaction_day,
 CAST(month(ts) AS INT) AS transaction_month, CAST(isodow(ts)-1 AS INT) AS transaction_weekday,
 CAST(isodow(ts) >= 6 AS INT) AS transaction_is_weekend, CAST(hour(ts) BETWEEN 8 AND 18 AS INT) AS is_business_hours,
 CAST(hour(ts) >= 22 OR hour(ts) <= 6 AS INT) AS is_night, CAST(hour(ts) BETWEEN 9 AND 17 AS INT) AS is_business_automl,
 CAST(hour(ts) < 6 AS INT) AS is_night_tx, CAST(hour(ts) <= 6 AS INT) AS is_early_morning FROM events""")
def f9(spark, d):
    h = F.hour("ts")
    return events(spark, d).select(
        "event_id", *[c.alias(k) for k, c in ft.time_parts("ts").items()],
        ft.is_business_hours(h, "automl").alias("is_business_automl"), ft.is_night(h, "transaction").alias("is_night_tx"),
        ft.is_night(h, "early_morning").alias("is_early_morning"))


@query("f10_cyclic", """SELECT event_id, round(sin(2*pi()*hour(ts)/24),4) AS hour_sin, round(cos(2*pi()*hour(ts)/24),4)+0.0 AS hour_cos,
 round(sin(2*pi()*(isodow(ts)-1)/7),4) AS weekday_sin, round(cos(2*pi()*(isodow(ts)-1)/7),4) AS weekday_cos FROM events""")
def f10(spark, d):
    c = {**ft.cyclic(F.hour("ts"), 24, "hour"), **ft.cyclic(F.weekday("ts"), 7, "weekday")}
    return events(spark, d).select("event_id", *[(r(v) + 0.0).alias(k) for k, v in c.items()])


@query("f11_amount_ratios", f"""WITH {EV} SELECT event_id, round(value/(k+1e-6),2) AS value_div_k,
 round(k/(value+1e-8),2) AS k_value_ratio FROM ev""")
def f11(spark, d):
    return events(spark, d).select("event_id", r(ft.ratio("value", "k"), 2).alias("value_div_k"),
                                   r(ft.ratio("k", "value", 1e-8), 2).alias("k_value_ratio"))


@query("f12_interactions", f"""WITH {EV} SELECT event_id, round(value*k,4) AS value_x_k, round(value*hour(ts),4) AS value_x_hour,
 round(hour(ts)*ln(1+value),4) AS hour_amount_interaction, CAST((hour(ts)>=22 OR hour(ts)<=6) AND value > 150 AS INT) AS night_and_high_amount,
 round(k*value/1e6,8) AS velocity_x_amount FROM ev""")
def f12(spark, d):
    h, log = F.hour("ts"), F.log1p(ft.non_negative("value"))
    return events(spark, d).select(
        "event_id", r(ft.product("value", "k")).alias("value_x_k"), r(ft.product("value", h)).alias("value_x_hour"),
        r(h * log).alias("hour_amount_interaction"),
        (ft.is_night(h) * ft.above("value", 150)).alias("night_and_high_amount"),
        r(ft.product("k", "value", 1e6), 8).alias("velocity_x_amount"))


@query("f13_pair_comparison", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CAST(c_nationkey = s_nationkey AS INT) AS is_same_country, CAST(c_nationkey <> s_nationkey AS INT) AS is_international,
 CAST(l_returnflag = l_linestatus AS INT) AS is_same_bank, CAST(c_mktsegment <> 'BUILDING' AS INT) AS is_foreign_currency
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""")
def f13(spark, d):
    li, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = (li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
         .join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
         .join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ft.same("c_nationkey", "s_nationkey").alias("is_same_country"),
                    ft.different("c_nationkey", "s_nationkey").alias("is_international"),
                    ft.same("l_returnflag", "l_linestatus").alias("is_same_bank"),
                    ft.differs_from("c_mktsegment", "BUILDING").alias("is_foreign_currency"))


@query("f14_name_features", """SELECT doc_id, CAST(length(text) AS INT) AS text_length,
 CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INT) AS text_words FROM documents""")
def f14(spark, d):
    return table(spark, d, "documents").select("doc_id", ft.name_length("text").alias("text_length"),
                                               ft.word_count("text").alias("text_words"))


@query("f15_balance_use", """SELECT o_orderkey, round(o_totalprice/(c_acctbal+1),4) AS amount_to_balance_ratio,
 CAST(o_totalprice/(c_acctbal+1) > 0.8 AS INT) AS depletes_balance FROM orders JOIN customer ON o_custkey = c_custkey""")
def f15(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    u = ft.balance_use("o_totalprice", "c_acctbal")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", r(u["amount_to_balance_ratio"]).alias("amount_to_balance_ratio"), u["depletes_balance"].alias("depletes_balance"))


@query("f16_balance_change", """WITH b AS (SELECT o_orderkey, c_acctbal AS bb, c_acctbal - o_totalprice AS ba, o_totalprice AS cl
 FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT o_orderkey, round(ba-bb,2) AS balance_change, round((ba-bb)/(bb+1)*100,3) AS balance_change_pct,
 round(ba/(cl+1),4) AS balance_after_claim_ratio, round(cl/(bb+1),4) AS claim_to_balance_ratio FROM b""")
def f16(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    b = ft.balance_change("c_acctbal", F.col("c_acctbal") - F.col("o_totalprice"), "o_totalprice")
    dig = {"balance_change": 2, "balance_change_pct": 3}
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", *[r(v, dig.get(k, 4)).alias(k) for k, v in b.items()])


@query("f17_credit_risk", """WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus='P') AS late, sum(o_totalprice) AS loan FROM orders GROUP BY 1),
 b AS (SELECT c_custkey, late*1.0::DOUBLE/n AS dti, late, abs(c_acctbal)/100 AS inc, loan FROM customer JOIN o ON o_custkey=c_custkey),
 q AS (SELECT quantile_cont(dti,0.25) AS d25, quantile_cont(dti,0.75) AS d75, quantile_cont(inc,0.25) AS i25 FROM b)
 SELECT c_custkey, round(ln(1+dti),4) AS debt_income_log, CAST(dti>d75 AS INT) AS is_high_debt, CAST(dti<d25 AS INT) AS is_low_debt,
 CAST(late>0 AS INT) AS has_delinquency, round(ln(1+late),4) AS delinquency_log, round(ln(1+inc),4) AS income_log,
 CAST(inc<i25 AS INT) AS is_low_income, round(loan/(inc*1000+1),3) AS loan_to_income_ratio FROM b, q""")
def f17(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("late"), F.sum("o_totalprice").alias("loan"))
    b = (table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
         .select("c_custkey", (F.col("late") / F.col("n")).alias("dti"), "late", (F.abs("c_acctbal") / 100).alias("inc"), "loan"))
    q = exact_quantiles(b, {"dti": [0.25, 0.75], "inc": [0.25]})
    c = ft.credit_risk("dti", "late", "inc", "loan", q["dti"][0], q["dti"][1], q["inc"][0])
    return b.select("c_custkey", *[(v if k.startswith(("is_", "has_")) else r(v, 3 if k.startswith("loan") else 4)).alias(k)
                                   for k, v in c.items()])


@query("f18_customer_profile", f"""WITH {EV}, b AS (SELECT event_id, k AS age, k*5 AS tenure, value AS velocity, value*k AS distance FROM ev),
 q AS (SELECT quantile_cont(velocity,0.9) AS v90, quantile_cont(distance,0.9) AS d90, quantile_cont(distance,0.95) AS d95 FROM b)
 SELECT event_id, round(ln(1+age),4) AS age_log, CAST(age<25 AS INT) AS is_young_customer, CAST(age>60 AS INT) AS is_senior_customer,
 round(ln(1+tenure),4) AS tenure_log, CAST(tenure<30 AS INT) AS is_new_account, CAST(tenure>365 AS INT) AS is_old_account,
 round(ln(1+velocity),4) AS velocity_log, CAST(velocity>v90 AS INT) AS is_high_velocity, round(ln(1+distance),4) AS distance_log,
 CAST(distance>d90 AS INT) AS is_far_from_home, CAST(distance>d95 AS INT) AS is_very_far FROM b, q""")
def f18(spark, d):
    b = events(spark, d).select("event_id", F.col("k").alias("age"), (F.col("k") * 5).alias("tenure"),
                                F.col("value").alias("velocity"), (F.col("value") * F.col("k")).alias("distance"))
    q = exact_quantiles(b, {"velocity": [0.9], "distance": [0.9, 0.95]})
    c = ft.customer_profile("age", "tenure", "velocity", "distance", q["velocity"][0], *q["distance"])
    return b.select("event_id", *[(v if k.startswith("is_") else r(v)).alias(k) for k, v in c.items()])


@query("f19_policy_profile", f"""WITH {EV}, q AS (SELECT quantile_cont(value,0.9) AS p90 FROM ev)
 SELECT event_id, round(ln(1+k),4) AS policy_age_log, CAST(k<12 AS INT) AS is_new_policy, CAST(k>60 AS INT) AS is_old_policy,
 CAST(k%7>0 AS INT) AS has_previous_claims, CAST(k%7>=3 AS INT) AS is_frequent_claimant, round(ln(1+value),4) AS processing_time_log,
 CAST(value>p90 AS INT) AS is_slow_processing FROM ev, q""")
def f19(spark, d):
    ev = events(spark, d)
    q = exact_quantiles(ev, {"value": [0.9]})["value"][0]
    c = ft.policy_profile("k", F.col("k") % 7, "value", q)
    return ev.select("event_id", *[(v if k.startswith(("is_", "has_")) else r(v)).alias(k) for k, v in c.items()])


@query("f20_merchant_profile", """WITH q AS (SELECT quantile_cont(l_discount,0.25) AS q25, quantile_cont(l_discount,0.75) AS q75 FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(1+l_discount),4) AS merchant_risk_log, CAST(l_discount>q75 AS INT) AS is_high_risk_merchant,
 CAST(l_discount<q25 AS INT) AS is_low_risk_merchant, round(ln(1+l_tax),4) AS cashback_log, CAST(l_tax>0 AS INT) AS has_cashback,
 round(l_tax/(l_extendedprice+1)*1e6,4) AS cashback_ppm FROM lineitem, q""")
def f20(spark, d):
    li = table(spark, d, "lineitem")
    q = exact_quantiles(li, {"l_discount": [0.25, 0.75]})["l_discount"]
    c = ft.merchant_profile("l_discount", "l_tax", "l_extendedprice", *q)
    ppm = c.pop("cashback_to_amount_ratio") * 1e6
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     *[(v if k.startswith(("is_", "has_")) else r(v)).alias(k) for k, v in c.items()], r(ppm).alias("cashback_ppm"))


@query("f21_noisy_amount")
def f21(spark, d):
    ev = events(spark, d)
    std = ev.agg(F.stddev_samp("value")).first()[0]
    return ev.select("event_id", "value", ft.noisy("value", std, "event_id").alias("amount_noisy"))


@query("f22_squared_only", """WITH g AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
 SELECT event_id, round(((value-m)/s)*((value-m)/s),4) AS value_zscore_squared FROM events, g""")
def f22(spark, d):
    ev = events(spark, d)
    s = ev.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).first()
    z = ev.select("event_id", ft.zscore("value", s["m"], s["s"]).alias("value_zscore"))
    return z.select("event_id", r(F.col("value_zscore") * F.col("value_zscore")).alias("value_zscore_squared"))


# ---- cleaning, encoding, scaling --------------------------------------------------------------

@query("t9_median_imputation", f"""WITH {EV}, b AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN NULL ELSE value END AS v FROM ev)
 SELECT event_id, round(coalesce(v, (SELECT median(v) FROM b)),4) AS value_filled FROM b""")
def t9(spark, d):
    b = events(spark, d).select("event_id", F.when(F.col("k") % 10 != 0, F.col("value")).alias("value"))
    return encode.impute_median(b, ["value"]).select("event_id", r("value").alias("value_filled"))


@query("t10_mode_imputation", f"""WITH {EV}, b AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN NULL ELSE event_type END AS v FROM ev),
 m AS (SELECT v FROM b WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)
 SELECT event_id, coalesce(v, (SELECT v FROM m), 'Unknown') AS event_type, 'Unknown' AS nothing FROM b""")
def t10(spark, d):
    b = events(spark, d).select("event_id", F.when(F.col("k") % 10 != 0, F.col("event_type")).alias("event_type"),
                                F.lit(None).cast("string").alias("nothing"))
    return encode.impute_mode(b, ["event_type", "nothing"])


@query("t11_finite_values", f"""WITH {EV} SELECT event_id, coalesce(CASE WHEN k % 3 = 0 THEN NULL WHEN k % 5 = 0 THEN NULL ELSE value END, 0) AS value FROM ev""")
def t11(spark, d):
    v = F.when(F.col("k") % 3 == 0, F.lit(float("inf"))).when(F.col("k") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return events(spark, d).select("event_id", ft.finite(v, 0.0).alias("value"))


@query("t12_label_encoding", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag_code, l_linestatus_code, p_name_code FROM
 (SELECT *, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag_code, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus_code,
  dense_rank() OVER (ORDER BY p_name) - 1 AS p_name_code FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def t12(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    cols = ["l_returnflag", "l_linestatus", "p_name"]
    codes = encode.fit_label_codes(j, cols)
    return encode.apply_label_codes(j, codes, cols, suffix="_code").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[big(f"{c}_code").alias(f"{c}_code") for c in cols])


@query("t13_min_max", f"""WITH {EV}, g AS (SELECT min(value) AS a, max(value) AS b, min(k) AS c, max(k) AS e FROM ev)
 SELECT event_id, round((value-a)/(b-a),4) AS value_norm, round((k-c)*1.0::DOUBLE/(e-c),4) AS k_norm, 0.5::DOUBLE AS one_norm FROM ev, g""")
def t13(spark, d):
    ev = events(spark, d).withColumn("one", F.lit(1))
    return encode.scale_min_max(ev, ["value", "k", "one"]).select(
        "event_id", *[r(c).alias(c) for c in ("value_norm", "k_norm", "one_norm")])


@query("t14_standard_robust_scaling", f"""WITH {EV}, g AS (SELECT avg(value) AS m, stddev_pop(value) AS s, median(value) AS md,
 quantile_cont(value,0.75)-quantile_cont(value,0.25) AS iqr FROM ev)
 SELECT event_id, round((value-m)/s,4) AS value_std, round((value-md)/iqr,4) AS value_robust FROM ev, g""")
def t14(spark, d):
    ev = events(spark, d)
    out = encode.scale_robust(encode.scale_standard(ev, ["value"]), ["value"])
    return out.select("event_id", r("value_std").alias("value_std"), r("value_robust").alias("value_robust"))


@query("t15_zscore", """WITH g AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
 SELECT event_id, round((value-m)/s,4) AS amount_zscore, CAST((value-m)/s > 2 AS INT) AS is_high_amount FROM events, g""")
def t15(spark, d):
    return encode.add_zscore(events(spark, d), "value").select(
        "event_id", r("amount_zscore").alias("amount_zscore"), "is_high_amount")


@query("p6_coerce_numeric", f"""WITH {EV} SELECT event_id, coalesce(TRY_CAST(CASE WHEN k % 4 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE),0) AS value FROM ev""")
def p6(spark, d):
    text = F.when(F.col("k") % 4 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return events(spark, d).select("event_id", ft.to_number(text).alias("value"))


@query("a34_category_share", f"""WITH {LI} SELECT l_returnflag, count(*) AS n, round(count(*)*1.0::DOUBLE/sum(count(*)) OVER (),6) AS share,
 round(avg(is_fraud),6) AS fraud_rate FROM li GROUP BY 1""")
def a34(spark, d):
    li = lines(spark, d)
    g = li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("is_fraud").alias("rate"))
    total = li.agg(F.count("*").alias("t"))
    return g.join(F.broadcast(total)).select("l_returnflag", big("n").alias("n"), r(F.col("n") / F.col("t"), 6).alias("share"),
                                             r("rate", 6).alias("fraud_rate"))
