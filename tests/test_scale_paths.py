"""The routes for large inputs and hot keys give the same rows as the short ones."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import evaluate, keyed, matching, ordering, patterns
from ledgerwatch.plans.base import events, lines, table


def rows(df, *cols):
    return sorted(tuple(x) for x in df.select(*cols).collect())


@pytest.fixture(scope="module")
def hot(spark, sf):
    """Events of which one user holds a third, with repeated instants."""
    e = events(spark, sf)
    return (e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))
            .withColumn("ts", F.when(F.col("event_id") % 7 == 0, F.date_trunc("day", F.col("ts").cast("timestamp")))
                        .otherwise(F.col("ts").cast("timestamp")))
            .withColumn("dest", F.col("k") % 4).persist())


def test_quantiles_narrowing_equals_sorting(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.lognormal(3, 2, 5000), "b": rng.integers(0, 9, 5000).astype(float)})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = ordering.exact_quantiles(df, {"a": probs, "b": probs}, row_limit=20)
    for c in ("a", "b"):
        assert got[c] == pytest.approx(list(pdf[c].quantile(probs)), rel=1e-12)


def test_order_statistics_reject_bad_rank(spark):
    with pytest.raises(ValueError):
        ordering.order_statistics(spark.range(3).select(F.col("id").cast("double").alias("v")), [(F.col("v"), 3)])


def test_running_totals_partitioned_equals_window(spark, sf):
    e = events(spark, sf).select("event_id", "value")
    m = {"t": F.col("value").cast("decimal(20,2)")}
    a = ordering.running_totals(e, ["value", "event_id"], m, row_limit=10)
    b = ordering.running_totals(e, ["value", "event_id"], m)
    assert rows(a, "event_id", "t") == rows(b, "event_id", "t")
    assert rows(ordering.global_rank(e, ["value", "event_id"], row_limit=10), "event_id", "rank") == \
        rows(ordering.global_rank(e, ["value", "event_id"]), "event_id", "rank")


@pytest.mark.parametrize("limit", [5, 40])
def test_hot_keys_rolling(hot, limit):
    for fn in (lambda h: patterns.smurfing(hot, "user_id", "ts", "value", 5, 60, 5, 3, h).select("event_id", "smurf_count", "smurf_total", "is_smurfing"),
               lambda h: patterns.high_velocity(hot, "user_id", "ts", 6, 4, h).select("event_id", "velocity", "is_high_velocity"),
               lambda h: patterns.burst(hot, "user_id", "ts", F.col("event_type") == "error", 7, 5, h).select("event_id", "burst_count", "is_burst")):
        a, b = fn(limit), fn(keyed.HOT_ROWS)
        assert rows(a, *a.columns) == rows(b, *b.columns)


@pytest.mark.parametrize("limit", [5, 40])
def test_hot_keys_previous_and_prior(hot, limit):
    for fn in (lambda h: patterns.dormant_wakeup(hot, "user_id", "ts", "event_id", "value", 1, 5, h).select("event_id", "gap_seconds", "is_dormant_wakeup"),
               lambda h: patterns.unusual_amount(hot, "user_id", "ts", "event_id", "value", 2, h).select("event_id", F.round("prior_mean", 8), "is_unusual_amount")):
        a, b = fn(limit), fn(keyed.HOT_ROWS)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture(scope="module")
def odd(spark):
    """NULL keys, NULL times, a burst within a second, one far outlier, equal times."""
    random.seed(11)
    stamp = lambda k: f"2024-01-02 00:00:00.{k % 997:06d}"
    data = [(k, 1, stamp(k), float(k % 70)) for k in range(300)] + [(300, 1, "2031-01-01 00:00:00", 9.0)]
    data += [(400 + k, None if k % 2 else 2, None if k % 5 == 0 else f"2024-01-{1 + k % 20:02d} 0{k % 9}:00:00", float(k % 70)) for k in range(120)]
    random.shuffle(data)
    return spark.createDataFrame([(i, u, t, v, "error" if i % 3 else "ok", f"d{i % 4}") for i, u, t, v in data],
                                 "event_id long, user_id long, t string, value double, event_type string, dest string").withColumn("ts", F.to_timestamp("t")).drop("t")


@pytest.mark.parametrize("limit", [5, 100])
def test_hot_keys_with_missing_keys_and_times(odd, limit):
    for fn in (lambda h: patterns.smurfing(odd, "user_id", "ts", "value", 5, 60, 5, 3, h), lambda h: patterns.high_velocity(odd, "user_id", "ts", 6, 4, h),
               lambda h: patterns.burst(odd, "user_id", "ts", F.col("event_type") == "error", 7, 5, h),
               lambda h: patterns.dormant_wakeup(odd, "user_id", "ts", "event_id", "value", 1, 5, h),
               lambda h: patterns.unusual_amount(odd, "user_id", "ts", "event_id", "value", 2, h),
               lambda h: patterns.beneficiary_concentration(odd, "user_id", "ts", "event_id", "dest", 3, 3, h)):
        a, b = fn(limit), fn(keyed.HOT_ROWS)
        assert a.columns == b.columns and b.count() == odd.count()
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_chunks_of_a_burst_are_even(odd):
    base = odd.withColumns({"_key": keyed.whole_key("user_id"), "_t": keyed.instant("ts")})
    _, hot, chunks = keyed.split_hot(base, 100)
    sizes = [r["count"] for r in keyed.chunked(hot, "_t", chunks).where("user_id = 1").groupBy("_chunk").count().collect()]
    assert sum(sizes) == 301 and max(sizes) <= 200


def test_order_statistics_with_infinite_ends(spark):
    inf = float("inf")
    data = [-inf] * 30 + [inf] * 30 + [float(k) for k in range(-200, 200)] + [1e308, -1e308, 5e-324, 0.0]
    df = spark.createDataFrame([(x,) for x in data], "v double")
    probs = {"v": [0.0, 0.01, 0.05, 0.3, 0.5, 0.77, 0.95, 1.0]}
    assert ordering.exact_quantiles(df, probs, row_limit=7) == ordering.exact_quantiles(df, probs)
    want = [(F.col("v"), k) for k in (0, 29, 30, 31, 231, 232, 233, 430, 432, 433, 463)]
    assert ordering.order_statistics(df, want, row_limit=3) == [sorted(data)[k] for _, k in want]


@pytest.mark.parametrize("limit", [5, 40, keyed.HOT_ROWS])
@pytest.mark.parametrize("days", [1, 3, 21])
def test_concentration_against_brute_force(hot, limit, days):
    got = {x["event_id"]: (x["window_count"], x["is_concentrated"]) for x in
           patterns.beneficiary_concentration(hot, "user_id", "ts", "event_id", "dest", days, 3, limit).collect()}
    pdf = hot.select("event_id", "user_id", "ts", "dest").toPandas()
    for _, g in pdf.groupby("user_id"):
        for x in g.itertuples():
            w = g[(g.ts <= x.ts) & (g.ts >= x.ts - pd.Timedelta(days=days))]
            assert got[x.event_id] == (len(w), int(w.dest.nunique() <= 2 and len(w) >= 3))


def test_split_is_exact_and_independent_of_partitioning(spark, sf):
    li = lines(spark, sf)
    a = evaluate.stratified_split(li, "is_fraud", "line_id", [0.2, 0.8])
    b = evaluate.stratified_split(li.repartition(5), "is_fraud", "line_id", [0.2, 0.8])
    assert rows(a, "line_id", "fold") == rows(b, "line_id", "fold")
    for y in (0, 1):
        n = li.where(F.col("is_fraud") == y).count()
        assert a.where((F.col("is_fraud") == y) & (F.col("fold") == 0)).count() == int(0.2 * n + 0.5)


def test_split_by_histogram_equals_direct(spark, sf):
    li = lines(spark, sf).withColumn("h", evaluate.split_hash("line_id"))
    want = [(F.col("h"), 17), (F.col("h"), 3000)]
    assert ordering.order_statistics(li, want, row_limit=10) == ordering.order_statistics(li, want)


def test_newest_renumbered_with_ties(spark):
    random.seed(3)
    data = [(i, f"2024-01-0{random.randint(1, 5)} 00:00:00") for i in range(200)]
    df = spark.createDataFrame(data, "id int, t string").select("id", F.to_timestamp("t").alias("t"))
    got = rows(patterns.newest_renumbered(df, "t", "id", 60), "id", "seq")
    want = sorted((x[0], i + 1) for i, x in enumerate(sorted(data, key=lambda x: (x[1], x[0]))[-60:]))
    assert got == want


def test_auc_partitioned_equals_direct(spark, sf, monkeypatch):
    s = lines(spark, sf).withColumn("p", F.col("l_extendedprice"))
    a = evaluate.ranking_metrics(s, "is_fraud", "p").first()
    real = ordering.running_totals
    monkeypatch.setattr(evaluate, "running_totals", lambda *x: real(*x, row_limit=50))
    b = evaluate.ranking_metrics(s, "is_fraud", "p").first()
    assert tuple(a) == pytest.approx(tuple(b), rel=1e-12)


def test_tables_are_pruned_and_pushed_down(spark, sf):
    plan = table(spark, sf, "events").where("value > 10").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,10.0)]" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_fit_layout_follows_rows_not_input_partitions(spark):
    from ledgerwatch.operators import boosting, engineering
    rng = np.random.default_rng(7)
    rows = [(f"k{i}", float(rng.integers(1, 50)), float(rng.integers(0, 10)) / 100, 0) for i in range(3000)]
    rows = [(k, q, d, int(q > 40 and d >= 0.05)) for k, q, d, _ in rows]
    df = spark.createDataFrame(rows, "key string, q double, d double, y int")
    feats = engineering.FittedFeatures([], ["q", "d"])
    trees = {n: boosting.train(df.repartition(n), "y", "key", feats, {"n_estimators": 4, "max_depth": 3}, measure=False).trees.toDebugString.split("\n", 1)[1]
             for n in (2, 7, 200)}  # the first line names the model's random uid
    assert trees[2] == trees[7] == trees[200]
    assert [boosting.fit_partitions(n) for n in (0, 1, 65_536, 65_537, 10 ** 9)] == [1, 1, 1, 2, 15_259]


@pytest.mark.parametrize("spread_", [0, 1])
def test_nearest_by_log_over_seven_range_partitions_equals_brute_force(spark, spread_):
    from ledgerwatch.operators import registry
    rng = random.Random(spread_)
    top = 40 if not spread_ else 10 ** 6  # all sizes in one narrow stretch of the logarithm, or spread wide
    users = [(f"u{i}", rng.randint(0, top)) for i in range(400)] + [("hot", 7)] * 50 + [("none", None)]
    refs = [(k, rng.randint(0, top)) for k in range(60)] + [(1000 + k, 7) for k in range(3)]
    u = spark.createDataFrame(users, "user_id string, n long")
    s = spark.createDataFrame(refs, "s_suppkey long, m long")
    got = sorted((r["user_id"], r["n"], r["nearest"]) for r in registry.nearest_by_log(u, s, "n", "m", "user_id", "s_suppkey", partitions=7).collect())
    want = []
    for uid, n in users:
        best = None if n is None else min(refs, key=lambda r: (abs(math.log(n + 1.0) - math.log(r[1] + 1.0)), r[0]))[0]
        want.append((uid, n, best))
    assert got == sorted(want)


def test_keyset_pages_equal_offset_pages(spark):
    from ledgerwatch.operators import registry
    rng = random.Random(3)
    rows = [(k, f"2024-0{rng.randint(1, 3)}-1{rng.randint(0, 9)}", float(k)) for k in range(1, 1234)]
    df = spark.createDataFrame(rows, "o_orderkey long, o_orderdate string, o_totalprice double").repartition(5)
    keys = [("o_orderdate", True), ("o_orderkey", False)]
    index = registry.page_index(df, keys, 20)
    assert index.count() == 62
    for number in (1, 2, 3, 40, 62, 63):
        got = [r["o_orderkey"] for r in registry.keyset_page(df, keys, index, number, 20).collect()]
        want = [r["o_orderkey"] for r in registry.page(df, [F.desc("o_orderdate"), "o_orderkey"], number, 20).collect()]
        assert got == want
    plan = registry.keyset_page(df, keys, index, 40, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Offset" not in plan


@pytest.fixture(scope="module")
def flat(spark):
    """One key whose 600 rows share one instant, one key of 400 rows without time, a few ordinary rows."""
    data = [(k, 1, "2024-01-02 10:00:00", float(k % 13), f"d{k % 5}") for k in range(600)]
    data += [(1000 + k, 2, None, float(k % 7), f"d{k % 3}") for k in range(400)]
    data += [(2000 + k, 3 + k % 4, f"2024-01-0{1 + k % 9} 0{k % 9}:00:00", float(k), "d0") for k in range(40)]
    return (spark.createDataFrame(data, "event_id long, user_id long, t string, value double, dest string")
            .withColumn("ts", F.to_timestamp("t")).drop("t"))


def test_a_key_of_one_instant_is_cut_into_even_chunks(flat):
    base = flat.withColumns({"_key": keyed.whole_key("user_id"), "_t": keyed.instant("ts")})
    _, hot, chunks = keyed.split_hot(base, 100)
    sizes = [r["count"] for r in keyed.chunked(hot, "_t", chunks, "event_id").groupBy("_chunk").count().collect()]
    assert sum(sizes) == 1000 and chunks >= 20 and max(sizes) <= 2 * 100


@pytest.mark.parametrize("limit", [30, 100])
def test_one_instant_keys_give_the_rows_of_the_window(flat, limit):
    for fn in (lambda h: patterns.dormant_wakeup(flat, "user_id", "ts", "event_id", "value", 1, 5, h),
               lambda h: patterns.unusual_amount(flat, "user_id", "ts", "event_id", "value", 2, h),
               lambda h: patterns.beneficiary_concentration(flat, "user_id", "ts", "event_id", "dest", 3, 3, h)):
        a, b = fn(limit), fn(keyed.HOT_ROWS)
        assert a.columns == b.columns and a.count() == flat.count()
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_binned_fold_metrics_equal_plain_counting(spark):
    rng = random.Random(8)
    rows = [(c, f, rng.choice([0, 1, 1 if c == 2 else 0]), rng.choice([None, round(rng.random(), 3)])) for c in (1, 2) for f in range(3) for _ in range(150)]
    rows += [(3, 0, 1, 0.7), (3, 0, 1, 0.2)]  # one class only: no ROC-AUC
    df = spark.createDataFrame(rows, "config int, fold int, label int, p double")
    got = {(r["config"], r["fold"]): r for r in evaluate.binned_metrics(df, ["config", "fold"]).collect()}
    for (c, f), r in got.items():
        mine = [(y, p) for cc, ff, y, p in rows if (cc, ff) == (c, f) and p is not None]
        tp = sum(1 for y, p in mine if y == 1 and p >= 0.5)
        fp = sum(1 for y, p in mine if y == 0 and p >= 0.5)
        fn = sum(1 for y, p in mine if y == 1 and p < 0.5)
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn)
        pos = [p for y, p in mine if y == 1]
        neg = [p for y, p in mine if y == 0]
        if pos and neg:  # scores of three decimals fall in distinct bins, so pairs are exact
            auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
            assert r["roc_auc"] == pytest.approx(auc)
        else:
            assert r["roc_auc"] is None
    summary = evaluate.fold_summary(evaluate.binned_metrics(df, ["config", "fold"]), ["config"]).collect()
    assert {r["config"] for r in summary} == {1, 2, 3}


def test_column_matching_keeps_data_sets_out_of_python(spark):
    """Only distinct names reach Python; ties, repeated and missing positions and a missing data set choose as `greedy_pairs` does."""
    rows = [(d, p, c) for d, cols in {"a": ["zips", "zapp", "CLIENT_ID", "customer_ref", "zip"], "b": ["ref_customer", "client_id", "amount", "montant"],
                                      None: ["Tx_Amount", "qqq", "tx_amount"], "none": ["qqq"]}.items() for p, c in enumerate(cols)]
    rows += [("a", 0, "zips"), ("b", None, "tx_amt"), ("b", 1, None)]
    ref = spark.createDataFrame(rows, "dataset string, position long, col_name string")
    target = ["tx_amount", "client_id", "customer_id", "zip", "zipp"]
    pairs = matching.match_columns(target, ref)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan
    grp = {x["col_name"]: x["grp"] for x in matching.with_groups(ref.select("col_name").unionByName(spark.createDataFrame([(c,) for c in target], "col_name string"))).collect()}
    want = []
    for d in ("a", "b", None, "none"):
        cols = sorted(((-1 if p is None else p, c) for x, p, c in rows if x == d and c is not None))
        want += [(d, *p) for p in matching.greedy_pairs([(c, grp[c]) for c in target], [(c, grp[c]) for _, c in cols])]
    assert sorted(map(tuple, pairs.collect()), key=str) == sorted(want, key=str)


def test_training_rows_are_dealt_as_raw_columns_and_shared(spark, sf):
    """No feature vector is shuffled or stored: the dealt rows hold columns of the table; two fits may share them, and
    features that need a join are dealt after it into the same order."""
    from ledgerwatch.operators import boosting, engineering
    li = lines(spark, sf)
    small = {"n_estimators": 3, "max_depth": 3}
    feats = engineering.FittedFeatures([{"name": "q_log", "kind": "log", "a": "l_quantity"}], ["l_quantity", "l_discount", "l_linenumber"])
    layout = boosting.lay_out(li, "is_fraud", "line_id", unread=["l_suppkey"])
    assert set(layout.dealt.columns) == {*li.columns, "_fold"} - {"l_suppkey"}
    assert layout.dealt.rdd.getNumPartitions() == layout.partitions == 1
    counts = layout.dealt.where("is_fraud = 0").count(), layout.dealt.where("is_fraud = 1").count()
    assert layout.weight == counts[0] / counts[1]
    own = boosting.train(li, "is_fraud", "line_id", feats, small, measure=False)
    shared = boosting.train(li, "is_fraud", "line_id", feats, small, measure=False, layout=layout)
    stats = li.groupBy("l_suppkey").agg(F.count("*").alias("l_suppkey_tx_count"), F.avg("l_tax").alias("l_suppkey_avg_amount"))
    joined = engineering.FittedFeatures(feats.steps, feats.inputs, customer="l_suppkey", stats=stats)
    assert feats.by_row and not joined.by_row
    use = feats.outputs
    by_join = boosting.train(li.repartition(3), "is_fraud", "line_id", joined, small, measure=False, use=use)
    body = lambda m: m.trees.toDebugString.split("\n", 1)[1]
    assert body(own) == body(shared) == body(by_join)
    layout.release()


def test_roles_count_distinct_values_only_where_asked(spark, monkeypatch):
    from ledgerwatch.operators import columns, engineering, profile
    counted = []
    real = profile.distinct_counts
    for m in (profile, columns):
        monkeypatch.setattr(m, "distinct_counts", lambda df, exact=True, cols=None: counted.extend(cols) or real(df, exact, cols))
    df = spark.createDataFrame([(i, i * 1000, i % 7, 0.5 * i, float(i), "ab"[i % 2], f"t{i}", None) for i in range(60)],
                               "serial long, broad long, bucket int, price double, meter double, flavour string, word string, hollow int")
    assert engineering.column_roles(df) == {"id": ["serial", "broad", "meter", "word"], "numeric": ["bucket", "hollow"],
                                            "amount": ["price"], "categorical": ["flavour"]}
    assert sorted(counted) == ["broad", "flavour", "meter", "serial", "word"]
    counted.clear()
    assert columns.training_columns(df) == ["bucket", "price", "meter", "flavour", "hollow"]
    assert sorted(counted) == ["broad", "flavour", "serial", "word"]
    assert profile.unique_shares(df.limit(0), ["serial", "word"]) == {"serial": 0.0, "word": 0.0}
