"""Edge cases on hand-made rows, and matching cases derived by hand."""

import datetime as dt

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions import features as ft
from ledgerwatch.functions import names as nm
from ledgerwatch.operators import boosting, columns, encode, engineering, evaluate, isolation, matching, profile, registry, report, selection, target
from ledgerwatch.plans import modelling, registry as queries
from ledgerwatch.plans.base import lines
from ledgerwatch.sources import readers, writers


def one(df, *cols):
    return [tuple(x) for x in df.select(*cols).collect()]


def cat(spark, sets):
    return spark.createDataFrame([(k, i, c, "string") for k, cs in sets.items() for i, c in enumerate(cs)],
                                 "dataset string, position int, col_name string, dtype string")


def test_missing_values_never_set_flags(spark):
    df = spark.createDataFrame([(None, None), (float("nan"), "x"), (5.0, None)], "v double, s string")
    assert one(df, ft.above(ft.clean_number("v"), 1.0), ft.same("s", "s"), ft.different("s", F.lit("x"))) == [(0, 0, 1), (0, 1, 0), (1, 0, 1)]
    assert one(df, ft.finite("v", 0.0)) == [(0.0,), (0.0,), (5.0,)]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (10.0,), (None,)], "v double")
    assert [x[0] for x in one(df, ft.equal_width_bin("v", 0.0, 10.0))] == [0, 0, 1, 9, None]
    assert [x[0] for x in one(df, ft.equal_width_bin("v", 3.0, 3.0))][0] == 4
    assert [x[0] for x in one(df, ft.quantile_bin("v", [0.0, 1.0, 1.0, 10.0]))] == [0, 0, 1, 1, None]


def test_risk_level_of_zero(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.7,), (1.0,)], "p double")
    assert [x[0] for x in one(df, ft.risk_level("p"))] == [None, "LOW", "MEDIUM", "HIGH"]
    assert one(df, ft.risk_level("p", True))[0][0] == "LOW"


def test_word_count_of_blank(spark):
    df = spark.createDataFrame([("",), ("  ",), (" a  b ",), (None,)], "s string")
    assert [x[0] for x in one(df, ft.word_count("s"))][:3] == [0, 0, 2]


def test_name_normalisation_and_groups(spark):
    names = ["tx_amt", "tx amt", "amount_squared", "transaction_type", "montant_transaction", "horodatage", "zzz", "card-number"]
    df = spark.createDataFrame([(n,) for n in names], "col_name string")
    got = {x["col_name"]: (x["norm"], x["grp"]) for x in matching.with_groups(df).collect()}
    assert got["tx_amt"][0] == "txamt" and got["tx amt"][0] == "transactionamount" and got["amount_squared"] == ("amount", "amount")
    assert got["transaction_type"][1] == "timestamp"  # contains "on", and timestamp comes before channel
    assert got["montant_transaction"][1] == "amount" and got["horodatage"][1] == "timestamp" and got["zzz"][1] == "unknown"
    split = df.select("col_name", nm.normalized(F.col("col_name"), split_tokens=True).alias("n")).where("col_name = 'tx_amt'").first()["n"]
    assert split == "transactionamount"


def test_similarity_of_known_schemas(spark):
    ref = cat(spark, {"a": ["amount", "client_id", "tx_time"], "same": ["tx_amount", "customer_id", "timestamp"], "none": ["qqq", "www"]})
    s = {x["dataset"]: x for x in matching.similarity(["tx_amount", "customer_id", "timestamp"], ref).collect()}
    assert s["a"]["similarity"] > 0.7 and s["same"]["similarity"] == 1.0 and s["same"]["match_quality"] == "excellent"
    assert s["none"]["total_matches"] == 0 and s["none"]["match_quality"] == "incompatible"


def test_greedy_pairs_are_one_to_one():
    pairs = matching.greedy_pairs([("customer_id", "customer_id"), ("client_id", "customer_id"), ("zip", "unknown")],
                                  [("client_id", "customer_id"), ("zips", "unknown")])
    assert pairs == [("semantic", "customer_id", "client_id", 1.0), ("fuzzy", "zip", "zips", pytest.approx(6 / 7))]
    assert matching.greedy_pairs([("zip", "unknown")], [("zap", "unknown")]) == []


def test_unmatched_and_suggestions(spark):
    ref = cat(spark, {"a": ["amount", "zzz"]})
    pairs = matching.match_columns(["tx_amount", "foo"], ref)
    assert sorted(map(tuple, matching.unmatched(["tx_amount", "foo"], ref, pairs).select("side", "col_name").collect())) == [
        ("reference", "zzz"), ("target", "foo")]
    best = matching.suggest_mapping(["tx_amount"], ref, 1).first()
    assert best["right"] == "amount" and best["score"] == pytest.approx(0.6 * nm.ratio("tx_amount", "amount") + 0.5)


def unlabelled(spark):
    rows = [(f"t{i}", f"c{i % 400}", 1000 + i * 7, i % 7, 1 + i % 28, 1 + i % 12, 2020 + i % 4, i % 24, i, 5000 + i) for i in range(1000)]
    return spark.createDataFrame(rows, "tx_id string, customer_ref string, amount_fcfa int, weekday int, day int, month int, year int, hour int, "
                                       "account_tenure_days int, balance_before int")


def test_target_detection(spark):
    df = unlabelled(spark)
    with pytest.raises(ValueError):
        target.detect_target(df)
    labelled = df.withColumn("is_fraudulent", (F.col("account_tenure_days") % 10 == 0).cast("int"))
    assert target.detect_target(labelled) == "is_fraudulent"
    assert "is_fraudulent" not in target.drop_leaked_target(labelled).columns
    typed = df.select("tx_id", "customer_ref", F.col("amount_fcfa").cast("double").alias("amount_fcfa"),
                      F.when(F.col("hour") % 3 == 0, "in").otherwise("out").alias("kind"))
    assert target.detect_target(typed) == "kind"


def test_target_encoding(spark):
    df = spark.createDataFrame([("fraud",), ("normal",), ("weird",), ("weird",), ("odd",), (None,)], "y string")
    assert [x[0] for x in one(target.encode_text_target(df, "y"), "target")][:5] == [1, 0, 0, 0, 0]
    nums = spark.createDataFrame([(1,), (2,), (2,)], "y int")
    assert [x[0] for x in one(target.encode_numeric_target(nums, "y"), "target")] == [0, 1, 1]
    three = spark.createDataFrame([(1,), (1,), (2,), (2,), (3,)], "y int")
    assert [x[0] for x in one(target.encode_numeric_target(three, "y"), "target")] == [0, 0, 0, 0, 1]


def test_imputation_and_codes(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (5.0, None), (2.0, "b")], "v double, s string")
    assert one(encode.impute_median(df, ["v"]), "v")[1] == (2.0,)
    assert one(encode.impute_mode(df, ["s"]), "s")[2] == ("b",)
    codes = encode.fit_label_codes(df, ["s"])
    assert [x[0] for x in one(encode.apply_label_codes(df, codes, ["s"]), "s")].count(-1) == 0
    unseen = spark.createDataFrame([("zz",)], "s string")
    assert one(encode.apply_label_codes(unseen, codes, ["s"]), "s") == [(-1,)]


def test_correlation_with_and_without_gaps(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(a + b), 1.0) for a, b in rng.normal(size=(50, 2))]
    df = spark.createDataFrame(rows, "x double, y double, c double")
    gap = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0)], df.schema))
    a, b = ({(x["a"], x["b"]): x["r"] for x in profile.correlation_matrix(d, ["x", "y", "c"]).collect()} for d in (df, gap))
    assert a[("x", "y")] == pytest.approx(b[("x", "y")]) and a[("x", "c")] is None and b[("x", "c")] is None


def test_importance_helpers(spark):
    imp = spark.createDataFrame([("d", f"f{i}", v) for i, v in enumerate([0.6, 0.3, 0.1, 0.0])], "dataset string, feature string, importance double")
    n = selection.features_needed(selection.with_cumulative(imp)).first()
    assert (n["for_80"], n["for_95"]) == (2, 3)
    assert selection.intelligent(imp, 0.95, 2).count() == 3 and selection.intelligent(imp, 0.95, 10).count() == 4
    g = selection.importance_statistics(imp).first()["gini"]
    assert g == pytest.approx(2 * (1 * 0 + 2 * .1 + 3 * .3 + 4 * .6) / 4 - 5 / 4)


def test_diverse_configs_are_spread(spark):
    grid = spark.createDataFrame([("d", i, float(i % 10), float(i // 10), 0.99 - i / 1000) for i in range(30)], "dataset string, id int, a double, b double, s double")
    got = one(selection.diverse_configs(grid, ["a", "b"], "s", "id", 0.9, 4).orderBy("pick"), "id")
    pts = np.array([(i % 10, i // 10) for i in range(30)], float)
    z = (pts - pts.mean(0)) / pts.std(0)
    want = [0]
    while len(want) < 4:
        d = np.min(np.linalg.norm(z[:, None] - z[want], axis=2), axis=1)
        d[want] = -1
        want.append(int(np.flatnonzero(np.isclose(d, d.max()))[0]))
    assert [x[0] for x in got] == want


def test_adaptive_thresholds(spark):
    def pick(scores):
        return report.adaptive_thresholds(spark.createDataFrame([(float(s),) for s in scores], "combined_score double"))
    assert pick([0.45] * 5 + [0.0] * 95)["medium"] == 0.40
    assert pick([0.9] * 50 + [0.0] * 50)["rounds"] == 1
    low = pick([0.0] * 100)
    assert (low["high"], low["medium"], low["converged"]) == (0.25, 0.15, False)


def test_usage_average(spark):
    log = spark.createDataFrame([("m", dt.datetime(2024, 1, i % 27 + 1), i, float(i % 7)) for i in range(300)], "m string, t timestamp, i int, s double")
    rows = sorted(log.collect(), key=lambda x: (x["t"], x["i"]))
    avg = None
    for x in rows:
        avg = x["s"] if avg is None else 0.7 * avg + 0.3 * x["s"]
    got = registry.usage(log, "m", "t", "i", "s").first()
    assert got["usage_count"] == 300 and got["avg_similarity_score"] == pytest.approx(avg, rel=1e-12)


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(2000, 2)))] + [(9000 + i, 12.0 + i, -12.0 - i) for i in range(10)]
    df = spark.createDataFrame(pts, "id long, a double, b double")
    s = isolation.anomaly_scores(df, "id", ["a", "b"], 0.01, trees=50)
    top = {x["id"] for x in s.orderBy(F.desc("anomaly_score")).limit(10).collect()}
    assert len([i for i in top if i >= 9000]) >= 9
    assert 15 <= s.where("is_anomaly = 1").count() <= 21
    again = isolation.anomaly_scores(df.repartition(7), "id", ["a", "b"], 0.01, trees=50)
    assert s.join(again.withColumnRenamed("anomaly_score", "o"), "id").where(F.abs(F.col("anomaly_score") - F.col("o")) > 1e-12).count() == 0


def test_model_learns_saves_and_scores_alike(spark, sf):
    li = lines(spark, sf)
    m = modelling.quick_model(li, measure=True)
    assert m.performance["test_auc"] > 0.95
    path = writers.scratch(spark, "test-model")
    m.save(path)
    back = boosting.FraudModel.load(path)
    a = {x["line_id"]: x["fraud_probability"] for x in m.score(li, ["line_id"]).collect()}
    b = {x["line_id"]: x["fraud_probability"] for x in back.score(li.repartition(3), ["line_id"]).collect()}
    assert a == b


def test_rules_from_roles_found_by_name(spark):
    rows = [(f"t{i}", float(i), dt.datetime(2024, 1, 1, i % 24), "FR" if i % 2 else "BE", "FR", i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "tx_id string, amount double, event_time timestamp, sender_country string, receiver_country string, y int")
    named = engineering.fit_rules(df, "y")
    assert {"amount_log", "transaction_hour"} <= set(named.outputs)
    f = engineering.fit_rules(df, "y", {"id": ["tx_id"], "amount": ["amount"], "time": ["event_time"], "country": ["sender_country", "receiver_country"]})
    assert {"amount_log", "amount_bin", "transaction_hour", "is_night", "is_same_country", "hour_amount_interaction"} <= set(f.outputs)
    out = f.transform(df, ["tx_id"])
    assert out.where("is_same_country = 1").count() == 50 and "tx_id" in out.columns


def test_column_choices(spark, sf):
    df = spark.createDataFrame([(f"x{i}", i % 3, "a", 1.0) for i in range(50)], "code string, weekday int, created_by string, v double")
    assert columns.training_columns(df) == ["weekday", "v"]
    assert columns.align(df, ["v", "gone"]).columns == ["v", "gone"]


def test_evaluation_against_direct_formulas(spark):
    rng = np.random.default_rng(2)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg).astype(float) + 0.5 * (pos[:, None] == neg))
    assert evaluate.ranking_metrics(df, "y", "p").first()["roc_auc"] == pytest.approx(auc)


def test_readers(spark, sf, tmp_path):
    assert readers.allowed_file("a.CSV") and not readers.allowed_file("a.exe")
    with pytest.raises(ValueError):
        readers.read_any(spark, "/x/y.exe")
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_json(spark, str(tmp_path / "r.json"), "a int").count() == 2


def test_every_query_has_columns_and_sql_names_match_keys(spark):
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert len(queries.QUERIES) > 150


def test_column_limits_are_off_by_default(spark):
    df = spark.createDataFrame([(float(k), float(k % 7), float(k % 5), float(k % 3), str(k % 2)) for k in range(50)], "a double, b double, c double, d double, s string")
    df = df.withColumns({f"s{k}": F.col("s") for k in range(6)})
    assert {r["name"] for r in profile.amount_patterns(df, ["a", "b", "c", "d"]).collect()} == {"a", "b", "c", "d"}
    assert {r["name"] for r in profile.categorical_patterns(df, [f"s{k}" for k in range(6)]).collect()} == {f"s{k}" for k in range(6)}
    made = {s["name"] for s in engineering.fit_flags(df, {"binning": 1.0}, ["a", "b", "c"]).steps}
    assert {"a_bin", "b_bin", "c_bin"} <= made


def brute_diverse(rows, k, threshold, fallback):
    """Farthest-first choice per data set in plain Python: rows are (dataset, key, score, a, b)."""
    out = []
    for ds in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == ds]
        good = [r for r in mine if r[2] >= threshold]
        pool = good if len(good) >= k else sorted(mine, key=lambda r: (-r[2], r[1]))[:fallback]
        x = np.array([[r[3], r[4]] for r in pool], float)
        sd = x.std(0)
        z = (x - x.mean(0)) / np.where(sd > 0, sd, 1.0)
        first = min(range(len(pool)), key=lambda i: (-pool[i][2], pool[i][1]))
        chosen, dist = [first], [None]
        while len(chosen) < min(k, len(pool)):
            d = [min(np.sqrt(((z[i] - z[j]) ** 2).sum()) for j in chosen) for i in range(len(pool))]
            nxt = min((i for i in range(len(pool)) if i not in chosen), key=lambda i: (-round(d[i], 9), pool[i][1]))
            chosen.append(nxt)
            dist.append(d[nxt])
        out += [(ds, p + 1, pool[i][1], dd) for p, (i, dd) in enumerate(zip(chosen, dist))]
    return out


def test_diverse_per_dataset_equals_brute_force_with_a_hot_and_a_small_data_set(spark):
    rng = np.random.default_rng(4)
    rows = [("hot", i, float(rng.choice([0.7, 0.85, 0.9, 0.99])), float(rng.integers(0, 5)), float(rng.integers(0, 3))) for i in range(600)]
    rows += [("small", 1000 + i, 0.5, float(i), 1.0) for i in range(4)]  # fewer than k rows, constant b
    rows += [("few_good", 2000 + i, 0.95 if i < 3 else 0.1 * (i % 7), float(i % 4), float(i % 2)) for i in range(80)]
    grid = spark.createDataFrame(rows, "dataset string, id long, s double, a double, b double")
    got = selection.diverse_per_dataset(grid, ["a", "b"], "s", "id", threshold=0.8, k=6, fallback=20)
    got = sorted((r["dataset"], r["pick"], r["id"], r["distance"]) for r in got.collect())
    want = sorted(brute_diverse(rows, 6, 0.8, 20))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all((g[3] is None and w[3] is None) or abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want))
    rep = {r["dataset"]: r for r in selection.diversity_per_dataset(selection.diverse_per_dataset(grid, ["a", "b"], "s", "id", 0.8, 6, 20), ["a", "b"]).collect()}
    assert rep["small"]["n_chosen"] == 4 and rep["hot"]["n_chosen"] == 6
    assert selection.diverse_per_dataset(grid.limit(0), ["a", "b"], "s", "id", 0.8, 6).count() == 0


def test_spelling_index_gives_the_greedy_pairs_of_plain_ratios(spark):
    rng = np.random.default_rng(11)
    vocab = ["amount", "tx_amount", "amt", "client_id", "customer_id", "cust", "zip", "zips", "zap", "time", "tx_time", "timestamp",
             "merchant", "merch_name", "balance", "bal", "x", "", "AMOUNT"]
    data = {f"d{k}": list(dict.fromkeys(rng.choice(vocab, size=int(rng.integers(1, 9))).tolist())) for k in range(12)}
    ref = cat(spark, data)
    target = ["tx_amount", "customer", "zip", "ts", "merchant_name", "bal"]
    got = sorted(map(tuple, matching.match_columns(target, ref).collect()))
    grouped = {x["col_name"]: x["grp"] for x in matching.with_groups(ref).collect()}
    left = [(x["col_name"], x["grp"]) for x in matching.with_groups(spark.createDataFrame([(c,) for c in target], "col_name string")).collect()]
    left.sort(key=lambda x: target.index(x[0]))
    want = sorted((ds, *p) for ds, cols in data.items() for p in matching.greedy_pairs(left, [(c, grouped[c]) for c in cols]))
    assert got == want
    index = matching.spelling_index(target, ref, matching.least_ratio(0.7)).collect()
    assert len(index) == len({(r["left"], r["col_name"]) for r in index})  # one exact ratio per distinct pair
    assert all(r["ratio"] == pytest.approx(nm.ratio(r["left"], r["col_name"])) for r in index)


def test_masked_gram_equals_pairwise_twins_with_gaps_and_nan(spark):
    from ledgerwatch.operators import profile
    rng = np.random.default_rng(5)
    rows = []
    for i in range(500):
        a = float(rng.normal(1e5, 3.0))
        b = a * 0.5 + float(rng.normal(0, 1))
        c = float(rng.choice([1.0, 2.0, 7.0]))
        rows.append((None if i % 7 == 0 else a, float("nan") if i % 5 == 0 else b, c if i % 11 else float("inf"), 4.0))
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    pdf = pd.DataFrame(rows, columns=["a", "b", "c", "k"]).replace([np.inf, -np.inf], np.nan)
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df, ["a", "b", "c", "k"]).collect()}
    for x, y in [("a", "b"), ("a", "c"), ("b", "c")]:
        both = pdf[[x, y]].dropna()
        assert got[x, y] == pytest.approx(np.corrcoef(both[x], both[y])[0, 1], abs=1e-9)
    assert got["a", "k"] is None and got["c", "k"] is None  # a constant column
    mom = {r["name"]: r for r in profile.moments(df, ["a", "b", "k"]).collect()}
    for c in ("a", "b"):
        v = pdf[c].dropna()
        assert mom[c]["variance"] == pytest.approx(v.var(ddof=1), rel=1e-7)
        assert mom[c]["skewness"] == pytest.approx(((v - v.mean()) ** 3).mean() / v.var(ddof=0) ** 1.5, abs=1e-6)
        assert mom[c]["kurtosis"] == pytest.approx(((v - v.mean()) ** 4).mean() / v.var(ddof=0) ** 2 - 3, abs=1e-6)
    assert mom["k"]["skewness"] is None and mom["k"]["variance"] == 0.0


def test_distinct_counts_in_one_shuffle_equal_per_column_counts(spark):
    from ledgerwatch.operators import profile
    rows = [(i % 7, None if i % 3 == 0 else f"s{i % 5}", float(i % 4) * (-1 if i % 2 else 1), None) for i in range(200)]
    rows.append((0, "s0", -0.0, None))
    df = spark.createDataFrame(rows, "a int, b string, c double, d string")
    got = {r["name"]: r["n_unique"] for r in profile.distinct_counts(df).collect()}
    want = {c: df.select(c).where(F.col(c).isNotNull()).distinct().count() for c in df.columns}
    assert got == want and got["d"] == 0
    plan = profile.distinct_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3  # one shuffle of the cells, one of the counts (and the broadcast of names)
    assert profile.distinct_counts(df.limit(0)).where("n_unique > 0").count() == 0


def test_isolation_scores_in_the_row_with_medians_and_small_tables(spark):
    rng = np.random.default_rng(9)
    pts = [(i % 50 if i % 10 else None, float(a), None if i % 13 == 0 else float(b)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    pts += [(7, 40.0, float("nan")), (None, -35.0, 30.0)]
    df = spark.createDataFrame(pts, "id long, a double, b double")
    got = isolation.anomaly_scores(df, "id", ["a", "b"], 0.02, trees=40).collect()
    assert len(got) == len(pts)  # NULL and repeated keys keep their rows: nothing is joined back
    assert sorted((r["id"] is None, r["id"] or 0, r["a"]) for r in got) == sorted((i is None, i or 0, a) for i, a, _ in pts)
    top = sorted(got, key=lambda r: -r["anomaly_score"])[:2]
    assert {r["a"] for r in top} == {40.0, -35.0}
    assert all(0.0 <= r["anomaly_score"] <= 1.0 for r in got)
    med = isolation.medians(df, ["a", "b"])
    b = sorted(x for _, _, x in pts if x is not None and not math.isnan(x))
    assert med["b"] == pytest.approx((b[len(b) // 2 - 1] + b[len(b) // 2]) / 2 if len(b) % 2 == 0 else b[len(b) // 2])
    forest = isolation.fit_forest(df, "id", ["a", "b"], trees=5, fill=med)
    assert {r["size"] for r in forest} <= set(range(1, 123)) and max(r["size"] for r in forest) <= 122


def test_versioned_tables_change_together_and_survive_a_failed_run(spark):
    from pyspark.sql.functions import udf

    from ledgerwatch.operators import versions
    root = writers.scratch(spark, "test-versions")
    assert versions.current(spark, root) is None
    reg = spark.createDataFrame([("m1", True, 0.9)], "model_name string, is_active boolean, roc_auc double")
    use = spark.createDataFrame([("m1", 3)], "model_name string, usage_count long")
    assert versions.commit(spark, root, {"registry": reg, "usage": use}) == 1

    @udf("long")
    def boom(x):
        raise RuntimeError("lost in the middle of the run")

    reg2 = reg.union(spark.createDataFrame([("m2", True, 0.95)], reg.schema))
    with pytest.raises(Exception):
        versions.commit(spark, root, {"registry": reg2, "usage": use.withColumn("usage_count", boom("usage_count"))})
    assert versions.current(spark, root) == (1, ["registry", "usage"])
    assert [tuple(r) for r in versions.read(spark, root, "registry").collect()] == [("m1", True, 0.9)]
    assert versions.commit(spark, root, {"registry": reg2, "usage": use.withColumn("usage_count", F.col("usage_count") + 1)}) == 2
    assert sorted(r["model_name"] for r in versions.read(spark, root, "registry").collect()) == ["m1", "m2"]
    assert versions.read(spark, root, "usage").first()["usage_count"] == 4
    assert versions.read(spark, root, "usage", 1).first()["usage_count"] == 3
