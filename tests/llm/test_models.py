"""Suffix tree, toxicity, URL rules and personal data: invariants, twins and planted cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerwatch.llm import personal_data, suffix_tree, toxicity, url_rules
from ledgerwatch.llm.queries import URL_RULES
from tests.llm import cases


def test_suffix_tree_distributions_and_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    tree, counts = suffix_tree.train(train)
    total = Counter()
    for r in train.collect():
        total.update(cases.words(r["text"]))
        total[None] += 1
    assert (tree.tokens, tree.distinct) == (sum(total.values()), len(total))
    sym = np.arange(len(tree.head))
    outside = 1 - (10 ** tree.root(tree.count)).sum()  # words that the head does not hold
    assert any(level.state.any() for level in tree.levels)
    for k, level in enumerate(tree.levels):
        for c in np.flatnonzero(level.state)[:20]:
            rest, here, j = 0.0, c, k
            while j >= 0:
                rest += tree.levels[j].log_rest[here]
                here, j = tree.levels[j].suffix[here], j - 1
            mass = (10 ** suffix_tree.probability(tree, k, np.full(len(sym), c), sym)).sum() + 10 ** rest * outside
            assert abs(mass - 1) < 1e-6
    got = suffix_tree.score(docs, tree, counts).toPandas().set_index("doc_id")
    held = []
    for r in docs.collect():
        w = [*cases.words(r["text"]), None]
        base = sum(math.log10((total[x] + 0.5) / (tree.tokens + 0.5 * (tree.distinct + 1))) for x in w)
        row = got.loc[r["doc_id"]]
        assert row["n_tokens"] == len(w) and row["n_known"] == sum(total[x] > 0 for x in w) and abs(row["base_score"] - base) < 1e-6 * abs(base)
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1:
            held.append(r["doc_id"])
    assert got.loc[held]["score"].sum() > got.loc[held]["base_score"].sum()
    edge = suffix_tree.score(cases.frame(spark), tree, counts).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in edge) == sorted((i or -1, len(cases.words(t)) + 1) for i, t, _ in cases.ROWS)
    assert len({r["score"] for r in edge if r["doc_id"] == 10}) == 1
    bare, none = suffix_tree.train(cases.frame(spark).limit(0))
    assert bare.tokens == 0 and suffix_tree.score(cases.frame(spark).limit(0), bare, none).count() == 0


def test_suffix_tree_of_tables_equals_arrays(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(400)
    docs = docs.unionByName(cases.frame(spark).select(*docs.columns)) if set(docs.columns) <= set(cases.frame(spark).columns) else docs
    train = docs.filter("doc_id is null or doc_id % 5 <> 1")

    def scores():
        got = suffix_tree.score(docs, *suffix_tree.train(train)).collect()
        return sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in got)

    want = scores()
    monkeypatch.setattr(suffix_tree, "ARRAY_TOKENS", 0)
    for hot in (0, 3000):
        monkeypatch.setattr(suffix_tree, "HOT", hot)
        assert scores() == want
    assert any(abs(r[3] - r[4]) > 1 for r in want)


def test_suffix_tree_keeps_contexts_in_a_larger_corpus(spark):
    """A phrase seen five times keeps its context among 1.2 million other tokens."""
    phrase = "zeta quux leads to omega"
    few = [(k, phrase) for k in range(5)]
    filler = spark.range(100, 12_100).selectExpr("id as doc_id", "array_join(transform(sequence(1, 100), x -> concat('w', pmod(hash(id, x), 40))), ' ') as text")
    docs = spark.createDataFrame(few, "doc_id long, text string").unionByName(filler)
    tree, counts = suffix_tree.train(docs)
    assert tree.tokens > 1_000_000
    got = suffix_tree.score(docs.filter("doc_id = 0"), tree, counts).first()
    assert got["score"] > got["base_score"] + 10


def test_suffix_tree_of_tables_frees_what_it_no_longer_reads(spark, tmp_path, monkeypatch):
    """The table route leaves in the shared folder only symbols, weights and sums of documents, and no pair that occurs once is stored."""
    docs = spark.range(400).selectExpr("id as doc_id", "concat('a', id, ' b', id, ' c', id, if(id % 4 = 0, ' x y z', '')) as text")
    want = sorted((r["doc_id"], round(r["score"], 6)) for r in suffix_tree.score(docs, *suffix_tree.train(docs)).collect())
    monkeypatch.setattr(suffix_tree, "ARRAY_TOKENS", 0)
    monkeypatch.setattr(suffix_tree, "HOT", 0)
    made = []

    def written(df):
        made.append(str(tmp_path / f"llm-{len(made)}"))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    monkeypatch.setattr(suffix_tree, "written", written)
    tree, counts = suffix_tree.train(docs)
    got = sorted((r["doc_id"], round(r["score"], 6)) for r in suffix_tree.score(docs, tree, counts).collect())
    left = [t.count() for t in map(spark.read.parquet, made) if "id" not in t.columns]
    assert got == want
    assert sum(n > 20 for n in left) == 1 and counts.count() in left  # 1,204 symbols; pairs, longer grams and states are few or freed
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"


def test_toxicity_on_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = toxicity.train(toxicity.labelled(docs, labels.filter(part != 0)))
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.predict(docs, model).withColumnRenamed("toxic", "found").join(labels.filter(part == 0), "doc_id").select("found", "toxic").collect()
    right = sum(r["found"] == (r["toxic"] == 1) for r in got)
    assert right >= 0.9 * len(got)
    edge = toxicity.predict(cases.frame(spark), model).collect()
    assert len(edge) == len(cases.ROWS) and all(0 <= r["expected_severity"] <= 2 for r in edge)
    bare = toxicity.train(toxicity.labelled(docs, labels.limit(0)))
    assert {r["toxic"] for r in toxicity.predict(docs, bare).collect()} == {False}
    assert toxicity.predict(docs.limit(0), model).count() == 0


def test_rare_toxic_word_has_a_weight_beside_many_common_ones(spark):
    rows = [(k, " ".join(f"c{(k * 7 + 13 * j) % 1300}" for j in range(90)) + " here there", 1) for k in range(800)]
    rows += [(1000 + k, "here there " + f"n{k % 50}", 0) for k in range(800)] + [(3000 + k, f"slur here there n{k}", 1) for k in range(40)]
    model = toxicity.train(spark.createDataFrame(rows, "id long, text string, grade int"))
    a, b = toxicity.predict(spark.createDataFrame([(1, "slur here there n1"), (2, "here there n1")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert a["p_toxic"] > 0.5 > b["p_toxic"] and len(model.words) > 1000


def test_toxicity_fit_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 6)).astype(float)
    y = np.digitize(x @ np.array([3, 2, 0, 0, -2, -3.0]) + rng.logistic(size=3000), [0, 2.5])
    row, col = np.nonzero(x)
    w, cuts = toxicity.fit(y, row, col, np.ones(len(row)), 6)
    assert np.abs(w - [3, 2, 0, 0, -2, -3]).max() < 0.5 and abs(cuts[0]) < 0.4 and abs(cuts[1] - 2.5) < 0.5


URLS = ["http://A.Example.NET/en/1?x=1", "https://example.net/de/", "http://example.net", "http://b.example.com/de/7#z", "http://x.org/fr/", "http://notexample.com/de/1",
        "ftp://h?q=://y", None, "", "no scheme", "http://spam-farm.example.org/es/1", "://x/y", "http://ÄB.net/a", "http://u.net?p=/en/"]


def plain_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_url_rules_and_mined_rules(spark, sf):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)] + [(None, URLS[0], "x", "y")], "page_id long, url string, rule string, tokens string")
    got = url_rules.judge(pages, URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = plain_judge(URLS[r["page_id"] or 0])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"])
    assert url_rules.judge(pages.limit(0), URL_RULES).count() == 0
    labelled = spark.createDataFrame([(f"http://casino-{k}.example.com/en/{k}", "block") for k in range(30)]
                                     + [(f"http://site{k}.example.com/en/{k}", "allow") for k in range(30)] + [(None, "allow")], "url string, verdict string")
    new = spark.createDataFrame([(1, "http://casino-x.example.com/en/5"), (2, "http://site9.example.com/en/5"), (3, "http://k.other.de/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge(new, [], labelled).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_mined_rules_equal_counting(spark):
    baskets = [(["a", "b"], "block")] * 6 + [(["a", "c"], "allow")] * 3 + [(["b"], "block")] * 2 + [(["c"], "block")]
    got = {(tuple(r["tokens"]), r["verdict"]): (round(r["confidence"], 9), r["support"]) for r in
           url_rules.mine(spark.createDataFrame(baskets, "tokens array<string>, verdict string"), url_rules.Mining(0.1, 0.5)).collect()}
    rules = {}
    for tokens in ({"a"}, {"b"}, {"c"}, {"a", "b"}, {"a", "c"}):
        met = [v for t, v in baskets if tokens <= set(t)]
        for v in ("allow", "block"):
            if met.count(v) / len(baskets) >= 0.1 and met.count(v) / len(met) >= 0.5:
                rules[tuple(sorted(tokens)), v] = (round(met.count(v) / len(met), 9), met.count(v))
    want = {k: x for k, x in rules.items() if not any((tuple(t for t in k[0] if t != d), k[1]) in rules
            and rules[tuple(t for t in k[0] if t != d), k[1]][0] >= x[0] for d in k[0])}
    assert got == want


def luhn(d):
    return sum((x if k % 2 == 0 else x * 2 - 9 * (x > 4)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, expression) in enumerate(PLAIN.items()):
        for m in re.finditer(expression, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind != "ip" or all(int(x) <= 255 for x in m[0].split("."))) and (kind != "card" or 14 <= len(d) <= 19 and luhn(d)) and (kind != "phone" or 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


PRIVATE = ["a@b.c_x@d.e.f x@y z@w.", "mail é x.y+z@mail-1.example.com, 1.2.3.4.5.6.7.8 and 256.1.1.1 007.08.09.255", "4539 1488 0343 6467 and 4539148803436467 or 4539148803436468",
           "+1 (017) 555-7713 +44-20-7946-0958. +12", "\U0001F600 4539-1488-0343-6467 10.0.0.1@h.i", "9" * 60_000 + " a@b.co", "x" * 50_000 + "@q.r", "1 " * 20_000, "+1111111111+2222222222", "", None]


def test_base_spans_equal_plain_expressions(spark, sf):
    rows = [(k, t) for k, t in enumerate(PRIVATE)] + [(100 + i, t) for k, (i, t, _) in enumerate(cases.ROWS) if i]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, base string, spans string")
    got = personal_data.find(docs).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    for r in got:
        assert [tuple(x) for x in r["base"]] == plain_spans(texts[r["doc_id"]])
        assert {tuple(x) for x in r["base"]} <= {tuple(x) for x in r["spans"]}
    assert personal_data.report(docs.limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    seeds = [(k, f"noise{k} words please write to user{k}@mail.example.com today thanks") for k in range(40)]
    hidden = [(100, "other words please write to user77(at)mail-example today thanks"), (101, "the year 20245 was fine and write code 55555 often")]
    got = {r["doc_id"]: r["spans"] for r in personal_data.find(spark.createDataFrame(seeds + hidden, "doc_id long, text string")).collect()}
    assert got[101] == [] and all(len(got[k]) == 1 for k in range(40))
    wide = seeds + [(100, "other words please write to user7777(at)mail-example today thanks")]
    got = {r["doc_id"]: r["spans"] for r in personal_data.find(spark.createDataFrame(wide, "doc_id long, text string")).collect()}
    assert [(x["kind"], wide[-1][1][x["start"]:x["end"]]) for x in got[100]] == [("email", "user7777(at)mail-example")]
