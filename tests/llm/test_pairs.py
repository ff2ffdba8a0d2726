"""Jaccard classes, benchmark leaks and components against all-pairs twins."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import common, ngram_jaccard, template_leaks
from tests.llm import cases


def outline(values):
    return ngram_jaccard.Outline(common.mix(np.array(sorted(values), dtype=np.uint64)))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 9, 10, 12, 19, 20, 31, 33, 52, 84, 100, 127, 128, 129, 200, 400, 1000, 3000])
def test_linked_sets_share_more_than_both_may_leave_unprobed(size):
    rng = random.Random(size)
    for _ in range(30):
        a = set(rng.sample(range(1, 10**9), size))
        b = set(a)
        for _ in range(rng.randint(0, max(1, size // 9 + 1))):
            if rng.random() < 0.5 and len(b) > 1:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.randint(10**9, 2 * 10**9))
        if 5 * len(a & b) < 4 * len(a | b):
            continue
        x, y = outline(a), outline(b)
        band = ngram_jaccard.band_of(max(len(a), len(b)))
        assert band in x.bands() and band in y.bands()
        shared = np.intersect1d(x.signatures(band), y.signatures(band))
        left = 0 if ngram_jaccard.plan(band)[1] else sum(max(0, (o.weight(band) - o.need(band)) // 2) for o in (x, y))
        assert len(shared) > left


def near_copies():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage, rows, i = [word() for _ in range(60)], [], 100
    for n in (3, 7, 12, 25, 60, 150, 300, 700):
        base = [word() for _ in range(n)]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    for _ in range(40):  # one passage in texts that do not link, some of them nearly
        rows.append((i, " ".join(passage + [word() for _ in range(rng.choice([4, 12, 20, 60]))])))
        i += 1
    rng.shuffle(rows)
    return rows


def test_classes_equal_all_pairs(spark):
    rows = near_copies() + [(i, t) for i, t, _ in cases.ROWS]
    extra = [(i, t, "x", 1) for i, t in rows]
    got = ngram_jaccard.classes(spark.createDataFrame(extra, "doc_id long, text string, sig string, n int")).collect()
    want = cases.classes(rows)
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got) == sorted((i or -1, len(cases.shingles(t))) for i, t in rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == {**want, None: None}


def test_probing_finds_what_hubs_miss(spark, monkeypatch):
    """Without the first round every link has to come from the probed buckets."""
    monkeypatch.setattr(ngram_jaccard, "_merged", lambda label, links, kept=ngram_jaccard._merged, calls=[]: (
        kept(label, links) if calls else (calls.append(1), label)[1]))
    rows = near_copies()
    got = ngram_jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == cases.classes(rows)


def test_one_of_each_keeps_columns_and_empty_tables_pass(spark):
    df = cases.frame(spark)
    got = ngram_jaccard.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 1, 3, 4, 5, 6, 8, 10, 10, 11, 12, 14]
    assert ngram_jaccard.classes(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(300, 301), (301, 301)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*order, 300, 301, 302]], "node long")
    got = {r["node"]: r["component"] for r in common.components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(order, 0), 300: 300, 301: 300, 302: 302}


ITEM = "A train leaves the old station at 15 km per hour and Anna waits 40 minutes before she follows Peter to the big market hall."
BENCH = [(1, ITEM), (2, "short item"), (3, None), (4, "the quick brown fox jumps over it"), (5, "")]
NOISE = "quite other words stand here before and after the thing that we look for in this text "
DOCS = [
    (1, NOISE + ITEM + " " + NOISE), (2, NOISE + ITEM.replace("15 km", "70 miles").replace("Anna", "Maria").replace("40 minutes", "3 hours").replace("Peter", "Hans") + NOISE),
    (3, NOISE + ITEM.replace("15 km", "70 miles").replace("40 minutes", "3 hours").replace("Anna", "Peter") + NOISE), (4, NOISE * 3), (5, ITEM.upper()), (6, "Well, the quick brown fox jumps over it!"), (7, None), (8, ""),
    (9, " ".join(ITEM.split()[:9])), (None, ITEM), (1, NOISE + ITEM)]


def test_leaks_verbatim_and_reparameterised(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, item string, h int")
    bench = spark.createDataFrame([(i, t, "y") for i, t in BENCH], "item_id long, text string, doc string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in template_leaks.leaks(docs, bench).collect()}
    assert got[1, 1] == "verbatim" and got[2, 1] == "reparameterised" and got[6, 4] == "verbatim"
    assert (3, 1) not in got  # Anna and Peter became one value: not consistent
    assert not {i for i, _ in got} & {4, 7, 8, 9}
    kept = template_leaks.clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {3, 4, 7, 8, 9, None}
    assert template_leaks.leaks(docs.limit(0), bench).count() == 0 and template_leaks.leaks(docs, bench.limit(0)).count() == 0


def test_short_dense_and_first_words_of_items_leak(spark):
    bench = [(1, "What is the capital of France?"), (2, "Anna has three apples and eats one of them."), (3, "What is 12 + 30?"), (4, "Peter Paul Mary Hans Otto 5 7 9 11 Karl"),
             (5, "日本の首都はどこですか"), (6, "Yes")]
    docs = [(1, "Question: What is the capital of France? Answer below"), (2, "It rains. Ben has three apples and eats one of them. So"), (3, "solve: what is 12 + 30 now"),
            (4, "see Peter Paul Mary Hans Otto 5 7 9 11 Karl there"), (5, "質問、日本の首都はどこですかと聞いた"), (6, "yesterday it was well"), (7, "what is 12 + 31"), (8, "oh yes yes"),
            (9, "Peter Paul Mary Hans Otto 5 7 9 12 Karl"), (10, "so what is the capital of France today")]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in template_leaks.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(1, 1): "verbatim", (2, 2): "reparameterised", (3, 3): "verbatim", (4, 4): "verbatim", (5, 5): "verbatim", (8, 6): "verbatim", (10, 1): "verbatim"}


def test_leaks_by_shuffle_equal_leaks_by_broadcast(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, template_leaks.leaks(docs, bench).collect()))
    monkeypatch.setattr(template_leaks, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, template_leaks.leaks(docs, bench).collect())) == one
    plain = lambda t: " " + " ".join(template_leaks.re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [(r["item_id"], plain(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, x in items if x in plain(r["text"])}
    assert {(d, i) for d, i, *_ in one} == want and want
    assert docs.filter(F.col("doc_id").isin([d for d, _ in want])).count() == len({d for d, _ in want})


def test_classes_take_few_jobs(spark):
    """Small graphs are joined by one task and labels by broadcast: every job costs the driver memory."""
    sc, rows = spark.sparkContext, near_copies()
    sc.setJobGroup("few-jobs", "classes")
    try:
        got = ngram_jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        jobs = len(sc.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r["doc_id"]: r["component_id"] for r in got} == cases.classes(rows)
    assert jobs <= 150, jobs


def test_many_edges_by_rounds_equal_one_task(spark, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(260)], "a long, b long")
    nodes = spark.range(400).withColumnRenamed("id", "node")
    small = sorted(map(tuple, common.components(nodes, edges).collect()))
    monkeypatch.setattr(common, "LOCAL_EDGES", 0)
    assert sorted(map(tuple, common.components(nodes, edges).collect())) == small


def test_wide_tables_by_shuffle_equal_broadcast(spark, monkeypatch):
    """Labels, copies and ends of pairs above the broadcast bound, ids that repeat with other texts, graphs by rounds."""
    rows = near_copies()[::3]
    rows += [(i + 5000, t) for i, t in rows[::7]] + [(i, rows[0][1]) for i, _ in rows[:3]]
    for module in (common, ngram_jaccard):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common.bounded, "__defaults__", (0,))
    monkeypatch.setattr(common, "LOCAL_EDGES", 0)
    got = ngram_jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == cases.classes(rows)


def test_word_hashes_of_an_array_equal_those_of_words():
    texts = ["a  B\tc\x0b\x0cÜ É \x1c x\x85y", " lead trail ", None, "", " \n", "ÀB ſK K", "x" * 50 + "   y　z"]
    h, count = common.word_hashes(pa.array(["cut", *texts]).slice(1))
    assert list(count) == [len(common.words(t)) for t in texts]
    assert (h == np.concatenate([common.WordHashes()(common.words(t)) for t in texts])).all()
