"""Whitening, codebooks and substring dedup against brute-force versions, with their defined cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import codebooks, substrings, whitening
from ledgerwatch.llm.queries import QUERIES

VEC = "vec_id long, embedding array<double>, label int"


def valid(rows):
    return [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]


# ---------------------------------------------------------------- op11 whitening

def brute_whitening(rows, k=8):
    rows = valid(rows)
    d = max(len(r[1]) for r in rows)
    x = np.array([[math.floor(1024 * float(v)) + 100000 for v in r[1]] + [100000] * (d - len(r[1])) for r in rows], dtype=float)
    n = len(x)
    ev, evec = np.linalg.eigh(np.cov(x.T, bias=True))
    ev, evec = ev[::-1][:k], evec[:, ::-1][:, :k]
    w = (x - x.mean(0)) @ evec / np.sqrt(ev)
    s = x.sum(0)
    dev = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))) for row in x]
    return ev, w, dev, [r[0] for r in rows]


def test_whitening_equals_numpy_on_the_fixture(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    ev, w, dev, ids = brute_whitening(rows)
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op11_whitening"](spark, sf).collect()}
    assert len(got) == 8 * len(ids)
    for c in range(8):
        sign = 1.0 if got[ids[0], c + 1]["whitened"] * w[0, c] >= 0 else -1.0  # either sign, one for all rows
        for i, vid in enumerate(ids):
            r = got[vid, c + 1]
            assert r["whitened"] == pytest.approx(sign * w[i, c], abs=1e-9)
            assert r["deviation"] == dev[i] and r["n"] == len(ids)
    total = sum(np.linalg.eigvalsh(np.cov(np.array([[math.floor(1024 * float(v)) + 100000 for v in r[1]] for r in valid(rows)]).T, bias=True)))
    assert [got[ids[0], c + 1]["explained"] for c in range(8)] == pytest.approx(list(ev / total), rel=1e-6)
    assert 0 <= got[ids[0], 1]["identity_error"] <= 1e-4


def test_whitening_defined_cases(spark):
    rows = [(1, [0.5, 0.25, -0.125], 0), (2, [0.1, 0.2, 0.3], None), (3, None, 1), (4, [0.1, None, 0.2], 1),
            (5, [float("nan"), 0.1, 0.2], 1), (6, [float("inf"), 0.0, 0.0], 1), (None, [0.3, -0.2, 0.9], 2),
            (2, [0.1, 0.2, 0.3], None), (7, [0.9, 0.8], 3)]
    df = spark.createDataFrame(rows, VEC).withColumn("component", F.lit("clash")).withColumn("llm_y", F.lit(1))
    got = whitening.whiten(df).collect()
    ids = sorted({r["vec_id"] for r in got}, key=str)
    assert ids == sorted([1, 2, None, 7], key=str)  # invalid vectors dropped, null id kept, repeats kept
    assert len(got) == 3 * 5  # three components (d = 3), five valid rows (2 twice)
    assert all(r["n"] == 5 for r in got)
    # a short vector is padded with zero entries
    ev, w, dev, vids = brute_whitening([(i, v, lab) for i, v, lab in rows if i != 7] + [(7, [0.9, 0.8, 0.0], 3)], k=3)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(3):
        sign = 1.0 if by[vids[0], c + 1]["whitened"] * w[0, c] >= 0 else -1.0
        for i, vid in enumerate(vids):
            assert by[vid, c + 1]["whitened"] == pytest.approx(sign * w[i, c], abs=1e-9)
            assert by[vid, c + 1]["deviation"] == dev[i]
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5], 0)], VEC)).collect()
    assert [(r["component"], r["whitened"], r["deviation"], r["identity_error"]) for r in one] == [(1, None, 0, None), (2, None, 0, None)]


def test_eigen_solver_on_clusters_and_ties():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((300, 12))
    for cov in [np.cov(a.T, bias=True), np.diag([5.0, 5.0, 5.0, 1.0, 1.0, 0.5]), np.cov(np.hstack([a[:, :3]] * 4).T, bias=True)]:
        values, vectors = whitening.leading(cov, 6)
        ev = np.linalg.eigvalsh(cov)[::-1][:6]
        assert values == pytest.approx(ev, abs=1e-12 * ev[0])
        live = values > 1e-12 * np.trace(cov)
        v = vectors[live]
        assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-10
        assert np.abs(cov @ v.T - v.T * values[live]).max() < 1e-10 * ev[0]


# ---------------------------------------------------------------- op12 codebooks

def brute_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted(valid(rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, [math.floor(4096 * float(v)) for v in r[1]]))
    d = max(len(r[1]) for r in rows)
    x = np.array([[math.floor(4096 * float(v)) for v in r[1]] + [0] * (d - len(r[1])) for r in rows], dtype=np.int64)
    cuts = codebooks.bounds(d, parts)
    book = [x[:entries, s:e].copy() for s, e in cuts]

    def assign():
        idx, err = np.zeros((len(x), parts), dtype=int), np.zeros(len(x), dtype=np.int64)
        for p, (s, e) in enumerate(cuts):
            dist = ((x[:, None, s:e] - book[p][None]) ** 2).sum(2)
            idx[:, p], err = dist.argmin(1), err + dist.min(1)
        return idx, err

    for _ in range(rounds):
        idx, _ = assign()
        for p, (s, e) in enumerate(cuts):
            for k in range(len(book[p])):
                m = idx[:, p] == k
                if m.any():
                    book[p][k] = x[m, s:e].sum(0) // m.sum()
    idx, err = assign()
    by_label = {}
    for r, e in zip(rows, err):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(int(v)) for c in book for row in c for v in row).encode()).hexdigest()
    return sorted([(r[0], "".join(f"{int(v):02x}" for v in i), int(e), by_label[r[2]], digest) for r, i, e in zip(rows, idx, err)], key=str)


def test_codebooks_equal_brute_force_on_the_fixture(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    got = sorted([tuple(r) for r in QUERIES["op12_codebooks"](spark, sf).collect()], key=str)
    assert got == brute_codes(rows)


@pytest.mark.parametrize("cell", [1, 7, 512, 1 << 20])
def test_codebooks_exact_at_any_cell_size(spark, cell):
    rng = random.Random(cell)
    rows = [(rng.choice([i, i, None, 3]), [rng.choice([0.0, 0.001, -0.3, 0.25, rng.uniform(-1, 1)]) for _ in range(16)], rng.choice([0, 1, None]))
            for i in range(60)]
    rows += [(100, None, 1), (101, [float("nan")] * 16, 1), (102, [1.0] * 16, 1), (102, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, VEC)
    got = sorted([tuple(r) for r in codebooks.codes(df, cell=cell).collect()], key=str)
    assert got == brute_codes(rows)


def test_codebooks_memo_evaluates_fewer_than_all_pairs():
    rng = np.random.default_rng(0)
    book = [rng.integers(-1200, 1200, size=(16, 8))]
    a = codebooks.Assigner(book, 512)
    v = rng.integers(-1200, 1200, size=(5000, 8))
    idx, dist = a.nearest(0, v)
    full = ((v[:, None, :] - book[0][None]) ** 2).sum(2)
    assert (idx == full.argmin(1)).all() and (dist == full.min(1)).all()
    assert a.evaluated < 16 * len(v)


def test_codebooks_small_and_empty_tables(spark):
    rows = [(5, [0.5] * 8, 1), (4, [0.25] * 8, None), (6, [0.5] * 8, None)]
    got = sorted([tuple(r) for r in codebooks.codes(spark.createDataFrame(rows, VEC)).collect()], key=str)
    assert got == brute_codes(rows)  # three entries per codebook
    assert codebooks.codes(spark.createDataFrame([], VEC)).count() == 0


# ---------------------------------------------------------------- op13 substring dedup

def brute_substrings(rows, width=13):
    first = {}
    for i, t in rows:
        ws = t.encode().split() if t else []
        if i is not None:
            for s in range(len(ws) - width + 1):
                k = tuple(ws[s:s + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        ws = t.encode().split() if t else []
        gone = [False] * len(ws)
        if i is not None:
            for s in range(len(ws) - width + 1):
                if first[tuple(ws[s:s + width])] < i:
                    gone[s:s + width] = [True] * width
        kept = [w for w, g in zip(ws, gone) if not g]
        out.append((i, len(ws), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_substrings_equal_brute_force_on_a_hostile_corpus(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "c", "the", "of", "x", "y", "z", "qq", "rr", "ü", "日本"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120))) for _ in range(30)]
    rows = []
    for i in range(250):
        t = base[rng.randrange(30)] if rng.random() < 0.3 else " ".join(rng.choice(vocab[:rng.randint(1, 12)]) for _ in range(rng.randint(0, 80)))
        if rng.random() < 0.5:
            b = base[rng.randrange(30)].split()
            s = rng.randrange(len(b) + 1)
            t += "\n\t " + " ".join(b[s:s + rng.randint(5, 30)]) + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 20)))
        rows.append((rng.choice([i, i, i, rng.randrange(250), None]), rng.choice([t, t, t, None, ""])))
    rows.append((1000, " ".join(["w"] * 5000)))  # one long run
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sym", F.lit(1)).withColumn("th", F.lit(2))
    got = sorted([tuple(r) for r in substrings.report(df).collect()], key=str)
    assert got == brute_substrings(rows)


def test_substrings_query_on_the_fixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in QUERIES["op13_substring_dedup"](spark, sf).collect()], key=str)
    assert got == brute_substrings(rows)


def test_interior_blocks_are_the_same_in_every_occurrence():
    rng = random.Random(2)
    vocab = [b"a", b"b", b"c", b"d"]
    for _ in range(200):
        x = [rng.choice(vocab) for _ in range(13)]
        texts = [[rng.choice(vocab) for _ in range(rng.randint(0, 6))] + x + [rng.choice(vocab) for _ in range(rng.randint(0, 6))] for _ in range(4)]
        seen = []
        for t in texts:
            off = next(s for s in range(len(t)) if t[s:s + 13] == x)
            p = substrings.parse(t, substrings.LEVEL)
            inner = {(int(p.start[j]) - off, int(p.end[j]) - off, int(p.sym[j])) for j in range(len(p.sym))
                     if p.lo[j] >= off and p.hi[j] <= off + 12}
            seen.append(inner)
        # a block interior to the window in one text is a block of every other text at the same offset
        for a in seen:
            for b_text, b in zip(texts, seen):
                p = substrings.parse(b_text, substrings.LEVEL)
                off = next(s for s in range(len(b_text)) if b_text[s:s + 13] == x)
                blocks = {(int(p.start[j]) - off, int(p.end[j]) - off, int(p.sym[j])) for j in range(len(p.sym))}
                assert a <= blocks


def test_substrings_empty_and_short(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in substrings.report(df).collect()) == brute_substrings([(1, "a b c"), (2, None), (3, "")])
    assert substrings.report(df.limit(0)).count() == 0


def test_representatives_are_the_same_for_equal_windows():
    rng = random.Random(3)
    names = {}
    for size in (1, 2, 4, 30):
        vocab = [b"w%d" % k for k in range(size)]
        for _ in range(60):
            ws = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
            found = substrings.representatives(ws, substrings.LEVEL, 13)
            assert len(found) == max(0, len(ws) - 12)
            for s, name in enumerate(found.tolist()):
                assert names.setdefault(tuple(ws[s:s + 13]), name) == name
    ws = [b"v%d" % rng.randrange(10_000) for _ in range(20_000)]
    assert len(np.unique(substrings.representatives(ws, substrings.LEVEL, 13))) < len(ws) / 2  # of 11,250 blocks


def test_substrings_shuffle_the_texts_once(spark):
    words = [f"w{k}" for k in range(40)]
    df = spark.createDataFrame([(k, " ".join(words[k % 7:] * 2)) for k in range(60)], "doc_id long, text string").repartition(4)
    found = substrings.report(df)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and "collect_list(struct" not in plan
