"""Exact dedup, sharding, tokens, languages: row-wise operators against plain Python."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import byte_bpe, exact_dedup, language_id, sharding
from ledgerwatch.llm.queries import vocabulary
from tests.llm import cases


def expected_groups(rows):
    out = Counter()
    for i, t, _ in rows:
        same = [j for j, u, _ in rows if cases.normal(u) == cases.normal(t)]
        keep = min((j for j in same if j is not None), default=None)
        out[i, keep, len(same), i == keep, hashlib.sha256(cases.normal(t).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bits", [None, lambda t: F.unhex(F.lit("00")), lambda t: F.unhex(F.hex(F.length(t) % 3))])
def test_exact_groups_also_under_colliding_hashes(spark, bits):
    got = exact_dedup.resolve(cases.frame(spark), hash_bits=bits)
    assert Counter(map(tuple, got.collect())) == expected_groups(cases.ROWS)


def test_keep_first_leaves_one_row_of_each_group(spark):
    df = cases.frame(spark)
    got = exact_dedup.keep_first(df)
    assert got.columns == df.columns
    texts = [cases.normal(r["text"]) for r in got.collect()]
    assert sorted(texts) == sorted({cases.normal(t) for _, t, _ in cases.ROWS})
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 5, 6, 8, 9, 10, 11, 12, 14]
    assert exact_dedup.keep_first(df.limit(0)).count() == 0 and exact_dedup.resolve(df.limit(0)).count() == 0


def check_shards(rows, got, shards=16):
    assert len(got) == len(rows)
    size = {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t, *_ in rows}
    assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in got} == size
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    total, start = sum(r["size"] for r in got), 0
    for r in ordered:  # contiguous: the shard is that of the row's middle in the running sum
        assert r["shard"] == (2 * start + r["size"]) * shards // (2 * total)
        start += r["size"]
    assert [r["text_crc32"] for r in ordered] == sorted(r["text_crc32"] for r in got)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_shards_cut_at_equal_bytes(spark, sf):
    check_shards(cases.ROWS, sharding.by_bytes(cases.frame(spark)).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + k, "copy " * 50) for k in range(100)]
    hot = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 7):
        got = sharding.by_bytes(hot, partitions=parts).collect()
        check_shards(rows, got)
    per = Counter()
    for r in got:
        per[r["shard"]] += r["size"]
    assert max(per.values()) - min(per.values()) <= 2 * max(r["size"] for r in got)
    assert sharding.by_bytes(cases.frame(spark).limit(0)).count() == 0


TEXTS = ["", "a", "Hello world's  end", "naïve café — 你好 \U0001F600\U0001F600", "\n\n  \t x", "1234567 890", "a" * 3000, " " * 2500 + "b", "abc" * 900 + "!?" * 700,
         "don't we'll I'm", "  mixed", "thethethethe" * 40, "Ünïcödé" * 30]


def reference_encoder():
    import tiktoken
    ranks, pattern = vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_tokens_equal_the_library(spark):
    ranks, pattern = vocabulary()
    own, other = byte_bpe.Encoder(ranks, pattern, pieces=5), reference_encoder()
    rng = np.random.default_rng(1)
    texts = TEXTS + ["".join(chr(c) for c in rng.integers(32, 0x2FF, 60)) for _ in range(200)] + [bytes(rng.integers(97, 101, 90).tolist()).decode() for _ in range(50)]
    ids, per = own(texts)
    ends = np.cumsum(per)
    for t, end, n in zip(texts, ends, per, strict=True):
        assert ids[end - n:end].tolist() == other.encode_ordinary(t), t
    rows = byte_bpe.decode(byte_bpe.encode(cases.frame(spark), ranks, pattern), ranks).collect()
    assert len(rows) == len(cases.ROWS)
    for r in rows:
        texts = {t or "" for i, t, _ in cases.ROWS if i == r["doc_id"]}
        text = bytes(r["decoded"]).decode()
        assert text in texts and list(r["ids"]) == other.encode_ordinary(text)
    assert byte_bpe.digests(cases.frame(spark).limit(0), ranks, pattern).count() == 0


def test_long_pieces_merge_like_short_ones():
    ranks, pattern = vocabulary()
    enc = byte_bpe.Encoder(ranks, pattern)
    rng = np.random.default_rng(2)
    for n in (2, 3, 50, 400):
        raw = bytes(rng.choice(list(b"theraion "), n).tolist())
        ids = enc.bytes[np.frombuffer(raw, np.uint8)]
        assert enc.merge_long(ids.tolist()).tolist() == enc.merge_matrix(ids.reshape(1, -1).copy())[0].tolist()
    assert base64.b64encode(b"x")  # the rank file's alphabet


def plain_profile(texts, ranks=language_id.RANKS):
    total = Counter()
    for t in texts:
        for w in language_id.LETTERS.findall((t or "").lower()):
            total.update(language_id.grams(w))
    return [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:ranks]]


def plain_predict(text, profiles, ranks=language_id.RANKS):
    own = plain_profile([text], ranks)
    if not own or not profiles:
        return "und", 0.0
    best = None
    for lang in sorted(profiles):
        place = {g: k for k, g in enumerate(profiles[lang])}
        away = sum(abs(place[g] - k) if g in place else ranks for k, g in enumerate(own))
        if best is None or away < best[0]:
            best = away, lang
    return best[1], 1 - best[0] / (ranks * len(own))


def test_languages_equal_plain_profiles(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    profiles = language_id.train(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    assert profiles == {lang: plain_profile([r["text"] for r in train if r["lang"] == lang]) for lang in {r["lang"] for r in train}}
    got = {r["doc_id"]: r for r in language_id.predict(docs, profiles, keep=["doc_id"]).collect()}
    for r in rows[:60]:
        lang, score = plain_predict(r["text"], profiles)
        assert (got[r["doc_id"]]["lang_pred"], round(got[r["doc_id"]]["score"], 9)) == (lang, round(score, 9))
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    edge = language_id.predict(cases.frame(spark), profiles).collect()
    assert len(edge) == len(cases.ROWS)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in edge if r["doc_id"] in (3, 4, 5, 12))
    assert all(0 < r["score"] <= 1 for r in edge if r["doc_id"] in (1, 8, 11))
    assert language_id.train(cases.frame(spark).limit(0)) == {}
    assert {r["lang_pred"] for r in language_id.predict(cases.frame(spark), {}).collect()} == {"und"}
