"""The pipeline's stages in a row against plain Python on the smallest table."""

import corpus_pipeline
from ledgerwatch.llm.template_leaks import leaks
from tests.llm import cases


def test_stages_keep_columns_and_equal_plain_filters(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    frame, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        kept = frame.collect()
        if name != "byte_bpe":
            assert frame.columns == docs.columns
            frame = spark.createDataFrame(kept, docs.schema)
        ids[name] = {r["doc_id"] for r in kept}
    first = {}
    for i, t in sorted(rows):
        first.setdefault(cases.normal(t), i)
    assert ids["language_id"] == {i for i, t in rows if any(c.isalpha() for c in t or "")}
    left = [(i, t) for i, t in rows if i in set(first.values()) & ids["language_id"]]
    assert ids["exact_dedup"] == {i for i, _ in left}
    near = cases.classes(left)
    assert ids["ngram_jaccard"] == {i for i in near if near[i] == i}
    bad = {r["doc_id"] for r in leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids["benchmark_decontamination"] == ids["ngram_jaccard"] - bad == ids["byte_bpe"]


def test_stages_pass_over_odd_rows(spark, sf):
    frame = cases.frame(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, sf)
        kept = out.collect()
        if name != "byte_bpe":
            assert out.columns == frame.columns
            frame = spark.createDataFrame(kept, frame.schema)
    assert sorted(r["doc_id"] for r in kept) == [1, 6, 8, 10, 11, 14]


def test_stages_hand_workers_small_batches(spark):
    import pyarrow as pa

    from ledgerwatch.llm import language_id

    def sizes(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('ein langer Text ', 6000) AS text", "'de' AS lang").coalesce(1)
    language_id.predict(docs, {"de": ["e"]}).count()
    assert docs.mapInArrow(sizes, "n long").groupBy().max("n").first()[0] < 6 << 20
    spark.conf.set(name, "1000000")
    language_id.predict(docs, {"de": ["e"]})
    assert spark.conf.get(name) == "1000000"  # a bound of the session stays
    spark.conf.unset(name)


def test_scorer_forgets_words_without_changing_results(monkeypatch):
    from ledgerwatch.llm import language_id

    texts = [" ".join(f"wort{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(j, j + 40)) for j in range(0, 600, 20)]
    profiles = {"de": ["w", "wo", "or", "rt"], "en": ["t", "ta", "tb"]}
    whole = [language_id.Scorer(profiles)(t) for t in texts]
    monkeypatch.setattr(language_id, "REMEMBERED", 50)
    scorer = language_id.Scorer(profiles)
    assert [scorer(t) for t in texts] == whole and len(scorer.words) <= 90
