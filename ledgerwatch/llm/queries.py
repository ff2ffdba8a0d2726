"""Named queries of the training-data operators over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerwatch.llm import byte_bpe, codebooks, exact_dedup, language_id, ngram_jaccard, personal_data, sharding, substrings, suffix_tree, template_leaks, toxicity, url_rules, whitening
from ledgerwatch.llm.common import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_sharding")
def op3_sharding(spark, d):
    return sharding.by_bytes(read(spark, d, "documents"))


@query("op8_exact_dedup", r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
 g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)""")
def op8_exact_dedup(spark, d):
    return exact_dedup.resolve(read(spark, d, "documents"))


@query("op4_language_id")
def op4_language_id(spark, d):
    docs = read(spark, d, "documents")
    part = remainder("doc_id", 4)
    profiles = language_id.train(docs.filter(part != 2))
    marked = docs.select("doc_id", "text", (part == 2).alias("held_out"))
    return language_id.predict(marked, profiles, keep=["doc_id", "held_out"])


URL_RULES = [url_rules.Rule("net", "/", url_rules.BLOCK), url_rules.Rule("example.net", "/en/", url_rules.ALLOW),
             url_rules.Rule("example.com", "/de/", url_rules.BLOCK), url_rules.Rule("org", "/fr/", url_rules.ALLOW)]


@query("op5_url_rules")
def op5_url_rules(spark, d):
    return url_rules.judge(read(spark, d, "pages"), URL_RULES)


def vocabulary() -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of the public tokenizer that the queries use."""
    import public_tokenizers
    return byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@query("op6_byte_bpe")
def op6_byte_bpe(spark, d):
    return byte_bpe.digests(read(spark, d, "documents"), *vocabulary())


@query("op7_toxicity")
def op7_toxicity(spark, d):
    docs = read(spark, d, "documents")
    model = toxicity.train(toxicity.labelled(docs, read(spark, d, "labels")))
    return toxicity.predict(docs, model)


@query("op2_ngram_jaccard", r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
 e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
 l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
   GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, c.component_id FROM g JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON g.doc_id = c.a""")
def op2_ngram_jaccard(spark, d):
    return ngram_jaccard.classes(read(spark, d, "documents"))


@query("op1_template_leaks")
def op1_template_leaks(spark, d):
    return template_leaks.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query("op9_suffix_tree")
def op9_suffix_tree(spark, d):
    docs = read(spark, d, "documents")
    tree, counts = suffix_tree.train(docs.filter(remainder("doc_id", 5) != 1))
    scored = suffix_tree.score(docs, tree, counts)
    return scored.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op10_personal_data")
def op10_personal_data(spark, d):
    return personal_data.report(read(spark, d, "documents"))


@query("op11_whitening")
def op11_whitening(spark, d):
    return whitening.whiten(read(spark, d, "embeddings"))


@query("op12_codebooks")
def op12_codebooks(spark, d):
    return codebooks.codes(read(spark, d, "embeddings"))


@query("op13_substring_dedup")
def op13_substring_dedup(spark, d):
    return substrings.report(read(spark, d, "documents"))
