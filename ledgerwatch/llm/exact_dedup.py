"""Exact duplicates: 128-bit content hash, smallest id stays, bytes compared inside groups.

Texts are equal when identical after every run of ASCII white space became one space. The group of a
hash is aggregated before the shuffle (count, smallest id, smallest and largest text), so a group of
copies that holds a third of all rows reaches its reducer as one row per map task. Where smallest and
largest text of a hash differ, the hash collided and its rows are grouped by the text itself.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null id is larger
than every id; rows that repeat an id with an equal text share their decision (`keep_first` then keeps
one of them); an empty table gives an empty result; other columns are never read by `resolve`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.llm.common import SPACE, fresh, settled


def normalised(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text))


def groups(rows: DataFrame, hash_bits: Column | None = None) -> DataFrame:
    """(h, t, keep, n): one row per group of equal texts; t is null unless the hash collided.

    `rows` has `id` and the normalised text `t`; `hash_bits` replaces the hash (tests force collisions).
    """
    h = content_hash(F.col("t")) if hash_bits is None else hash_bits
    hashed = rows.select("id", "t", h.alias("h"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"].alias("keep")
    met = hashed.groupBy("h").agg(F.count("*").alias("n"), first, F.min("t").alias("lo"), F.max("t").alias("hi"))
    return met.select("h", "keep", "n", (F.col("lo") != F.col("hi")).alias("collided"))


def resolve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits=None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of the table."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    bits = (hash_bits or content_hash)(F.col("t"))
    met = settled(groups(rows, bits))
    named = rows.select("id", bits.alias("h"), F.sha2("t", 256).alias("sha"))
    joined = named.join(met, "h")
    plain = joined.filter("not collided").select("id", "keep", "n", "sha")
    if met.filter("collided").isEmpty():
        return _named(plain)
    # collided hashes only: group by the bytes themselves
    bad = rows.select("id", "t", bits.alias("h")).join(met.filter("collided").select("h"), "h", "left_semi")
    own = bad.groupBy("t").agg(F.count("*").alias("n"),
                               F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"].alias("keep"))
    exact = bad.join(own, "t").select("id", "keep", "n", F.sha2("t", 256).alias("sha"))
    return _named(plain.unionByName(exact))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table without its exact duplicates: all columns, one row of each group of equal texts."""
    i, s, n = fresh(docs, "id"), fresh(docs, "sha"), fresh(docs, "turn")
    kept = (resolve(docs, id_col, text_col).filter("kept")
            .select(F.col("doc_id").alias(i), F.col("text_sha256").alias(s)).distinct())
    marked = docs.withColumn(s, F.sha2(normalised(text_col), 256))
    same = marked[s].eqNullSafe(kept[s]) & marked[id_col].eqNullSafe(kept[i])
    left = marked.join(kept, same, "left_semi")
    turn = F.row_number().over(Window.partitionBy(id_col, s).orderBy(text_col, *[c for c, t in docs.dtypes
                               if c not in (id_col, text_col) and not t.startswith(("map", "variant", "void"))]))
    return left.withColumn(n, turn).filter(F.col(n) == 1).select(*docs.columns)
