"""Personal data: fixed patterns as seeds, contextual patterns bootstrapped from them.

Base spans come from fixed expressions (email, ip, card, phone) and their checks. They seed the bootstrap: every
base span and every other word with at least DIGITS digits or an @ is an instance, its neighbouring words are its
patterns (two words before, one before, one after, both sides). On the graph of patterns and distinct instance values

* confidence(pattern, kind) = scores of its values of that kind / (number of its values + 1),
* score(value, kind) = 1 - product of (1 - confidence) over its patterns,

are computed in turn, ROUNDS times; a pattern needs SUPPORT of seed or discovered value. Patterns of
confidence TRUST or more then mark the instances that no base span covers, with the kind of the best one.

Only DataFrame functions run. Texts are scanned once and nothing but hashes and positions is written; patterns and
values are distinct before they are shuffled and only aggregated by key, so a frequent neighbour word is a sum,
never a collected group. Rewritten expressions (possessive, anchored at run starts) match what the plain ones
match, without backtracking over long runs.

Defined cases: null and empty texts have no spans; kinds may overlap, spans of one kind do not; rows that repeat id and
text repeat their result; rows with a null id are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.llm.common import SPACE, settled, written

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "[A-Za-z0-9._%+-]"
EXPRESSIONS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
#: A character that every match of the kind holds.
SIGNS = {"email": "@", "ip": ".", "phone": "+"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
DIGITS = 4
ROUNDS = 3
SUPPORT = 3.0
TRUST = 0.8


def located(text: Column, expression: str) -> Column:
    """Array of (start, end, m) of the matches, in code points: lengths of the parts between them add up."""
    parts, found = F.split(text, expression, -1), F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    pairs = F.arrays_zip(F.slice(parts, F.lit(1), F.size(found)).alias("p"), found.alias("m"))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))).alias("out"))

    summed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, summed).otherwise(none)


def luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")
    value = F.transform(back, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Sorted array of (start, place, end, kind, m) of all base spans."""
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string,m:string>>")

    def of_kind(place: int, kind: str) -> Column:
        good = F.filter(located(text, EXPRESSIONS[kind]), lambda x: passes(kind, x["m"]))
        made = F.transform(good, lambda x: F.struct(
            x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m")))
        return F.when(text.contains(SIGNS[kind]), made).otherwise(none) if kind in SIGNS else made

    return F.array_sort(F.concat(*(of_kind(place, kind) for place, kind in enumerate(KINDS))))


def others(text: Column, base: Column) -> Column:
    """(start, end, m) of words that look like identifiers and lie outside base spans."""
    looks = F.filter(located(text, r"(?<![^\x20\x09-\x0D])(?:[^0-9@\x20\x09-\x0D]*+[0-9@])++[^\x20\x09-\x0D]*+"),
                     lambda x: (F.length(F.regexp_replace(x["m"], "[^0-9]", "")) >= DIGITS) | x["m"].contains("@"))
    apart = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return F.when(F.size(looks) > 0, F.filter(looks, apart)).otherwise(looks)


def neighbours(text: Column, start: Column, end: Column) -> Column:
    """Patterns of a span: its neighbouring words, lower-cased, without digits and marks."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}=:#]+", "")
    left = F.split(F.trim(F.regexp_replace(F.substring(text, F.greatest(start - 59, F.lit(1)), F.least(start, F.lit(60))), SPACE, " ")), " ")
    right = F.split(F.trim(F.regexp_replace(F.substring(text, end + 1, F.lit(40)), SPACE, " ")), " ")
    one, two, after = plain(F.element_at(left, -1)), plain(F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit(""))), plain(F.element_at(right, 1))
    made = F.array(F.concat(F.lit("two:"), two, F.lit(" "), one), F.concat(F.lit("one:"), one),
                   F.concat(F.lit("after:"), after), F.concat(F.lit("both:"), one, F.lit(" "), after))
    return F.transform(made, lambda p: F.xxhash64(p))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document: base spans, and all instances with hashes of value and patterns."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("other", others(F.col("text"), F.col("base")))
    text = F.col("text")
    seeds = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.xxhash64(x["m"]).alias("value"),
                                                   neighbours(text, x["start"], x["end"]).alias("patterns")))
    rest = F.transform("other", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(None).cast("string").alias("kind"),
                                                   F.xxhash64(x["m"]).alias("value"), neighbours(text, x["start"], x["end"]).alias("patterns")))
    slim = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    return rows.select("id", "th", slim.alias("base"), F.concat(seeds, rest).alias("instances"))


def bootstrap(instances: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, trust: float = TRUST) -> DataFrame:
    """Trusted (pattern, kind, confidence) from rows (value, kind, patterns); kind is null outside seeds."""
    edges = settled(instances.select("value", "kind", F.explode("patterns").alias("pattern")).distinct())
    size = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("values"))
    seeds = edges.filter("kind is not null").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    scores = seeds
    for turn in range(rounds):
        links = edges.select("pattern", "value").distinct()
        sums = links.join(scores, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
        good = settled(sums.filter(F.col("s") >= support).join(size, "pattern")
                       .select("pattern", "kind", (F.col("s") / (F.col("values") + 1)).alias("confidence")))
        if turn + 1 < rounds:
            told = (links.join(good, "pattern").groupBy("value", "kind")
                    .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score")))
            found = told.join(seeds.select("value"), "value", "left_anti").filter(F.col("score") >= trust)
            scores = settled(seeds.unionByName(found))
    return good.filter(F.col("confidence") >= trust)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (start, place, end, kind); spans has the discovered ones too."""
    rows = written(scan(docs, id_col, text_col))
    each = rows.select("id", "th", F.explode("instances").alias("x")).select("id", "th", "x.*")
    trusted = bootstrap(each.select("value", "kind", "patterns"))
    best = Window.partitionBy("id", "th", "start", "end").orderBy(F.desc("confidence"), "kind")
    new = (each.filter("kind is null").select("id", "th", "start", "end", F.explode("patterns").alias("pattern"))
           .join(trusted, "pattern").withColumn("r", F.row_number().over(best)).filter("r = 1"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = new.groupBy("id", "th").agg(F.collect_set(F.struct("start", place.alias("place"), "end", "kind")).alias("added"))
    more = added.select(F.col("id").alias("i"), F.col("th").alias("t"), "added")
    out = rows.join(more, rows["id"].eqNullSafe(more["i"]) & (rows["th"] == more["t"]), "left")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return out.select(F.col("id").alias("doc_id"), "base", every.alias("spans"))


def listed(spans: Column | str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the counts are of base spans."""
    found = find(docs, id_col, text_col)
    of_kind = lambda k: (lambda x: x["kind"] == k)
    counts = [F.size(F.filter("base", of_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
