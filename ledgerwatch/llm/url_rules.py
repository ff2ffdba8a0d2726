"""URL filter: a fixed rule list, and association rules mined by FP-growth for the urls it leaves open.

A url becomes a set of tokens (host labels and their hyphenated parts with the labels' role, path
segments with digits folded, query keys). FP-growth mines token sets together with the label item of
labelled urls; a rule tokens -> label stays if support and confidence reach their bounds and no rule with one
token less has at least its confidence. Rules match by an inverted index token -> rule: the
distinct token sets of open urls are exploded, joined with the index and counted, and a rule fires where
all its tokens met. Of the fired rules the most confident, then best supported, then shortest one decides.

Support is a share of the labelled urls, so the number of frequent tokens and rules does not grow with
the input. Equal urls and token sets are combined before their shuffle.

Defined cases: a null url or one without `://` has empty host and path, matches no rule and gets the
default verdict unless a mined rule fires; without labelled urls no rule is mined; repeated rows repeat
their verdict; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mining:
    """Bounds of the mined rules."""
    support: float = 0.01
    confidence: float = 0.8
    default: str = ALLOW


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: list[Rule], what) -> Column:
    """Value of the longest rule that fits, null without one."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url, never null."""
    labels = F.split(host, r"\.")
    own = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    fold = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    by_host = F.transform(own, lambda x: F.concat(F.lit("host:"), fold(x)))
    hyphened = F.flatten(F.transform(F.filter(own, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    parts = F.transform(F.filter(hyphened, lambda x: x != ""), lambda x: F.concat(F.lit("part:"), fold(x)))
    top = F.array(F.concat(F.lit("top:"), F.element_at(labels, -1)))
    folded = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda x: x != "")
    by_path = F.transform(folded, lambda x: F.concat(F.lit("path:"), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    return F.array_sort(F.array_distinct(F.concat(by_host, parts, top, by_path, keys)))


def mine(labelled: DataFrame, mining: Mining) -> DataFrame:
    """(rule_id, tokens, size, verdict, confidence, support) from rows (tokens, verdict)."""
    mark = "label:"
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(mark), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=mining.support, minConfidence=mining.confidence).fit(baskets)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    with_label = (sets.withColumn("verdict", F.expr(f"get(filter(items, x -> startswith(x, '{mark}')), 0)"))
                  .withColumn("tokens", F.expr(f"filter(items, x -> not startswith(x, '{mark}'))")))
    base = with_label.filter("verdict is null").select("tokens", F.col("freq").alias("met"))
    rules = (with_label.filter("verdict is not null and size(tokens) > 0").join(base, "tokens")
             .select("tokens", F.size("tokens").alias("size"), F.expr(f"substring(verdict, {len(mark) + 1})").alias("verdict"),
                     (F.col("freq") / F.col("met")).alias("confidence"), F.col("freq").alias("support"))
             .filter(F.col("confidence") >= mining.confidence)
             .withColumn("rule_id", F.xxhash64("tokens", "verdict")))
    # a rule goes if the rule without one of its tokens has the same verdict and at least its confidence
    wider = rules.filter("size > 1").select("rule_id", "verdict", "confidence", F.explode(
        F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("tokens"))
    rival = rules.select("tokens", "verdict", F.col("confidence").alias("reached"))
    beaten = wider.join(rival, ["tokens", "verdict"]).filter("reached >= confidence").select("rule_id").distinct()
    return rules.join(beaten, "rule_id", "left_anti")


def fired(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict) of the token sets in which a rule fires."""
    index = rules.select("rule_id", "size", "verdict", "confidence", "support", F.explode("tokens").alias("token"))
    met = (sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
           .groupBy("tokens", "rule_id")
           .agg(F.count("*").alias("met"), *[F.first(c).alias(c) for c in ("size", "verdict", "confidence", "support")])
           .filter("met = size"))
    best = Window.partitionBy("tokens").orderBy(F.desc("confidence"), F.desc("support"), "size", "verdict", "rule_id")
    return met.withColumn("r", F.row_number().over(best)).filter("r = 1").select("tokens", "verdict")


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, mining: Mining = Mining(),
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    `labels` (url, verdict) trains the mined rules; without it the urls that the rule list judges do.
    """
    cut = lambda df: df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = cut(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    rows = rows.withColumns({
        "tokens": tokens(F.col("url"), F.col("host"), F.col("path")),
        "rule": fitting(F.col("host"), F.col("path"), rules, lambda r: r.name),
        "told": fitting(F.col("host"), F.col("path"), rules, lambda r: r.verdict)})
    if labels is None:
        labelled = rows.filter("told is not null").select("tokens", F.col("told").alias("verdict"))
    else:
        known = cut(labels.select("url", "verdict").filter("verdict is not null"))
        labelled = known.select(tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "verdict")
    found = fired(rows.filter("told is null").select("tokens").distinct(), mine(labelled, mining))
    return (rows.join(found, "tokens", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("told", "verdict", F.lit(mining.default)).alias("verdict")))
