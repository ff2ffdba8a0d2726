"""Splits, class weights and classifier evaluation."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.operators.ordering import order_statistics, running_totals
from ledgerwatch.session import is_small


#: Classes whose cuts are fitted one by one; further, smaller ones are ranked.
NAMED_CLASSES = 1000
HASH_TOP = 2 ** 52 - 1


def split_hash(key: str, seed: int = 42) -> Column:
    """Repeatable pseudo-random whole number of a row key, below 2^52."""
    text = F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, label: str, key: str, fractions: list[float], seed: int = 42,
                     name: str = "fold", tally: dict[tuple, int] | None = None, hashed_as: str | None = None) -> DataFrame:
    """Adds ``fold``: 0 for the first fraction of each class, 1 for the second, ...

    Exact per class and independent of partitioning: the cut of a class is an order
    statistic of the row hash, so no large class is ever sorted in one task.  Only the
    ``NAMED_CLASSES`` largest classes are cut this way; a class beyond them holds less
    than that share of the rows and is ranked by a window.  A NULL label has no fold.
    ``tally`` takes the rows per (class, fold); ``hashed_as`` keeps the hash in a column of that name.
    Larger tables are hashed once for all passes: labels and hashes are stored on disk meanwhile.
    """
    h = split_hash(key, seed)
    pairs = df.select(label, h.alias("_h")).where(F.col(label).isNotNull())
    stored = not is_small(df)
    pairs = pairs.persist(StorageLevel.DISK_ONLY) if stored else pairs
    per_class = pairs.groupBy(label).agg(F.count("*").alias("n"))
    counts = {x[label]: x["n"] for x in per_class.orderBy(F.desc("n"), label).limit(NAMED_CLASSES).collect()}
    hashed = df.withColumn("_h", h)
    wanted, place = [], []
    for c, n in counts.items():
        share = 0.0
        for i, f in enumerate(fractions[:-1]):
            share += f
            k = int(share * n + 0.5)
            if k > 0:
                place.append((c, i, len(wanted)))
                wanted.append((F.when(F.col(label) == F.lit(c), F.col("_h")), k - 1))
    cuts = order_statistics(pairs, wanted, known=[(0, HASH_TOP, counts[c]) for c, _, _ in place])
    fold = F.lit(len(fractions) - 1)
    for c, i, at in sorted(place, key=lambda x: -x[1]):
        fold = F.when((F.col(label) == F.lit(c)) & (F.col("_h") <= F.lit(cuts[at])), F.lit(i)).otherwise(fold)
    kept = [F.col("_h").alias(hashed_as)] if hashed_as else []
    named = F.when(F.col(label).isNotNull(), fold)
    if tally is not None and len(counts) < NAMED_CLASSES:
        tally.update({(x[label], x["fold"]): x["n"] for x in pairs.groupBy(label, named.alias("fold")).agg(F.count("*").alias("n")).collect()})
    if stored:
        pairs.unpersist()
    if len(counts) < NAMED_CLASSES:
        return hashed.select(*df.columns, named.alias(name), *kept)
    large = F.coalesce(F.col(label).isin(list(counts)), F.lit(True))
    big = hashed.where(large).withColumn(name, F.when(F.col(label).isNotNull(), fold))
    part = Window.partitionBy(label)
    small = hashed.where(~large).withColumns({"_r": F.rank().over(part.orderBy("_h")), "_n": F.count("*").over(part)})
    own, share = F.lit(len(fractions) - 1), sum(fractions[:-1])
    for i in range(len(fractions) - 2, -1, -1):
        own = F.when(F.col("_r") <= F.floor(F.lit(share) * F.col("_n") + 0.5), F.lit(i)).otherwise(own)
        share -= fractions[i]
    out = big.unionByName(small.withColumn(name, own).drop("_r", "_n"))
    if tally is not None:
        tally.update({(x[label], x[name]): x["n"] for x in out.where(F.col(name).isNotNull()).groupBy(label, name).agg(F.count("*").alias("n")).collect()})
    return out.select(*df.columns, name, *kept)


def stratified_sample(df: DataFrame, label: str, key: str, fraction: float = 0.35, seed: int = 42) -> DataFrame:
    return stratified_split(df, label, key, [fraction, 1 - fraction], seed, "_f").where("_f = 0").drop("_f")


def add_class_weight(df: DataFrame, label: str, name: str = "weight", train: Column | None = None) -> DataFrame:
    """Positive rows weigh negatives / max(positives, 1), counted on training rows only."""
    t = df if train is None else df.where(train)
    x = t.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    return df.withColumn(name, F.when(F.col(label) == 1, x["neg"] / max(x["pos"], 1)).otherwise(1.0))


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    p, rc = _div(tp, tp + fp), _div(tp, tp + fn)
    return {"accuracy": _div(tp + tn, tp + fp + fn + tn), "precision": p, "recall": rc, "f1": _div(2 * p * rc, p + rc),
            "fraud_detection_rate": tp / F.greatest(tp + fn, F.lit(1)), "false_alarm_rate": fp / F.greatest(fp + tn, F.lit(1))}


def confusion(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    g = df.groupBy(*(by or [])).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    return g.withColumns(confusion_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC-AUC and average precision, one row.

    Rows are first added up per distinct score; the running totals over scores
    never gather in one task beyond a checked size.
    """
    g = (df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s"))
         .agg(F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) == 0).cast("bigint")).alias("neg")))
    run = running_totals(g, [F.desc("s")], {"tp": F.col("pos"), "fp": F.col("neg")})
    return run.agg(
        F.try_divide(F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.sum("pos")), F.sum("neg")).alias("roc_auc"),
        F.try_divide(F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp"))), F.sum("pos")).alias("average_precision"))


def at_top_k(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """Precision and recall among the K best, K = min(100, 5 % of the rows)."""
    n = df.count()
    k = min(100, int(n * 0.05))
    top = df.orderBy(F.desc(score), key).limit(k).agg(F.sum(label).alias("hits"))
    pos = df.agg(F.sum(label).alias("pos"))
    return top.join(F.broadcast(pos)).select(
        F.lit(k).alias("k"), _div(F.col("hits"), F.lit(k)).alias("precision_at_k"),
        _div(F.col("hits"), F.greatest("pos", F.lit(1))).alias("recall_at_k"))


def missed_frauds(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    m = df.where((F.col(label) == 1) & (F.col(score) < threshold))
    return m.agg(F.count("*").alias("missed"), F.avg(score).alias("avg_p"), F.min(score).alias("min_p"), F.max(score).alias("max_p")
                 ).withColumn("suggested_threshold", F.when(F.col("avg_p") > 0.3, F.col("avg_p")))


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Confusion counts and rates at every threshold in one pass over the rows."""
    y, s = F.col(label), F.col(score)
    counts = df.agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"),
                    *[c for i, t in enumerate(thresholds) for c in (
                        F.count_if((y == 1) & (s >= t)).alias(f"tp{i}"), F.count_if((y == 0) & (s >= t)).alias(f"fp{i}"))])
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                               (F.col("pos") - F.col(f"tp{i}")).alias("fn"), (F.col("neg") - F.col(f"fp{i}")).alias("tn"))
                      for i, t in enumerate(thresholds)])
    rows = counts.select(F.explode(cells).alias("x")).select("x.*")
    c = confusion_columns(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    return rows.withColumns({k: c[k] for k in ("precision", "recall", "f1")})


def threshold_cost(sweep: DataFrame, loss: float = 50_000, false_alarm: float = 5_000, review: float = 1_000) -> DataFrame:
    """Loss of missed frauds, of false alarms and of reviews per threshold.

    Reviews are the false alarms that are looked at by hand.
    """
    return sweep.select("threshold", (F.col("fn") * loss).alias("missed_loss"), (F.col("fp") * false_alarm).alias("false_alarm_cost"),
                        (F.col("fp") * review).alias("review_cost"),
                        (F.col("fn") * loss + F.col("fp") * (false_alarm + review)).alias("total_cost"))


def probability_bands(df: DataFrame, label: str, score: str) -> DataFrame:
    s = F.col(score)
    band = (F.when(s >= 0.5, "50-100").when(s >= 0.25, "25-50").when(s >= 0.15, "15-25").when(s >= 0.05, "05-15").otherwise("00-05"))
    g = df.where(F.col(label) == 1).groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("t")))).select("band", "n", (F.col("n") / F.col("t")).alias("share"))


def leakage_probe(df: DataFrame, label: str, cols: list[str], min_rows: int = 1) -> DataFrame:
    """Category values that are always or never fraud."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols])
    return (df.select(label, F.explode(cells).alias("x")).groupBy("x.name", "x.value")
            .agg(F.count("*").alias("n"), F.avg(label).alias("rate"))
            .where((F.col("rate").isin(0.0, 1.0)) & (F.col("n") >= min_rows)))


def overfit_check(train: DataFrame, test: DataFrame, limit: float = 0.05) -> DataFrame:
    """Both inputs come from ``confusion``."""
    a, b = train.select(F.col("f1").alias("train_f1")), test.select(F.col("f1").alias("test_f1"))
    gap = F.abs(F.col("train_f1") - F.col("test_f1"))
    return a.join(F.broadcast(b)).select("train_f1", "test_f1", gap.alias("gap"), (gap > limit).cast("int").alias("overfit"))


def regression_errors(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """MAE, RMSE and R2 per named (actual, predicted) pair in one pass."""
    from ledgerwatch.operators.profile import melt
    aggs, fields = [], {}
    for k, (y, p) in pairs.items():
        e = F.col(y) - F.col(p)
        aggs += [F.avg(F.abs(e)).alias(f"mae_{k}"), F.avg(e * e).alias(f"mse_{k}"), F.var_pop(y).alias(f"var_{k}")]
        fields[k] = {"mae": F.col(f"mae_{k}"), "rmse": F.sqrt(f"mse_{k}"), "r2": 1 - F.try_divide(f"mse_{k}", f"var_{k}")}
    return melt(df.agg(*aggs), fields)


#: Score bins of the fold evaluator; 0.5 is a bin edge, so decisions at 0.5 are exact.
SCORE_BINS = 1000


def binned_metrics(scores: DataFrame, by: list[str], label: str = "label", p: str = "p", bins: int = SCORE_BINS,
                   threshold: float = 0.5) -> DataFrame:
    """Per group of `by`: tp, fp, fn, tn at `threshold` (p >= threshold is positive), precision, recall,
    f1 and roc_auc, all from one table of counts per (group, score bin, label).

    The counts are combined before the shuffle, so a group never holds more than `bins` rows after it;
    roc_auc counts pairs in one bin as half (exact when scores differ by more than a bin). Labels
    other than 0 and 1 and NULL scores are left out; an empty class gives a NULL roc_auc.
    """
    b = F.least(F.greatest(F.floor(F.col(p) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = (scores.where(F.col(p).isNotNull() & F.col(label).isin(0, 1))
              .groupBy(*by, b.alias("_bin")).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")))
    return count_metrics(counts, by, bins, threshold)


def count_metrics(counts: DataFrame, by: list[str], bins: int = SCORE_BINS, threshold: float = 0.5) -> DataFrame:
    """`binned_metrics` from counts (by, _bin, _pos, _neg), one row per group and bin."""
    cut = int(round(threshold * bins))
    below = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumn("_neg_below", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    up = F.col("_bin") >= cut
    m = c.groupBy(*by).agg(
        F.sum(F.when(up, F.col("_pos")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~up, F.col("_pos")).otherwise(0)).alias("fn"), F.sum(F.when(~up, F.col("_neg")).otherwise(0)).alias("tn"),
        F.sum(F.col("_pos") * F.col("_neg_below") + 0.5 * F.col("_pos") * F.col("_neg")).alias("_pairs"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = _div(tp, tp + fp), _div(tp, tp + fn)
    return m.select(*by, "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"),
                    _div(2 * precision * recall, precision + recall).alias("f1"),
                    F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_pairs") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def fold_summary(metrics: DataFrame, by: list[str], names: tuple[str, ...] = ("f1", "precision", "recall", "roc_auc")) -> DataFrame:
    """Mean and population deviation over folds of every metric, per group of `by`."""
    return metrics.groupBy(*by).agg(*[F.avg(n).alias(f"mean_test_{n}") for n in names], *[F.stddev_pop(n).alias(f"std_test_{n}") for n in names])
