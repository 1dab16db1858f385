"""Ranking and decision metrics from aggregated score counts.

Rank metrics need only the positives and negatives of each distinct score, so
rows are aggregated before they are shuffled. Pooled metrics need running sums
over all distinct scores; these are taken inside ranges of the score, with the
totals of the ranges before, and never in one task. So are those inside groups
where there are very many scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from chronoloom.operators.ranks import splitters, value_counts
from chronoloom.storage import stored


#: Distinct scores of all groups together up to which a group's scores are taken in one task; of more, those of groups of up to an eighth of this are.
TOGETHER = 2_000_000


def _same(by: list[str]) -> Column:
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return same


def _grouped_sums(counts: DataFrame, by: list[str], parts: int) -> DataFrame:
    """pos_below, neg_below, P and N inside groups. Groups are windows, but where all have over TOGETHER rows those of over an eighth of it are taken in ranges of
    (group, score), and the sums of a group's ranges before come by a join, so a group of most scores is many tasks."""
    whole = W.partitionBy(*by)
    below = lambda c, over: F.coalesce(F.sum(c).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    def windows(own: DataFrame) -> DataFrame:
        up = whole.orderBy("_s")
        return own.select("*", below("_pos", up).alias("pos_below"), below("_neg", up).alias("neg_below"), F.sum("_pos").over(whole).alias("P"), F.sum("_neg").over(whole).alias("N"))

    if counts.count() <= TOGETHER:
        return windows(counts)
    keys = [F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]
    large = stored(counts.groupBy(*by).agg(F.count("*").alias("_size")).where(F.col("_size") > TOGETHER // 8).select(*keys), "large-groups")
    if large.isEmpty():
        return windows(counts)
    few = F.broadcast(large)  # at most a row for each TOGETHER / 8 rows of counts
    long = counts.join(few, _same(by), "left_semi")
    cuts = splitters(long, [*by, "_s"], parts)
    parted = long.withColumn("_part", F.size(F.filter(F.array(*cuts), lambda c: c <= F.struct(*by, "_s"))) if cuts else F.lit(0))
    sums = parted.groupBy(*by, "_part").agg(F.sum("_pos").alias("p"), F.sum("_neg").alias("n"))  # a row for each part and for each group
    ranged = whole.orderBy("_part")
    before = sums.select(*keys, F.col("_part").alias("_q"), below("p", ranged).alias("p0"), below("n", ranged).alias("n0"), F.sum("p").over(whole).alias("P"), F.sum("n").over(whole).alias("N"))
    inside = W.partitionBy(*by, "_part").orderBy("_s")
    placed = parted.select("*", below("_pos", inside).alias("p1"), below("_neg", inside).alias("n1"))
    same = _same(by) & F.col("_part").eqNullSafe(F.col("_q"))
    ranges = placed.join(before, same).withColumns({"pos_below": F.col("p0") + F.col("p1"), "neg_below": F.col("n0") + F.col("n1")}).drop("_part", "_q", "p0", "n0", "p1", "n1", *[f"_by{k}" for k in range(len(by))])
    return windows(counts.join(few, _same(by), "left_anti")).unionByName(ranges)


def _cumulated(counts: DataFrame, by: list[str], parts: int = 64) -> DataFrame:
    """counts with pos_from and neg_from (sums over scores at or above), pos_below, neg_below, and totals P and N."""
    counts = stored(counts, "score-counts")  # it is read several times
    if by:
        out = _grouped_sums(counts, by, parts)
    else:
        cuts = counts.agg(F.percentile_approx("_s", [k / parts for k in range(1, parts)], 10_000).alias("c")).first()["c"] or []
        part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("_s"))) if cuts else F.lit(0)
        parted = counts.withColumn("_part", part)
        sums = parted.groupBy("_part").agg(F.sum("_pos").alias("p"), F.sum("_neg").alias("n"))  # one row a part
        up = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        whole = W.partitionBy()
        before = sums.select(F.col("_part").alias("_q"), F.coalesce(F.sum("p").over(up), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("n0"), F.sum("p").over(whole).alias("P"), F.sum("n").over(whole).alias("N"))
        inside = W.partitionBy("_part").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
        own = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
        placed = parted.select("*", own("_pos").alias("p1"), own("_neg").alias("n1"))
        # null-safe, as the optimizer would carry the part's expression over a plain equality, to where the score isn't
        out = placed.join(F.broadcast(before), F.col("_part").eqNullSafe(F.col("_q"))).withColumns({"pos_below": F.col("p0") + F.col("p1"), "neg_below": F.col("n0") + F.col("n1")}).drop("_part", "_q", "p0", "n0", "p1", "n1")
    return out.withColumns({"pos_from": F.col("P") - F.col("pos_below"), "neg_from": F.col("N") - F.col("neg_below")})


def rank_metrics(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """auc (ties count half), ap (step-wise, ties as one step), base_rate, n_pos, n_neg; auc and ap are null for one class. NaN and null scores are left out."""
    by = by or []
    counts = value_counts(df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))), score, label, by)
    c = _cumulated(counts, by)
    won = F.sum((F.col("neg_below") + F.col("_neg") / 2) * F.col("_pos"))
    precision = F.sum(F.col("_pos") * F.col("pos_from") / (F.col("pos_from") + F.col("neg_from")))
    sums = c.groupBy(*by).agg(won.alias("_won"), precision.alias("_prec"), F.max("P").alias("n_pos"), F.max("N").alias("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select(*by, F.when(both, F.col("_won") / F.col("n_pos") / F.col("n_neg")).alias("auc"), F.when(both, F.col("_prec") / F.col("n_pos")).alias("ap"), (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("base_rate"), "n_pos", "n_neg")


def macro(per_group: DataFrame, metric: str = "auc") -> DataFrame:
    """Mean, population and sample deviation, median of a metric over groups that define it; groups defined and skipped."""
    return per_group.agg(F.avg(metric).alias("macro"), F.stddev_pop(metric).alias("sd_pop"), F.stddev_samp(metric).alias("sd_samp"), F.median(metric).alias("median"), F.count(metric).alias("defined"), F.count_if(F.col(metric).isNull()).alias("skipped"))


def evaluation(df: DataFrame, score: str, label: str, by: str, cohort: DataFrame | None = None) -> DataFrame:
    """One row: pooled auc and ap of all rows, and their means over the groups of the cohort (all groups if none is given) that have both classes; groups defined and skipped."""
    pooled = rank_metrics(df, score, label).select(F.col("auc").alias("pooled_auc"), F.col("ap").alias("pooled_ap"))
    own = df if cohort is None else df.join(cohort.select(by).distinct(), by, "left_semi")
    means = rank_metrics(own, score, label, [by]).agg(F.avg("auc").alias("macro_auc"), F.avg("ap").alias("macro_ap"), F.count("auc").alias("defined"), F.count_if(F.col("auc").isNull()).alias("skipped"))
    return pooled.crossJoin(means)  # one row each


def paired_metric(df: DataFrame, first: str, second: str, label: str, by: str) -> DataFrame:
    """By group with both classes: the AUC of two scores, their difference, and the number of rows."""
    a, b = (rank_metrics(df, s, label, [by]).where("auc is not null").select(by, F.col("auc").alias(name)) for s, name in ((first, "first"), (second, "second")))
    return a.join(b, by).join(df.groupBy(by).agg(F.count("*").alias("n_rows")), by).withColumn("delta", F.col("first") - F.col("second"))


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, and precision, recall and F1 of both classes, their macro F1, accuracy; 0 for an empty denominator."""
    c = df.groupBy(*(by or [])).agg(*[F.count_if((predicted == p) & (actual == a)).alias(n) for n, p, a in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))])
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    f1 = lambda hit, extra, miss: _over(2 * hit, 2 * hit + extra + miss)
    return c.withColumns({"precision": _over(tp, tp + fp), "recall": _over(tp, tp + fn), "f1": f1(tp, fp, fn), "f1_neg": f1(tn, fn, fp), "macro_f1": (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2, "accuracy": _over(tp + tn, tp + fp + fn + tn)})


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold with the greatest F1 among the distinct scores; the lowest of equals."""
    c = _cumulated(value_counts(df, score, label, []), [])
    f1 = 2 * F.col("pos_from") / (F.col("P") + F.col("pos_from") + F.col("neg_from"))
    return c.agg(F.max_by(F.struct(F.col("_s").alias("threshold"), f1.alias("f1")), F.struct(F.round(f1, 12), -F.col("_s"))).alias("b")).select("b.*")


def calibration(df: DataFrame, p: Column, label: Column, bins: int = 10, edge: float = 1e-6) -> DataFrame:
    """Brier score, log loss and expected calibration error over equal bins, of probabilities kept ``edge`` away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    y = label.cast("double")
    per_bin = df.groupBy(F.floor(q * bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(q).alias("sp"), F.sum(y).alias("sy"), F.sum((q - y) * (q - y)).alias("b"), F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("l"))
    return per_bin.agg((F.sum("b") / F.sum("n")).alias("brier"), (F.sum("l") / F.sum("n")).alias("nll"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"))
