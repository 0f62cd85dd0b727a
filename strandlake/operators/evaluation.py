"""Evaluation: average precision, rank and eps-guarded correlations, confusion measures, losses over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates as A


def average_precision(scores: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Step-wise average precision of each group; equal scores are one step, so windows see distinct scores only."""
    steps = scores.groupBy(*by, score).agg(F.sum(positive.cast("long")).alias("tp"), F.count("*").alias("n"))
    run = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    cum = steps.withColumns({"ctp": F.sum("tp").over(run), "cn": F.sum("n").over(run)})
    return cum.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")), F.sum("tp")), F.lit(0.0)).alias("ap"), F.sum("tp").alias("positives"))


def profile_pearson(df: DataFrame, region: str, track: str, x: str, y: str) -> DataFrame:
    """Correlation along positions, per region and track."""
    return df.groupBy(region, track).agg(A.pearson(x, y).alias("r"))


def count_pearson(df: DataFrame, region: str, track: str, x: str, y: str) -> DataFrame:
    """Correlation of totals over regions, per track; NULL for a single region."""
    totals = df.groupBy(region, track).agg(F.sum(F.col(x).cast("double")).alias("sx"), F.sum(F.col(y).cast("double")).alias("sy"))
    return totals.groupBy(track).agg(F.when(F.count("*") > 1, A.pearson("sx", "sy")).alias("r"))


def ordinal_spearman(df: DataFrame, by: list[str], position: str, x: str, y: str) -> DataFrame:
    """Rank correlation where ties keep the order of positions."""
    w = Window.partitionBy(*by)
    ranks = df.withColumns({"_x": F.row_number().over(w.orderBy(x, position)), "_y": F.row_number().over(w.orderBy(y, position))})
    return ranks.groupBy(*by).agg(A.pearson("_x", "_y").alias("r"))


def average_spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation where ties share their mean rank."""

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2

    return df.withColumns({"_x": rank(x), "_y": rank(y)}).groupBy(*by).agg(A.pearson("_x", "_y").alias("r"))


def usage_pearson(df: DataFrame, by: list[str], x: str, y: str, least: int = 2, least_std: float = 1e-8) -> DataFrame:
    """Correlation per group with enough rows and spread; other groups have no row."""
    stats = df.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"), A.pearson(x, y, 0.0 + 1e-300).alias("r"))
    return stats.filter((F.col("n") >= least) & (F.col("_sx") >= least_std) & (F.col("_sy") >= least_std)).drop("_sx", "_sy")


def summarize(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.count(value).alias("n"))


def argmax_class(probs: str) -> Column:
    """The first position of the largest value of an array."""
    return (F.array_position(F.col(probs), F.array_max(probs)) - 1).cast("int")


def accuracy(df: DataFrame, by: list[str], predicted: str, label: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts over a grid; the highest value belongs to the last cell, values outside have none."""
    cell = lambda c: F.least(F.floor((F.col(c) - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")
    inside = (F.col(x) >= low) & (F.col(x) <= high) & (F.col(y) >= low) & (F.col(y) <= high)
    return df.filter(inside).groupBy(cell(x).alias("bx"), cell(y).alias("by")).agg(F.count("*").alias("n"))


def nonzero_means(df: DataFrame, track: str, value: str) -> DataFrame:
    """Mean of the values that aren't 0, 1 where there are none."""
    return df.groupBy(track).agg(F.coalesce(F.avg(F.when(F.col(value) != 0, F.col(value))), F.lit(1.0)).alias("nonzero_mean"))


def multinomial_loss(df: DataFrame, by: list[str], position: str, predicted: str, true: str, segment: int, count_weight: float = 1.0, positional_weight: float = 1.0) -> DataFrame:
    """Poisson loss of segment totals and cross entropy within segments: loss, loss_total, loss_positional, max_sum_preds, max_preds, max_targets."""
    seg = F.floor(F.col(position) / segment)
    rows = df.withColumns({"_s": seg, "_t": F.greatest(F.col(true).cast("double"), F.lit(0.0)), "_p": F.col(predicted).cast("double")})
    totals = rows.groupBy(*by, "_s").agg(F.sum("_p").alias("tp"), F.sum("_t").alias("tt"), F.count("*").alias("n"), F.collect_list(F.struct("_p", "_t")).alias("rows"))
    term = F.aggregate("rows", F.lit(0.0), lambda s, r: s - r["_t"] * F.ln(r["_p"] / (F.col("tp") + 1e-7) + 1e-7))
    flat = totals.withColumns({"count_loss": A.poisson_term("tp", "tt"), "pos_loss": term, "mp": F.aggregate("rows", F.lit(0.0), lambda s, r: F.greatest(s, r["_p"])), "mt": F.aggregate("rows", F.lit(0.0), lambda s, r: F.greatest(s, r["_t"]))})
    out = flat.agg((F.avg("count_loss") / segment).alias("loss_total"), (F.sum("pos_loss") / F.sum("n")).alias("loss_positional"), F.max("tp").alias("max_sum_preds"), F.max("mp").alias("max_preds"), F.max("mt").alias("max_targets"))
    return out.select((count_weight * F.col("loss_total") + positional_weight * F.col("loss_positional")).alias("loss"), "*")


def cross_entropy_from_logits(df: DataFrame, example: str, logit: str, target: str) -> DataFrame:
    """Mean over examples of the cross entropy of targets with the softmax of logits."""
    top = df.groupBy(example).agg(F.max(logit).alias("_m"))
    each = df.join(top, example).groupBy(example).agg((F.ln(F.sum(F.exp(F.col(logit) - F.col("_m")))) + F.first("_m")).alias("lse"), F.sum(target).alias("st"), F.sum(F.col(target) * F.col(logit)).alias("sl"))
    return each.agg(F.avg(F.col("st") * F.col("lse") - F.col("sl")).alias("loss"))


def cross_entropy_counts(df: DataFrame, example: str, predicted: str, true: str, eps: float = 1e-7) -> DataFrame:
    """Mean over examples of the cross entropy of true with predicted shares of counts."""
    sums = df.groupBy(example).agg(F.sum(predicted).alias("sp"), F.sum(true).alias("st"))
    share = df.join(sums, example)
    term = -(F.col(true) / F.greatest(F.col("st"), F.lit(eps))) * F.ln(F.col(predicted) / F.greatest(F.col("sp"), F.lit(eps)) + eps)
    return share.groupBy(example).agg(F.sum(term).alias("l")).agg(F.avg("l").alias("loss"))


def similarity_report(df: DataFrame, x: str, y: str) -> DataFrame:
    """Cosine similarity, largest and mean difference, largest relative difference."""
    d = F.abs(F.col(x) - F.col(y))
    return df.agg(A.cosine(x, y).alias("cosine"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), F.max(F.try_divide(d, F.abs(F.col(y)) + 1e-8)).alias("max_rel"))


def head_metrics(df: DataFrame, head: str, region: str, track: str, x: str, y: str, **metrics: Column) -> DataFrame:
    """Per head the mean of its tracks' profile and count correlations, and of further ``metrics``.

    A metric is an aggregate expression over the rows of one region and track, as ``F.max(F.abs(F.col(x) - F.col(y)))``; one that is not
    raises when the query is analysed. NULL correlations, as counts of a single region, take no part in a mean.
    """
    for name in metrics:
        if name in (head, region, track, "profile_r", "count_r", "_sx", "_sy"):
            raise ValueError(f"a metric cannot be named {name!r}")
    sums = [F.sum(F.col(c).cast("double")).alias(n) for c, n in ((x, "_sx"), (y, "_sy"))]
    each = df.groupBy(head, region, track).agg(A.pearson(x, y).alias("profile_r"), *sums, *(m.alias(name) for name, m in metrics.items()))
    tracks = each.groupBy(head, track).agg(F.avg("profile_r").alias("profile_r"), F.when(F.count("*") > 1, A.pearson("_sx", "_sy")).alias("count_r"), *(F.avg(name).alias(name) for name in metrics))
    return tracks.groupBy(head).agg(*(F.avg(c).alias(c) for c in ("profile_r", "count_r", *metrics)))


def accumulated_pairs(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Per condition (and source) the number of pairs and the sums that correlations need; partial results add up."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))


def tissue_of(condition: str) -> Column:
    """A condition's name without the part after its last underscore."""
    return F.regexp_replace(condition, "_[^_]*$", "")


def tissue_rollup(df: DataFrame, condition: str, value: str) -> DataFrame:
    """Conditions rolled up to tissues: tissue, n, mean."""
    return df.groupBy(tissue_of(condition).alias("tissue")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def splice_loss(df: DataFrame, probability: str, label: str, weight: Column, by: list[str], eps: float = 1e-3) -> DataFrame:
    """Weighted cross entropy of a probability, and the accuracy at one half, per group; ``label`` is 0 or 1."""
    term = weight * -F.ln(F.col(probability) + eps)
    right = ((F.col(probability) >= 0.5) == (F.col(label) == 1)).cast("double")
    return df.groupBy(*by).agg((F.sum(term) / F.sum(weight)).alias("loss"), F.avg(right).alias("accuracy"))


def reduced_means(df: DataFrame, rank: Column, by: list[str], value: str) -> DataFrame:
    """The mean over ranks of each rank's mean, as data-parallel workers reduce their metrics."""
    return df.groupBy(rank.alias("_rank"), *by).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("mean"))


def timing_summary(df: DataFrame, section: str, seconds: str) -> DataFrame:
    """Mean, deviation, total and share of the time of each section; sections are few, so one window sums their totals."""
    rows = df.groupBy(section).agg(F.avg(seconds).alias("mean"), F.stddev_pop(seconds).alias("std"), F.sum(seconds).alias("total"))
    return rows.withColumn("pct", 100 * F.col("total") / F.sum("total").over(Window.partitionBy()))


def cumulative_positives(df: DataFrame, score: str, positive: str, steps: int = 1 << 12) -> DataFrame:
    """Per distinct score the positives and the rows at or above it: ctp, cn. Scores lie in [0, 1], cut into ``steps`` blocks."""
    from .windows import running_totals

    each = df.groupBy(score).agg(F.sum(positive).alias("tp"), F.count("*").alias("n"))
    run = running_totals(each, -F.floor(F.col(score) * steps), [F.desc(score)], "tp", "n")
    return run.select(score, F.col("run_tp").alias("ctp"), F.col("run_n").alias("cn"))


def best_gene_scores(scores: DataFrame, gene: str, value: str, wanted: list[str]) -> DataFrame:
    """The largest value of each wanted gene, found by id without version."""
    from ..functions.coords import without_version

    keyed = scores.withColumn("gene_key", without_version(gene))
    return keyed.filter(F.col("gene_key").isin(*wanted)).groupBy("gene_key").agg(F.max(value).alias("best"))
