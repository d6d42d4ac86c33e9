"""Metrics of scored records as grouped and windowed expressions: calibration, ranking, forecasting losses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reliability_bins(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Count, mean score and mean label per equal-width bin; the expected calibration error is their weighted gap."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("mean_label"))


def score_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """True and false positives at each distinct score, from the highest down.

    Rows are first added up per score, so the running sums see one row per distinct score.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    return per.select("s", "p", "n", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("seen"), F.sum("p").over(Window.partitionBy(F.lit(1))).alias("pos"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision (tied scores as one step), area under the ROC curve, Brier score: one row."""
    c = score_curve(df, score, label)
    ap = F.sum(F.col("p") / F.col("pos") * F.col("tp") / F.col("seen"))
    neg = F.col("n") - F.col("p")
    # Pairs ordered right: positives above each negative, ties half.
    right = F.sum(neg * (F.col("tp") - F.col("p") / 2)) / (F.max("pos") * (F.max("total") - F.max("pos")))
    brier = df.agg(F.avg(F.pow(F.col(score) - F.col(label).cast("double"), F.lit(2))).alias("brier"))
    return c.agg(ap.alias("pr_auc"), right.alias("roc_auc")).crossJoin(brier)  # one row each


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """Threshold with the highest F1 (the higher one of ties): one row."""
    c = score_curve(df, score, label).withColumn("f1", 2 * F.col("tp") / (F.col("seen") + F.col("pos")))
    return c.agg(F.max(F.struct(F.round("f1", 9).alias("f1"), "s")).alias("b")).select(F.col("b.s").alias("threshold"), F.col("b.f1").alias("f1"))


def abstention_curve(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Coverage and accuracy when only records with max(p, 1 - p) of at least each threshold are decided.

    One pass: the thresholds are exploded beside each row only after rows are grouped by confidence.
    """
    conf = F.greatest(F.col(score), 1 - F.col(score))
    right = ((F.col(score) >= 0.5).cast("int") == F.col(label).cast("int")).cast("bigint")
    per = df.groupBy(F.round(conf, 9).alias("conf")).agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("right"))
    grid = per.select("conf", "n", "right", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    kept = F.col("conf") >= F.col("threshold")
    return grid.groupBy("threshold").agg((F.sum(F.when(kept, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"), (F.sum(F.when(kept, F.col("right"))) / F.sum(F.when(kept, F.col("n")))).alias("accuracy"))


def average_rank(value: str, by: list[Column] | None = None) -> Column:
    """Rank with ties averaged, as Spearman's correlation needs it."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*(by or [F.lit(1)]), value)) - 1) / 2


def conformal_quantile(df: DataFrame, by: str, score: str, alpha: float) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score per group, at most the largest."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    k = F.least(F.ceil((n + 1) * (1 - alpha)), n)
    ranked = df.select(by, score, k.alias("k"), F.row_number().over(Window.partitionBy(by).orderBy(score)).alias("rn"))
    return ranked.where("rn = k").select(by, F.col(score).alias("quantile"))


def qlike(realised: str, forecast: str) -> Column:
    """Variance loss r - ln r - 1 with r = realised / forecast; null unless both are positive."""
    ratio = F.col(realised) / F.col(forecast)
    return F.when((F.col(realised) > 0) & (F.col(forecast) > 0), ratio - F.log(ratio) - 1)


def pinball(y: str, q: str, tau: float) -> Column:
    gap = F.col(y) - F.col(q)
    return F.greatest(tau * gap, (tau - 1) * gap)


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement and Cohen's kappa of two labels: one row."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    share = cells.select(a, b, (F.col("n") / total).alias("p"))
    rows = share.groupBy(F.col(a).alias("k")).agg(F.sum("p").alias("pa"))
    cols = share.groupBy(F.col(b).alias("k")).agg(F.sum("p").alias("pb"))
    chance = rows.join(cols, "k").agg(F.coalesce(F.sum(F.col("pa") * F.col("pb")), F.lit(0.0)).alias("pe"))
    agree = share.agg(F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("p"))), F.lit(0.0)).alias("po"))
    return agree.crossJoin(chance).select(F.col("po").alias("agreement"), ((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))  # one row each


def kupiec_christoffersen(hits: DataFrame, hit: str, order: str, by: str, p: float) -> DataFrame:
    """Likelihood ratios of unconditional coverage and of independence of hits, per group."""
    x = hits.select(by, F.col(hit).cast("int").alias("h"), F.lag(F.col(hit).cast("int")).over(Window.partitionBy(by).orderBy(order)).alias("b"))
    one = lambda c: F.sum(c.cast("bigint"))
    g = x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), one(F.col("h") == 1).alias("k"), *[F.coalesce(one((F.col("b") == i) & (F.col("h") == j)), F.lit(0)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
    xlog = lambda k, q: F.when(k > 0, k * F.log(q)).otherwise(0.0)
    rate = F.col("k") / F.col("n")
    uc = -2 * (xlog(F.col("k"), F.lit(p)) + xlog(F.col("n") - F.col("k"), F.lit(1 - p)) - xlog(F.col("k"), rate) - xlog(F.col("n") - F.col("k"), 1 - rate))
    zeros, ones = F.col("n00") + F.col("n01"), F.col("n10") + F.col("n11")
    p01, p11 = F.col("n01") / F.nullif(zeros, F.lit(0)), F.col("n11") / F.nullif(ones, F.lit(0))
    pi = (F.col("n01") + F.col("n11")) / F.nullif(zeros + ones, F.lit(0))
    part = lambda k, q: F.coalesce(F.when(k > 0, k * F.log(q)), F.lit(0.0))
    ind = -2 * (part(F.col("n00") + F.col("n10"), 1 - pi) + part(F.col("n01") + F.col("n11"), pi) - part(F.col("n00"), 1 - p01) - part(F.col("n01"), p01) - part(F.col("n10"), 1 - p11) - part(F.col("n11"), p11))
    return g.select(by, "n", "k", uc.alias("lr_uc"), ind.alias("lr_ind"))


def deflated_sharpe(returns: DataFrame, by: str, ret: str) -> DataFrame:
    """Per-period Sharpe ratio with the moments its deflation needs (population skew, Pearson kurtosis)."""
    return returns.groupBy(by).agg(F.count(ret).alias("n"), (F.avg(ret) / F.stddev_samp(ret)).alias("sharpe"), F.skewness(ret).alias("skew"), (F.kurtosis(ret) + 3).alias("kurt"))


def expected_max_sharpe(sd: float, trials: int) -> float:
    """Expected largest Sharpe ratio of ``trials`` worthless strategies whose ratios spread by ``sd``."""
    from statistics import NormalDist

    inv, e = NormalDist().inv_cdf, 0.5772156649015329
    return sd * ((1 - e) * inv(1 - 1 / trials) + e * inv(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
