"""Forecasting models: closed-form ridge in one aggregation, logistic regression with calibration, per-ticker volatility fits, bootstraps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge coefficients on standardised features (returned for the raw ones) and intercept.

    All sums come from one aggregation over the data; the driver solves a system as large as the number of features.
    """
    cols = [*features, target]
    sums = df.dropna(subset=cols).agg(F.count(F.lit(1)), *[F.sum(c) for c in cols], *[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(cols) for b in cols[i:]]).first()
    n, k = sums[0], len(cols)
    if not n:
        raise ValueError("no complete rows to fit on")
    mean = np.array(sums[1 : 1 + k], float) / n
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = np.array(sums[1 + k :], float)
    cov = np.triu(full) + np.triu(full, 1).T - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1] / n, 1e-300))
    scale[scale < 1e-12] = 1.0
    z = cov[:-1, :-1] / np.outer(scale, scale)
    beta = np.linalg.solve(z + alpha * np.eye(k - 1), cov[:-1, -1] / scale) / scale
    return beta, float(mean[-1] - beta @ mean[:-1])


def ridge_predict(df: DataFrame, features: list[str], fit: tuple[np.ndarray, float], name: str = "forecast", floor: float | None = None) -> DataFrame:
    value = F.lit(fit[1])
    for c, b in zip(features, fit[0]):
        value = value + F.col(c) * F.lit(float(b))
    return df.withColumn(name, F.greatest(value, F.lit(floor)) if floor is not None else value)


def logistic(df: DataFrame, features: list[str], label: str, *, balanced: bool = True, reg: float = 1e-4):
    """Logistic regression on complete rows, with class weights that make both classes count alike."""
    rows = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df).withColumn("__y", F.col(label).cast("double"))
    if balanced:
        n = rows.agg(F.avg("__y")).first()[0]
        if n is None or n in (0.0, 1.0):
            raise ValueError("both classes are needed")
        rows = rows.withColumn("__w", F.when(F.col("__y") == 1, 0.5 / n).otherwise(0.5 / (1 - n)))
        return LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=reg).fit(rows)
    return LogisticRegression(featuresCol="__x", labelCol="__y", regParam=reg).fit(rows)


def logistic_scores(model, df: DataFrame, features: list[str], name: str = "proba") -> DataFrame:
    rows = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df)
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")


def calibrated(fit_on: DataFrame, apply_to: DataFrame, score: str, label: str) -> DataFrame:
    """Platt- and isotonic-calibrated scores, fitted on one frame and applied to another."""
    platt = logistic(fit_on, [score], label, balanced=False, reg=0.0)
    out = logistic_scores(platt, apply_to, [score], "platt")
    iso = IsotonicRegression(featuresCol=score, labelCol="__y").fit(fit_on.withColumn("__y", F.col(label).cast("double")))
    return iso.transform(out).withColumnRenamed("prediction", "isotonic")


def _garch_path(r2: np.ndarray, p: np.ndarray, start: float) -> np.ndarray:
    s = np.empty(len(r2) + 1)
    s[0] = start
    for i, x in enumerate(r2):
        s[i + 1] = p[0] + p[1] * x + p[2] * s[i]
    return s


def garch_fit(r: np.ndarray, rounds: int = 60) -> np.ndarray | None:
    """(omega, alpha, beta) of a GARCH(1,1) by variance-targeted coordinate search; null where it fails.

    Omega is set so that the long-run variance is the sample's, which leaves two parameters in a triangle.
    """
    v = r.var()
    if len(r) < 60 or not np.isfinite(v) or v <= 1e-16:
        return None
    r2 = (r - r.mean()) ** 2

    def loss(a: float, b: float) -> float:
        s = _garch_path(r2, np.array([v * (1 - a - b), a, b]), v)[:-1]
        return float(np.sum(np.log(s) + r2 / s))

    a, b, step = 0.08, 0.88, 0.08
    best = loss(a, b)
    for _ in range(rounds):
        moved = False
        for da, db in ((step, 0), (-step, 0), (0, step), (0, -step), (step, -step), (-step, step)):
            x, y = a + da, b + db
            if x >= 0 and y >= 0 and x + y < 0.999 and (f := loss(x, y)) < best - 1e-9:
                a, b, best, moved = x, y, f, True
        if not moved:
            step /= 2
            if step < 1e-3:
                break
    return np.array([v * (1 - a - b), a, b])


def volatility_forecasts(returns: DataFrame, *, window: int = 252, horizon: int = 5) -> DataFrame:
    """Per ticker, from its last ``window`` log returns: GARCH mean variance over the horizon, with the naive one as fallback,
    the filtered-history 5 per cent quantile of the summed return, and a symmetric-absolute-value CAViaR quantile.

    One Arrow group per ticker; the group is cut to ``window`` rows by a window function before it is sent.
    """
    from pyspark.sql import Window

    last = returns.where("lret is not null").withColumn("__k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("__k") <= window).select("ticker", "date", "lret")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("date")["lret"].to_numpy(float)
        naive = r[-5:].var(ddof=1) if len(r) >= 5 else np.nan
        p = garch_fit(r)
        if p is None:
            return pd.DataFrame([(pdf["ticker"].iloc[0], len(r), naive, True, None, None)], columns=["ticker", "n", "variance", "fallback", "hs_q05", "caviar_q05"])
        s = _garch_path((r - r.mean()) ** 2, p, r.var())
        path, x = [], s[-1]
        for _ in range(horizon):
            path.append(x)
            x = p[0] + (p[1] + p[2]) * x
        z = (r - r.mean()) / np.sqrt(s[:-1])
        draws = np.random.default_rng(7).choice(z, (2000, horizon)) * np.sqrt(np.array(path))
        q = np.quantile(draws.sum(axis=1), 0.05)
        return pd.DataFrame([(pdf["ticker"].iloc[0], len(r), float(np.mean(path)), False, float(q), caviar_fit(r, 0.05))], columns=["ticker", "n", "variance", "fallback", "hs_q05", "caviar_q05"])

    return last.groupBy("ticker").applyInPandas(fit, "ticker string, n int, variance double, fallback boolean, hs_q05 double, caviar_q05 double")


def caviar_fit(r: np.ndarray, tau: float) -> float:
    """Next-day quantile of a CAViaR recursion q' = b0 + b1 q + b2 |r|, by a coarse grid refined once."""
    start = float(np.quantile(r[:60], tau))

    def run(b: tuple[float, float, float]) -> tuple[float, float]:
        q, loss = start, 0.0
        for x in r:
            gap = x - q
            loss += tau * gap if gap >= 0 else (tau - 1) * gap
            q = b[0] + b[1] * q + b[2] * abs(x)
        return loss, q

    base = abs(start)
    best = min((run((-base * (1 - b1) * k, b1, -b2)) for b1 in (0.0, 0.5, 0.8, 0.9) for b2 in (0.0, 0.1, 0.3, 0.6) for k in (0.5, 1.0)), key=lambda t: t[0])
    return float(best[1])


def bootstrap_sharpe_difference(daily: pd.DataFrame, a: str, b: str, draws: int = 5000, seed: int = 7) -> tuple[float, float, float]:
    """Difference of yearly Sharpe ratios of two daily series, with a 95 per cent interval (paired resampling of days)."""
    x = daily[[a, b]].to_numpy(float)
    r = np.random.default_rng(seed)
    sharpe = lambda m: m.mean(axis=-2) / m.std(axis=-2, ddof=1) * np.sqrt(252)
    d = np.array([np.subtract(*sharpe(x[r.integers(0, len(x), len(x))])) for _ in range(draws)])
    return float(np.subtract(*sharpe(x))), float(np.quantile(d, 0.025)), float(np.quantile(d, 0.975))


def model_confidence_set(losses: pd.DataFrame, level: float = 0.1, draws: int = 1000, block: int = 5, seed: int = 7) -> list[str]:
    """Models not worse than the best: worst ones leave while a stationary block bootstrap of the range statistic rejects equality."""
    if losses.isna().any().any():
        raise ValueError("losses must not be missing")
    r, names = np.random.default_rng(seed), list(losses.columns)
    x = losses.to_numpy(float)
    n = len(x)
    starts = r.integers(0, n, (draws, n))
    fresh = r.random((draws, n)) < 1 / block
    index = np.empty((draws, n), int)
    index[:, 0] = starts[:, 0]
    for t in range(1, n):
        index[:, t] = np.where(fresh[:, t], starts[:, t], (index[:, t - 1] + 1) % n)
    means = np.stack([x[i].mean(axis=0) for i in index])
    keep = list(range(len(names)))
    while len(keep) > 1:
        m = x[:, keep].mean(axis=0)
        gap = m - m.mean()
        boot = means[:, keep] - means[:, keep].mean(axis=1, keepdims=True) - gap
        sd = boot.std(axis=0) + 1e-12
        if (np.abs(boot / sd).max(axis=1) >= np.abs(gap / sd).max()).mean() > level:
            break
        keep.pop(int(np.argmax(gap / sd)))
    return [names[k] for k in keep]
