"""Returns, forward targets and trailing indicators of a price panel (one row per ticker and date).

All are windows over (ticker, date), so one sort serves them all; a window shorter than required
gives null, nothing is filled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line():
    """The window specification all series share."""
    return Window.partitionBy("ticker").orderBy("date")


def full(value: Column, over: str | Column, n: int, frame) -> Column:
    """``value`` over a frame, only where the frame holds ``n`` non-null entries."""
    return F.when(F.count(over).over(frame) >= n, value.over(frame))


def back(n: int, skip: int = 0):
    """The last ``n`` rows, ending ``skip`` rows ago."""
    return line().rowsBetween(-n + 1 - skip, -skip)


def ahead(n: int):
    return line().rowsBetween(1, n)


def with_returns(panel: DataFrame) -> DataFrame:
    """Simple and log return of a day on the ticker's previous trading day."""
    before = F.lag("close").over(line())
    return panel.withColumns({"ret": F.col("close") / before - 1, "lret": F.log("close") - F.log(before)})


def market_leg(returns: DataFrame, benchmark: str | None = None) -> DataFrame:
    """Market return per date: the benchmark's where it traded, else the equal-weight mean of all others."""
    other = F.lit(True) if benchmark is None else F.col("ticker") != benchmark
    own = F.lit(None).cast("double") if benchmark is None else F.max(F.when(F.col("ticker") == benchmark, F.col("ret")))
    return returns.groupBy("date").agg(F.coalesce(own, F.avg(F.when(other, F.col("ret")))).alias("mkt"))


def forward_compound(ret: str, n: int) -> Column:
    """Compounded return over the next ``n`` rows, null unless all are there."""
    return F.when(F.count(ret).over(ahead(n)) == n, F.product(1 + F.col(ret)).over(ahead(n)) - 1)


def forward_vol(lret: str, n: int) -> Column:
    return full(F.stddev_samp(lret), lret, n, ahead(n))


def momentum(n: int) -> Column:
    return F.col("close") / F.lag("close", n).over(line()) - 1


def trailing_vol(ret: str, n: int) -> Column:
    return full(F.stddev_samp(ret), ret, n, back(n))


def share_at_or_below(value: str, window: int, least: int) -> Column:
    """Part of the value's own history (it excluded) in the last ``window`` rows that is at or below it; needs ``least`` valid rows."""
    past = F.collect_list(value).over(line().rowsBetween(-window + 1, -1))
    return F.when(F.col(value).isNotNull() & (F.size(past) + 1 >= least), F.size(F.filter(past, lambda x: x <= F.col(value))) / F.size(past))


def moving_average_distance(n: int) -> Column:
    mean = full(F.avg("close"), "close", n, back(n))
    return F.when(mean > 0, F.col("close") / mean - 1)


def volume_z(n: int) -> Column:
    sd = full(F.stddev_samp("volume"), "volume", n, back(n))
    return F.when(sd == 0, 0.0).otherwise((F.col("volume") - F.avg("volume").over(back(n))) / sd)


def relative_volume(n: int) -> Column:
    mid = full(F.percentile("volume", 0.5), "volume", n, back(n))
    return F.when(mid > 0, F.col("volume") / mid)


def parkinson() -> Column:
    return F.pow(F.log(F.col("high") / F.col("low")), 2) / (4 * math.log(2))


def beta(y: str, x: str, window: int, least: int, otherwise: float = 1.0) -> Column:
    """Trailing regression slope; ``otherwise`` where fewer than ``least`` pairs stand in the window."""
    frame = back(window)
    return F.when(F.regr_count(y, x).over(frame) >= least, F.regr_slope(y, x).over(frame)).otherwise(F.lit(otherwise))


def wilder_rsi(panel: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's RSI: seeded by the mean of the first ``n`` moves, first value at bar ``n``; 100 without losses, 50 without moves.

    A recursion over the days of one ticker, run by a higher-order function in the JVM; the array is bounded by the calendar.
    """
    moves = panel.withColumn("move", F.col("close") - F.lag("close").over(line())).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "move"))).alias("d"))
    zero = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("l"), F.lit(0).alias("i"), F.array().cast("array<struct<date:date,rsi:double>>").alias("out"))

    def step(s, x):
        gain, loss = F.greatest(x["move"], F.lit(0.0)), F.greatest(-x["move"], F.lit(0.0))
        # Up to bar n the state holds sums, from then on smoothed means.
        g = F.when(s["i"] < n, s["g"] + gain).when(s["i"] == n, (s["g"] + gain) / n).otherwise((s["g"] * (n - 1) + gain) / n)
        l = F.when(s["i"] < n, s["l"] + loss).when(s["i"] == n, (s["l"] + loss) / n).otherwise((s["l"] * (n - 1) + loss) / n)
        start = x["move"].isNull()
        g, l = F.when(start, s["g"]).otherwise(g), F.when(start, s["l"]).otherwise(l)
        rsi = F.when(s["i"] >= n, F.when(l == 0, F.when(g > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + g / l)))
        return F.struct(g.alias("g"), l.alias("l"), (s["i"] + 1).alias("i"), F.concat(s["out"], F.array(F.struct(x["date"].alias("date"), rsi.alias("rsi")))).alias("out"))

    return moves.select("ticker", F.explode(F.aggregate("d", zero, step, lambda s: s["out"])).alias("o")).select("ticker", "o.date", "o.rsi")


def wilder_atr(panel: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's average true range over close: seeded by the mean of the first ``n`` ranges, first value at bar ``n - 1``."""
    before = F.lag("close").over(line())
    range_ = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    rows = panel.withColumn("tr", F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(range_)).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "tr", "close"))).alias("d"))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0).alias("i"), F.array().cast("array<struct<date:date,atr:double>>").alias("out"))

    def step(s, x):
        a = F.when(s["i"] < n - 1, s["a"] + x["tr"]).when(s["i"] == n - 1, (s["a"] + x["tr"]) / n).otherwise((s["a"] * (n - 1) + x["tr"]) / n)
        return F.struct(a.alias("a"), (s["i"] + 1).alias("i"), F.concat(s["out"], F.array(F.struct(x["date"].alias("date"), F.when(s["i"] >= n - 1, a / x["close"]).alias("atr")))).alias("out"))

    return rows.select("ticker", F.explode(F.aggregate("d", zero, step, lambda s: s["out"])).alias("o")).select("ticker", "o.date", "o.atr")


def macd_histogram(panel: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, warm: int = 34) -> DataFrame:
    """MACD line minus its signal line, exponential means started at the first value; null before bar ``warm``."""
    rows = panel.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("d"))
    zero = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("s"), F.lit(0.0).alias("g"), F.lit(0).alias("i"), F.array().cast("array<struct<date:date,hist:double>>").alias("out"))
    mean = lambda old, new, n, i: F.when(i == 0, new).otherwise(old + (new - old) * (2.0 / (n + 1)))

    def step(s, x):
        f, w = mean(s["f"], x["close"], fast, s["i"]), mean(s["s"], x["close"], slow, s["i"])
        g = mean(s["g"], f - w, signal, s["i"])
        hist = F.when(s["i"] >= warm, f - w - g)
        return F.struct(f.alias("f"), w.alias("s"), g.alias("g"), (s["i"] + 1).alias("i"), F.concat(s["out"], F.array(F.struct(x["date"].alias("date"), hist.alias("hist")))).alias("out"))

    return rows.select("ticker", F.explode(F.aggregate("d", zero, step, lambda s: s["out"])).alias("o")).select("ticker", "o.date", "o.hist")
