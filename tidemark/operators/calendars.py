"""Trading calendars and as-of lookups on them.

As-of joins on daily prices are equi-joins: :func:`day_map` gives, per ticker and calendar day, the
nearest trading days around it.  The map is as large as the calendar, whatever the number of
events, and an equi-join lets adaptive execution split a hot ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_panel(prices: DataFrame, *, revision: str = "loaded_at", id: str = "price_id", most_volume: float = 1e10) -> DataFrame:
    """One row per (ticker, date) with a positive close: the latest revision, ties to the lowest id.

    Volumes below 0 or above ``most_volume`` are no volumes and become null.
    """
    volume = F.when(F.col("volume").between(0, most_volume), F.col("volume")).alias("volume")
    best = F.max_by(F.struct("open", "high", "low", "close", volume), F.struct(revision, -F.col(id)))
    return prices.where("close > 0 and ticker is not null and date is not null").groupBy("ticker", "date").agg(best.alias("v")).select("ticker", "date", "v.*")


def positions(panel: DataFrame) -> DataFrame:
    """Trading-day position of every row in its ticker's own calendar, from 0."""
    return panel.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1)


def union_calendar(panel: DataFrame) -> DataFrame:
    """All dates on which any ticker traded, with their positions."""
    return panel.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def day_map(panel: DataFrame, pad: int = 40) -> DataFrame:
    """Per ticker and calendar day (from ``pad`` days before its first to ``pad`` after the panel's last date):
    the trading days at or before, before, at or after and after it."""
    last = panel.agg(F.max("date").alias("end"))
    span = panel.groupBy("ticker").agg(F.min("date").alias("lo")).crossJoin(F.broadcast(last))  # one row
    days = span.select("ticker", F.explode(F.sequence(F.date_sub("lo", pad), F.date_add("end", pad))).alias("day"))
    marked = days.join(panel.select("ticker", F.col("date").alias("day"), F.col("date").alias("traded")), ["ticker", "day"], "left")
    line = Window.partitionBy("ticker").orderBy("day")
    at = lambda f, lo, hi: f("traded", ignorenulls=True).over(line.rowsBetween(lo, hi))
    first, end = Window.unboundedPreceding, Window.unboundedFollowing
    return marked.select(
        "ticker", "day",
        at(F.last, first, 0).alias("at_or_before"), at(F.last, first, -1).alias("before"),
        at(F.first, 0, end).alias("at_or_after"), at(F.first, 1, end).alias("after"),
    )


def as_of(events: DataFrame, panel: DataFrame, *, day: Column, how: str, name: str = "asof_day", pad: int = 40) -> DataFrame:
    """Add the trading day ``how`` (a column of :func:`day_map`) of each event's ticker and ``day``; null when there is none."""
    m = day_map(panel, pad).select(F.col("ticker").alias("__t"), F.col("day").alias("__d"), F.col(how).alias(name))
    keyed = events.withColumn("__day", day)
    return keyed.join(m, (F.col("ticker") == F.col("__t")) & (F.col("__day") == F.col("__d")), "left").drop("__t", "__d", "__day")


def session_day(ts: Column, zone: str = "America/New_York") -> tuple[Column, Column]:
    """Local day of a UTC instant and whether it lies before the session opens at 09:30 local time."""
    local = F.from_utc_timestamp(ts, zone)
    return F.to_date(local), (F.hour(local) * 60 + F.minute(local)) < 570


def session_t0(events: DataFrame, panel: DataFrame, *, time: str, name: str = "t0") -> DataFrame:
    """Trading day whose close an article can still move: before the open of a trading day the day before, else the latest day.

    Articles later than the calendar plus its margin, or before its first day, get null.
    """
    day, early = session_day(F.col(time))
    m = day_map(panel).select(F.col("ticker").alias("__t"), F.col("day").alias("__d"), "at_or_before", "before")
    keyed = events.withColumns({"__day": day, "__early": early})
    out = keyed.join(m, (F.col("ticker") == F.col("__t")) & (F.col("__day") == F.col("__d")), "left")
    return out.withColumn(name, F.when(F.col("__early"), F.col("before")).otherwise(F.col("at_or_before"))).drop("__t", "__d", "__day", "__early", "at_or_before", "before")


def plus_trading_days(events: DataFrame, panel: DataFrame, *, day: str, horizon: int, name: str = "t1") -> DataFrame:
    """The trading day ``horizon`` positions after ``day`` in the ticker's calendar, null past its end or off it."""
    line = Window.partitionBy("ticker").orderBy("date")
    ahead = panel.select(F.col("ticker").alias("__t"), F.col("date").alias("__d"), F.lead("date", horizon).over(line).alias(name))
    return events.join(ahead, (F.col("ticker") == F.col("__t")) & (F.col(day) == F.col("__d")), "left").drop("__t", "__d")
