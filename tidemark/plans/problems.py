"""Queries of the training-data problems that belong to the core (1 to 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.readings import Field, ReadingLimits, implausible_fields
from tidemark.operators.rolling import rolling_totals
from tidemark.operators.versions import attributes_as_known
from tidemark.session import table

CLOSE_LIMITS = ReadingLimits(spike=5.8, floor=0.05, edge=1.0)
# Volumes swing widely from day to day and on news; a wrong one is off by a large factor.
VOLUME_LIMITS = ReadingLimits(spike=5.7, floor=3.0, edge=3.5)


def p1_readings(spark: SparkSession, d: str) -> DataFrame:
    prices = table(spark, d, "prices_daily").select("price_id", "ticker", "date", "close", "volume")
    traded = F.coalesce(F.col("volume") != 0, F.lit(True))
    fields = [Field("close", active=traded, limits=CLOSE_LIMITS), Field("volume", lowest_ok=True, limits=VOLUME_LIMITS)]
    return implausible_fields(prices, source="ticker", position="date", fields=fields).select("price_id", "ticker", "bad_field", "reason")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_readings(spark, d).select("price_id", "bad_field")


def _known_prices(spark: SparkSession, d: str) -> DataFrame:
    news = table(spark, d, "news_raw").select("news_id", "ticker", "published_at")
    prices = table(spark, d, "prices_daily").where("close is not null").select("price_id", "ticker", "date", "close", "loaded_at")
    return attributes_as_known(
        news,
        prices,
        event_entity="ticker",
        event_time="published_at",
        entity="ticker",
        available=F.greatest(F.col("loaded_at"), F.date_add("date", 1).cast("timestamp")),
        rank=[F.col("date"), F.col("loaded_at"), -F.col("price_id")],
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _known_prices(spark, d).select("news_id", "price_id")


def p2_close_as_known(spark: SparkSession, d: str) -> DataFrame:
    return _known_prices(spark, d).select("news_id", "ticker", F.date_format("date", "yyyy-MM-dd").alias("price_day"), "close")


def _latest_prices(spark: SparkSession, d: str) -> DataFrame:
    """The revision of each (ticker, date) loaded last; ties go to the lowest price_id."""
    best = F.max_by(F.struct("close", "volume"), F.struct("loaded_at", -F.col("price_id")))
    return table(spark, d, "prices_daily").groupBy("ticker", "date").agg(best.alias("v")).select("ticker", "date", "v.*")


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = rolling_totals(_latest_prices(spark, d), entity="ticker", day="date", measures={"close": F.col("close"), "volume": F.col("volume")})
    avg = lambda m, w: F.when(F.col(f"{m}_n_{w}") > 0, F.round(F.col(f"{m}_sum_{w}") / F.col(f"{m}_n_{w}"), 4)).alias(f"{m}_avg_{w}")
    return r.select(
        "ticker",
        F.date_format("date", "yyyy-MM-dd").alias("cal_day"),
        *[x for m in ("close", "volume") for w in (7, 30) for x in (F.round(f"{m}_sum_{w}", 4).alias(f"{m}_sum_{w}"), avg(m, w))],
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    prices = table(spark, d, "prices_daily").select("ticker", "date", "close", "volume")
    traded = F.when(F.col("close").isNotNull() & (F.col("volume") > 0), F.lit(1))
    r = rolling_totals(prices, entity="ticker", day="date", measures={"traded": traded}, windows=(7,))
    return r.where("traded_n_7 = 0").select("ticker", F.date_format("date", "yyyy-MM-dd").alias("cal_day"))


QUERIES = {
    "p1_found": p1_found,
    "p1_readings": p1_readings,
    "p2_found": p2_found,
    "p2_close_as_known": p2_close_as_known,
    "p3_found": p3_found,
    "p3_rolling": p3_rolling,
}

_P2 = """
SELECT {cols} FROM (
  SELECT n.news_id, n.ticker, p.price_id, p.date, p.close,
         row_number() OVER (PARTITION BY n.news_id ORDER BY p.date DESC, p.loaded_at DESC, p.price_id) AS rn
  FROM news_raw n JOIN prices_daily p
    ON p.ticker = n.ticker AND p.close IS NOT NULL
   AND p.date < CAST(n.published_at AT TIME ZONE 'UTC' AS DATE)
   AND p.date >= CAST(n.published_at AT TIME ZONE 'UTC' AS DATE) - INTERVAL 400 DAY
   AND p.loaded_at <= n.published_at
) WHERE rn = 1"""

_P3 = """
WITH latest AS (
  SELECT ticker, date, close, volume FROM (
    SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY loaded_at DESC, price_id) AS rn FROM prices_daily
    WHERE ticker IS NOT NULL AND date IS NOT NULL) WHERE rn = 1
), span AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM latest GROUP BY ticker),
cal AS (SELECT ticker, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span),
full_line AS (SELECT c.ticker, c.day, l.close, l.volume FROM cal c LEFT JOIN latest l ON l.ticker = c.ticker AND l.date = c.day)
SELECT ticker, strftime(day, '%Y-%m-%d') AS cal_day,
  {cols}
FROM full_line
WINDOW w7 AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""

ORACLE = {
    "p2_found": _P2.format(cols="news_id, price_id"),
    "p2_close_as_known": _P2.format(cols="news_id, ticker, strftime(date, '%Y-%m-%d') AS price_day, close"),
    "p3_rolling": _P3.format(
        cols=", ".join(
            f"round(coalesce(sum({m}) OVER w{w}, 0), 4) AS {m}_sum_{w}, round(avg({m}) OVER w{w}, 4) AS {m}_avg_{w}" for m in ("close", "volume") for w in (7, 30)
        )
    ),
    "p3_found": """
WITH per_day AS (SELECT ticker, date, max(CASE WHEN close IS NOT NULL AND volume > 0 THEN 1 ELSE 0 END) AS traded
  FROM prices_daily WHERE ticker IS NOT NULL AND date IS NOT NULL GROUP BY ticker, date),
span AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM per_day GROUP BY ticker),
cal AS (SELECT ticker, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span)
SELECT ticker, cal_day FROM (
  SELECT c.ticker, strftime(c.day, '%Y-%m-%d') AS cal_day,
    sum(coalesce(p.traded, 0)) OVER (PARTITION BY c.ticker ORDER BY c.day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS n
  FROM cal c LEFT JOIN per_day p ON p.ticker = c.ticker AND p.date = c.day) WHERE n = 0""",
}
