"""Inputs and SQL fragments the reference queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.calendars import price_panel
from tidemark.operators.series import with_returns
from tidemark.session import table

DIGITS = 6
#: The benchmark leg of the reference's plans; here the ticker with the most rows on most days is not fixed, so the equal-weight mean stands in.
PANEL_SQL = """
panel AS (SELECT ticker, date, open, high, low, close, CASE WHEN volume BETWEEN 0 AND 1e10 THEN volume END AS volume FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY loaded_at DESC, price_id) AS rn
  FROM prices_daily WHERE close > 0 AND ticker IS NOT NULL AND date IS NOT NULL) WHERE rn = 1)"""
RETURNS_SQL = PANEL_SQL + """,
rets AS (SELECT *, close / lag(close) OVER w - 1 AS ret, ln(close) - ln(lag(close) OVER w) AS lret,
  row_number() OVER w - 1 AS pos FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date))"""
MARKET_SQL = RETURNS_SQL + """,
market AS (SELECT date, avg(ret) AS mkt FROM rets GROUP BY date),
legs AS (SELECT r.*, m.mkt, r.ret - m.mkt AS ar FROM rets r JOIN market m ON m.date = r.date)"""
#: News rows with a ticker and a time; score stands in for a classifier's probability.
NEWS_SQL = """
news AS (SELECT news_id, url, title, body_snippet, ticker, published_at, source_domain,
  CAST(published_at AT TIME ZONE 'UTC' AS DATE) AS pub_date, ((news_id * 7919) % 1000) / 1000.0 AS proba
  FROM news_raw WHERE ticker IS NOT NULL AND published_at IS NOT NULL)"""
DAYMAP_SQL = PANEL_SQL + """,
span AS (SELECT ticker, min(date) - INTERVAL 40 DAY AS lo, (SELECT max(date) FROM panel) + INTERVAL 40 DAY AS hi FROM panel GROUP BY ticker),
days AS (SELECT ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
daymap AS (SELECT d.ticker, d.day,
  last_value(p.date IGNORE NULLS) OVER (PARTITION BY d.ticker ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_or_before,
  last_value(p.date IGNORE NULLS) OVER (PARTITION BY d.ticker ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(p.date IGNORE NULLS) OVER (PARTITION BY d.ticker ORDER BY d.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_or_after,
  first_value(p.date IGNORE NULLS) OVER (PARTITION BY d.ticker ORDER BY d.day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM days d LEFT JOIN panel p ON p.ticker = d.ticker AND p.date = d.day)"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    return price_panel(table(spark, d, "prices_daily"))


def returns(spark: SparkSession, d: str) -> DataFrame:
    return with_returns(panel(spark, d))


def news(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "news_raw").where("ticker is not null and published_at is not null")
    return rows.select("news_id", "url", "title", "body_snippet", "ticker", "published_at", "source_domain", F.to_date("published_at").alias("pub_date"), ((F.col("news_id") * 7919) % 1000 / 1000.0).alias("proba"))


def day(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def r(c: Column | str, digits: int = DIGITS) -> Column:
    """Rounded, with a zero of either sign alike."""
    return F.round(c, digits) + F.lit(0.0)


def sql_day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def sql_r(c: str, digits: int = DIGITS) -> str:
    return f"round({c}, {digits}) + 0.0"
