"""Reference queries over the price panel: scans, gates, as-of joins, returns, targets, indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators.calendars import as_of, plus_trading_days, positions, session_t0, union_calendar
from tidemark.plans.common import DAYMAP_SQL, MARKET_SQL, NEWS_SQL, PANEL_SQL, RETURNS_SQL, day, news, panel, r, returns, sql_day, sql_r
from tidemark.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


W_SQL = "PARTITION BY ticker ORDER BY date ROWS BETWEEN"


@query(f"WITH {PANEL_SQL} SELECT ticker, {sql_day('date')} AS day, open, high, low, close, volume FROM panel")
def price_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).withColumn("day", day("date")).drop("date")


@query(
    """WITH t AS (SELECT ticker, date, count(*) AS n, count(*) FILTER (close IS NULL) AS null_close FROM prices_daily GROUP BY ALL)
SELECT ticker, count(*) AS dates, CAST(sum(n) AS BIGINT) AS row_count, count(*) FILTER (n > 1) AS repeated, CAST(sum(null_close) AS BIGINT) AS null_closes FROM t GROUP BY ticker"""
)
def price_gates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "prices_daily").groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("close").isNull()).alias("nulls"))
    return t.groupBy("ticker").agg(F.count(F.lit(1)).alias("dates"), F.sum("n").alias("row_count"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("nulls").alias("null_closes"))


@query(
    f"""WITH {PANEL_SQL}, cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM panel)),
z AS (SELECT p.ticker, p.date, c.pos - row_number() OVER (PARTITION BY p.ticker ORDER BY p.date) AS isle FROM panel p JOIN cal c ON c.date = p.date WHERE volume = 0)
SELECT ticker, {sql_day('min(date)')} AS first_day, {sql_day('max(date)')} AS last_day, count(*) AS days FROM z GROUP BY ticker, isle HAVING count(*) >= 3"""
)
def zero_volume_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of at least three days without volume on the union calendar (gaps and islands)."""
    p = panel(spark, d)
    z = p.where("volume = 0").join(union_calendar(p), "date").withColumn("isle", F.col("pos") - F.row_number().over(S.line()))
    runs = z.groupBy("ticker", "isle").agg(day(F.min("date")).alias("first_day"), day(F.max("date")).alias("last_day"), F.count(F.lit(1)).alias("days"))
    return runs.where("days >= 3").drop("isle")


@query(
    f"""WITH {PANEL_SQL}, span AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM panel GROUP BY ticker), cal AS (SELECT DISTINCT date FROM panel)
SELECT s.ticker, {sql_day('c.date')} AS day FROM span s JOIN cal c ON c.date BETWEEN s.lo AND s.hi
WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.ticker = s.ticker AND p.date = c.date)"""
)
def calendar_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Days of the union calendar, within a ticker's life, on which it has no row."""
    p = panel(spark, d)
    days = p.groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select("ticker", F.explode(F.sequence("lo", "hi")).alias("date"))
    return days.join(p.select("date").distinct(), "date", "left_semi").join(p.select("ticker", "date"), ["ticker", "date"], "left_anti").select("ticker", day("date").alias("day"))


@query(
    """WITH f AS (SELECT ticker, min(date) FILTER (close IS NOT NULL) AS lo FROM prices_daily GROUP BY ticker)
SELECT p.ticker, count(*) AS kept FROM prices_daily p JOIN f ON f.ticker = p.ticker AND p.date >= f.lo GROUP BY p.ticker"""
)
def trim_leading_nulls(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "prices_daily").select("ticker", "date", "close")
    first = t.where("close is not null").groupBy("ticker").agg(F.min("date").alias("lo"))
    return t.join(first, "ticker").where("date >= lo").groupBy("ticker").agg(F.count(F.lit(1)).alias("kept"))


@query(f"WITH {RETURNS_SQL} SELECT ticker, {sql_day('date')} AS day, {sql_r('ret')} AS ret, {sql_r('lret')} AS lret FROM rets")
def daily_returns(spark: SparkSession, d: str) -> DataFrame:
    return returns(spark, d).select("ticker", day("date").alias("day"), r("ret").alias("ret"), r("lret").alias("lret"))


@query(f"WITH {MARKET_SQL} SELECT {sql_day('date')} AS day, {sql_r('mkt')} AS mkt FROM market")
def market_leg(spark: SparkSession, d: str) -> DataFrame:
    return S.market_leg(returns(spark, d)).select(day("date").alias("day"), r("mkt").alias("mkt"))


@query(
    f"""WITH {RETURNS_SQL}, s AS (SELECT date, CASE WHEN count(ret) >= 50 THEN stddev_samp(ret) END AS disp FROM rets GROUP BY date)
SELECT {sql_day('date')} AS day, {sql_r('disp')} AS disp, {sql_r('disp - lag(disp, 5) OVER (ORDER BY date)')} AS change_5d,
 {sql_r('CASE WHEN count(disp) OVER w = 60 AND stddev_samp(disp) OVER w > 0 THEN (disp - avg(disp) OVER w) / stddev_samp(disp) OVER w END', 4)} AS z60
FROM s WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""
)
def dispersion_z(spark: SparkSession, d: str) -> DataFrame:
    """Cross-sectional spread of returns per date with its change and standing in 60 days; one row per date, so the one window is small."""
    s = returns(spark, d).groupBy("date").agg(F.when(F.count("ret") >= 50, F.stddev_samp("ret")).alias("disp"))
    line = Window.orderBy("date")
    w = line.rowsBetween(-59, 0)
    sd = F.stddev_samp("disp").over(w)
    z = F.when((F.count("disp").over(w) == 60) & (sd > 0), (F.col("disp") - F.avg("disp").over(w)) / sd)
    return s.select(day("date").alias("day"), r("disp").alias("disp"), r(F.col("disp") - F.lag("disp", 5).over(line)).alias("change_5d"), r(z, 4).alias("z60"))


def _fwd_sql(n: int, c: str) -> str:
    return f"CASE WHEN count({c}) OVER f{n} = {n} THEN product(1 + {c}) OVER f{n} - 1 END"


@query(
    f"""WITH {MARKET_SQL}, t AS (SELECT ticker, date, {', '.join(f'{_fwd_sql(n, "ret")} AS r{n}, {_fwd_sql(n, "mkt")} AS m{n}' for n in (1, 3, 5))} FROM legs
WINDOW {', '.join(f'f{n} AS ({W_SQL} 1 FOLLOWING AND {n} FOLLOWING)' for n in (1, 3, 5))})
SELECT ticker, {sql_day('date')} AS day, {', '.join(f'{sql_r(f"r{n}")} AS ret_{n}d, {sql_r(f"r{n} - m{n}")} AS excess_{n}d, CAST(r{n} - m{n} > 0 AS INT) AS direction_{n}d' for n in (1, 3, 5))} FROM t"""
)
def targets_v2(spark: SparkSession, d: str) -> DataFrame:
    """Compounded forward return, its excess over the market leg and its direction; partial horizons are null."""
    x = returns(spark, d)
    x = x.join(S.market_leg(x), "date")
    x = x.select("ticker", "date", *[c for n in (1, 3, 5) for c in (S.forward_compound("ret", n).alias(f"r{n}"), S.forward_compound("mkt", n).alias(f"m{n}"))])
    cols = [c for n in (1, 3, 5) for c in (r(f"r{n}").alias(f"ret_{n}d"), r(F.col(f"r{n}") - F.col(f"m{n}")).alias(f"excess_{n}d"), (F.col(f"r{n}") - F.col(f"m{n}") > 0).cast("int").alias(f"direction_{n}d"))]
    return x.select("ticker", day("date").alias("day"), *cols)


@query(
    f"""WITH {MARKET_SQL}, t AS (SELECT ticker, date, product(1 + ret) OVER f AS r, product(1 + mkt) OVER f AS m, count(ret) OVER f AS n FROM legs WINDOW f AS ({W_SQL} 1 FOLLOWING AND 5 FOLLOWING))
SELECT ticker, {sql_day('date')} AS day, n AS fwd_days, CASE WHEN n > 0 THEN {sql_r('r - m')} END AS abn_ret FROM t"""
)
def fwd_abnormal(spark: SparkSession, d: str) -> DataFrame:
    """Compounded forward abnormal return over up to five days, with the number of days that went in."""
    x = returns(spark, d)
    x = x.join(S.market_leg(x), "date")
    f = S.ahead(5)
    n = F.count("ret").over(f)
    both = lambda c: F.product(1 + F.col(c)).over(f)
    return x.select("ticker", day("date").alias("day"), n.alias("fwd_days"), F.when(n > 0, r(both("ret") - both("mkt"))).alias("abn_ret"))


@query(
    f"""WITH {MARKET_SQL} SELECT ticker, {sql_day('date')} AS day,
 {sql_r('CASE WHEN count(lret) OVER f5 = 5 THEN stddev_samp(lret) OVER f5 END')} AS fwd_vol_5d, {sql_r('CASE WHEN count(lret) OVER f3 = 3 THEN sum(lret) OVER f3 END')} AS event_ret_3d,
 {sql_r('CASE WHEN count(lret) OVER f3 = 3 THEN abs(sum(lret - mkt) OVER f3) END')} AS abs_excess_3d
FROM legs WINDOW f5 AS ({W_SQL} 1 FOLLOWING AND 5 FOLLOWING), f3 AS ({W_SQL} 1 FOLLOWING AND 3 FOLLOWING)"""
)
def fwd_realized_vol(spark: SparkSession, d: str) -> DataFrame:
    """Forward volatility, summed log return and its absolute excess over the market leg."""
    x = returns(spark, d)
    x = x.join(S.market_leg(x), "date").withColumn("xs", F.col("lret") - F.col("mkt"))
    return x.select(
        "ticker", day("date").alias("day"), r(S.forward_vol("lret", 5)).alias("fwd_vol_5d"),
        r(S.full(F.sum("lret"), "lret", 3, S.ahead(3))).alias("event_ret_3d"), r(F.abs(S.full(F.sum("xs"), "lret", 3, S.ahead(3)))).alias("abs_excess_3d"),
    )


@query(
    f"""WITH {RETURNS_SQL} SELECT ticker, {sql_day('date')} AS day, {sql_r('close / lag(close, 5) OVER w - 1')} AS mom5, {sql_r('close / lag(close, 20) OVER w - 1')} AS mom20,
 {sql_r('lead(close, 1) OVER w / close - 1')} AS next_1d, {sql_r('lead(close, 5) OVER w / close - 1')} AS next_5d, {sql_r('lead(close, 10) OVER w / close - 1')} AS next_10d
FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date)"""
)
def momentum(spark: SparkSession, d: str) -> DataFrame:
    ahead = [r(F.lead("close", n).over(S.line()) / F.col("close") - 1).alias(f"next_{n}d") for n in (1, 5, 10)]
    return panel(spark, d).select("ticker", day("date").alias("day"), r(S.momentum(5)).alias("mom5"), r(S.momentum(20)).alias("mom20"), *ahead)


@query(
    f"""WITH {RETURNS_SQL}, v AS (SELECT ticker, date, CASE WHEN count(ret) OVER w = 20 THEN round(stddev_samp(ret) OVER w, 9) END AS vol FROM rets WINDOW w AS ({W_SQL} 19 PRECEDING AND CURRENT ROW)),
h AS (SELECT ticker, date, vol, list(vol) FILTER (vol IS NOT NULL) OVER ({W_SQL} 251 PRECEDING AND 1 PRECEDING) AS past FROM v)
SELECT ticker, {sql_day('date')} AS day, {sql_r('vol')} AS vol20, CASE WHEN vol IS NOT NULL AND len(past) + 1 >= 21 THEN {sql_r('len(list_filter(past, lambda x: x <= vol)) / len(past)')} END AS vol_rank FROM h"""
)
def vol_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Trailing volatility and the share of its own last year at or below it."""
    v = returns(spark, d).withColumn("vol", F.round(S.trailing_vol("ret", 20), 9))
    return v.select("ticker", day("date").alias("day"), r("vol").alias("vol20"), r(S.share_at_or_below("vol", 252, 21)).alias("vol_rank"))


@query(
    f"""WITH {RETURNS_SQL}, t AS (SELECT *, count(close) OVER w20 AS nc, avg(close) OVER w20 AS mc, count(volume) OVER w20 AS nv, avg(volume) OVER w20 AS mv, stddev_samp(volume) OVER w20 AS sv, quantile_cont(volume, 0.5) OVER w20 AS med,
 count(lret) OVER w5 AS nl, stddev_samp(lret) OVER w5 AS sl FROM rets WINDOW w20 AS ({W_SQL} 19 PRECEDING AND CURRENT ROW), w5 AS ({W_SQL} 4 PRECEDING AND CURRENT ROW))
SELECT ticker, {sql_day('date')} AS day, {sql_r('CASE WHEN nc >= 20 AND mc > 0 THEN close / mc - 1 END')} AS ma_dist20,
 {sql_r('CASE WHEN nv >= 20 THEN CASE WHEN sv = 0 THEN 0.0 ELSE (volume - mv) / sv END END', 4)} AS vol_z20, {sql_r('CASE WHEN nv >= 20 AND med > 0 THEN volume / med END', 4)} AS rel_vol20,
 {sql_r('CASE WHEN nl >= 5 THEN sl END')} AS rv5 FROM t"""
)
def ma_dist_volz_relvol(spark: SparkSession, d: str) -> DataFrame:
    return returns(spark, d).select(
        "ticker", day("date").alias("day"), r(S.moving_average_distance(20)).alias("ma_dist20"), r(S.volume_z(20), 4).alias("vol_z20"),
        r(S.relative_volume(20), 4).alias("rel_vol20"), r(S.trailing_vol("lret", 5)).alias("rv5"),
    )


@query(
    f"""WITH {RETURNS_SQL}, t AS (SELECT *, lret * lret AS r2, pow(ln(high / low), 2) / (4 * ln(2)) AS pk, CASE WHEN volume > 0 THEN ln(volume) END AS lv FROM rets WHERE high > 0 AND low > 0)
SELECT ticker, {sql_day('date')} AS day, {sql_r('r2', 8)} AS rv_1d, {sql_r('CASE WHEN count(r2) OVER w5 >= 5 THEN avg(r2) OVER w5 END', 8)} AS rv_5d, {sql_r('CASE WHEN count(r2) OVER w22 >= 22 THEN avg(r2) OVER w22 END', 8)} AS rv_22d,
 {', '.join(f"{sql_r(f'lag(lret, {k}) OVER w')} AS lag_{k}" for k in range(1, 6))}, {sql_r('pk', 8)} AS pk_1d, {sql_r('CASE WHEN count(pk) OVER w5 >= 5 THEN avg(pk) OVER w5 END', 8)} AS pk_5d,
 {sql_r('lv')} AS logvol, {sql_r('lv - lag(lv, 1) OVER w')} AS dlogvol_1, {sql_r('lv - lag(lv, 5) OVER w')} AS dlogvol_5, CAST(isodow(date) - 1 AS INT) AS weekday
FROM t WINDOW w AS (PARTITION BY ticker ORDER BY date), w5 AS ({W_SQL} 4 PRECEDING AND CURRENT ROW), w22 AS ({W_SQL} 21 PRECEDING AND CURRENT ROW)"""
)
def har_features(spark: SparkSession, d: str) -> DataFrame:
    """Legs of a heterogeneous autoregression of variance."""
    x = returns(spark, d).where("high > 0 and low > 0").withColumns({"r2": F.col("lret") * F.col("lret"), "pk": S.parkinson(), "lv": F.when(F.col("volume") > 0, F.log("volume"))})
    lag = lambda c, k: F.lag(c, k).over(S.line())
    return x.select(
        "ticker", day("date").alias("day"), r("r2", 8).alias("rv_1d"), r(S.full(F.avg("r2"), "r2", 5, S.back(5)), 8).alias("rv_5d"), r(S.full(F.avg("r2"), "r2", 22, S.back(22)), 8).alias("rv_22d"),
        *[r(lag("lret", k)).alias(f"lag_{k}") for k in range(1, 6)], r("pk", 8).alias("pk_1d"), r(S.full(F.avg("pk"), "pk", 5, S.back(5)), 8).alias("pk_5d"),
        r("lv").alias("logvol"), r(F.col("lv") - lag("lv", 1)).alias("dlogvol_1"), r(F.col("lv") - lag("lv", 5)).alias("dlogvol_5"), F.weekday("date").alias("weekday"),
    )


@query(
    f"""WITH {MARKET_SQL}, t AS (SELECT ticker, date, ret, mkt, regr_count(ret, mkt) OVER b AS n, regr_slope(ret, mkt) OVER b AS s, regr_syy(ret, mkt) OVER b AS syy, regr_sxy(ret, mkt) OVER b AS sxy
 FROM legs WINDOW b AS ({W_SQL} 251 PRECEDING AND CURRENT ROW)), u AS (SELECT *, CASE WHEN n >= 60 THEN s ELSE 1.0 END AS beta FROM t)
SELECT ticker, {sql_day('date')} AS day, {sql_r('beta')} AS beta, {sql_r('CASE WHEN n >= 60 THEN (syy - s * sxy) / (n - 1) END', 8)} AS idio_var, {sql_r('beta * mkt')} AS systematic, {sql_r('ret - beta * mkt')} AS idiosyncratic,
 {sql_r('CASE WHEN ret <> 0 OR mkt <> 0 THEN (pow(beta * mkt, 2) + pow(ret - beta * mkt, 2)) / pow(abs(beta * mkt) + abs(ret - beta * mkt), 2) END')} AS herfindahl FROM u"""
)
def market_model(spark: SparkSession, d: str) -> DataFrame:
    """Trailing beta with fallback, idiosyncratic variance and the two-leg decomposition of the day's return."""
    x = returns(spark, d)
    x = x.join(S.market_leg(x), "date")
    b = S.back(252)
    over = lambda f: f("ret", "mkt").over(b)
    x = x.select("ticker", "date", "ret", "mkt", over(F.regr_count).alias("n"), over(F.regr_slope).alias("s"), over(F.regr_syy).alias("syy"), over(F.regr_sxy).alias("sxy"))
    x = x.withColumn("beta", F.when(F.col("n") >= 60, F.col("s")).otherwise(1.0)).withColumn("sys", F.col("beta") * F.col("mkt")).withColumn("idio", F.col("ret") - F.col("sys"))
    herf = (F.pow("sys", F.lit(2)) + F.pow("idio", F.lit(2))) / F.pow(F.abs("sys") + F.abs("idio"), F.lit(2))
    return x.select(
        "ticker", day("date").alias("day"), r("beta").alias("beta"), r(F.when(F.col("n") >= 60, (F.col("syy") - F.col("s") * F.col("sxy")) / (F.col("n") - 1)), 8).alias("idio_var"),
        r("sys").alias("systematic"), r("idio").alias("idiosyncratic"), r(F.when((F.col("ret") != 0) | (F.col("mkt") != 0), herf)).alias("herfindahl"),
    )


@query(
    f"""WITH {MARKET_SQL}, t AS (SELECT ticker, date, ar, quantile_cont(abs(ar), 0.9) OVER w AS q, count(ar) OVER w AS n FROM legs WINDOW w AS ({W_SQL} 252 PRECEDING AND 1 PRECEDING))
SELECT ticker, {sql_day('date')} AS day, {sql_r('ar')} AS ar FROM t WHERE n >= 60 AND abs(ar) >= q"""
)
def trailing_q90_events(spark: SparkSession, d: str) -> DataFrame:
    """Days whose absolute abnormal return reaches the 0.9 quantile of the year before."""
    x = returns(spark, d)
    x = x.join(S.market_leg(x), "date").withColumn("ar", F.col("ret") - F.col("mkt")).withColumn("a", F.abs("ar"))
    w = S.line().rowsBetween(-252, -1)
    x = x.withColumns({"q": F.percentile("a", 0.9).over(w), "n": F.count("a").over(w)})
    return x.where("n >= 60 and a >= q").select("ticker", day("date").alias("day"), r("ar").alias("ar"))


@query(
    f"""WITH {RETURNS_SQL}, t AS (SELECT ticker, date, ret, close, lag(close, 3) OVER w0 AS c3, count(ret) OVER w AS n, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s FROM rets WINDOW w0 AS (PARTITION BY ticker ORDER BY date), w AS ({W_SQL} 59 PRECEDING AND 1 PRECEDING))
SELECT ticker, {sql_day('date')} AS day, {sql_r('ret')} AS ret_1d, {sql_r('close / c3 - 1')} AS ret_3d, {sql_r('CASE WHEN n >= 10 AND s > 0 THEN (ret - m) / s END', 4)} AS z, coalesce(n >= 10 AND s > 0 AND abs((ret - m) / s) > 2, FALSE) AS outlier FROM t"""
)
def abnormal_z(spark: SparkSession, d: str) -> DataFrame:
    """Standing of a day's return among the returns of the 60 closes before it."""
    w = S.line().rowsBetween(-59, -1)
    x = returns(spark, d).withColumns({"n": F.count("ret").over(w), "m": F.avg("ret").over(w), "s": F.stddev_samp("ret").over(w), "c3": F.lag("close", 3).over(S.line())})
    z = F.when((F.col("n") >= 10) & (F.col("s") > 0), (F.col("ret") - F.col("m")) / F.col("s"))
    return x.select("ticker", day("date").alias("day"), r("ret").alias("ret_1d"), r(F.col("close") / F.col("c3") - 1).alias("ret_3d"), r(z, 4).alias("z"), F.coalesce(F.abs(z) > 2, F.lit(False)).alias("outlier"))


@query(
    f"""WITH {RETURNS_SQL} SELECT ticker, {sql_day('date')} AS day, {sql_r('CASE WHEN count(lret) OVER w5 >= 5 THEN stddev_samp(lret) OVER w5 END')} AS naive_vol,
 {sql_r('CASE WHEN count(lret) OVER w252 >= 60 THEN quantile_cont(lret, 0.05) OVER w252 * sqrt(3) END')} AS naive_q05 FROM rets WINDOW w5 AS ({W_SQL} 4 PRECEDING AND CURRENT ROW), w252 AS ({W_SQL} 251 PRECEDING AND CURRENT ROW)"""
)
def naive_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Persistence volatility, and the trailing 5 per cent quantile scaled to three days."""
    q = F.when(F.count("lret").over(S.back(252)) >= 60, F.percentile("lret", 0.05).over(S.back(252)) * F.sqrt(F.lit(3.0)))
    return returns(spark, d).select("ticker", day("date").alias("day"), r(S.trailing_vol("lret", 5)).alias("naive_vol"), r(q).alias("naive_q05"))


_REC = f"""WITH RECURSIVE {PANEL_SQL}, p AS (SELECT *, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS move, lag(close) OVER w AS prev FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)),"""


@query(
    _REC
    + f""" g AS (SELECT ticker, date, i, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l FROM p WHERE i = 0
 UNION ALL SELECT p.ticker, p.date, p.i, CASE WHEN p.i < 14 THEN g.g + greatest(p.move, 0) WHEN p.i = 14 THEN (g.g + greatest(p.move, 0)) / 14 ELSE (g.g * 13 + greatest(p.move, 0)) / 14 END,
  CASE WHEN p.i < 14 THEN g.l + greatest(-p.move, 0) WHEN p.i = 14 THEN (g.l + greatest(-p.move, 0)) / 14 ELSE (g.l * 13 + greatest(-p.move, 0)) / 14 END
 FROM g JOIN p ON p.ticker = g.ticker AND p.i = g.i + 1)
SELECT ticker, {sql_day('date')} AS day, {sql_r('CASE WHEN i >= 14 THEN CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + g / l) END END', 4)} AS rsi FROM g"""
)
def rsi14(spark: SparkSession, d: str) -> DataFrame:
    return S.wilder_rsi(panel(spark, d)).select("ticker", day("date").alias("day"), r("rsi", 4).alias("rsi"))


@query(
    _REC
    + f""" t AS (SELECT *, CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr FROM p),
 g AS (SELECT ticker, date, i, tr::DOUBLE AS a, close FROM t WHERE i = 0 UNION ALL SELECT t.ticker, t.date, t.i, CASE WHEN t.i < 13 THEN g.a + t.tr WHEN t.i = 13 THEN (g.a + t.tr) / 14 ELSE (g.a * 13 + t.tr) / 14 END, t.close FROM g JOIN t ON t.ticker = g.ticker AND t.i = g.i + 1)
SELECT ticker, {sql_day('date')} AS day, {sql_r('CASE WHEN i >= 13 THEN a / close END', 5)} AS atr FROM g"""
)
def atr14(spark: SparkSession, d: str) -> DataFrame:
    return S.wilder_atr(panel(spark, d)).select("ticker", day("date").alias("day"), r("atr", 5).alias("atr"))


@query(
    _REC
    + f""" g AS (SELECT ticker, date, i, close AS f, close AS s, 0.0::DOUBLE AS m FROM p WHERE i = 0
 UNION ALL SELECT p.ticker, p.date, p.i, g.f + (p.close - g.f) * 2 / 13, g.s + (p.close - g.s) * 2 / 27, g.m + ((g.f + (p.close - g.f) * 2 / 13) - (g.s + (p.close - g.s) * 2 / 27) - g.m) * 2 / 10 FROM g JOIN p ON p.ticker = g.ticker AND p.i = g.i + 1)
SELECT ticker, {sql_day('date')} AS day, {sql_r('CASE WHEN i >= 34 THEN f - s - m END', 5)} AS hist FROM g"""
)
def macd_hist(spark: SparkSession, d: str) -> DataFrame:
    return S.macd_histogram(panel(spark, d)).select("ticker", day("date").alias("day"), r("hist", 5).alias("hist"))


def _as_of_query(name: str, how: str, key: str):
    sql = f"WITH {DAYMAP_SQL}, {NEWS_SQL} SELECT n.news_id, {sql_day(f'm.{how}')} AS asof_day, p.close FROM news n LEFT JOIN daymap m ON m.ticker = n.ticker AND m.day = n.pub_date LEFT JOIN panel p ON p.ticker = n.ticker AND p.date = m.{how}"

    def f(spark: SparkSession, d: str) -> DataFrame:
        p = panel(spark, d)
        x = as_of(news(spark, d).select("news_id", "ticker", "pub_date"), p, day=F.col("pub_date"), how=how)
        close = p.select("ticker", F.col("date").alias("asof_day"), "close")
        return x.join(close, ["ticker", "asof_day"], "left").select("news_id", day("asof_day").alias("asof_day"), "close")

    f.__name__, f.__doc__ = name, key
    return query(sql)(f)


asof_strict = _as_of_query("asof_strict", "before", "Latest close strictly before the day of publication.")
asof_inclusive = _as_of_query("asof_inclusive", "at_or_before", "Latest close at or before the day of publication.")
asof_forward = _as_of_query("asof_forward", "at_or_after", "First close at or after the day of publication.")
asof_forward_strict = _as_of_query("asof_forward_strict", "after", "First close after the day of publication.")


@query(
    f"""WITH {DAYMAP_SQL}, {NEWS_SQL}, lead_days AS (SELECT ticker, date, lead(date, 5) OVER (PARTITION BY ticker ORDER BY date) AS t1 FROM panel),
l AS (SELECT news_id, ticker, published_at AT TIME ZONE 'America/New_York' AS local FROM news),
t AS (SELECT l.news_id, l.ticker, CASE WHEN hour(l.local) * 60 + minute(l.local) < 570 THEN m.before ELSE m.at_or_before END AS t0 FROM l LEFT JOIN daymap m ON m.ticker = l.ticker AND m.day = CAST(l.local AS DATE))
SELECT t.news_id, {sql_day('t.t0')} AS t0, {sql_day('x.t1')} AS t1 FROM t LEFT JOIN lead_days x ON x.ticker = t.ticker AND x.date = t.t0"""
)
def session_t0_t1(spark: SparkSession, d: str) -> DataFrame:
    """Event day by exchange session, and the fifth trading day after it."""
    p = panel(spark, d)
    x = session_t0(news(spark, d).select("news_id", "ticker", "published_at"), p, time="published_at")
    return plus_trading_days(x, p, day="t0", horizon=5).select("news_id", day("t0").alias("t0"), day("t1").alias("t1"))


@query(
    f"""WITH {MARKET_SQL}, {NEWS_SQL}, dayly AS (SELECT ticker, pub_date AS date, count(*) AS n FROM news GROUP BY ALL),
w AS (SELECT l.ticker, l.date, sum(ar) OVER x AS car, count(ar) OVER x AS k FROM legs l WINDOW x AS ({W_SQL} 1 PRECEDING AND 5 FOLLOWING))
SELECT d.ticker, {sql_day('d.date')} AS day, d.n AS articles, {sql_r('w.car')} AS car FROM dayly d JOIN w ON w.ticker = d.ticker AND w.date = d.date WHERE w.k = 7"""
)
def car_event(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative abnormal return from the day before to five days after each day with news; incomplete windows are dropped."""
    x = returns(spark, d)
    x = x.join(S.market_leg(x), "date").withColumn("ar", F.col("ret") - F.col("mkt"))
    w = S.line().rowsBetween(-1, 5)
    x = x.select("ticker", "date", F.sum("ar").over(w).alias("car"), F.count("ar").over(w).alias("k")).where("k = 7")
    n = news(spark, d).groupBy("ticker", F.col("pub_date").alias("date")).agg(F.count(F.lit(1)).alias("articles"))
    return n.join(x, ["ticker", "date"]).select("ticker", day("date").alias("day"), "articles", r("car").alias("car"))


@query(
    f"""WITH {MARKET_SQL}, {NEWS_SQL}, ev AS (SELECT ticker, pub_date AS date FROM news GROUP BY ALL),
w AS (SELECT ticker, date, sum(ar) OVER x AS car, count(ar) OVER x AS k, stddev_samp(ar) OVER e AS s, count(ar) OVER e AS ne FROM legs WINDOW x AS ({W_SQL} 1 PRECEDING AND 1 FOLLOWING), e AS ({W_SQL} 121 PRECEDING AND 2 PRECEDING))
SELECT ev.ticker, {sql_day('ev.date')} AS day, {sql_r('w.car / (w.s * sqrt(3))', 4)} AS scar FROM ev JOIN w ON w.ticker = ev.ticker AND w.date = ev.date WHERE k = 3 AND ne >= 30 AND s >= 1e-10"""
)
def scar(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative abnormal return over three days in units of the 120 days before the window."""
    x = returns(spark, d)
    x = x.join(S.market_leg(x), "date").withColumn("ar", F.col("ret") - F.col("mkt"))
    w, e = S.line().rowsBetween(-1, 1), S.line().rowsBetween(-121, -2)
    x = x.select("ticker", "date", F.sum("ar").over(w).alias("car"), F.count("ar").over(w).alias("k"), F.stddev_samp("ar").over(e).alias("s"), F.count("ar").over(e).alias("ne")).where("k = 3 and ne >= 30 and s >= 1e-10")
    ev = news(spark, d).select("ticker", F.col("pub_date").alias("date")).distinct()
    return ev.join(x, ["ticker", "date"]).select("ticker", day("date").alias("day"), r(F.col("car") / (F.col("s") * F.sqrt(F.lit(3.0))), 4).alias("scar"))


@query(
    f"""WITH {PANEL_SQL}, e AS (SELECT ticker, CAST(earnings_ts AT TIME ZONE 'UTC' AS DATE) AS date, max(earnings_ts) AS ts, max_by(surprise_pct, earnings_ts) AS surprise
  FROM earnings WHERE reported_eps IS NOT NULL AND surprise_pct IS NOT NULL GROUP BY ALL)
SELECT ticker, {sql_day('date')} AS day, surprise, coalesce(lag(surprise) OVER (PARTITION BY ticker ORDER BY date), 0) / 100 AS prev_surprise FROM e"""
)
def prev_surprise(spark: SparkSession, d: str) -> DataFrame:
    """Latest report per (ticker, day) with actuals, and the surprise of the report before it."""
    e = table(spark, d, "earnings").where("reported_eps is not null and surprise_pct is not null").groupBy("ticker", F.to_date("earnings_ts").alias("date")).agg(F.max_by("surprise_pct", "earnings_ts").alias("surprise"))
    return e.select("ticker", day("date").alias("day"), "surprise", (F.coalesce(F.lag("surprise").over(S.line()), F.lit(0.0)) / 100).alias("prev_surprise"))


@query(f"WITH {PANEL_SQL} SELECT ticker, count(*) AS days, CAST(sum(volume) AS BIGINT) AS volume, {sql_day('max(date)')} AS last_day FROM panel GROUP BY ticker")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), F.sum("volume").cast("bigint").alias("volume"), day(F.max("date")).alias("last_day"))


@query(
    f"""WITH {PANEL_SQL}, t AS (SELECT ticker, date, close, lag(close) OVER w AS prev, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, {sql_day('date')} AS day, close, prev AS previous, {sql_r('100 * (close / prev - 1)', 4)} AS pct FROM t WHERE rn = 1"""
)
def watchlist_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Last and previous close per ticker."""
    x = panel(spark, d).withColumn("previous", F.lag("close").over(S.line())).groupBy("ticker").agg(F.max_by(F.struct("date", "close", "previous"), "date").alias("v")).select("ticker", "v.*")
    return x.select("ticker", day("date").alias("day"), "close", "previous", r(100 * (F.col("close") / F.col("previous") - 1), 4).alias("pct"))


@query(
    f"""WITH {PANEL_SQL}, q AS (SELECT ticker, date, unnest([{', '.join("{'field': '" + c + "', 'value': " + c + "}" for c in ('open', 'high', 'low', 'close', 'volume'))}], recursive := true) FROM panel)
SELECT ticker, {sql_day('date')} AS day, field, value FROM q WHERE value IS NOT NULL"""
)
def wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).unpivot(["ticker", "date"], ["open", "high", "low", "close", "volume"], "field", "value").where("value is not null").select("ticker", day("date").alias("day"), "field", "value")


@query(
    f"""WITH {PANEL_SQL}, c AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM panel))
SELECT {sql_day('c.date')} AS day, c.pos, count(p.ticker) AS tickers FROM c JOIN panel p ON p.date = c.date GROUP BY c.date, c.pos"""
)
def trading_calendar(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    n = p.groupBy("date").agg(F.count("ticker").alias("tickers"))
    return union_calendar(p).join(n, "date").select(day("date").alias("day"), F.col("pos").cast("bigint").alias("pos"), "tickers")


@query(f"WITH {RETURNS_SQL} SELECT ticker, {sql_day('date')} AS day, pos FROM rets")
def trading_positions(spark: SparkSession, d: str) -> DataFrame:
    return positions(panel(spark, d)).select("ticker", day("date").alias("day"), F.col("pos").cast("bigint").alias("pos"))
