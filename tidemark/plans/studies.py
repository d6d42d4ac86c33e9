"""Reference queries of the studies: guards, event statistics, assembled features, splits, backtest, parsers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import entities as E
from tidemark.operators import guards as G
from tidemark.operators import scoring as M
from tidemark.operators import series as S
from tidemark.operators import textual as T
from tidemark.operators.calendars import as_of, day_map
from tidemark.plans.articles import _LABEL, _labelled
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


def legs(spark: SparkSession, d: str) -> DataFrame:
    """Returns with the market leg and the abnormal return."""
    x = returns(spark, d)
    return x.join(S.market_leg(x), "date").withColumn("ar", F.col("ret") - F.col("mkt"))


# Normal distribution function by a fixed polynomial (error under 1e-7): the same expression in both languages.
_PHI = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def two_sided(z: Column) -> Column:
    """Two-sided p value of a standard normal statistic."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (_PHI[0] + t * (_PHI[1] + t * (_PHI[2] + t * (_PHI[3] + t * _PHI[4]))))
    return 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def sql_two_sided(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"({t} * ({_PHI[0]} + {t} * ({_PHI[1]} + {t} * ({_PHI[2]} + {t} * ({_PHI[3]} + {t} * {_PHI[4]})))))"
    return f"(2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {poly})"


# Scans and lookups


@query("SELECT news_id, ticker, url FROM news_raw WHERE ticker IN (SELECT ticker FROM earnings)")
def ticker_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """Articles of the tickers in a list held by another table (semi join, so the list may be of any length)."""
    return table(spark, d, "news_raw").select("news_id", "ticker", "url").join(table(spark, d, "earnings").select("ticker"), "ticker", "left_semi").select("news_id", "ticker", "url")


@query(
    f"""WITH {NEWS_SQL}, s AS (SELECT url, min(news_id) AS news_id FROM news WHERE url IS NOT NULL GROUP BY url), t AS (SELECT url, min_by(title, news_id) AS title FROM news_raw WHERE title <> '' AND url IS NOT NULL GROUP BY url)
SELECT s.url, s.news_id, t.title FROM s LEFT JOIN t ON t.url = s.url"""
)
def title_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Title of each scored page: the first non-empty one fetched, null where there is none."""
    s = news(spark, d).where("url is not null").groupBy("url").agg(F.min("news_id").alias("news_id"))
    t = table(spark, d, "news_raw").where("title <> '' and url is not null").groupBy("url").agg(F.min_by("title", "news_id").alias("title"))
    return s.join(t, "url", "left").select("url", "news_id", "title")


@query(
    f"""WITH {NEWS_SQL}, {_LABEL}, k AS (SELECT news_id, y, row_number() OVER (PARTITION BY y ORDER BY (news_id * 48271) % 2147483647, news_id) AS rn FROM labelled)
SELECT news_id, y FROM k WHERE rn <= CASE WHEN y = 1 THEN 30 ELSE 70 END"""
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A labelling sample of 30 positive and 70 negative articles, drawn by a hash of the id: the same on every run."""
    x = _labelled(spark, d).select("news_id", "y", ((F.col("news_id") * 48271) % 2147483647).alias("h"))
    # The rows of a label are never sorted in one task: each side is a top-k.
    side = lambda y, n: x.where(F.col("y") == y).orderBy("h", "news_id").limit(n)
    return side(1, 30).union(side(0, 70)).select("news_id", "y")


# Gates and guards


@query(
    f"""WITH {RETURNS_SQL}, f AS (SELECT ticker, CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS vol, close / lag(close, 5) OVER w - 1 AS mom, volume FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date), w20 AS ({W_SQL} 19 PRECEDING AND CURRENT ROW))
SELECT ticker, count(*) AS n_rows, count(*) FILTER (vol IS NOT NULL AND mom IS NOT NULL AND volume IS NOT NULL) AS kept, count(*) FILTER (vol IS NULL OR mom IS NULL OR volume IS NULL) AS dropped FROM f GROUP BY ticker"""
)
def drop_null_features(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept and dropped because a feature is missing, per ticker."""
    x = returns(spark, d).select("ticker", S.trailing_vol("ret", 20).alias("vol"), S.momentum(5).alias("mom"), "volume")
    return G.complete_rows(x, ["vol", "mom", "volume"], by=["ticker"])


@query(
    f"""WITH {DAYMAP_SQL}, {NEWS_SQL}, x AS (SELECT n.ticker, n.pub_date, m.before AS context, m.at_or_before AS loose FROM news n JOIN daymap m ON m.ticker = n.ticker AND m.day = n.pub_date)
SELECT count(*) AS articles, count(*) FILTER (context >= pub_date) AS violations, count(*) FILTER (loose >= pub_date) AS violations_if_inclusive FROM x"""
)
def point_in_time_check(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose context day isn't before publication: none for the strict lookup, some for the inclusive one."""
    p = panel(spark, d)
    x = news(spark, d).select("ticker", "pub_date").join(day_map(p).select("ticker", F.col("day").alias("pub_date"), F.col("before").alias("context"), F.col("at_or_before").alias("loose")), ["ticker", "pub_date"])
    late = lambda c: F.count_if(F.col(c) >= F.col("pub_date"))
    return x.agg(F.count(F.lit(1)).alias("articles"), late("context").alias("violations"), late("loose").alias("violations_if_inclusive"))


@query(f"SELECT feature, observed, published, available FROM (VALUES {', '.join(str(x) for x in G.FEATURE_TIMES)}) t(feature, observed, published, available)")
def feature_times(spark: SparkSession, d: str) -> DataFrame:
    """When each feature is observed, published and usable."""
    return G.feature_times(spark)


@query(
    f"""WITH {RETURNS_SQL}, {NEWS_SQL}, ev AS (SELECT DISTINCT ticker, pub_date AS date FROM news), w AS (SELECT ticker, date, lag(date, 2) OVER x AS base_end, lag(date, 121) OVER x AS base_start, lag(date, 1) OVER x AS event_start, lead(date, 1) OVER x AS event_end FROM rets WINDOW x AS (PARTITION BY ticker ORDER BY date))
SELECT w.ticker, {sql_day('w.date')} AS day, {sql_day('base_end')} AS base_end, {sql_day('event_start')} AS event_start, base_end < event_start AS disjoint FROM w JOIN ev ON ev.ticker = w.ticker AND ev.date = w.date WHERE base_start IS NOT NULL AND event_end IS NOT NULL"""
)
def window_disjointness(spark: SparkSession, d: str) -> DataFrame:
    """End of each event's estimation window against the start of its event window."""
    at = lambda f, n: f("date", n).over(S.line())
    w = panel(spark, d).select("ticker", "date", at(F.lag, 2).alias("base_end"), at(F.lag, 121).alias("base_start"), at(F.lag, 1).alias("event_start"), at(F.lead, 1).alias("event_end")).where("base_start is not null and event_end is not null")
    ev = news(spark, d).select("ticker", F.col("pub_date").alias("date")).distinct()
    return w.join(ev, ["ticker", "date"]).select("ticker", day("date").alias("day"), day("base_end").alias("base_end"), day("event_start").alias("event_start"), (F.col("base_end") < F.col("event_start")).alias("disjoint"))


@query(
    f"""WITH {PANEL_SQL}, {NEWS_SQL}, u AS (SELECT ticker FROM universe WHERE ticker IS NOT NULL), m AS (SELECT unnest(range(1, 13)) AS month),
n AS (SELECT ticker, month(pub_date) AS month, count(*) AS n FROM news GROUP BY ALL), l AS (SELECT ticker, max(date) AS last FROM panel GROUP BY ticker), e AS (SELECT max(date) AS hi FROM panel)
SELECT u.ticker, count(*) FILTER (n.n IS NULL) AS empty_months, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS articles, any_value(CASE WHEN l.last IS NULL THEN NULL ELSE date_diff('day', l.last, e.hi) END) AS stale_days
FROM u CROSS JOIN m LEFT JOIN n ON n.ticker = u.ticker AND n.month = m.month LEFT JOIN l ON l.ticker = u.ticker CROSS JOIN e GROUP BY u.ticker"""
)
def completeness_check(spark: SparkSession, d: str) -> DataFrame:
    """Per listed ticker: months without any article, articles, and days since its last price."""
    p = panel(spark, d)
    n = news(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("articles"), F.count_distinct(F.month("pub_date")).alias("months"))
    last = p.groupBy("ticker").agg(F.max("date").alias("last"))
    end = F.broadcast(p.agg(F.max("date").alias("hi")))  # one row
    x = table(spark, d, "universe").where("ticker is not null").select("ticker").join(n, "ticker", "left").join(last, "ticker", "left").crossJoin(end)
    return x.select("ticker", (12 - F.coalesce("months", F.lit(0))).alias("empty_months"), F.coalesce("articles", F.lit(0)).alias("articles"), F.datediff("hi", "last").cast("bigint").alias("stale_days"))


@query(
    f"""WITH {NEWS_SQL} SELECT ticker, {sql_day('pub_date')} AS day, count(*) AS articles, count(*) FILTER (greatest(proba, 1 - proba) >= 0.8) AS used, {sql_r('avg(proba) FILTER (greatest(proba, 1 - proba) >= 0.8)')} AS mean_proba FROM news GROUP BY ticker, pub_date"""
)
def confident_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Daily sentiment from confident articles only; days without any keep a null."""
    sure = F.greatest(F.col("proba"), 1 - F.col("proba")) >= 0.8
    g = news(spark, d).groupBy("ticker", "pub_date").agg(F.count(F.lit(1)).alias("articles"), F.count_if(sure).alias("used"), r(F.avg(F.when(sure, F.col("proba")))).alias("mean_proba"))
    return g.select("ticker", day("pub_date").alias("day"), "articles", "used", "mean_proba")


@query(
    r"""SELECT ticker, regexp_full_match(ticker, '[A-Z][A-Z0-9.-]{0,9}') AS ticker_ok, count(*) AS n, count(*) FILTER (regexp_full_match(url, 'https?://[^\s/]+/.*')) AS urls_ok FROM news_raw WHERE ticker IS NOT NULL GROUP BY ticker"""
)
def input_validation(spark: SparkSession, d: str) -> DataFrame:
    """Well-formed ticker symbols and addresses, per ticker."""
    n = table(spark, d, "news_raw").where("ticker is not null")
    return n.groupBy("ticker").agg(F.first(F.col("ticker").rlike(r"^[A-Z][A-Z0-9.-]{0,9}$")).alias("ticker_ok"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("url").rlike(r"^https?://[^\s/]+/.*$")).alias("urls_ok")).select("ticker", "ticker_ok", "n", "urls_ok")


# As-of lookups on second series, joins

_LEVEL = f"""{RETURNS_SQL}, lvl AS (SELECT date, avg(lret) AS m, stddev_pop(lret) AS disp, count(lret) AS n FROM rets GROUP BY date),
index_line AS (SELECT date, sum(coalesce(m, 0)) OVER (ORDER BY date) AS level, disp, CASE WHEN n > 0 THEN m END AS m FROM lvl)"""


def market_index(spark: SparkSession, d: str) -> DataFrame:
    """The market's own series: one row a date with its log level, mean move and dispersion (bounded by the calendar)."""
    lvl = returns(spark, d).groupBy("date").agg(F.avg("lret").alias("m"), F.stddev_pop("lret").alias("disp"))
    return lvl.select("date", F.sum(F.coalesce("m", F.lit(0.0))).over(Window.orderBy("date")).alias("level"), "disp", "m")


@query(
    f"""WITH {_LEVEL}, {NEWS_SQL}, f AS (SELECT date, level - lag(level, 5) OVER (ORDER BY date) AS run5, lead(date) OVER (ORDER BY date) AS nxt FROM index_line)
SELECT n.news_id, {sql_day('f.date')} AS leg_day, {sql_r('f.run5')} AS run5, f.date <> n.pub_date AS fallback FROM news n JOIN f ON f.date <= n.pub_date AND (f.nxt IS NULL OR f.nxt > n.pub_date)"""
)
def second_leg_asof(spark: SparkSession, d: str) -> DataFrame:
    """The market leg on its own calendar at or before publication, and whether an earlier day had to do."""
    f = market_index(spark, d).select("date", (F.col("level") - F.lag("level", 5).over(Window.orderBy("date"))).alias("run5"), F.lead("date").over(Window.orderBy("date")).alias("nxt"))
    # One row a calendar day: the event join is an equi-join whatever the number of events.
    days = f.select(F.explode(F.sequence("date", F.coalesce(F.date_sub("nxt", 1), F.date_add("date", 400)))).alias("pub_date"), "date", "run5")
    return news(spark, d).select("news_id", "pub_date").join(days, "pub_date").select("news_id", day("date").alias("leg_day"), r("run5").alias("run5"), (F.col("date") != F.col("pub_date")).alias("fallback"))


@query(
    f"""WITH {DAYMAP_SQL}, e AS (SELECT ticker, CAST(earnings_ts AT TIME ZONE 'UTC' AS DATE) AS d FROM earnings WHERE ticker IS NOT NULL AND earnings_ts IS NOT NULL GROUP BY ALL)
SELECT e.ticker, {sql_day('e.d')} AS day, {sql_day('m.at_or_before')} AS snapped FROM e JOIN daymap m ON m.ticker = e.ticker AND m.day = e.d WHERE date_diff('day', m.at_or_before, e.d) <= 7"""
)
def snap_to_trading_day(spark: SparkSession, d: str) -> DataFrame:
    """Trading day at or before each report, at most a week before it."""
    e = table(spark, d, "earnings").where("ticker is not null and earnings_ts is not null").select("ticker", F.to_date("earnings_ts").alias("d")).distinct()
    x = as_of(e, panel(spark, d), day=F.col("d"), how="at_or_before", name="snap")
    return x.where(F.datediff("d", "snap") <= 7).select("ticker", day("d").alias("day"), day("snap").alias("snapped"))


@query(
    f"""WITH {NEWS_SQL}, x AS (SELECT news_id, ticker, published_at, CASE WHEN title <> '' THEN list_distinct(regexp_extract_all(lower(title), '[a-z]+')) ELSE [] END AS w FROM news),
y AS (SELECT * FROM x WHERE len(w) > 0), p AS (SELECT a.news_id, max(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))) AS best, count(*) AS earlier FROM y a JOIN y b ON a.ticker = b.ticker AND b.published_at < a.published_at AND b.published_at >= a.published_at - INTERVAL 7 DAY GROUP BY a.news_id)
SELECT y.news_id, coalesce(p.earlier, 0) AS earlier, {sql_r('1 - coalesce(p.best, 0)')} AS novelty FROM y LEFT JOIN p ON p.news_id = y.news_id"""
)
def trailing_novelty(spark: SparkSession, d: str) -> DataFrame:
    """One minus the likeness of a title to the nearest one of its ticker in the seven days before it.

    The range join is an equi-join on ticker and day: each earlier title is offered to the eight days it can matter to,
    which adaptive execution can split where a ticker is hot.
    """
    x = news(spark, d).where("title <> ''").select("news_id", "ticker", "published_at", F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("([a-z]+)"), F.lit(1))).alias("w"), "pub_date").where("size(w) > 0")
    b = x.select("ticker", F.col("published_at").alias("tb"), F.col("w").alias("wb"), F.explode(F.sequence("pub_date", F.date_add("pub_date", 7))).alias("pub_date"))
    both = F.size(F.array_intersect("w", "wb"))
    near = x.join(b, ["ticker", "pub_date"]).where("tb < published_at and tb >= published_at - interval 7 days")
    best = near.groupBy("news_id").agg(F.max(both / (F.size("w") + F.size("wb") - both)).alias("best"), F.count(F.lit(1)).alias("earlier"))
    return x.select("news_id").join(best, "news_id", "left").select("news_id", F.coalesce("earlier", F.lit(0)).alias("earlier"), r(1 - F.coalesce("best", F.lit(0.0))).alias("novelty"))


@query(
    f"""WITH {RETURNS_SQL}, t AS (SELECT ticker, pos, date, CASE WHEN count(ret) OVER w = 20 THEN list(ret) OVER w END AS path, CASE WHEN count(ret) OVER w = 20 THEN avg(ret) OVER w END AS m, CASE WHEN count(ret) OVER w = 20 THEN stddev_pop(ret) OVER w END AS s,
 CASE WHEN count(lret) OVER f = 5 THEN stddev_samp(lret) OVER f END AS label FROM rets WINDOW w AS ({W_SQL} 19 PRECEDING AND CURRENT ROW), f AS ({W_SQL} 1 FOLLOWING AND 5 FOLLOWING)),
z AS (SELECT *, list_transform(path, lambda x: (x - m) / s) AS zp FROM t WHERE s > 1e-12), e AS (SELECT * FROM z WHERE pos % 20 = 0),
c AS (SELECT e.ticker, e.date, e.pos, z.label, round(list_dot_product(e.zp, z.zp) / 20, 9) AS sim, row_number() OVER (PARTITION BY e.ticker, e.pos ORDER BY round(list_dot_product(e.zp, z.zp) / 20, 9) DESC, z.pos DESC) AS rn
 FROM e JOIN z ON z.ticker = e.ticker AND z.pos BETWEEN e.pos - 500 AND e.pos - 6 WHERE z.label IS NOT NULL)
SELECT ticker, {sql_day('date')} AS day, count(*) AS analogues, {sql_r('avg(label)')} AS mean_vol, {sql_r('coalesce(stddev_samp(label), 0)')} AS sd_vol, {sql_r('max(sim)')} AS nearest FROM c WHERE rn <= 10 GROUP BY ticker, date"""
)
def analogue_vol(spark: SparkSession, d: str) -> DataFrame:
    """Volatility after the ten past days whose 20-day path, standardised, is most like today's (every 20th trading day)."""
    w = S.back(20)
    full = F.count("ret").over(w) == 20
    t = returns(spark, d).withColumn("pos", F.row_number().over(S.line()) - 1).select(
        "ticker", "pos", "date", F.when(full, F.collect_list("ret").over(w)).alias("path"), F.when(full, F.avg("ret").over(w)).alias("m"), F.when(full, F.stddev_pop("ret").over(w)).alias("s"), S.full(F.stddev_samp("lret"), "lret", 5, S.ahead(5)).alias("label")
    )
    z = t.where("s > 1e-12").select("ticker", "pos", "date", "label", F.transform("path", lambda x: (x - F.col("m")) / F.col("s")).alias("zp"))
    e = z.where("pos % 20 = 0").select("ticker", F.col("pos").alias("p"), "date", F.col("zp").alias("ze"))
    c = e.join(z.where("label is not null").select("ticker", "pos", "label", "zp"), "ticker").where("pos between p - 500 and p - 6")
    dot = F.aggregate(F.zip_with("ze", "zp", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    c = c.withColumn("sim", F.round(dot / 20, 9))
    top = c.withColumn("rn", F.row_number().over(Window.partitionBy("ticker", "p").orderBy(F.desc("sim"), F.desc("pos")))).where("rn <= 10")  # at most 495 rows a group
    return top.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("analogues"), r(F.avg("label")).alias("mean_vol"), r(F.coalesce(F.stddev_samp("label"), F.lit(0.0))).alias("sd_vol"), r(F.max("sim")).alias("nearest")).select("ticker", day("date").alias("day"), "analogues", "mean_vol", "sd_vol", "nearest")


@query(
    f"""WITH {NEWS_SQL}, {_LABEL}, j AS (SELECT url, max_by(y, news_id) AS judged FROM labelled JOIN news USING (news_id) WHERE url IS NOT NULL AND news_id % 3 <> 0 GROUP BY url)
SELECT count(*) AS articles, count(j.judged) AS judged, count(*) FILTER (j.judged IS NULL) AS abstained, CAST(coalesce(sum(j.judged), 0) AS BIGINT) AS positive, count(*) FILTER (j.judged <> l.y) AS changed FROM labelled l JOIN news n USING (news_id) LEFT JOIN j ON j.url = n.url"""
)
def label_swap(spark: SparkSession, d: str) -> DataFrame:
    """Weak labels replaced by judged ones of the same page; pages nobody judged abstain."""
    l = _labelled(spark, d).select("news_id", "url", "y")
    j = l.where("url is not null and news_id % 3 <> 0").groupBy("url").agg(F.max_by("y", "news_id").alias("judged"))
    x = l.join(j, "url", "left")
    return x.agg(F.count(F.lit(1)).alias("articles"), F.count("judged").alias("judged"), F.count_if(F.col("judged").isNull()).alias("abstained"), F.coalesce(F.sum("judged"), F.lit(0)).alias("positive"), F.count_if(F.col("judged") != F.col("y")).alias("changed"))


@query(f"WITH {NEWS_SQL}, {_LABEL} SELECT max(pub_date)::VARCHAR AS cutoff, count(*) AS n, CAST(sum(y) AS BIGINT) AS positive, {sql_r('avg(y)')} AS positive_rate FROM labelled")
def weak_label_stats(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).agg(day(F.max("pub_date")).alias("cutoff"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive"), r(F.avg("y")).alias("positive_rate"))


@query(
    f"""WITH {PANEL_SQL}, cal AS (SELECT DISTINCT date FROM panel), t AS (SELECT DISTINCT ticker FROM panel)
SELECT t.ticker, count(*) AS calendar_days, count(p.date) AS traded, {sql_r('count(p.date) / count(*)')} AS share, {sql_day('max(p.date)')} AS last_day FROM t CROSS JOIN cal LEFT JOIN panel p ON p.ticker = t.ticker AND p.date = cal.date GROUP BY t.ticker"""
)
def aligned_panel(spark: SparkSession, d: str) -> DataFrame:
    """Each ticker laid on the union calendar: how much of it has rows."""
    p = panel(spark, d)
    n = F.broadcast(p.agg(F.count_distinct("date").alias("calendar_days")))  # one row
    return p.groupBy("ticker").agg(F.count(F.lit(1)).alias("traded"), day(F.max("date")).alias("last_day")).crossJoin(n).select("ticker", "calendar_days", "traded", r(F.col("traded") / F.col("calendar_days")).alias("share"), "last_day")


# Event statistics

_EVENTS = f"""{MARKET_SQL}, {NEWS_SQL}, ev AS (SELECT ticker, pub_date AS date FROM news GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT ticker, date, pos, ar, sum(ar) OVER x AS car, count(ar) OVER x AS k, stddev_samp(ar) OVER e AS s, count(ar) OVER e AS ne FROM legs WINDOW x AS ({W_SQL} 1 PRECEDING AND 1 FOLLOWING), e AS ({W_SQL} 121 PRECEDING AND 2 PRECEDING)),
cars AS (SELECT w.ticker, w.date, w.pos, car, car / (s * sqrt(3)) AS scar FROM w JOIN ev ON ev.ticker = w.ticker AND ev.date = w.date WHERE k = 3 AND ne >= 100 AND s >= 1e-10)"""


def _cars(spark: SparkSession, d: str) -> DataFrame:
    """Abnormal returns cumulated around days with at least two articles, also in units of their estimation window."""
    w, e = S.line().rowsBetween(-1, 1), S.line().rowsBetween(-121, -2)
    x = legs(spark, d).withColumn("pos", F.row_number().over(S.line()) - 1)
    x = x.select("ticker", "date", "pos", F.sum("ar").over(w).alias("car"), F.count("ar").over(w).alias("k"), F.stddev_samp("ar").over(e).alias("s"), F.count("ar").over(e).alias("ne")).where("k = 3 and ne >= 100 and s >= 1e-10")
    ev = news(spark, d).groupBy("ticker", F.col("pub_date").alias("date")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return x.join(ev, ["ticker", "date"]).select("ticker", "date", "pos", "car", (F.col("car") / (F.col("s") * math.sqrt(3))).alias("scar"))


@query(
    f"""WITH {_EVENTS}, a AS (SELECT count(*) AS n, avg(car) AS m, stddev_samp(car) / sqrt(count(*)) AS se FROM cars)
SELECT n, {sql_r('m')} AS mean_car, {sql_r('m / se', 4)} AS t_stat, {sql_r(sql_two_sided('m / se'), 5)} AS p_value, {sql_r('m - 1.959964 * se')} AS ci_low, {sql_r('m + 1.959964 * se')} AS ci_high FROM a"""
)
def event_study_test(spark: SparkSession, d: str) -> DataFrame:
    """Mean cumulative abnormal return with its t statistic, p value and interval (normal limit)."""
    a = _cars(spark, d).agg(F.count(F.lit(1)).alias("n"), F.avg("car").alias("m"), (F.stddev_samp("car") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    t = F.col("m") / F.col("se")
    return a.select("n", r("m").alias("mean_car"), r(t, 4).alias("t_stat"), r(two_sided(t), 5).alias("p_value"), r(F.col("m") - 1.959964 * F.col("se")).alias("ci_low"), r(F.col("m") + 1.959964 * F.col("se")).alias("ci_high"))


@query(
    f"""WITH {_EVENTS}, o AS (SELECT ticker, count(*) OVER (PARTITION BY ticker ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS later, count(*) OVER (PARTITION BY ticker) AS n FROM cars)
SELECT ticker, any_value(n) AS events, CAST(sum(later) AS BIGINT) AS overlapping, {sql_r('CASE WHEN any_value(n) > 1 THEN sum(later) / (any_value(n) * (any_value(n) - 1) / 2) END')} AS rate FROM o GROUP BY ticker"""
)
def overlap_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of a ticker's event pairs whose windows overlap; counted by a range window, so no pairs are made."""
    line = Window.partitionBy("ticker").orderBy("pos")
    o = _cars(spark, d).select("ticker", F.count(F.lit(1)).over(line.rangeBetween(1, 2)).alias("later"))
    g = o.groupBy("ticker").agg(F.count(F.lit(1)).alias("events"), F.sum("later").alias("overlapping"))
    n = F.col("events")
    return g.select("ticker", "events", "overlapping", r(F.when(n > 1, F.col("overlapping") / (n * (n - 1) / 2))).alias("rate"))


_CORR = """m AS (SELECT date, avg(z) AS mz, count(*) AS k FROM (SELECT ticker, date, (ar - avg(ar) OVER (PARTITION BY ticker)) / stddev_pop(ar) OVER (PARTITION BY ticker) AS z FROM legs WHERE ar IS NOT NULL) GROUP BY date),
rbar AS (SELECT avg((k * mz * mz * k - k) / (k * (k - 1))) AS r FROM m WHERE k > 1)"""


def _mean_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Mean pairwise correlation of abnormal returns: per day the mean product of two standardised series, from sums, so no pairs are made."""
    own = Window.partitionBy("ticker")
    z = legs(spark, d).where("ar is not null").select("date", ((F.col("ar") - F.avg("ar").over(own)) / F.stddev_pop("ar").over(own)).alias("z"))
    k = F.col("k")
    m = z.groupBy("date").agg(F.avg("z").alias("mz"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return m.agg(F.avg((k * F.col("mz") * F.col("mz") * k - k) / (k * (k - 1))).alias("r"))


@query(f"WITH {MARKET_SQL}, {_CORR} SELECT {sql_r('r')} AS mean_correlation FROM rbar")
def mean_pairwise_corr(spark: SparkSession, d: str) -> DataFrame:
    return _mean_correlation(spark, d).select(r("r").alias("mean_correlation"))


@query(
    f"""WITH {_EVENTS}, {_CORR}, a AS (SELECT count(*) AS n, avg(scar) AS m, stddev_samp(scar) AS s FROM cars), b AS (SELECT n, m / (s / sqrt(n)) AS bmp, m / (s / sqrt(n)) * sqrt((1 - r) / (1 + (n - 1) * r)) AS adj FROM a, rbar WHERE n >= 3)
SELECT n, {sql_r('bmp', 4)} AS bmp, {sql_r(sql_two_sided('bmp'), 5)} AS bmp_p, {sql_r('adj', 4)} AS adj_bmp, {sql_r(sql_two_sided('adj'), 5)} AS adj_bmp_p FROM b"""
)
def bmp(spark: SparkSession, d: str) -> DataFrame:
    """Standardised cross-sectional test, plain and adjusted for correlation between events."""
    a = _cars(spark, d).agg(F.count(F.lit(1)).alias("n"), F.avg("scar").alias("m"), F.stddev_samp("scar").alias("s")).where("n >= 3").crossJoin(_mean_correlation(spark, d))  # one row each
    n, rho = F.col("n"), F.col("r")
    plain = F.col("m") / (F.col("s") / F.sqrt(n))
    b = a.select("n", plain.alias("b"), (plain * F.sqrt((1 - rho) / (1 + (n - 1) * rho))).alias("a"))
    return b.select("n", r("b", 4).alias("bmp"), r(two_sided(F.col("b")), 5).alias("bmp_p"), r("a", 4).alias("adj_bmp"), r(two_sided(F.col("a")), 5).alias("adj_bmp_p"))


@query(
    f"""WITH {_EVENTS}, roll AS (SELECT ticker, date, round(car / (s * sqrt(3)), 9) AS v FROM w WHERE k = 3 AND ne >= 100 AND s >= 1e-10), k AS (SELECT ticker, date, (rank() OVER (PARTITION BY ticker ORDER BY v) + (count(*) OVER (PARTITION BY ticker, v) - 1) / 2) / (count(*) OVER (PARTITION BY ticker) + 1) - 0.5 AS u FROM roll),
x AS (SELECT k.u FROM k JOIN ev ON ev.ticker = k.ticker AND ev.date = k.date)
SELECT count(*) AS n, {sql_r('avg(u)')} AS mean_rank, {sql_r('avg(u) / (stddev_samp(u) / sqrt(count(*)))', 4)} AS grank FROM x"""
)
def grank(spark: SparkSession, d: str) -> DataFrame:
    """Generalised rank test: where the event's standing lies among its ticker's rolling ones."""
    w, e = S.line().rowsBetween(-1, 1), S.line().rowsBetween(-121, -2)
    x = legs(spark, d).select("ticker", "date", F.sum("ar").over(w).alias("car"), F.count("ar").over(w).alias("k"), F.stddev_samp("ar").over(e).alias("s"), F.count("ar").over(e).alias("ne")).where("k = 3 and ne >= 100 and s >= 1e-10")
    roll = x.select("ticker", "date", F.round(F.col("car") / (F.col("s") * math.sqrt(3)), 9).alias("v"))
    u = roll.select("ticker", "date", (M.average_rank("v", [F.col("ticker")]) / (F.count(F.lit(1)).over(Window.partitionBy("ticker")) + 1) - 0.5).alias("u"))
    ev = news(spark, d).groupBy("ticker", F.col("pub_date").alias("date")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("ticker", "date")
    return u.join(ev, ["ticker", "date"]).agg(F.count(F.lit(1)).alias("n"), r(F.avg("u")).alias("mean_rank"), r(F.avg("u") / (F.stddev_samp("u") / F.sqrt(F.count(F.lit(1)))), 4).alias("grank"))


@query(
    f"""WITH {MARKET_SQL}, {NEWS_SQL}, line AS (SELECT ticker, date, ar, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos FROM legs), ev AS (SELECT ticker, pub_date AS date FROM news GROUP BY ALL HAVING count(*) >= 3), e AS (SELECT ev.ticker, ev.date, l.pos AS p FROM ev JOIN line l ON l.ticker = ev.ticker AND l.date = ev.date)
SELECT e.ticker, {sql_day('e.date')} AS event_day, CAST(l.pos - e.p AS INT) AS rel, l.pos - e.p < -1 AS estimation, {sql_r('l.ar')} AS ar FROM e JOIN line l ON l.ticker = e.ticker AND l.pos BETWEEN e.p - 121 AND e.p + 1 WHERE l.ar IS NOT NULL"""
)
def ar_panel(spark: SparkSession, d: str) -> DataFrame:
    """Abnormal returns of each event's estimation and event window in long form: an equi-join on (ticker, position)."""
    line = legs(spark, d).select("ticker", "date", "ar", F.row_number().over(S.line()).alias("pos"))
    ev = news(spark, d).groupBy("ticker", F.col("pub_date").alias("date")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    e = ev.join(line, ["ticker", "date"]).select("ticker", day("date").alias("event_day"), F.col("pos").alias("p"))
    e = e.select("ticker", "event_day", "p", F.explode(F.sequence(F.col("p") - 121, F.col("p") + 1)).alias("pos"))
    rel = F.col("pos") - F.col("p")
    return e.join(line.where("ar is not null"), ["ticker", "pos"]).select("ticker", "event_day", rel.cast("int").alias("rel"), (rel < -1).alias("estimation"), r("ar").alias("ar"))


@query(
    f"""WITH {RETURNS_SQL}, h AS (SELECT ticker, date, CAST(lret < q AS INT) AS h FROM (SELECT ticker, date, lret, CASE WHEN count(lret) OVER l >= 60 THEN quantile_cont(lret, 0.05) OVER l END AS q FROM rets WINDOW l AS ({W_SQL} 252 PRECEDING AND 1 PRECEDING)) WHERE lret < q IS NOT NULL),
b AS (SELECT ticker, h, lag(h) OVER (PARTITION BY ticker ORDER BY date) AS b FROM h), c AS (SELECT ticker, count(*) FILTER (b = 0 AND h = 0) AS n00, count(*) FILTER (b = 0 AND h = 1) AS n01, count(*) FILTER (b = 1 AND h = 0) AS n10, count(*) FILTER (b = 1 AND h = 1) AS n11 FROM b GROUP BY ticker),
p AS (SELECT *, n01 / nullif(n00 + n01, 0) AS p0, n11 / nullif(n10 + n11, 0) AS p1, (n01 + n11) / nullif(n00 + n01 + n10 + n11, 0) AS pi FROM c)
SELECT ticker, n00, n01, n10, n11, {sql_r('-2 * (CASE WHEN n00 + n10 > 0 THEN (n00 + n10) * ln(1 - pi) ELSE 0 END + CASE WHEN n01 + n11 > 0 THEN (n01 + n11) * ln(pi) ELSE 0 END - CASE WHEN n00 > 0 THEN n00 * ln(1 - p0) ELSE 0 END - CASE WHEN n01 > 0 THEN n01 * ln(p0) ELSE 0 END - CASE WHEN n10 > 0 THEN n10 * ln(1 - p1) ELSE 0 END - CASE WHEN n11 > 0 THEN n11 * ln(p1) ELSE 0 END)', 5)} AS lr_ind FROM p"""
)
def christoffersen(spark: SparkSession, d: str) -> DataFrame:
    """Independence of the days that fall below the trailing quantile: transition counts and likelihood ratio, per ticker."""
    last = S.line().rowsBetween(-252, -1)
    x = returns(spark, d).select("ticker", "date", "lret", F.when(F.count("lret").over(last) >= 60, F.percentile("lret", 0.05).over(last)).alias("q"))
    h = x.select("ticker", "date", (F.col("lret") < F.col("q")).cast("int").alias("h")).where("h is not null").withColumn("b", F.lag("h").over(S.line()))
    n = lambda a, b: F.count_if((F.col("b") == a) & (F.col("h") == b)).alias(f"n{a}{b}")
    c = h.groupBy("ticker").agg(n(0, 0), n(0, 1), n(1, 0), n(1, 1))
    n00, n01, n10, n11 = (F.col(f"n{k}") for k in ("00", "01", "10", "11"))
    part = lambda k, n: F.when(n > 0, k / n)
    p0, p1, pi = part(n01, n00 + n01), part(n11, n10 + n11), part(n01 + n11, n00 + n01 + n10 + n11)
    term = lambda k, p: F.when(k > 0, k * F.log(p)).otherwise(0.0)
    lr = -2 * (term(n00 + n10, 1 - pi) + term(n01 + n11, pi) - term(n00, 1 - p0) - term(n01, p0) - term(n10, 1 - p1) - term(n11, p1))
    return c.select("ticker", "n00", "n01", "n10", "n11", r(lr, 5).alias("lr_ind"))


_DSR_NULL = M.expected_max_sharpe(1.0, 100)


@query(
    f"""WITH {RETURNS_SQL}, m AS (SELECT ticker, count(ret) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp FROM rets GROUP BY ticker),
k AS (SELECT r.ticker, m.n, any_value(mu / sd) AS sr, avg(pow((ret - mu) / sp, 3)) AS sk, avg(pow((ret - mu) / sp, 4)) AS ku FROM rets r JOIN m ON m.ticker = r.ticker WHERE ret IS NOT NULL GROUP BY r.ticker, m.n),
v AS (SELECT stddev_samp(sr) * {_DSR_NULL!r} AS null_sr FROM k)
SELECT ticker, n, {sql_r('sr')} AS sharpe, {sql_r('null_sr')} AS null_sharpe, {sql_r('(sr - null_sr) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr)', 4)} AS dsr_z FROM k, v WHERE 1 - sk * sr + (ku - 1) / 4 * sr * sr > 0"""
)
def deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    """Sharpe ratio of each ticker against the best of a hundred worthless ones, as a normal score."""
    k = M.deflated_sharpe(returns(spark, d).where("ret is not null"), "ticker", "ret")
    v = F.broadcast(k.agg((F.stddev_samp("sharpe") * _DSR_NULL).alias("null_sr")))  # one row
    sr = F.col("sharpe")
    under = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    return k.crossJoin(v).where(under > 0).select("ticker", "n", r(sr).alias("sharpe"), r("null_sr").alias("null_sharpe"), r((sr - F.col("null_sr")) * F.sqrt(F.col("n") - 1) / F.sqrt(under), 4).alias("dsr_z"))


@query(
    f"""WITH {RETURNS_SQL}, l AS (SELECT date, avg(abs(a - rv)) AS la, avg(abs(b - rv)) AS lb FROM (SELECT date, CASE WHEN count(lret) OVER w5 = 5 THEN stddev_samp(lret) OVER w5 END AS a, CASE WHEN count(lret) OVER w20 = 20 THEN stddev_samp(lret) OVER w20 END AS b, CASE WHEN count(lret) OVER f = 5 THEN stddev_samp(lret) OVER f END AS rv
 FROM rets WINDOW w5 AS ({W_SQL} 4 PRECEDING AND CURRENT ROW), w20 AS ({W_SQL} 19 PRECEDING AND CURRENT ROW), f AS ({W_SQL} 1 FOLLOWING AND 5 FOLLOWING)) WHERE a IS NOT NULL AND b IS NOT NULL AND rv IS NOT NULL GROUP BY date),
a AS (SELECT count(*) AS n, avg(la - lb) AS m, stddev_samp(la - lb) / sqrt(count(*)) AS se, sum(CAST(la < lb AS INT)) AS wins FROM l)
SELECT n, {sql_r('m', 8)} AS mean_difference, {sql_r('m / se', 4)} AS dm, {sql_r(sql_two_sided('m / se'), 5)} AS p_value, CAST(wins AS BIGINT) AS wins FROM a"""
)
def paired_t_dm(spark: SparkSession, d: str) -> DataFrame:
    """Paired comparison of two volatility forecasts by their daily losses (paired form of Diebold and Mariano's test)."""
    x = returns(spark, d).select("date", S.trailing_vol("lret", 5).alias("a"), S.trailing_vol("lret", 20).alias("b"), S.full(F.stddev_samp("lret"), "lret", 5, S.ahead(5)).alias("rv")).where("a is not null and b is not null and rv is not null")
    l = x.groupBy("date").agg(F.avg(F.abs(F.col("a") - F.col("rv"))).alias("la"), F.avg(F.abs(F.col("b") - F.col("rv"))).alias("lb"))
    gap = F.col("la") - F.col("lb")
    a = l.agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("m"), (F.stddev_samp(gap) / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count_if(gap < 0).alias("wins"))
    t = F.col("m") / F.col("se")
    return a.select("n", r("m", 8).alias("mean_difference"), r(t, 4).alias("dm"), r(two_sided(t), 5).alias("p_value"), "wins")


@query(
    f"""WITH {NEWS_SQL}, {_LABEL}, f AS (SELECT month(pub_date) AS fold, avg(pow(proba - y, 2)) AS loss FROM labelled GROUP BY 1), a AS (SELECT count(*) AS folds, avg(loss) AS m, stddev_samp(loss) AS s FROM f)
SELECT folds, {sql_r('m')} AS mean, {sql_r('s')} AS sd, {sql_r('m - 1.959964 * s / sqrt(folds)')} AS ci_low, {sql_r('m + 1.959964 * s / sqrt(folds)')} AS ci_high FROM a"""
)
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, spread and interval of a loss over monthly folds."""
    f = _labelled(spark, d).groupBy(F.month("pub_date").alias("fold")).agg(F.avg(F.pow(F.col("proba") - F.col("y"), F.lit(2))).alias("loss"))
    a = f.agg(F.count(F.lit(1)).alias("folds"), F.avg("loss").alias("m"), F.stddev_samp("loss").alias("s"))
    half = 1.959964 * F.col("s") / F.sqrt("folds")
    return a.select("folds", r("m").alias("mean"), r("s").alias("sd"), r(F.col("m") - half).alias("ci_low"), r(F.col("m") + half).alias("ci_high"))


_CONFUSION = "c AS (SELECT count(*) AS n, count(*) FILTER (proba >= 0.5 AND y = 1) AS tp, count(*) FILTER (proba >= 0.5 AND y = 0) AS fp, count(*) FILTER (proba < 0.5 AND y = 1) AS fn, count(*) FILTER (proba < 0.5 AND y = 0) AS tn FROM labelled)"


@query(
    f"""WITH {NEWS_SQL}, {_LABEL}, {_CONFUSION} SELECT n, tp, fp, fn, tn, {sql_r('(tp + tn) / n')} AS accuracy, {sql_r('tp / nullif(tp + fp, 0)')} AS "precision", {sql_r('tp / nullif(tp + fn, 0)')} AS recall, {sql_r('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1, {sql_r('fp / nullif(fp + tn, 0)')} AS false_positive_rate FROM c"""
)
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    """Confusion counts at one half with accuracy, precision, recall, F1 and false positive rate."""
    hit, y = F.col("proba") >= 0.5, F.col("y") == 1
    c = _labelled(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    over = lambda a, b: r(a / F.nullif(b, F.lit(0)))
    return c.select("n", "tp", "fp", "fn", "tn", r((tp + tn) / F.col("n")).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), over(fp, fp + tn).alias("false_positive_rate"))


@query(f"WITH {NEWS_SQL}, {_LABEL}, b AS (SELECT least(floor(proba * 10), 9) AS bin, count(*) AS n, avg(proba) AS s, avg(y) AS m FROM labelled GROUP BY 1) SELECT {sql_r('sum(n * abs(s - m)) / sum(n)')} AS ece FROM b")
def expected_calibration_error(spark: SparkSession, d: str) -> DataFrame:
    b = M.reliability_bins(_labelled(spark, d), "proba", "y")
    return b.agg(r(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_label"))) / F.sum("n")).alias("ece"))


@query(
    f"""WITH {NEWS_SQL}, {PANEL_SQL}, td AS (SELECT ticker, pub_date AS date, round(avg(proba), 9) AS mp FROM news GROUP BY ALL), x AS (SELECT td.mp, p.nxt FROM td JOIN (SELECT ticker, date, round(lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1, 12) AS nxt FROM panel) p ON p.ticker = td.ticker AND p.date = td.date WHERE nxt IS NOT NULL AND nxt <> 0 AND mp <> 0.5)
SELECT count(*) AS n, {sql_r('avg(CAST((mp > 0.5) = (nxt > 0) AS INT))')} AS directional_accuracy FROM x"""
)
def directional_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """How often a day's sentiment points the way the next day went."""
    td = news(spark, d).groupBy("ticker", F.col("pub_date").alias("date")).agg(F.round(F.avg("proba"), 9).alias("mp"))
    nxt = panel(spark, d).select("ticker", "date", F.round(F.lead("close").over(S.line()) / F.col("close") - 1, 12).alias("nxt"))
    x = td.join(nxt, ["ticker", "date"]).where("nxt is not null and nxt <> 0 and mp <> 0.5")
    return x.agg(F.count(F.lit(1)).alias("n"), r(F.avg(((F.col("mp") > 0.5) == (F.col("nxt") > 0)).cast("int"))).alias("directional_accuracy"))


@query(
    f"""WITH {PANEL_SQL}, h AS (SELECT unnest([1, 5, 10]) AS horizon), x AS (SELECT ticker, close, lead(close, 1) OVER w AS c1, lead(close, 5) OVER w AS c5, lead(close, 10) OVER w AS c10 FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)),
y AS (SELECT ticker, horizon, round((CASE horizon WHEN 1 THEN c1 WHEN 5 THEN c5 ELSE c10 END) / close - 1, 9) AS f FROM x, h)
SELECT ticker, horizon, count(f) AS n, {sql_r('quantile_cont(f, 0.5)')} AS median, {sql_r('avg(f)')} AS mean, {sql_r('avg(CAST(f > 0 AS INT))')} AS share_up FROM y WHERE f IS NOT NULL GROUP BY ticker, horizon"""
)
def forward_summary(spark: SparkSession, d: str) -> DataFrame:
    """Forward returns of each ticker per horizon: count, median, mean, share above zero."""
    wide = panel(spark, d).select("ticker", *[F.round(F.lead("close", h).over(S.line()) / F.col("close") - 1, 9).alias(str(h)) for h in (1, 5, 10)])
    x = wide.unpivot("ticker", ["1", "5", "10"], "horizon", "f").where("f is not null")
    return x.groupBy("ticker", F.col("horizon").cast("int").alias("horizon")).agg(F.count("f").alias("n"), r(F.percentile("f", 0.5)).alias("median"), r(F.avg("f")).alias("mean"), r(F.avg((F.col("f") > 0).cast("int"))).alias("share_up"))


@query(
    f"""WITH {NEWS_SQL}, t AS (SELECT ticker, pub_date, news_id, title, abs(proba - 0.5) AS s FROM news WHERE title <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY ticker, pub_date ORDER BY round(s, 9) DESC, news_id) AS rn FROM t)
SELECT ticker, {sql_day('pub_date')} AS day, news_id, title FROM k WHERE rn = 1"""
)
def top_headline(spark: SparkSession, d: str) -> DataFrame:
    """The headline with the strongest signal of each ticker and day; the earliest of equals."""
    s = F.round(F.abs(F.col("proba") - 0.5), 9)
    g = news(spark, d).where("title <> ''").groupBy("ticker", "pub_date").agg(F.max_by(F.struct("news_id", "title"), F.struct(s, -F.col("news_id"))).alias("b"))
    return g.select("ticker", day("pub_date").alias("day"), "b.news_id", "b.title")


@query(
    f"""WITH {RETURNS_SQL}, x AS (SELECT CASE WHEN count(lret) OVER f = 5 THEN stddev_samp(lret) OVER f END AS rv, CASE WHEN count(lret) OVER w5 = 5 THEN stddev_samp(lret) OVER w5 END AS a, CASE WHEN count(lret) OVER w10 = 10 THEN stddev_samp(lret) OVER w10 END AS b, CASE WHEN count(lret) OVER w20 = 20 THEN stddev_samp(lret) OVER w20 END AS c
 FROM rets WINDOW w5 AS ({W_SQL} 4 PRECEDING AND CURRENT ROW), w10 AS ({W_SQL} 9 PRECEDING AND CURRENT ROW), w20 AS ({W_SQL} 19 PRECEDING AND CURRENT ROW), f AS ({W_SQL} 1 FOLLOWING AND 5 FOLLOWING)),
y AS (SELECT rv, unnest([{{'model': 'vol5', 'v': a}}, {{'model': 'vol10', 'v': b}}, {{'model': 'vol20', 'v': c}}], recursive := true) FROM x WHERE rv IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL), l AS (SELECT model, count(*) AS n, avg(abs(rv - v)) AS loss FROM y GROUP BY model)
SELECT model, n, {sql_r('loss')} AS mae, row_number() OVER (ORDER BY loss, model) = 1 AS champion FROM l"""
)
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Candidate forecasts by their mean absolute error, the best marked."""
    x = returns(spark, d).select(S.full(F.stddev_samp("lret"), "lret", 5, S.ahead(5)).alias("rv"), *[S.trailing_vol("lret", n).alias(f"vol{n}") for n in (5, 10, 20)]).dropna()
    l = x.unpivot("rv", ["vol5", "vol10", "vol20"], "model", "v").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("rv") - F.col("v"))).alias("loss"))
    return l.select("model", "n", r("loss").alias("mae"), (F.row_number().over(Window.orderBy("loss", "model")) == 1).alias("champion"))  # three rows


# Assembled features

_MARKET_F = "CASE WHEN count(m) OVER (ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) = 22 THEN"


@query(
    f"""WITH {_LEVEL}, v AS (SELECT date, {_MARKET_F} stddev_samp(m) OVER (ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) END AS vix FROM index_line), w AS (SELECT date, vix, lag(vix, 5) OVER (ORDER BY date) AS v5, count(vix) OVER b AS n, avg(vix) OVER b AS base FROM v WINDOW b AS (ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW))
SELECT {sql_day('date')} AS day, {sql_r('vix', 8)} AS level, {sql_r('vix - v5', 8)} AS change_5d, {sql_r('CASE WHEN n = 22 THEN vix / base - 1 END')} AS slope FROM w"""
)
def market_vol_features(spark: SparkSession, d: str) -> DataFrame:
    """Level, five-day change and slope of the market's volatility; null without 22 valid days before."""
    line = Window.orderBy("date")  # one row a date
    b = line.rowsBetween(-21, 0)
    v = market_index(spark, d).select("date", S.full(F.stddev_samp("m"), "m", 22, b).alias("vix"))
    return v.select(day("date").alias("day"), r("vix", 8).alias("level"), r(F.col("vix") - F.lag("vix", 5).over(line), 8).alias("change_5d"), r(F.when(F.count("vix").over(b) == 22, F.col("vix") / F.avg("vix").over(b) - 1)).alias("slope"))


@query(
    f"""WITH {_LEVEL}, f AS (SELECT date, disp, disp - lag(disp, 5) OVER (ORDER BY date) AS d5, CASE WHEN count(disp) OVER b = 60 AND stddev_samp(disp) OVER b > 0 THEN (disp - avg(disp) OVER b) / stddev_samp(disp) OVER b END AS z, row_number() OVER (ORDER BY date) AS nth FROM index_line WINDOW b AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT r.ticker, {sql_day('r.date')} AS day, {sql_r('f.disp', 8)} AS disp, {sql_r('f.d5', 8)} AS disp_5d, {sql_r('f.z', 4)} AS disp_z60, {sql_r('f.z * r.lret * r.lret', 8)} AS z_x_rv1 FROM rets r JOIN f ON f.date = r.date WHERE f.nth > 65 AND f.z IS NOT NULL AND r.lret IS NOT NULL"""
)
def dispersion_features(spark: SparkSession, d: str) -> DataFrame:
    """Cross-sectional dispersion, its change and standing, and its product with the ticker's variance; the first 65 days are burn-in."""
    line = Window.orderBy("date")  # one row a date
    b = line.rowsBetween(-59, 0)
    z = F.when((F.count("disp").over(b) == 60) & (F.stddev_samp("disp").over(b) > 0), (F.col("disp") - F.avg("disp").over(b)) / F.stddev_samp("disp").over(b))
    f = market_index(spark, d).select("date", "disp", (F.col("disp") - F.lag("disp", 5).over(line)).alias("d5"), z.alias("z"), F.row_number().over(line).alias("nth")).where("nth > 65 and z is not null")
    x = returns(spark, d).where("lret is not null").select("ticker", "date", "lret").join(F.broadcast(f), "date")  # as many rows as trading days
    return x.select("ticker", day("date").alias("day"), r("disp", 8).alias("disp"), r("d5", 8).alias("disp_5d"), r("z", 4).alias("disp_z60"), r(F.col("z") * F.col("lret") * F.col("lret"), 8).alias("z_x_rv1"))


@query(
    f"""WITH {MARKET_SQL}, v AS (SELECT *, CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS vol20, close / lag(close, 5) OVER w - 1 AS mom5, close / lag(close, 20) OVER w - 1 AS mom20, CASE WHEN count(close) OVER w20 = 20 THEN close / avg(close) OVER w20 - 1 END AS dist20,
 CASE WHEN count(mkt) OVER w5 = 5 THEN exp(sum(ln(1 + mkt)) OVER w5) - 1 END AS mkt5, CASE WHEN count(mkt) OVER w20 = 20 THEN stddev_samp(mkt) OVER w20 END AS mvol20 FROM legs WINDOW w AS (PARTITION BY ticker ORDER BY date), w5 AS ({W_SQL} 4 PRECEDING AND CURRENT ROW), w20 AS ({W_SQL} 19 PRECEDING AND CURRENT ROW)), {NEWS_SQL},
dm AS (SELECT ticker, date, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS nxt, {', '.join(('mom5', 'mom20', 'vol20', 'dist20', 'mkt5', 'mvol20'))} FROM v)
SELECT n.news_id, {sql_day('dm.date')} AS context_day, {sql_r('mom5')} AS mom5, {sql_r('mom20')} AS mom20, {sql_r('vol20')} AS vol20, {sql_r('dist20')} AS dist20, {sql_r('mkt5')} AS mkt5, {sql_r('mvol20')} AS mvol20, {sql_r('mom5 - mkt5')} AS rel5
FROM news n JOIN dm ON dm.ticker = n.ticker AND dm.date < n.pub_date AND (dm.nxt IS NULL OR dm.nxt >= n.pub_date) WHERE date_diff('day', dm.date, n.pub_date) <= 40"""
)
def context_features(spark: SparkSession, d: str) -> DataFrame:
    """Seven features of the last trading day before publication: own momentum, volatility and distance, the market's, and the difference."""
    log_sum = F.sum(F.log(1 + F.col("mkt"))).over(S.back(5))
    v = legs(spark, d).select(
        "ticker", "date", S.momentum(5).alias("mom5"), S.momentum(20).alias("mom20"), S.trailing_vol("ret", 20).alias("vol20"), S.moving_average_distance(20).alias("dist20"),
        F.when(F.count("mkt").over(S.back(5)) == 5, F.exp(log_sum) - 1).alias("mkt5"), S.trailing_vol("mkt", 20).alias("mvol20"), F.lead("date").over(S.line()).alias("nxt"),
    )
    # One row a calendar day after each trading day, up to the next one (at most 40): an equi-join, whatever the number of articles.
    until = F.least(F.coalesce("nxt", F.date_add("date", 40)), F.date_add("date", 40))
    v = v.withColumn("pub_date", F.explode(F.sequence(F.date_add("date", 1), until)))
    x = news(spark, d).select("news_id", "ticker", "pub_date").join(v, ["ticker", "pub_date"])
    return x.select("news_id", day("date").alias("context_day"), *[r(c).alias(c) for c in ("mom5", "mom20", "vol20", "dist20", "mkt5", "mvol20")], r(F.col("mom5") - F.col("mkt5")).alias("rel5"))


@query(
    f"""WITH {PANEL_SQL}, t AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos FROM panel), e AS (SELECT ticker, date, pos FROM (SELECT *, abs(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) AS mv FROM t) WHERE mv IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY round(mv, 12) DESC, pos) = 1)
SELECT e.ticker, {sql_day('e.date')} AS event_day, {sql_day('t.date')} AS day, CAST(t.pos - e.pos AS INT) AS rel, t.close FROM e JOIN t ON t.ticker = e.ticker AND t.pos BETWEEN e.pos - 10 AND e.pos + 5"""
)
def timeline_window(spark: SparkSession, d: str) -> DataFrame:
    """Closes from ten days before to five days after each ticker's largest move."""
    t = panel(spark, d).select("ticker", "date", "close", F.row_number().over(S.line()).alias("pos"), F.round(F.abs(F.col("close") / F.lag("close").over(S.line()) - 1), 12).alias("mv"))
    e = t.where("mv is not null").groupBy("ticker").agg(F.max_by(F.struct("date", "pos"), F.struct("mv", -F.col("pos"))).alias("e")).select("ticker", F.col("e.date").alias("ed"), F.col("e.pos").alias("ep"))
    return t.join(e, "ticker").where("pos between ep - 10 and ep + 5").select("ticker", day("ed").alias("event_day"), day("date").alias("day"), (F.col("pos") - F.col("ep")).cast("int").alias("rel"), "close")


# Splits, pools, backtest


@query(
    f"""WITH {PANEL_SQL}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel))
SELECT {sql_day('date')} AS day, CASE WHEN pos <= floor(0.7 * n) THEN 'train' ELSE 'test' END AS part, pos <= floor(0.7 * n) AND pos > floor(0.7 * n) - ceil(0.2 * floor(0.7 * n)) AS calibration, CAST(ntile(6) OVER (ORDER BY date) AS INT) AS fold FROM c"""
)
def date_splits(spark: SparkSession, d: str) -> DataFrame:
    """70/30 split by date, the most recent fifth of training as calibration part, and six folds of equal length."""
    line = Window.orderBy("date")  # one row a date
    c = panel(spark, d).select("date").distinct().select("date", F.row_number().over(line).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"), F.ntile(6).over(line).alias("fold"))
    train = F.floor(0.7 * F.col("n"))
    return c.select(day("date").alias("day"), F.when(F.col("pos") <= train, "train").otherwise("test").alias("part"), ((F.col("pos") <= train) & (F.col("pos") > train - F.ceil(0.2 * train))).alias("calibration"), "fold")


@query(
    f"""WITH {NEWS_SQL}, {_LABEL}, n AS (SELECT count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0) AS b FROM labelled), c AS (SELECT l.*, CASE WHEN l.y = CAST(n.a < n.b AS INT) THEN greatest(1, CAST(floor(greatest(a, b) / least(a, b)) AS INT)) ELSE 1 END AS times FROM labelled l, n)
SELECT y, count(*) AS distinct_rows, CAST(sum(times) AS BIGINT) AS n_rows FROM c GROUP BY y"""
)
def oversample(spark: SparkSession, d: str) -> DataFrame:
    """The rarer label repeated a whole number of times, so that it comes nearest to the other from below."""
    x = _labelled(spark, d)
    n = F.broadcast(x.agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b")))  # one row
    rare = F.col("y") == (F.col("a") < F.col("b")).cast("int")
    times = F.when(rare, F.greatest(F.lit(1), F.floor(F.greatest("a", "b") / F.least("a", "b")).cast("int"))).otherwise(1)
    out = x.crossJoin(n).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return out.groupBy("y").agg(F.count_if(F.col("copy") == 1).alias("distinct_rows"), F.count(F.lit(1)).alias("n_rows"))


@query(
    f"""WITH {NEWS_SQL}, t AS (SELECT ticker, pub_date, count(*) AS n, arg_min(proba, (published_at, news_id)) AS p1, avg(proba) AS pm FROM news GROUP BY ALL)
SELECT ticker, {sql_day('pub_date')} AS day, {sql_r('p1')} AS first_policy, {sql_r('pm')} AS weight_policy FROM t"""
)
def dedupe_policies(spark: SparkSession, d: str) -> DataFrame:
    """A day's score by either policy: its first article, or all of them at equal weight."""
    g = news(spark, d).groupBy("ticker", "pub_date").agg(F.min_by("proba", F.struct("published_at", "news_id")).alias("p1"), F.avg("proba").alias("pm"))
    return g.select("ticker", day("pub_date").alias("day"), r("p1").alias("first_policy"), r("pm").alias("weight_policy"))


_FOLDS = """cal AS (SELECT date, ntile(6) OVER (ORDER BY date) AS fold FROM (SELECT DISTINCT date FROM panel)),
td AS (SELECT ticker, pub_date AS date, round(avg(proba), 9) AS mp FROM news GROUP BY ALL), sc AS (SELECT td.ticker, td.date, mp, fold FROM td JOIN cal ON cal.date = td.date),
cut AS (SELECT f.fold, quantile_cont(s.mp, 0.95) AS q FROM (SELECT DISTINCT fold FROM cal) f JOIN sc s ON s.fold < f.fold GROUP BY f.fold)"""


def _folded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sentiment of each ticker and day with its fold, and the threshold of each fold from strictly earlier folds."""
    cal = panel(spark, d).select("date").distinct().select("date", F.ntile(6).over(Window.orderBy("date")).alias("fold"))
    td = news(spark, d).groupBy("ticker", F.col("pub_date").alias("date")).agg(F.round(F.avg("proba"), 9).alias("mp"))
    sc = td.join(cal, "date")
    later = sc.select("mp", F.explode(F.sequence(F.col("fold") + 1, F.lit(7))).alias("fold")).where("fold <= 6")
    # Counts per score first: a fold's scores are never gathered in one task.
    seen = later.groupBy("fold", "mp").agg(F.count(F.lit(1)).alias("n"))
    cut = seen.groupBy("fold").agg(F.expr("percentile(mp, 0.95, n)").alias("q"))
    return sc, cut


@query(
    f"""WITH {RETURNS_SQL}, {NEWS_SQL}, {_FOLDS}, ent AS (SELECT sc.ticker, sc.date, sc.fold FROM sc JOIN cut ON cut.fold = sc.fold WHERE mp >= q), e AS (SELECT e.ticker, e.fold, r.pos FROM ent e JOIN rets r ON r.ticker = e.ticker AND r.date = e.date), held AS (SELECT DISTINCT ticker, fold, unnest(generate_series(pos + 1, pos + 3)) AS pos FROM e),
p AS (SELECT h.fold, r.date, avg(r.ret) AS ret FROM held h JOIN rets r ON r.ticker = h.ticker AND r.pos = h.pos WHERE r.ret IS NOT NULL GROUP BY h.fold, r.date)
SELECT CAST(fold AS INT) AS fold, count(*) AS days, {sql_r('avg(ret)')} AS mean_ret, {sql_r('exp(sum(ln(1 + ret))) - 1')} AS total FROM p GROUP BY fold"""
)
def backtest_folds(spark: SparkSession, d: str) -> DataFrame:
    """Walk-forward backtest: a warm-up block, entry where sentiment reaches the 0.95 quantile of all earlier folds, held for three trading days."""
    sc, cut = _folded(spark, d)
    rets = returns(spark, d).select("ticker", "date", "ret", (F.row_number().over(S.line()) - 1).alias("pos"))
    ent = sc.join(F.broadcast(cut), "fold").where("mp >= q").join(rets.select("ticker", "date", "pos"), ["ticker", "date"])  # five thresholds
    held = ent.select("ticker", "fold", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + 3)).alias("pos")).distinct()
    p = held.join(rets.where("ret is not null"), ["ticker", "pos"]).groupBy("fold", "date").agg(F.avg("ret").alias("ret"))
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("days"), r(F.avg("ret")).alias("mean_ret"), r(F.exp(F.sum(F.log(1 + F.col("ret")))) - 1).alias("total"))


@query(
    f"""WITH {RETURNS_SQL}, {NEWS_SQL}, {_FOLDS}, k AS (SELECT sc.fold, count(*) AS n FROM sc JOIN cut ON cut.fold = sc.fold WHERE mp >= q GROUP BY sc.fold), t AS (SELECT r.ticker, r.date, c.fold, row_number() OVER (PARTITION BY c.fold ORDER BY (hash0 * 48271 + r.pos * 16807) % 2147483647, r.ticker, r.pos) AS rn
  FROM (SELECT *, CAST(length(ticker) * 7919 + ascii(ticker) * 104729 AS BIGINT) AS hash0 FROM rets) r JOIN cal c ON c.date = r.date WHERE c.fold > 1)
SELECT t.ticker, {sql_day('t.date')} AS day, CAST(t.fold AS INT) AS fold FROM t JOIN k ON k.fold = t.fold WHERE t.rn <= k.n"""
)
def random_pool(spark: SparkSession, d: str) -> DataFrame:
    """As many random entries in each fold as the signal makes, from all tickers and days: the backtest's null arm."""
    sc, cut = _folded(spark, d)
    k = sc.join(F.broadcast(cut), "fold").where("mp >= q").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    cal = panel(spark, d).select("date").distinct().select("date", F.ntile(6).over(Window.orderBy("date")).alias("fold")).where("fold > 1")
    x = returns(spark, d).select("ticker", "date", (F.row_number().over(S.line()) - 1).alias("pos")).join(F.broadcast(cal), "date")  # a row per trading date
    h = ((F.length("ticker") * 7919 + F.ascii("ticker") * 104729).cast("bigint") * 48271 + F.col("pos") * 16807) % 2147483647
    t = x.withColumn("rn", F.row_number().over(Window.partitionBy("fold").orderBy(h, "ticker", "pos")))  # price rows of two months
    return t.join(F.broadcast(k), "fold").where("rn <= n").select("ticker", day("date").alias("day"), "fold")


# Parsers and text


@query(
    r"""WITH q AS (SELECT news_id, query FROM news_raw WHERE query IS NOT NULL) SELECT news_id, nullif(regexp_extract(query, '"([^"]+)"', 1), '') AS phrase, len(regexp_extract_all(query, '[A-Za-z0-9]+')) AS terms, regexp_matches(query, '\bOR\b') AS any_of FROM q"""
)
def query_filters(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the search expression an article was fetched by: quoted phrase, number of terms, whether any of several."""
    q = table(spark, d, "news_raw").where("query is not null")
    return q.select("news_id", F.nullif(F.regexp_extract("query", r'"([^"]+)"', 1), F.lit("")).alias("phrase"), F.size(F.regexp_extract_all("query", F.lit(r"([A-Za-z0-9]+)"), F.lit(1))).cast("bigint").alias("terms"), F.col("query").rlike(r"\bOR\b").alias("any_of"))


@query(
    """WITH c AS (SELECT news_id, strftime(published_at AT TIME ZONE 'UTC', '%Y%m%dT%H%M%SZ') AS s FROM news_raw WHERE published_at IS NOT NULL), m AS (SELECT news_id, CASE WHEN news_id % 7 = 0 THEN replace(s, 'T', ' ') ELSE s END AS s FROM c)
SELECT news_id, s AS text, strftime(try_strptime(s, '%Y%m%dT%H%M%SZ'), '%Y-%m-%d %H:%M:%S') AS parsed FROM m"""
)
def compact_datetime(spark: SparkSession, d: str) -> DataFrame:
    """Compact timestamps read strictly; malformed ones give null."""
    s = F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'")
    m = table(spark, d, "news_raw").where("published_at is not null").select("news_id", F.when(F.col("news_id") % 7 == 0, F.replace(s, F.lit("T"), F.lit(" "))).otherwise(s).alias("text"))
    return m.select("news_id", "text", F.date_format(F.try_to_timestamp("text", F.lit("yyyyMMdd'T'HHmmss'Z'")), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query(
    f"""WITH {PANEL_SQL}, s AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM panel GROUP BY ticker), k AS (SELECT unnest(range(0, 4)) AS i)
SELECT ticker, CAST(i AS INT) AS chunk, {sql_day('lo + CAST(floor((date_diff(\'day\', lo, hi) + 1) * i / 4) AS INT)')} AS first_day, {sql_day('lo + CAST(floor((date_diff(\'day\', lo, hi) + 1) * (i + 1) / 4) AS INT) - 1')} AS last_day FROM s, k WHERE date_diff('day', lo, hi) >= 3"""
)
def date_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each ticker's span in four contiguous windows without gap or overlap."""
    s = panel(spark, d).groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where(F.datediff("hi", "lo") >= 3)
    s = s.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(3))))
    edge = lambda i: F.floor((F.datediff("hi", "lo") + 1) * i / 4).cast("int")
    return s.select("ticker", "chunk", day(F.date_add("lo", edge(F.col("chunk")))).alias("first_day"), day(F.date_add("lo", edge(F.col("chunk") + 1) - 1)).alias("last_day"))


@query("""SELECT ticker, '"' || company || '" (' || ticker || ' OR shares) sourcelang:english' AS text FROM universe WHERE ticker IS NOT NULL AND company IS NOT NULL""")
def query_text(spark: SparkSession, d: str) -> DataFrame:
    """Search expression of each listed company."""
    return table(spark, d, "universe").where("ticker is not null and company is not null").select("ticker", F.format_string('"%s" (%s OR shares) sourcelang:english', "company", "ticker").alias("text"))


@query(
    r"""WITH t AS (SELECT company, trim(regexp_replace(regexp_replace(lower(company), '[^a-z0-9 ]+', ' ', 'g'), '\b(inc|corp|corporation|company|co|ltd|limited|plc|group|holdings|holding|ag|sa|se|nv)\b', ' ', 'g')) AS s, ticker FROM universe WHERE company IS NOT NULL)
SELECT ticker, regexp_replace(s, ' +', ' ', 'g') AS name FROM t"""
)
def organisation_names(spark: SparkSession, d: str) -> DataFrame:
    """Company names without legal forms and punctuation."""
    s = F.regexp_replace(F.lower("company"), r"[^a-z0-9 ]+", " ")
    s = F.regexp_replace(s, r"\b(inc|corp|corporation|company|co|ltd|limited|plc|group|holdings|holding|ag|sa|se|nv)\b", " ")
    return table(spark, d, "universe").where("company is not null").select("ticker", F.regexp_replace(F.trim(s), " +", " ").alias("name"))


@query(
    """WITH c AS (SELECT ticker, count(*) FILTER (alias IS NOT NULL) AS n FROM aliases WHERE ticker IS NOT NULL GROUP BY ticker), a AS (SELECT ticker FROM c WHERE n >= 3), b AS (SELECT ticker FROM c WHERE n >= 6)
SELECT ticker, ticker IN (SELECT ticker FROM b) AS kept, ticker NOT IN (SELECT ticker FROM b) AS removed FROM a"""
)
def watchlist_changes(spark: SparkSession, d: str) -> DataFrame:
    """A watchlist after a stricter rule: who stays, who goes."""
    c = table(spark, d, "aliases").where("ticker is not null").groupBy("ticker").agg(F.count("alias").alias("n")).where("n >= 3")
    return c.select("ticker", (F.col("n") >= 6).alias("kept"), (F.col("n") < 6).alias("removed"))


# Names in texts


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Listed aliases and company names in the articles; an alias of one word may be a common word and is ambiguous."""
    listed = table(spark, d, "aliases").where("ticker is not null").select("alias", "ticker")
    names = listed.union(table(spark, d, "universe").select("company", "ticker")).withColumn("ambiguous", F.size(E.words(F.col("alias"))) == 1)
    texts = table(spark, d, "news_raw").select("news_id", T.article_text(F.col("title"), F.col("body_snippet")).alias("text"))
    return E.entity_mentions(texts, names, id="news_id", text="text")


@query()
def entity_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of a listed name in an article (greedy by length, which SQL can't say; tested against brute force)."""
    return _mentions(spark, d)


@query()
def ticker_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Ticker of each article: its surest mention, else the one it was fetched for."""
    best = E.best_mention(_mentions(spark, d), "news_id")
    n = table(spark, d, "news_raw").select("news_id", F.col("ticker").alias("fetched_for"))
    return n.join(best, "news_id", "left").select("news_id", F.coalesce("ticker", "fetched_for").alias("ticker"), "confidence")


@query()
def entity_prf(spark: SparkSession, d: str) -> DataFrame:
    """Mentions against the tickers the articles were fetched for."""
    gold = table(spark, d, "news_raw").where("ticker is not null").select("news_id", "ticker")
    found = _mentions(spark, d).join(gold.select("news_id"), "news_id", "left_semi")
    return E.set_scores(gold, found, "news_id").select("tp", "fp", "fn", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"))


_TAGS = "regexp_replace(" * 5 + "text" + "".join(f", '(?is)<{t}\\b.*?</{t}>', ' ', 'g')" for t in ("script", "style", "nav", "header", "footer"))


@query(rf"SELECT doc_id, md5(substring(trim(regexp_replace(regexp_replace({_TAGS}, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')), 1, 600)) AS snippet FROM documents WHERE text IS NOT NULL")
def html_snippet(spark: SparkSession, d: str) -> DataFrame:
    """Lead of each document's visible text, as a digest (600 characters are the feature)."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.visible_text(F.col("text"))).alias("snippet"))


@query(
    r"""WITH s AS (SELECT news_id, list_distinct(regexp_extract_all(lower(title), '[a-z]+')) AS q, string_split(regexp_replace(body_snippet, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM news_raw WHERE title <> '' AND body_snippet <> ''),
p AS (SELECT news_id, q, unnest(parts) AS part, generate_subscripts(parts, 1) AS spot FROM s), h AS (SELECT news_id, spot, len(list_intersect(q, list_distinct(regexp_extract_all(lower(part), '[a-z]+')))) AS hits FROM p WHERE length(part) > 40),
k AS (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY hits DESC, spot) AS place FROM h) SELECT news_id, CAST(place AS INT) AS place, CAST(spot AS INT) AS sentence, CAST(hits AS INT) AS hits FROM k WHERE place <= 2"""
)
def top_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The two sentences of each article that hold most words of its title (a top-k report, found within the row)."""
    n = table(spark, d, "news_raw").where("title <> '' and body_snippet <> ''")
    low = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    parts = F.split(F.regexp_replace("body_snippet", r"([.!?])\s+", "$1\u0001"), "\u0001")
    x = n.select("news_id", low(F.col("title")).alias("q"), F.transform(parts, lambda s, i: F.struct(s.alias("s"), (i + 1).alias("at"))).alias("parts"))
    x = x.select("news_id", "q", F.filter("parts", lambda p: F.length(p["s"]) > 40).alias("parts"))
    scored = F.array_sort(F.transform("parts", lambda p: F.struct((-F.size(F.array_intersect("q", low(p["s"])))).alias("o"), p["at"].alias("at"))))
    return x.select("news_id", F.posexplode(F.slice(scored, 1, 2)).alias("place", "p")).select("news_id", (F.col("place") + 1).alias("place"), F.col("p.at").alias("sentence"), (-F.col("p.o")).alias("hits"))


# Work lists, explanations, further feature sets


@query(
    f"""WITH {NEWS_SQL}, q AS (SELECT unnest([1, 2, 3, 4]) AS quarter), w AS (SELECT ticker, quarter FROM universe, q WHERE ticker IS NOT NULL)
SELECT ticker, CAST(quarter AS INT) AS quarter FROM w WHERE NOT EXISTS (SELECT 1 FROM news n WHERE n.ticker = w.ticker AND quarter(n.pub_date) = w.quarter)"""
)
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    """Quarters of each listed ticker still to be fetched: those without an article (what a resumed ingest works off)."""
    w = table(spark, d, "universe").where("ticker is not null").select("ticker", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("quarter"))
    return w.join(news(spark, d).select("ticker", F.quarter("pub_date").alias("quarter")), ["ticker", "quarter"], "left_anti")


_MOVE = "mv AS (SELECT ticker, date FROM (SELECT ticker, date, round(abs(ret), 12) AS a, pos FROM rets WHERE ret IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY a DESC, pos) = 1)"


@query(
    f"""WITH {RETURNS_SQL}, {NEWS_SQL}, {_MOVE}, k AS (SELECT m.ticker, m.date, n.news_id, trim(coalesce(n.title, '') || ' ' || coalesce(n.body_snippet, '')) AS text, row_number() OVER (PARTITION BY m.ticker ORDER BY abs(date_diff('day', n.pub_date, m.date)), n.news_id) AS k
 FROM mv m JOIN news n ON n.ticker = m.ticker AND n.pub_date BETWEEN m.date - INTERVAL 1 DAY AND m.date + INTERVAL 1 DAY)
SELECT ticker, {sql_day('date')} AS move_day, CAST(k AS INT) AS cite, news_id, '[' || k || '] ' || substring(text, 1, 220) AS quote FROM k WHERE k <= 6"""
)
def cited_explanation(spark: SparkSession, d: str) -> DataFrame:
    """Up to six quotes, each with its number, from the articles around every ticker's largest move."""
    m = returns(spark, d).where("ret is not null").withColumn("a", F.round(F.abs("ret"), 12)).groupBy("ticker").agg(F.max_by("date", F.struct("a", -F.datediff("date", F.lit("1970-01-01")))).alias("date"))
    days = m.select("ticker", "date", F.explode(F.sequence(F.date_sub("date", 1), F.date_add("date", 1))).alias("pub_date"))
    n = news(spark, d).select("news_id", "ticker", "pub_date", T.article_text(F.col("title"), F.col("body_snippet")).alias("text"))
    # The first six by an array of bounded length per ticker and day, then over its three days.
    x = days.join(n, ["ticker", "pub_date"]).select("ticker", "date", F.struct(F.abs(F.datediff("pub_date", "date")).alias("far"), "news_id", F.substring("text", 1, 220).alias("text")).alias("s"))
    top = x.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("s.far", "s.news_id"))).where("k <= 6")  # articles of three days
    return top.select("ticker", day("date").alias("move_day"), F.col("k").alias("cite"), "s.news_id", F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] "), F.col("s.text")).alias("quote"))


@query(
    f"""WITH {_LEVEL}, v AS (SELECT date, m * m AS r2 FROM index_line)
SELECT {sql_day('date')} AS day, {sql_r('r2', 8)} AS rv_1d, {sql_r('CASE WHEN count(r2) OVER w5 = 5 THEN avg(r2) OVER w5 END', 8)} AS rv_5d, {sql_r('CASE WHEN count(r2) OVER w22 = 22 THEN avg(r2) OVER w22 END', 8)} AS rv_22d,
 {', '.join(f"CAST(isodow(date) = {k} AS INT) AS {n}" for k, n in enumerate(('mon', 'tue', 'wed', 'thu', 'fri'), 1))} FROM v WINDOW w5 AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w22 AS (ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)"""
)
def market_leg_features(spark: SparkSession, d: str) -> DataFrame:
    """The market's legs of the variance regression, with the weekday as indicators: one row a date."""
    line = Window.orderBy("date")
    v = market_index(spark, d).select("date", (F.col("m") * F.col("m")).alias("r2"))
    leg = lambda n: r(S.full(F.avg("r2"), "r2", n, line.rowsBetween(1 - n, 0)), 8).alias(f"rv_{n}d")
    return v.select(day("date").alias("day"), r("r2", 8).alias("rv_1d"), leg(5), leg(22), *[(F.weekday("date") == k).cast("int").alias(n) for k, n in enumerate(("mon", "tue", "wed", "thu", "fri"))])


@query(
    f"""WITH {RETURNS_SQL}, t AS (SELECT ticker, date, lret, CASE WHEN count(lret) OVER w5 = 5 THEN stddev_samp(lret) OVER w5 END AS vol5, CASE WHEN count(lret) OVER w22 = 22 THEN stddev_samp(lret) OVER w22 END AS vol22, CASE WHEN count(lret) OVER w252 >= 60 THEN quantile_cont(lret, 0.05) OVER w252 END AS q05,
 close / max(close) OVER w22 - 1 AS drawdown, CASE WHEN open > 0 THEN open / lag(close) OVER w - 1 END AS gap, CASE WHEN high > 0 AND low > 0 THEN ln(high / low) END AS span, CASE WHEN count(volume) OVER w22 = 22 AND avg(volume) OVER w22 > 0 THEN volume / avg(volume) OVER w22 END AS turnover
 FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date), w5 AS ({W_SQL} 4 PRECEDING AND CURRENT ROW), w22 AS ({W_SQL} 21 PRECEDING AND CURRENT ROW), w252 AS ({W_SQL} 251 PRECEDING AND CURRENT ROW))
SELECT ticker, {sql_day('date')} AS day, {', '.join(f"{sql_r(c)} AS {c}" for c in ('lret', 'vol5', 'vol22', 'q05', 'drawdown', 'gap', 'span'))}, {sql_r('turnover', 4)} AS turnover FROM t WHERE vol22 IS NOT NULL AND q05 IS NOT NULL"""
)
def tail_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of the lower tail, for the days that have their whole past: return, volatilities, trailing quantile, drawdown, gap, span, turnover."""
    b = S.back(22)
    ok = (F.count("volume").over(b) == 22) & (F.avg("volume").over(b) > 0)
    t = returns(spark, d).select(
        "ticker", "date", "lret", S.trailing_vol("lret", 5).alias("vol5"), S.trailing_vol("lret", 22).alias("vol22"), F.when(F.count("lret").over(S.back(252)) >= 60, F.percentile("lret", 0.05).over(S.back(252))).alias("q05"),
        (F.col("close") / F.max("close").over(b) - 1).alias("drawdown"), F.when(F.col("open") > 0, F.col("open") / F.lag("close").over(S.line()) - 1).alias("gap"), F.when((F.col("high") > 0) & (F.col("low") > 0), F.log(F.col("high") / F.col("low"))).alias("span"), F.when(ok, F.col("volume") / F.avg("volume").over(b)).alias("turnover"),
    )
    return t.where("vol22 is not null and q05 is not null").select("ticker", day("date").alias("day"), *[r(c).alias(c) for c in ("lret", "vol5", "vol22", "q05", "drawdown", "gap", "span")], r("turnover", 4).alias("turnover"))


@query(
    f"""WITH {PANEL_SQL}, cal AS (SELECT date, ntile(6) OVER (ORDER BY date) AS fold FROM (SELECT DISTINCT date FROM panel)), x AS (SELECT p.ticker, p.date, c.fold, round(p.f, 4) AS f FROM (SELECT ticker, date, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS f FROM panel) p JOIN cal c ON c.date = p.date WHERE f IS NOT NULL),
cut AS (SELECT g.fold, quantile_cont(x.f, 0.7) AS hi, quantile_cont(x.f, 0.3) AS lo FROM (SELECT DISTINCT fold FROM cal) g JOIN x ON x.fold < g.fold GROUP BY g.fold)
SELECT CAST(x.fold AS INT) AS fold, count(*) AS n, count(*) FILTER (f >= hi) AS positive, count(*) FILTER (f <= lo) AS negative, count(*) FILTER (f < hi AND f > lo) AS abstained FROM x JOIN cut ON cut.fold = x.fold GROUP BY x.fold"""
)
def fold_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of five-day returns by the 0.7 and 0.3 quantiles of strictly earlier folds; what lies between abstains."""
    p = panel(spark, d)
    cal = p.select("date").distinct().select("date", F.ntile(6).over(Window.orderBy("date")).alias("fold"))
    x = p.select("ticker", "date", F.round(F.lead("close", 5).over(S.line()) / F.col("close") - 1, 4).alias("f")).where("f is not null").join(F.broadcast(cal), "date")  # one row a date
    # Counts per value first: what a quantile sees is bounded by the number of different rounded returns.
    seen = x.groupBy("fold", "f").agg(F.count(F.lit(1)).alias("n")).select("f", "n", F.explode(F.sequence(F.col("fold") + 1, F.lit(7))).alias("fold")).where("fold <= 6").groupBy("fold", "f").agg(F.sum("n").alias("n"))
    cut = seen.groupBy("fold").agg(F.expr("percentile(f, 0.7, n)").alias("hi"), F.expr("percentile(f, 0.3, n)").alias("lo"))
    f = F.col("f")
    return x.join(F.broadcast(cut), "fold").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(f >= F.col("hi")).alias("positive"), F.count_if(f <= F.col("lo")).alias("negative"), F.count_if((f < F.col("hi")) & (f > F.col("lo"))).alias("abstained"))
