"""Reference queries with splits, models, retrieval of analogues and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators import series as S
from tidemark.operators.calendars import plus_trading_days, session_t0, union_calendar
from tidemark.operators.splits import SplitConfig, walk_forward
from tidemark.plans.articles import _LABEL, _labelled
from tidemark.plans.common import DAYMAP_SQL, MARKET_SQL, NEWS_SQL, RETURNS_SQL, day, news, panel, r, returns, sql_day, sql_r
from tidemark.session import cut, shared_dir, table
from tidemark.streaming.poll import article_stream, poll

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_T01 = f"""{DAYMAP_SQL}, {NEWS_SQL}, ahead AS (SELECT ticker, date, lead(date, 5) OVER (PARTITION BY ticker ORDER BY date) AS t1 FROM panel),
l AS (SELECT news_id, ticker, published_at AT TIME ZONE 'America/New_York' AS local FROM news),
ev0 AS (SELECT l.news_id, l.ticker, CASE WHEN hour(l.local) * 60 + minute(l.local) < 570 THEN m.before ELSE m.at_or_before END AS t0 FROM l JOIN daymap m ON m.ticker = l.ticker AND m.day = CAST(l.local AS DATE)),
ev AS (SELECT e.news_id, e.t0, a.t1 FROM ev0 e JOIN ahead a ON a.ticker = e.ticker AND a.date = e.t0 WHERE a.t1 IS NOT NULL)"""


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = panel(spark, d)
    x = session_t0(news(spark, d).select("news_id", "ticker", "published_at"), p, time="published_at")
    return plus_trading_days(x, p, day="t0", horizon=5).where("t0 is not null and t1 is not null").select("news_id", "t0", "t1"), union_calendar(p)


@query(
    f"""WITH {_T01}, per AS (SELECT t0 AS d, count(*) AS n FROM ev GROUP BY 1), c AS (SELECT d, sum(n) OVER (ORDER BY d) - n AS before, sum(n) OVER () AS total FROM per),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS fold), st AS (SELECT fold, min(d) AS s FROM c, f WHERE before >= round_even(total * fold / 6.0, 0) GROUP BY fold),
b AS (SELECT fold, s, lead(s) OVER (ORDER BY fold) AS nxt FROM st), e AS (SELECT fold, s, nxt, (SELECT max(d) FROM per WHERE d >= s AND (nxt IS NULL OR d < nxt)) AS te FROM b),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM panel)),
g AS (SELECT e.*, coalesce((SELECT c2.date FROM cal c1 JOIN cal c2 ON c2.pos = c1.pos + 5 WHERE c1.date = e.te), DATE '9999-12-31') AS em FROM e)
SELECT fold, role, count(*) AS n FROM (SELECT g.fold, CASE WHEN t0 >= s AND (nxt IS NULL OR t0 < nxt) THEN 'test' WHEN t0 < s AND t1 >= s THEN 'purged'
  WHEN t0 < s AND EXISTS (SELECT 1 FROM g h WHERE h.fold < g.fold AND ev.t0 > h.te AND ev.t0 <= h.em) THEN 'embargoed' WHEN t0 < s THEN 'train' END AS role FROM ev, g) WHERE role IS NOT NULL GROUP BY ALL"""
)
def walk_forward_folds(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the roles in five expanding folds, purged and embargoed."""
    ev, calendar = _events(spark, d)
    return walk_forward(ev, calendar, SplitConfig(5, 5), id="news_id").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_T01}, per AS (SELECT t0 AS d, count(*) AS n FROM ev GROUP BY 1), c AS (SELECT d, sum(n) OVER (ORDER BY d) - n AS before, sum(n) OVER () AS total FROM per), s AS (SELECT min(d) AS s FROM c WHERE before >= total * 0.8)
SELECT CASE WHEN t0 >= s THEN 'test' WHEN t1 >= s THEN 'purged' ELSE 'train' END AS role, count(*) AS n FROM ev, s GROUP BY 1"""
)
def purged_split(spark: SparkSession, d: str) -> DataFrame:
    """One split: the last fifth tests, labels reaching into it are purged."""
    ev, _ = _events(spark, d)
    per = ev.groupBy("t0").agg(F.count(F.lit(1)).alias("n"))
    line = Window.orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    start = per.select("t0", (F.sum("n").over(line) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total")).where("before >= total * 0.8").agg(F.min("t0").alias("s"))
    role = F.when(F.col("t0") >= F.col("s"), "test").when(F.col("t1") >= F.col("s"), "purged").otherwise("train")
    return ev.crossJoin(F.broadcast(start)).groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"))  # one row


_HAR = ["rv1", "rv5", "rv22"]


def _har(spark: SparkSession, d: str) -> DataFrame:
    x = returns(spark, d).withColumn("r2", F.col("lret") * F.col("lret"))
    x = x.select("ticker", "date", S.forward_vol("lret", 5).alias("y"), F.sqrt("r2").alias("rv1"), F.sqrt(S.full(F.avg("r2"), "r2", 5, S.back(5))).alias("rv5"), F.sqrt(S.full(F.avg("r2"), "r2", 22, S.back(22))).alias("rv22"))
    return x.dropna(subset=["y", *_HAR])


@query()
def ridge_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Heterogeneous autoregression of forward volatility: fitted on the first eight months, mean losses after it."""
    x = cut(_har(spark, d))
    fit = M.ridge(x.where("date < date'2025-09-01'"), _HAR, "y")
    out = M.ridge_predict(x.where("date >= date'2025-09-01'"), _HAR, fit, floor=1e-4)
    return out.agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.pow(F.col("y") - F.col("forecast"), F.lit(2))), 8).alias("mse"), r(F.avg(F.abs(F.col("y") - F.col("forecast")))).alias("mae"))


@query()
def logreg_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Class-balanced logistic regression of the label on score and lexicon counts, then both calibrations, as mean scores per label."""
    from tidemark.operators import textual as T

    w = T.tokens(T.article_text(F.col("title"), F.col("body_snippet")))
    x = cut(_labelled(spark, d).withColumns({"score": F.col("proba").cast("double"), "pos": T.in_list(w, T.POSITIVE).cast("double"), "neg": T.in_list(w, T.NEGATIVE).cast("double")}).select("news_id", "pub_date", "score", "pos", "neg", "y"))
    cols = ["score", "pos", "neg"]
    model = M.logistic(x.where("pub_date < date'2025-08-01'"), cols, "y")
    scored = M.logistic_scores(model, x.where("pub_date >= date'2025-08-01'"), cols).select("news_id", "pub_date", "proba", "y")
    out = M.calibrated(scored.where("pub_date < date'2025-10-01'"), scored.where("pub_date >= date'2025-10-01'"), "proba", "y")
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[r(F.avg(c), 4).alias(c) for c in ("proba", "platt", "isotonic")])


@query(
    f"""WITH {NEWS_SQL}, {_LABEL}, x AS (SELECT pub_date, CAST(proba AS DOUBLE) AS p, y FROM labelled), cal AS (SELECT CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM x WHERE pub_date < DATE '2025-10-01'),
k AS (SELECT least(ceil((count(*) + 1) * 0.9), count(*)) AS k FROM cal), q AS (SELECT s AS q FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn FROM cal), k WHERE rn = k)
SELECT CAST(1 - p <= q AS INT) + CAST(p <= q AS INT) AS set_size, count(*) AS n, {sql_r('avg(CAST(CASE WHEN y = 1 THEN 1 - p <= q ELSE p <= q END AS INT))', 4)} AS coverage FROM x, q WHERE pub_date >= DATE '2025-10-01' GROUP BY 1"""
)
def conformal_sets(spark: SparkSession, d: str) -> DataFrame:
    """Split-conformal label sets at 90 per cent: sizes and coverage after the calibration months."""
    x = _labelled(spark, d).select("pub_date", F.col("proba").cast("double").alias("p"), "y")
    score = F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p"))
    cal = x.where("pub_date < date'2025-10-01'").select(score.alias("s"))
    k = cal.agg(F.least(F.ceil((F.count(F.lit(1)) + 1) * 0.9), F.count(F.lit(1))).alias("k"), F.count(F.lit(1)).alias("n"))
    # Order statistic from counts per distinct score.
    per = cal.groupBy("s").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
    q = per.crossJoin(F.broadcast(k)).where("upto >= k").agg(F.min("s").alias("q"))  # one row
    t = x.where("pub_date >= date'2025-10-01'").crossJoin(F.broadcast(q))
    one, zero = (1 - F.col("p")) <= F.col("q"), F.col("p") <= F.col("q")
    size = one.cast("int") + zero.cast("int")
    return t.groupBy(size.alias("set_size")).agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.when(F.col("y") == 1, one).otherwise(zero).cast("int")), 4).alias("coverage"))


@query()
def volatility_fits(spark: SparkSession, d: str) -> DataFrame:
    """GARCH, filtered-history and CAViaR forecasts per ticker (tolerance checks only)."""
    return M.volatility_forecasts(returns(spark, d)).select("ticker", "n", "fallback", r("variance", 8).alias("variance"), r("hs_q05", 5).alias("hs_q05"), r("caviar_q05", 5).alias("caviar_q05"))


@query()
def bootstrap_sharpe(spark: SparkSession, d: str) -> DataFrame:
    """Sharpe difference of the signal strategy and the market leg with its interval; one row per trading date reaches the driver."""
    from tidemark.plans.articles import _pnl

    daily = _pnl(spark, d).join(S.market_leg(returns(spark, d)), "date").dropna().orderBy("date").toPandas()
    diff, lo, hi = M.bootstrap_sharpe_difference(daily, "pnl", "mkt")
    return spark.createDataFrame([(len(daily), round(diff, 4), round(lo, 4), round(hi, 4))], "days int, difference double, low double, high double")


@query()
def confidence_set(spark: SparkSession, d: str) -> DataFrame:
    """Model confidence set of three volatility forecasts on mean daily losses."""
    x = _har(spark, d).withColumn("mean", F.avg("y").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -6)))
    loss = lambda c: F.avg(F.pow(F.col("y") - F.col(c), F.lit(2))).alias(c)
    daily = x.dropna().groupBy("date").agg(loss("rv5"), loss("rv22"), loss("mean")).orderBy("date").toPandas().drop(columns="date")
    kept = M.model_confidence_set(daily) if len(daily) else []
    return spark.createDataFrame([(m, m in kept) for m in ("rv5", "rv22", "mean")], "model string, kept boolean")


@query(
    f"""WITH {MARKET_SQL}, {NEWS_SQL}, f AS (SELECT ticker, date, ret, abs(ret) AS mag, volume / nullif(avg(volume) OVER w, 0) AS rv, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS nxt FROM legs WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
e AS (SELECT f.* FROM f JOIN (SELECT ticker, pub_date AS date, count(*) AS n FROM news GROUP BY ALL HAVING count(*) >= 2) n USING (ticker, date) WHERE ret IS NOT NULL AND rv IS NOT NULL),
z AS (SELECT ticker, date, nxt, (ret - avg(ret) OVER t) / coalesce(nullif(stddev_pop(ret) OVER t, 0), 1) AS a, (rv - avg(rv) OVER t) / coalesce(nullif(stddev_pop(rv) OVER t, 0), 1) AS b FROM e WINDOW t AS (PARTITION BY ticker)),
q AS (SELECT ticker, max(date) AS qd FROM e GROUP BY ticker), k AS (SELECT z.ticker, z.date, z.nxt, sqrt(pow(z.a - x.a, 2) + pow(z.b - x.b, 2)) AS dist FROM z JOIN q USING (ticker) JOIN z x ON x.ticker = z.ticker AND x.date = q.qd WHERE z.date < q.qd)
SELECT ticker, {sql_day('date')} AS day, CAST(rn AS INT) AS rank, {sql_r('dist', 4)} AS distance, {sql_r('nxt')} AS next_5d FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(dist, 9), date) AS rn FROM k) WHERE rn <= 5"""
)
def analogues(spark: SparkSession, d: str) -> DataFrame:
    """Per ticker, the five earlier busy days most like its last one, with what followed."""
    x = returns(spark, d)
    before = S.line().rowsBetween(-20, -1)
    x = x.select("ticker", "date", "ret", (F.col("volume") / F.nullif(F.avg("volume").over(before), F.lit(0.0))).alias("rv"), (F.lead("close", 5).over(S.line()) / F.col("close") - 1).alias("nxt"))
    busy = news(spark, d).groupBy("ticker", F.col("pub_date").alias("date")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    e = x.join(busy, ["ticker", "date"]).where("ret is not null and rv is not null")
    t = Window.partitionBy("ticker")  # one row per busy day
    z = lambda c: (F.col(c) - F.avg(c).over(t)) / F.coalesce(F.nullif(F.stddev_pop(c).over(t), F.lit(0.0)), F.lit(1.0))
    e = e.select("ticker", "date", "nxt", z("ret").alias("a"), z("rv").alias("b"), F.max("date").over(t).alias("qd"))
    last = e.where("date = qd").select("ticker", F.col("a").alias("qa"), F.col("b").alias("qb"))
    k = e.where("date < qd").join(last, "ticker").withColumn("dist", F.sqrt(F.pow(F.col("a") - F.col("qa"), F.lit(2)) + F.pow(F.col("b") - F.col("qb"), F.lit(2))))
    k = k.withColumn("rank", F.row_number().over(t.orderBy(F.round("dist", 9), "date"))).where("rank <= 5")
    return k.select("ticker", day("date").alias("day"), "rank", r("dist", 4).alias("distance"), r("nxt").alias("next_5d"))


@query(
    f"""WITH {RETURNS_SQL}, {NEWS_SQL}, t AS (SELECT ticker, date, ret, (ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0) AS z FROM rets WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING)),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(abs(z), 9) DESC NULLS LAST, date) AS k FROM t) WHERE k = 1),
h AS (SELECT m.ticker, m.date, m.ret, m.z, n.news_id, row_number() OVER (PARTITION BY m.ticker ORDER BY greatest(n.proba, 1 - n.proba) DESC, n.proba DESC, n.news_id) AS rn FROM m LEFT JOIN news n ON n.ticker = m.ticker AND n.pub_date BETWEEN m.date - 1 AND m.date + 1)
SELECT ticker, {sql_day('date')} AS day, {sql_r('ret')} AS ret, {sql_r('z', 4)} AS z, news_id, CAST(rn AS INT) AS rank FROM h WHERE rn <= 3"""
)
def why_moved(spark: SparkSession, d: str) -> DataFrame:
    """The most unusual day of each ticker with the three strongest articles around it."""
    w = S.line().rowsBetween(-59, -1)
    x = returns(spark, d).withColumn("z", (F.col("ret") - F.avg("ret").over(w)) / F.nullif(F.stddev_samp("ret").over(w), F.lit(0.0)))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc_nulls_last(F.round(F.abs("z"), 9)), "date"))).where("k = 1").select("ticker", "date", "ret", "z")
    # The three days around the move are exploded, so the range join is an equi-join.
    near = x.select("*", F.explode(F.array(F.date_sub("date", 1), "date", F.date_add("date", 1))).alias("pub_date"))
    hit = near.join(news(spark, d).select("ticker", "pub_date", "news_id", "proba"), ["ticker", "pub_date"]).select("ticker", "date", "news_id", "proba")
    best = Window.partitionBy("ticker").orderBy(F.desc(F.greatest(F.col("proba"), 1 - F.col("proba"))), F.desc("proba"), "news_id")
    hit = hit.withColumn("rank", F.row_number().over(best)).where("rank <= 3")
    return x.join(hit.drop("date"), "ticker", "left").select("ticker", day("date").alias("day"), r("ret").alias("ret"), r("z", 4).alias("z"), "news_id", F.coalesce("rank", F.lit(1)).alias("rank"))


@query(
    f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings),
s AS (SELECT a.vec_id, max(list_cosine_similarity(a.v, b.v)) AS top FROM e a JOIN e b ON a.label = b.label AND b.pos < a.pos AND b.pos >= a.pos - 100 GROUP BY 1)
SELECT e.vec_id, {sql_r('coalesce(1 - s.top, 1.0)', 5)} AS novelty FROM e LEFT JOIN s USING (vec_id)"""
)
def embedding_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Novelty of each vector: one less its highest cosine to the 100 earlier ones of its label, 1 where there is none."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    e = e.withColumn("norm", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))))
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).withColumn("block", F.floor(F.col("pos") / 100))
    # Positions within 100 of each other lie in the same block or the one before: an equi-join on blocks.
    past = e.select("label", F.explode(F.array("block", F.col("block") + 1)).alias("block"), F.col("pos").alias("p2"), F.col("embedding").alias("v2"), F.col("norm").alias("n2"))
    dot = F.aggregate(F.zip_with("embedding", "v2", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    sim = e.join(past, ["label", "block"]).where("p2 < pos and p2 >= pos - 100").groupBy("vec_id").agg(F.max(dot / F.nullif(F.col("norm") * F.col("n2"), F.lit(0.0))).alias("top"))
    return e.select("vec_id").join(sim, "vec_id", "left").select("vec_id", r(F.coalesce(1 - F.col("top"), F.lit(1.0)), 5).alias("novelty"))


@query("SELECT count(DISTINCT url) AS urls FROM news_raw WHERE published_at IS NOT NULL AND url IS NOT NULL")
def stream_poll_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """All articles polled through the stream into an idempotent store: each page once."""
    base = f"{shared_dir(spark)}/poll-{uuid.uuid4().hex[:12]}"
    source = table(spark, d, "news_raw").select("news_id", "url", "title", "published_at")
    source.write.parquet(f"{base}/in")
    stream = article_stream(spark, f"{base}/in", source.schema, lookback="400 days", files_per_batch=100)
    q = poll(stream, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").agg(F.countDistinct("url").alias("urls"))
