"""Reference queries over articles: projections, upserts, features, labels, metrics, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import scoring as M
from tidemark.operators import series as S
from tidemark.operators import textual as T
from tidemark.operators.calendars import as_of, session_t0
from tidemark.plans.common import DAYMAP_SQL, MARKET_SQL, NEWS_SQL, RETURNS_SQL, day, news, panel, r, returns, sql_day, sql_r
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


@query("SELECT news_id, trim(coalesce(title, '') || ' ' || coalesce(body_snippet, '')) AS text FROM news_raw WHERE title <> ''")
def article_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_raw").where("title <> ''").select("news_id", T.article_text(F.col("title"), F.col("body_snippet")).alias("text"))


@query(
    """SELECT CASE WHEN published_at < TIMESTAMPTZ '2025-08-01 00:00:00+00' THEN 'dev' WHEN published_at < TIMESTAMPTZ '2025-10-01 00:00:00+00' THEN 'test' ELSE 'confirmation' END AS period, count(*) AS n, count(ticker) AS with_ticker
FROM news_raw WHERE published_at IS NOT NULL GROUP BY 1"""
)
def period_split(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("published_at") < F.lit("2025-08-01").cast("timestamp"), "dev").when(F.col("published_at") < F.lit("2025-10-01").cast("timestamp"), "test").otherwise("confirmation")
    return table(spark, d, "news_raw").where("published_at is not null").groupBy(p.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count("ticker").alias("with_ticker"))


@query("SELECT (SELECT count(*) FROM news_raw) AS news, (SELECT count(*) FROM prices_daily) AS prices, (SELECT count(*) FROM earnings) AS earnings")
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda name: table(spark, d, name).agg(F.count(F.lit(1)).alias(name.split("_")[0]))
    return n("news_raw").crossJoin(n("prices_daily")).crossJoin(n("earnings"))  # one row each


@query(
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY news_id) AS rn FROM news_raw WHERE batch_no > 0 AND url IS NOT NULL)
SELECT news_id, url FROM f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM news_raw o WHERE o.batch_no = 0 AND o.url = f.url)"""
)
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Rows of later deliveries whose url the first stock lacks, the first of each url."""
    n = table(spark, d, "news_raw").select("news_id", "url", "batch_no").where("url is not null")
    new = n.where("batch_no > 0").groupBy("url").agg(F.min("news_id").alias("news_id"))
    return new.join(n.where("batch_no = 0").select("url"), "url", "left_anti").select("news_id", "url")


@query("SELECT url, max(news_id) AS news_id, CAST(count(*) AS BIGINT) AS fetches FROM news_raw WHERE url IS NOT NULL GROUP BY url")
def insert_or_replace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_raw").where("url is not null").groupBy("url").agg(F.max("news_id").alias("news_id"), F.count(F.lit(1)).alias("fetches"))


@query(
    f"""WITH {NEWS_SQL} SELECT url, news_id, proba FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY published_at DESC, news_id DESC) AS rn FROM news WHERE url IS NOT NULL) WHERE rn = 1"""
)
def merge_scored(spark: SparkSession, d: str) -> DataFrame:
    """Of repeated scores of a page, the one published last."""
    best = F.max_by(F.struct("news_id", "proba"), F.struct("published_at", "news_id"))
    return news(spark, d).where("url is not null").groupBy("url").agg(best.alias("b")).select("url", "b.*")


@query(
    f"""WITH {NEWS_SQL}, t AS (SELECT *, count(*) OVER (PARTITION BY ticker, pub_date) AS n, row_number() OVER (PARTITION BY ticker, pub_date ORDER BY published_at, news_id) AS rn FROM news)
SELECT ticker, {sql_day('pub_date')} AS day, news_id AS first_id, n AS articles, {sql_r('1.0 / n')} AS weight FROM t WHERE rn = 1"""
)
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """First article of each ticker and day, and the weight each of the day's articles has."""
    g = news(spark, d).groupBy("ticker", "pub_date").agg(F.min_by("news_id", F.struct("published_at", "news_id")).alias("first_id"), F.count(F.lit(1)).alias("articles"))
    return g.select("ticker", day("pub_date").alias("day"), "first_id", "articles", r(1 / F.col("articles")).alias("weight"))


@query(f"WITH {NEWS_SQL} SELECT ticker, {sql_day('pub_date')} AS day, {sql_r('avg(proba)')} AS mean_proba, count(*) AS n FROM news GROUP BY ticker, pub_date")
def ticker_day_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return news(spark, d).groupBy("ticker", "pub_date").agg(r(F.avg("proba")).alias("mean_proba"), F.count(F.lit(1)).alias("n")).select("ticker", day("pub_date").alias("day"), "mean_proba", "n")


_SPIKES = f"td AS (SELECT ticker, pub_date AS date, avg(proba) AS mp, count(*) AS n FROM news GROUP BY ALL), cut AS (SELECT quantile_cont(round(mp, 9), 0.95) AS q FROM td), spikes AS (SELECT td.* FROM td, cut WHERE round(mp, 9) >= q AND n >= 2)"


def _spikes(spark: SparkSession, d: str) -> DataFrame:
    td = news(spark, d).groupBy("ticker", F.col("pub_date").alias("date")).agg(F.round(F.avg("proba"), 9).alias("mp"), F.count(F.lit(1)).alias("n"))
    return td.crossJoin(F.broadcast(td.agg(F.percentile("mp", 0.95).alias("q")))).where("mp >= q and n >= 2")  # one row


@query(f"WITH {NEWS_SQL}, {_SPIKES} SELECT ticker, {sql_day('date')} AS day, {sql_r('mp')} AS mean_proba, n FROM spikes")
def spike_events(spark: SparkSession, d: str) -> DataFrame:
    return _spikes(spark, d).select("ticker", day("date").alias("day"), r("mp").alias("mean_proba"), "n")


@query(
    f"""WITH {MARKET_SQL}, {NEWS_SQL}, {_SPIKES}, w AS (SELECT ticker, date, sum(ar) OVER x AS car, count(ar) OVER x AS k FROM legs WINDOW x AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
e AS (SELECT w.car FROM spikes s JOIN w USING (ticker, date) WHERE k = 3)
SELECT count(*) AS events, {sql_r('avg(car)')} AS mean_car, {sql_r('avg(car) / (stddev_samp(car) / sqrt(count(*)))', 4)} AS t_stat FROM e"""
)
def event_study(spark: SparkSession, d: str) -> DataFrame:
    """Mean abnormal return around days of high sentiment, with its t statistic."""
    x = returns(spark, d)
    x = x.join(S.market_leg(x), "date").withColumn("ar", F.col("ret") - F.col("mkt"))
    w = S.line().rowsBetween(-1, 1)
    x = x.select("ticker", "date", F.sum("ar").over(w).alias("car"), F.count("ar").over(w).alias("k")).where("k = 3")
    e = _spikes(spark, d).join(x, ["ticker", "date"])
    return e.agg(F.count(F.lit(1)).alias("events"), r(F.avg("car")).alias("mean_car"), r(F.avg("car") / (F.stddev_samp("car") / F.sqrt(F.count(F.lit(1)))), 4).alias("t_stat"))


@query(
    f"""WITH {NEWS_SQL}, dc AS (SELECT ticker, pub_date, count(*) AS n FROM news GROUP BY ALL)
SELECT ticker, {sql_day('pub_date')} AS day, n, {sql_r('(rank() OVER (PARTITION BY ticker ORDER BY n) - 1) / count(*) OVER (PARTITION BY ticker)')} AS qrank,
 n >= 2 OR (rank() OVER (PARTITION BY ticker ORDER BY n) - 1) / count(*) OVER (PARTITION BY ticker) >= 0.75 AS keep FROM dc"""
)
def attention_keep(spark: SparkSession, d: str) -> DataFrame:
    """Days kept for attention: two articles, or busier than three quarters of the ticker's days."""
    dc = news(spark, d).groupBy("ticker", "pub_date").agg(F.count(F.lit(1)).alias("n"))
    q = (F.rank().over(Window.partitionBy("ticker").orderBy("n")) - 1) / F.count(F.lit(1)).over(Window.partitionBy("ticker"))
    return dc.withColumn("q", q).select("ticker", day("pub_date").alias("day"), "n", r("q").alias("qrank"), ((F.col("n") >= 2) | (F.col("q") >= 0.75)).alias("keep"))


_LABEL = "labelled AS (SELECT news_id, source_domain, proba, ticker, pub_date, CAST((news_id * 104729) % 997 < 997 * (0.2 + 0.5 * proba) AS INT) AS y FROM news)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Scores with a made-up outcome that agrees with them in part."""
    return news(spark, d).withColumn("y", ((F.col("news_id") * 104729) % 997 < 997 * (0.2 + 0.5 * F.col("proba"))).cast("int"))


@query(f"WITH {NEWS_SQL}, {_LABEL} SELECT CAST(least(floor(proba * 10), 9) AS INT) AS bin, count(*) AS n, {sql_r('avg(proba)')} AS mean_score, {sql_r('avg(y)')} AS mean_label FROM labelled GROUP BY 1")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return M.reliability_bins(_labelled(spark, d), "proba", "y").select("bin", "n", r("mean_score").alias("mean_score"), r("mean_label").alias("mean_label"))


_CURVE = "per AS (SELECT proba AS s, CAST(sum(y) AS BIGINT) AS p, count(*) AS n FROM labelled GROUP BY 1), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER () AS pos, sum(n) OVER () AS total FROM per WINDOW w AS (ORDER BY s DESC))"


@query(
    f"""WITH {NEWS_SQL}, {_LABEL}, {_CURVE} SELECT {sql_r('sum(p / pos * tp / seen)')} AS pr_auc, {sql_r('sum((n - p) * (tp - p / 2)) / (max(pos) * (max(total) - max(pos)))')} AS roc_auc,
 (SELECT {sql_r('avg(pow(proba - y, 2))')} FROM labelled) AS brier FROM c"""
)
def pr_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return M.ranking_metrics(_labelled(spark, d), "proba", "y").select(r("pr_auc").alias("pr_auc"), r("roc_auc").alias("roc_auc"), r("brier").alias("brier"))


@query(f"WITH {NEWS_SQL}, {_LABEL}, {_CURVE} SELECT s AS threshold, round(2 * tp / (seen + pos), 9) AS f1 FROM c ORDER BY round(2 * tp / (seen + pos), 9) DESC, s DESC LIMIT 1")
def best_f1_threshold(spark: SparkSession, d: str) -> DataFrame:
    return M.best_threshold(_labelled(spark, d), "proba", "y")


@query(
    f"""WITH {NEWS_SQL}, {_LABEL}, g AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS threshold), t AS (SELECT round(greatest(proba, 1 - proba), 9) AS conf, CAST(CAST(proba >= 0.5 AS INT) = y AS INT) AS ok FROM labelled)
SELECT CAST(threshold AS DOUBLE) AS threshold, {sql_r('count(*) FILTER (conf >= threshold) / count(*)')} AS coverage, {sql_r('avg(ok) FILTER (conf >= threshold)')} AS accuracy FROM t, g GROUP BY 1"""
)
def abstention_curve(spark: SparkSession, d: str) -> DataFrame:
    c = M.abstention_curve(_labelled(spark, d), "proba", "y", [0.5, 0.6, 0.7, 0.8, 0.9])
    return c.select("threshold", r("coverage").alias("coverage"), r("accuracy").alias("accuracy"))


@query(
    f"""WITH {NEWS_SQL}, {_LABEL}, s AS (SELECT ticker, round(CASE WHEN y = 1 THEN 1 - proba ELSE proba END, 9) AS score FROM labelled), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM s)
SELECT ticker, score AS quantile FROM k WHERE rn = least(ceil((n + 1) * (1 - 0.1)), n)"""
)
def conformal_quantile(spark: SparkSession, d: str) -> DataFrame:
    s = _labelled(spark, d).select("ticker", F.round(F.when(F.col("y") == 1, 1 - F.col("proba")).otherwise(F.col("proba")), 9).alias("score"))
    return M.conformal_quantile(s, "ticker", "score", 0.1)


@query(
    f"""WITH {NEWS_SQL}, {_LABEL}, t AS (SELECT y AS a, CAST(proba >= 0.5 AS INT) AS b FROM labelled), c AS (SELECT avg(CAST(a = b AS INT)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM t)
SELECT {sql_r('po')} AS agreement, {sql_r('(po - pe) / (1 - pe)')} AS kappa FROM c"""
)
def kappa_agreement(spark: SparkSession, d: str) -> DataFrame:
    x = _labelled(spark, d).select(F.col("y").alias("a"), (F.col("proba") >= 0.5).cast("int").alias("b"))
    return M.kappa(x, "a", "b").select(r("agreement").alias("agreement"), r("kappa").alias("kappa"))


@query(
    f"""WITH {RETURNS_SQL}, w AS (SELECT ticker, date, lret, CASE WHEN count(lret) OVER b = 5 THEN var_samp(lret) OVER b END AS fc, CASE WHEN count(lret) OVER f = 5 THEN var_samp(lret) OVER f END AS rv, CASE WHEN count(lret) OVER l >= 60 THEN quantile_cont(lret, 0.05) OVER l END AS q
 FROM rets WINDOW b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), l AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))
SELECT ticker, {sql_r('avg(rv / fc - ln(rv / fc) - 1) FILTER (rv > 0 AND fc > 0)', 4)} AS qlike, {sql_r('avg(pow(rv - fc, 2))', 8)} AS mse, {sql_r('avg(abs(sqrt(rv) - sqrt(fc)))')} AS mae_vol, {sql_r('avg(greatest(0.05 * (lret - q), -0.95 * (lret - q)))')} AS pinball,
 {sql_r('avg(CAST(lret >= q AS INT))')} AS coverage FROM w GROUP BY ticker"""
)
def forecast_losses(spark: SparkSession, d: str) -> DataFrame:
    """Losses of the persistence variance and of the trailing quantile, per ticker."""
    rets = returns(spark, d)
    last = S.line().rowsBetween(-252, -1)
    x = rets.select("ticker", "lret", S.full(F.var_samp("lret"), "lret", 5, S.back(5)).alias("fc"), S.full(F.var_samp("lret"), "lret", 5, S.ahead(5)).alias("rv"), F.when(F.count("lret").over(last) >= 60, F.percentile("lret", 0.05).over(last)).alias("q"))
    return x.groupBy("ticker").agg(
        r(F.avg(M.qlike("rv", "fc")), 4).alias("qlike"), r(F.avg(F.pow(F.col("rv") - F.col("fc"), F.lit(2))), 8).alias("mse"), r(F.avg(F.abs(F.sqrt("rv") - F.sqrt("fc")))).alias("mae_vol"),
        r(F.avg(F.when(F.col("lret").isNotNull() & F.col("q").isNotNull(), M.pinball("lret", "q", 0.05)))).alias("pinball"), r(F.avg((F.col("lret") >= F.col("q")).cast("int"))).alias("coverage"),
    )


@query(
    f"""WITH {RETURNS_SQL}, h AS (SELECT ticker, date, CAST(lret < q AS INT) AS h FROM (SELECT ticker, date, lret, CASE WHEN count(lret) OVER l >= 60 THEN quantile_cont(lret, 0.05) OVER l END AS q FROM rets WINDOW l AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)) WHERE lret < q IS NOT NULL),
b AS (SELECT *, lag(h) OVER (PARTITION BY ticker ORDER BY date) AS b FROM h), g AS (SELECT ticker, count(*) AS n, CAST(sum(h) AS BIGINT) AS k FROM b GROUP BY ticker)
SELECT ticker, n, k, {sql_r('-2 * (CASE WHEN k > 0 THEN k * ln(0.05) ELSE 0 END + CASE WHEN n - k > 0 THEN (n - k) * ln(0.95) ELSE 0 END - CASE WHEN k > 0 THEN k * ln(k / n) ELSE 0 END - CASE WHEN n - k > 0 THEN (n - k) * ln(1 - k / n) ELSE 0 END)', 5)} AS lr_uc FROM g"""
)
def kupiec(spark: SparkSession, d: str) -> DataFrame:
    """Unconditional coverage of the trailing quantile, per ticker."""
    last = S.line().rowsBetween(-252, -1)
    x = returns(spark, d).select("ticker", "date", "lret", F.when(F.count("lret").over(last) >= 60, F.percentile("lret", 0.05).over(last)).alias("q"))
    h = x.select("ticker", "date", (F.col("lret") < F.col("q")).cast("int").alias("h")).where("h is not null")
    return M.kupiec_christoffersen(h, "h", "date", "ticker", 0.05).select("ticker", "n", "k", r("lr_uc", 5).alias("lr_uc"))


@query(
    f"""WITH {RETURNS_SQL}, m AS (SELECT ticker, count(ret) AS n, avg(ret) AS mu, stddev_samp(ret) AS sd, stddev_pop(ret) AS sp FROM rets GROUP BY ticker)
SELECT r.ticker, m.n, {sql_r('any_value(mu / sd)')} AS sharpe, {sql_r('avg(pow((ret - mu) / sp, 3))', 4)} AS skew, {sql_r('avg(pow((ret - mu) / sp, 4))', 4)} AS kurt FROM rets r JOIN m ON m.ticker = r.ticker WHERE ret IS NOT NULL GROUP BY r.ticker, m.n"""
)
def sharpe_moments(spark: SparkSession, d: str) -> DataFrame:
    return M.deflated_sharpe(returns(spark, d).where("ret is not null"), "ticker", "ret").select("ticker", "n", r("sharpe").alias("sharpe"), r("skew", 4).alias("skew"), r("kurt", 4).alias("kurt"))


@query(
    f"""WITH {RETURNS_SQL}, {NEWS_SQL}, td AS (SELECT ticker, pub_date AS date, avg(proba) AS mp FROM news GROUP BY ALL), x AS (SELECT mp, lead_ret FROM td JOIN (SELECT ticker, date, round(lead(close) OVER (PARTITION BY ticker ORDER BY date) / close - 1, 12) AS lead_ret FROM rets) USING (ticker, date) WHERE lead_ret IS NOT NULL),
k AS (SELECT rank() OVER (ORDER BY round(mp, 9)) + (count(*) OVER (PARTITION BY round(mp, 9)) - 1) / 2 AS a, rank() OVER (ORDER BY lead_ret) + (count(*) OVER (PARTITION BY lead_ret) - 1) / 2 AS b FROM x)
SELECT count(*) AS n, {sql_r('corr(a, b)')} AS rank_ic FROM k"""
)
def rank_ic(spark: SparkSession, d: str) -> DataFrame:
    """Spearman correlation of a day's sentiment with the next day's return (global ranks by a range sort, over one row per ticker and day)."""
    td = news(spark, d).groupBy("ticker", F.col("pub_date").alias("date")).agg(F.round(F.avg("proba"), 9).alias("mp"))
    nxt = panel(spark, d).select("ticker", "date", F.round(F.lead("close").over(S.line()) / F.col("close") - 1, 12).alias("nxt"))
    x = td.join(nxt, ["ticker", "date"]).where("nxt is not null")
    return x.select(M.average_rank("mp").alias("a"), M.average_rank("nxt").alias("b")).agg(F.count(F.lit(1)).alias("n"), r(F.corr("a", "b")).alias("rank_ic"))


_TOKENS = r"regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')"
_IN = lambda names: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{n}'" for n in names) + ")))"


@query(
    f"""WITH t AS (SELECT news_id, trim(coalesce(title, '') || ' ' || coalesce(body_snippet, '')) AS text FROM news_raw), k AS (SELECT news_id, {_TOKENS} AS w FROM t), c AS (SELECT news_id, len(w) AS n, {_IN(T.POSITIVE)} AS p, {_IN(T.NEGATIVE)} AS q, {_IN(T.UNCERTAIN)} AS u FROM k)
SELECT news_id, CAST(n AS INT) AS words, CAST(p AS INT) AS pos, CAST(q AS INT) AS neg, CAST(u AS INT) AS unc, {sql_r('p / greatest(n, 1)')} AS pos_rate, {sql_r('(p - q) / (p + q + 1)')} AS polarity, {sql_r('(p + q) / greatest(n, 1)')} AS subjectivity FROM c"""
)
def lexicon_features(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "news_raw").select("news_id", T.tokens(T.article_text(F.col("title"), F.col("body_snippet"))).alias("w"))
    c = t.select("news_id", F.size("w").alias("n"), T.in_list(F.col("w"), T.POSITIVE).alias("p"), T.in_list(F.col("w"), T.NEGATIVE).alias("q"), T.in_list(F.col("w"), T.UNCERTAIN).alias("u"))
    n = F.greatest(F.col("n"), F.lit(1))
    return c.select("news_id", F.col("n").alias("words"), F.col("p").alias("pos"), F.col("q").alias("neg"), F.col("u").alias("unc"), r(F.col("p") / n).alias("pos_rate"), r((F.col("p") - F.col("q")) / (F.col("p") + F.col("q") + 1)).alias("polarity"), r((F.col("p") + F.col("q")) / n).alias("subjectivity"))


@query(
    """WITH h AS (SELECT news_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), '^www\\.', '') AS h, published_at FROM news_raw WHERE url IS NOT NULL)
SELECT news_id, CASE WHEN h = 'quillwire.example' OR h LIKE '%.quillwire.example' THEN 2 WHEN h IN ('ledgerpost.example', 'morningtape.example') OR h LIKE '%.ledgerpost.example' OR h LIKE '%.morningtape.example' THEN 1 ELSE 0 END AS tier, CAST(hour(published_at AT TIME ZONE 'UTC') // 6 AS INT) AS hour_bucket FROM h"""
)
def domain_tier(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1)
    return table(spark, d, "news_raw").where("url is not null").select("news_id", T.host_tier(host, ("quillwire.example",), ("ledgerpost.example", "morningtape.example")).alias("tier"), F.floor(F.hour("published_at") / 6).cast("int").alias("hour_bucket"))


@query(
    """WITH s AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 700)) AS st FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(st // 700 AS INT) AS chunk_no, length(substring(text, st + 1, 800)) AS n, md5(substring(text, st + 1, 800)) AS hash FROM s"""
)
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = T.chunks(table(spark, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_no", F.length("chunk").cast("bigint").alias("n"), F.md5("chunk").alias("hash"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TFIDF = f"""tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM src) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(DISTINCT id) FROM src)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
raw AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)), tfidf AS (SELECT r.id, r.term, r.w / n.norm AS w FROM raw r JOIN (SELECT id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY id) n ON n.id = r.id)"""


@query(f"WITH src AS (SELECT news_id AS id, title AS text FROM news_raw WHERE title IS NOT NULL), {_TFIDF} SELECT id AS news_id, term, {sql_r('w')} AS w FROM tfidf")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return T.tf_idf(table(spark, d, "news_raw").where("title is not null"), "news_id", "title").select("news_id", "term", r("w").alias("w"))


@query(
    f"""WITH src AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), {_TFIDF}, q AS (SELECT item_id, term, 1.0 / sqrt(count(*) OVER (PARTITION BY item_id)) AS wq FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM eval_items) WHERE term NOT IN ({_STOP})),
s AS (SELECT item_id, id, sum(w * wq) AS score FROM tfidf JOIN q USING (term) GROUP BY ALL)
SELECT item_id, id AS doc_id, CAST(rank AS INT) AS rank, {sql_r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 5"""
)
def retrieve_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest documents of each evaluation text (a top-k report)."""
    w = T.tf_idf(table(spark, d, "documents").where("text is not null"), "doc_id", "text")
    q = table(spark, d, "eval_items").select("item_id", F.explode(F.array_distinct(F.filter(T.tokens(F.col("text"), r"([a-z]{2,})"), lambda x: ~x.isin(*T.STOP_WORDS)))).alias("term"))
    q = q.withColumn("w", 1 / F.sqrt(F.count(F.lit(1)).over(Window.partitionBy("item_id"))))
    return T.retrieve(w, q, "doc_id", "item_id", 5).select("item_id", "doc_id", "rank", r("score").alias("score"))


@query(
    """SELECT news_id, CAST(len(list_filter(regexp_split_to_array(body_snippet, '(?:\\. )'), lambda s: length(s) > 40)) AS INT) AS long_parts FROM news_raw WHERE body_snippet IS NOT NULL"""
)
def key_sentences(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.split("body_snippet", r"(?:\. )"), lambda s: F.length(s) > 40)
    return table(spark, d, "news_raw").where("body_snippet is not null").select("news_id", F.size(parts).alias("long_parts"))


@query("SELECT sha256(regexp_replace(trim(title), '\\s+', ' ', 'g')) AS cache_key, count(*) AS n FROM news_raw WHERE title IS NOT NULL GROUP BY 1")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_raw").where("title is not null").groupBy(F.sha2(F.regexp_replace(F.trim("title"), r"\s+", " "), 256).alias("cache_key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '2025-02-10' AS lo, '2025-03-31' AS hi UNION ALL SELECT '2025-04-01', '2025-06-30' UNION ALL SELECT '2025-07-01', '2025-09-30' UNION ALL SELECT '2025-10-01', '2025-11-20'")
def quarter_windows(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.explode(T.quarter_windows("2025-02-10", "2025-11-20")).alias("q")).select(day("q.lo").alias("lo"), day("q.hi").alias("hi"))


_PNL = f"""WITH {DAYMAP_SQL}, {NEWS_SQL}, l AS (SELECT news_id, ticker, proba, published_at AT TIME ZONE 'America/New_York' AS local FROM news),
t AS (SELECT l.ticker, CASE WHEN hour(l.local) * 60 + minute(l.local) < 570 THEN m.before ELSE m.at_or_before END AS t0, proba FROM l JOIN daymap m ON m.ticker = l.ticker AND m.day = CAST(l.local AS DATE)),
g AS (SELECT ticker, t0, max(proba) AS strength FROM t WHERE t0 IS NOT NULL GROUP BY ALL), sig AS (SELECT *, lag(strength, 1, 0.0) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM (
 SELECT p.ticker, p.date, p.close, lead(p.close) OVER w / p.close - 1 AS nxt, CASE WHEN last_value(g.strength IGNORE NULLS) OVER w >= 0.9 THEN 1.0 ELSE 0.0 END AS strength FROM panel p LEFT JOIN g ON g.ticker = p.ticker AND g.t0 = p.date WINDOW w AS (PARTITION BY p.ticker ORDER BY p.date))),
pnl AS (SELECT date, avg(strength * nxt - abs(strength - prev) / 2 * 0.0005) AS pnl FROM sig WHERE nxt IS NOT NULL GROUP BY date)"""


@query(f"{_PNL} SELECT {sql_day('date')} AS day, {sql_r('pnl')} AS pnl FROM pnl"
)
def daily_pnl(spark: SparkSession, d: str) -> DataFrame:
    """Daily mean profit of holding what the latest strong signal says, less five basis points of turnover."""
    return _pnl(spark, d).select(day("date").alias("day"), r("pnl").alias("pnl"))


def _pnl(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    g = session_t0(news(spark, d).select("ticker", "published_at", "proba"), p, time="published_at").where("t0 is not null").groupBy("ticker", F.col("t0").alias("date")).agg(F.max("proba").alias("raw"))
    line = S.line()
    x = p.select("ticker", "date", "close").join(g, ["ticker", "date"], "left")
    x = x.withColumns({"nxt": F.lead("close").over(line) / F.col("close") - 1, "strength": F.when(F.last("raw", ignorenulls=True).over(line) >= 0.9, 1.0).otherwise(0.0)})
    x = x.withColumn("prev", F.lag("strength", 1, 0.0).over(line))
    return x.where("nxt is not null").groupBy("date").agg(F.avg(F.col("strength") * F.col("nxt") - F.abs(F.col("strength") - F.col("prev")) / 2 * 0.0005).alias("pnl"))


@query(
    f"""{_PNL}, eq AS (SELECT date, pnl, product(1 + pnl) OVER (ORDER BY date) AS equity FROM pnl), pk AS (SELECT *, max(equity) OVER (ORDER BY date) AS peak FROM eq)
SELECT {sql_r('max_by(equity, date) - 1')} AS total_return, {sql_r('avg(pnl) / stddev_samp(pnl) * sqrt(252)', 4)} AS sharpe, {sql_r('max(peak - equity) / max(peak)')} AS max_drawdown FROM pk"""
)
def strategy_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Total return, yearly Sharpe ratio and largest drawdown (from the highest equity reached) of the daily series."""
    line = Window.orderBy("date")  # one row per trading date
    x = _pnl(spark, d).select("date", "pnl", F.product(1 + F.col("pnl")).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("equity"))
    x = x.withColumn("peak", F.max("equity").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return x.agg(
        r(F.max_by("equity", "date") - 1).alias("total_return"), r(F.avg("pnl") / F.stddev_samp("pnl") * F.sqrt(F.lit(252.0)), 4).alias("sharpe"), r(F.max(F.col("peak") - F.col("equity")) / F.max("peak")).alias("max_drawdown")
    )


@query(
    f"""WITH {NEWS_SQL}, t AS (SELECT news_id, ticker, published_at, row_number() OVER (ORDER BY published_at, news_id) AS rn, count(*) OVER () AS n FROM news)
SELECT news_id, CASE WHEN rn <= n * 0.6 THEN 'train' WHEN rn <= n * 0.75 THEN 'calibration' ELSE 'test' END AS role FROM t"""
)
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    """60/15/25 split in order of publication.

    Counts per day tell the days in which the cuts fall; only the rows of those two days are ranked, by counts per instant.
    """
    x = news(spark, d).select("news_id", "published_at", "pub_date")
    per = x.groupBy("pub_date").agg(F.count(F.lit(1)).alias("k"))
    days = per.select("pub_date", "k", (F.sum("k").over(Window.orderBy("pub_date").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy()).alias("n"))  # one row a day
    cut = lambda q: (F.col("before") < F.floor(F.col("n") * q)) & (F.col("before") + F.col("k") > F.floor(F.col("n") * q))
    placed = x.join(days.withColumn("torn", cut(0.6) | cut(0.75)), "pub_date")
    role = lambda rn: F.when(rn <= F.col("n") * 0.6, "train").when(rn <= F.col("n") * 0.75, "calibration").otherwise("test").alias("role")
    whole = placed.where("not torn").select("news_id", role(F.col("before") + F.col("k")))
    torn = placed.where("torn")
    upto = torn.groupBy("pub_date", "published_at").agg(F.count(F.lit(1)).alias("m"))
    upto = upto.select("published_at", (F.sum("m").over(Window.partitionBy("pub_date").orderBy("published_at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("earlier"))
    rn = F.col("before") + F.col("earlier") + F.row_number().over(Window.partitionBy("published_at").orderBy("news_id"))
    return whole.union(torn.join(upto, "published_at").select("news_id", role(rn)))
