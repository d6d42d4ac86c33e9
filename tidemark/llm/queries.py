"""Queries of the problems tagged llm, and their SQL where there is one."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.abuse import fit_abuse_network, score_texts
from tidemark.llm.dedup import ArticleStore
from tidemark.llm.leaks import leaked_items
from tidemark.llm.mapping import map_names
from tidemark.llm.mixing import mix_sources, source_key, token_counts
from tidemark.llm.nearest import nearest_in_time
from tidemark.llm.overlaps import cross_split_overlaps
from tidemark.session import shared_dir, table


TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
# Pre-token pattern of the byte-level vocabulary (a fixed value that belongs to its ranks).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Scores of clean and abusive windows part here (README, problem 10).
ABUSE_SCORE = 0.7


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The first stock, then all later deliveries, each checked against what was accepted before."""
    news = table(spark, d, "news_raw").select("news_id", "url", "title", "body_snippet", "batch_no")
    store = ArticleStore(spark, _scratch(spark, "articles"))
    cols = {"id": "news_id", "url": "url", "title": "title", "body": "body_snippet"}
    store.ingest(news.where("batch_no is null or batch_no <= 0"), **cols)
    store.ingest(news.where("batch_no > 0"), **cols)
    return store.articles().where("first < id").select(F.col("first").alias("news_id_a"), F.col("id").alias("news_id_b"))


def _split(c):
    """Split by UTC time of publication; null belongs to none."""
    return F.when(c < F.lit("2025-08-01").cast("timestamp"), "train").when(c < F.lit("2025-10-01").cast("timestamp"), "validation").when(c.isNotNull(), "test")


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records of the splits with their class, training and evaluation records apart."""
    news = table(spark, d, "news_raw").select("news_id", "title", "body_snippet", "source_domain", _split(F.col("published_at")).alias("split"))
    classes = cross_split_overlaps(news, id="news_id", split="split", train="train", title="title", body="body_snippet")
    placed = news.select("news_id", "source_domain", "split").where("split is not null").join(classes.select(F.col("id").alias("news_id"), "first"), "news_id")
    return placed.where("split = 'train'"), placed.where("split <> 'train'")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = _overlaps(spark, d)
    pairs = a.select(F.col("news_id").alias("a"), "first").join(b.select(F.col("news_id").alias("b"), "first"), "first")
    return pairs.select(F.least("a", "b").alias("news_id_a"), F.greatest("a", "b").alias("news_id_b"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records, and those with a like in training, per split and source."""
    a, b = _overlaps(spark, d)
    hit = b.join(a.select("first").distinct(), "first", "left_semi").groupBy("split", "source_domain").agg(F.count(F.lit(1)).alias("leaked"))
    news = table(spark, d, "news_raw").select("source_domain", _split(F.col("published_at")).alias("split")).where("split is not null and split <> 'train'")
    return news.groupBy("split", "source_domain").agg(F.count(F.lit(1)).alias("records")).join(hit, ["split", "source_domain"], "left").fillna(0, ["leaked"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    aliases, news = table(spark, d, "aliases"), table(spark, d, "news_raw")
    typed = aliases.where("ticker is null").select(F.col("alias_id").alias("id"), F.col("alias").alias("text"), F.lit(True).alias("whole"))
    titles = news.where("ticker is null and title is not null and title <> ''").select(F.col("news_id").alias("id"), F.col("title").alias("text"), F.lit(False).alias("whole"))
    mapped = map_names(typed.union(titles), table(spark, d, "universe"), aliases)
    return mapped.select(F.when(F.col("whole"), F.lit("alias")).otherwise(F.lit("title")).alias("rec_kind"), F.col("id").alias("rec_id"), "ticker")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    news = table(spark, d, "news_raw").select("news_id", "ticker", "published_at")
    prices = table(spark, d, "prices_daily").where("close is not null").select("price_id", "ticker", (F.col("date").cast("timestamp") + F.expr("interval 21 hours")).alias("at"))
    return nearest_in_time(
        news, prices, left_id="news_id", left_entity="ticker", left_time="published_at", right_id="price_id", right_entity="ticker", right_time="at", tolerance_seconds=30 * 3600
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text")
    return found.select("doc_id", "item_id")


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets").withColumn("source", source_key(F.col("source")))
    docs = table(spark, d, "documents").withColumn("source", source_key(F.col("source")))
    docs = docs.join(targets.select("source"), "source", "left_semi")
    sized = token_counts(docs, id="doc_id", text="text", keep=[F.col("source")], tokenizer_path=f"{TOKENIZERS}/byte_bpe_50k.tiktoken", pattern=BYTE_PATTERN)
    return mix_sources(sized, targets, id="doc_id")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def _abuse_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    net = fit_abuse_network(table(spark, d, "rated_texts"), docs, text="text", rating="rating", doc_text="text", doc_id="doc_id")
    return score_texts(docs, net, id="doc_id", text="text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse_scores(spark, d).where(F.col("abuse_score") >= ABUSE_SCORE).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "documents").select("doc_id", source_key(F.col("source")).alias("source"))
    flagged = (F.col("abuse_score") >= ABUSE_SCORE).cast("int")
    per = _abuse_scores(spark, d).join(sources, "doc_id").groupBy("source")
    return per.agg(F.count(F.lit(1)).alias("documents"), F.sum(flagged).alias("flagged"), F.round(F.avg(flagged), 6).alias("rate"))


QUERIES = {"p4_found": p4_found, "p5_found": p5_found, "p5_counts": p5_counts, "p6_found": p6_found, "p7_found": p7_found, "p8_found": p8_found, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_rates": p10_rates}

ORACLE = {
    "p7_found": """
SELECT news_id, price_id FROM (
  SELECT n.news_id, p.price_id, row_number() OVER (PARTITION BY n.news_id ORDER BY abs(epoch_us(n.published_at) - p.us), p.us, p.price_id) AS rn
  FROM news_raw n JOIN (
    SELECT price_id, ticker, date, epoch_us(CAST(date AS TIMESTAMP)) + 75600000000 AS us FROM prices_daily WHERE close IS NOT NULL
  ) p ON p.ticker = n.ticker
     AND p.date BETWEEN CAST(n.published_at AT TIME ZONE 'UTC' AS DATE) - INTERVAL 3 DAY AND CAST(n.published_at AT TIME ZONE 'UTC' AS DATE) + INTERVAL 3 DAY
     AND abs(epoch_us(n.published_at) - p.us) <= 108000000000
) WHERE rn = 1""",
}
