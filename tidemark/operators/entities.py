"""Names from a list of aliases in free text, as equi-joins on words.

A text is read as its runs of letters and digits.  An alias is looked up by its first word, so what is
joined are words and not texts with all aliases; the whole alias is then compared in place.  Of
overlapping mentions the longest alias wins, then the earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that tell that a text speaks of a company (fixed values; pass others as a parameter).
FINANCE_WORDS = ("shares", "stock", "earnings", "revenue", "profit", "quarter", "sales", "guidance", "dividend", "analyst", "investors", "market", "price", "results")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def entity_mentions(texts: DataFrame, aliases: DataFrame, *, id: str, text: str, finance: tuple[str, ...] = FINANCE_WORDS, context: int = 20, sure: float = 0.95, unsure: float = 0.5) -> DataFrame:
    """Mentions of listed names: ``id``, ``start`` (place of the first word), ``mention``, ``ticker``, ``confidence``.

    ``aliases``: ``alias``, ``ticker`` and ``ambiguous`` (boolean; null counts as not).  An ambiguous alias without a
    finance word among the ``context`` words on either side has the lower confidence.  Of several tickers
    with one alias the lowest is taken.  Null and empty texts and aliases name nothing; ids should be unique.
    """
    names = aliases.where(F.col("ticker").isNotNull()).select(words(F.col("alias")).alias("name"), "ticker", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous")).where("size(name) > 0")
    names = names.groupBy("name").agg(F.min_by(F.struct("ticker", "ambiguous"), F.struct("ticker", "ambiguous")).alias("t")).select("name", "t.*", F.col("name")[0].alias("word"))
    read = texts.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), words(F.col(text)).alias("w"))
    found = read.select("id", "w", F.posexplode("w").alias("start", "word")).join(names, "word").where(F.slice("w", F.col("start") + 1, F.size("name")) == F.col("name"))
    around = F.slice("w", F.greatest(F.lit(1), F.col("start") + 1 - context), F.size("name") + 2 * context)
    known = F.arrays_overlap(around, F.array(*[F.lit(x) for x in finance]))
    mention = F.array_join("name", " ")
    hits = found.select("id", F.struct((-F.length(mention)).alias("order"), "start", (F.col("start") + F.size("name")).alias("end"), mention.alias("mention"), "ticker", F.when(F.col("ambiguous") & ~known, unsure).otherwise(sure).alias("confidence")).alias("h"))
    # Longest first; a mention is kept if no longer one has claimed any of its words.  The hits of one text: bounded by its length.
    per = hits.groupBy("id").agg(F.array_sort(F.collect_list("h")).alias("h"))
    empty = F.slice("h", 1, 0)
    kept = F.aggregate("h", empty, lambda held, x: F.when(F.exists(held, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), held).otherwise(F.concat(held, F.array(x))))
    return per.select("id", F.explode(kept).alias("m")).select(F.col("id").alias(id), "m.start", "m.mention", "m.ticker", "m.confidence")


def best_mention(mentions: DataFrame, id: str) -> DataFrame:
    """The surest mention of each text, the first of equals."""
    return mentions.groupBy(id).agg(F.max_by(F.struct("ticker", "confidence"), F.struct("confidence", -F.col("start"))).alias("b")).select(id, "b.*")


def set_scores(gold: DataFrame, found: DataFrame, id: str) -> DataFrame:
    """Precision, recall and F1 of found ticker sets against true ones, over all texts: one row."""
    g = gold.select(id, "ticker").distinct().withColumn("gold", F.lit(1))
    f = found.select(id, "ticker").distinct().withColumn("found", F.lit(1))
    n = g.join(f, [id, "ticker"], "full").agg(F.count_if(F.col("gold").isNotNull() & F.col("found").isNotNull()).alias("tp"), F.count_if(F.col("gold").isNull()).alias("fp"), F.count_if(F.col("found").isNull()).alias("fn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))
