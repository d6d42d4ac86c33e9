"""Text features as JVM expressions: projections, lexicon counts, host tiers, chunks, TF-IDF and cosine retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Small built-in word lists; pass others as parameters.
POSITIVE = ("stronger", "solid", "robust", "improving", "upbeat", "encouraging", "better", "brisk", "resilient", "firmer", "gained", "advanced", "climbed", "rose")
NEGATIVE = ("weaker", "softer", "sluggish", "disappointing", "deteriorating", "fragile", "fell", "lost", "dropped", "declined", "slipped", "retreated", "shed", "patchy")
UNCERTAIN = ("uneven", "cautious", "volatile", "lumpy", "might", "could", "may", "unclear", "whether", "expects")
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "have", "in", "is", "it", "its", "of", "on", "or", "said", "that", "the", "their", "they", "this", "to", "was", "were", "which", "who", "will", "with", "would")
WORD = r"([a-z]+(?:'[a-z]+)?)"


def article_text(title: Column, body: Column) -> Column:
    """Title and body, nulls as empty, without outer blanks."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))


def in_list(words: Column, listed: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*listed)))


def host_tier(host: Column, first: tuple[str, ...], second: tuple[str, ...]) -> Column:
    """2 for hosts of the first tier or under them, 1 for the second tier, else 0; ``www.`` aside."""
    h = F.regexp_replace(F.lower(host), r"^www\.", "")
    under = lambda names: F.coalesce(F.exists(F.array(*[F.lit(n) for n in names]), lambda n: (h == n) | F.endswith(h, F.concat(F.lit("."), n))), F.lit(False))
    return F.when(under(first), 2).when(under(second), 1).otherwise(0)


def visible_text(html: Column, limit: int = 600) -> Column:
    """Visible text of a page: scripts, styles and frames dropped, tags and blanks collapsed, at most ``limit`` characters."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)\b.*?</\1>", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"\s+", " ")), 1, limit)


def chunks(df: DataFrame, id: str, text: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """Overlapping pieces of each text with a running number."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return df.where(F.length(text) > 0).select(id, text, F.posexplode(starts).alias("chunk_no", "start")).select(id, "chunk_no", F.substring(F.col(text), F.col("start") + 1, F.lit(size)).alias("chunk"))


def tf_idf(df: DataFrame, id: str, text: str, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Unit-length weights (1 + ln tf)(ln((1 + n) / (1 + df)) + 1) of the words of each text."""
    words = F.filter(tokens(F.col(text), r"([a-z]{2,})"), lambda w: ~w.isin(*stop))
    tf = df.select(id, F.explode(words).alias("term")).groupBy(id, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.countDistinct(id).alias("n_docs"))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))  # n is one row
    w = tf.join(idf, "term").select(id, "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy(id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, id).select(id, "term", (F.col("w") / F.col("norm")).alias("w"))


def retrieve(weights: DataFrame, queries: DataFrame, id: str, query_id: str, k: int) -> DataFrame:
    """Top ``k`` records by cosine for each query: both sides as (id, term, w)."""
    q = queries.select(F.col(query_id), "term", F.col("w").alias("wq"))
    sim = weights.join(q, "term").groupBy(query_id, id).agg(F.sum(F.col("w") * F.col("wq")).alias("score"))
    best = Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), id)
    return sim.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 40)


def quarter_windows(start: str, end: str) -> Column:
    """Calendar quarters clipped to [start, end] as an array of (lo, hi)."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    firsts = F.sequence(F.trunc(s, "quarter"), e, F.expr("interval 3 months"))
    return F.transform(firsts, lambda q: F.struct(F.greatest(q, s).alias("lo"), F.least(F.date_sub(F.add_months(q, 3), 1), e).alias("hi")))
