"""Mapping freely typed names to a canonical list by a prefix-filter set-similarity join.

The join works on sets of character trigrams: tokens are ordered by global rarity, only the rare
prefixes of two sets are joined, length and position filters drop what can't reach the threshold,
and the Jaccard similarity of the rest is computed exactly.  It maps the distinct words of the
texts to words of the canonical names (and their short forms); a name then is the words of one
entry standing side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.session import cut, written

# Endings of company names that tell nothing about which company is meant (fixed values).
LEGAL_FORMS = ("ag", "sa", "plc", "ltd", "inc", "corp", "group", "holdings", "co", "grp", "intl", "company", "companies", "the", "llc", "gmbh", "se", "nv", "limited", "incorporated", "corporation")


@dataclass(frozen=True)
class NameLimits:
    """jaccard: least trigram similarity of two words; edits: most letters apart; short: letters of a shortened first word;
    name: least trigram similarity of a whole text to a whole listed name or alias."""

    jaccard: float = 0.28
    edits: int = 3
    short: int = 5
    name: float = 0.75


def grams(word: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a word with its ends marked."""
    padded = F.concat(F.lit("^" * (n - 1)), word, F.lit("$" * (n - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: padded.substr(i, F.lit(n))))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Exact Jaccard join of two tables (``key``, ``tokens`` array without repeats): ``l``, ``r``, ``jaccard`` >= threshold.

    Keys should be unique per side.  Empty or null sets match nothing.
    """
    sets = left.select(F.lit(0).alias("side"), "key", "tokens").union(right.select(F.lit(1), "key", "tokens")).where("size(tokens) > 0")
    flat = sets.select("side", "key", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    rarity = flat.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.max("side").alias("hi"), F.min("side").alias("lo"))
    order = Window.partitionBy("side", "key").orderBy("df", "t")  # one set: bounded by the length of a word
    ranked = flat.join(rarity, "t").withColumn("at", F.row_number().over(order))
    # A pair that reaches the threshold shares one of the first n - ceil(threshold * n) + 1 tokens.
    prefix = cut(ranked.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("hi") > F.col("lo"))).select("side", "key", "n", "t", "at"))
    side = lambda s, a: prefix.where(F.col("side") == s).select("t", F.col("key").alias(a), F.col("n").alias(f"n{a}"), F.col("at").alias(f"at{a}"))
    need = threshold / (1 + threshold) * (F.col("nl") + F.col("nr"))
    most = F.least(F.col("nl") - F.col("atl"), F.col("nr") - F.col("atr")) + 1
    pairs = side(0, "l").join(side(1, "r"), "t").where((F.col("nr") >= F.col("nl") * threshold) & (F.col("nl") >= F.col("nr") * threshold))
    # Position filter: at the first common token, what is left must still be enough.
    pairs = pairs.groupBy("l", "r").agg(F.max((most + F.lit(0)) >= need).alias("can")).where("can").select("l", "r")
    # Verifying costs far more than the pairs' few bytes tell: dealt evenly over all tasks.
    pairs = pairs.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "l", "r")
    full = pairs.join(left.select(F.col("key").alias("l"), F.col("tokens").alias("tl")), "l").join(right.select(F.col("key").alias("r"), F.col("tokens").alias("tr")), "r")
    both = F.size(F.array_intersect("tl", "tr"))
    full = full.withColumn("jaccard", both / (F.size("tl") + F.size("tr") - both))
    return full.where(F.col("jaccard") >= threshold).select("l", "r", "jaccard")


# Letters of the longest word whose deletion neighbourhood is listed (some 300 entries); longer ones are rare and their grams tell them apart.
_LISTED = 12


def _deletions(words: DataFrame, edits: Column, most: int) -> DataFrame:
    """Each word (``key``) under what is left of it without up to ``edits`` letters, ``most`` at most: ``rest`` (hashed), ``key``."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    d = words.select("key", edits.alias("edits"), F.array("key").alias("d0"))
    for j in range(most):
        d = d.withColumn(f"d{j + 1}", F.when(F.least("edits", F.length("key")) > j, F.array_distinct(F.flatten(F.transform(f"d{j}", less)))).otherwise(F.array().cast("array<string>")))
    return d.select("key", F.explode(F.concat(*[f"d{j}" for j in range(most + 1)])).alias("rest")).select(F.xxhash64("rest").alias("rest"), "key")


def close_words(left: DataFrame, right: DataFrame, limits: NameLimits) -> DataFrame:
    """All pairs of words (``key``, ``tokens``: their grams) that reach the Jaccard similarity and are few enough edits apart: ``l``, ``r``, ``jaccard``, ``edits``.

    Two words ``k`` edits apart have something in common that is left when at most ``k`` letters of each are taken out; so
    only words nearly that close ever meet, however many share a syllable.  Long words meet by their grams.
    """
    spark, size = left.sparkSession, F.length("key")
    deal = lambda d: d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key")
    third = lambda n: F.least(F.lit(limits.edits), F.floor(n / 3)).cast("int")
    one = _deletions(deal(left.where(size <= _LISTED).select("key")), third(size), limits.edits).withColumnRenamed("key", "l")
    two = _deletions(deal(right.where(size <= _LISTED + limits.edits).select("key")), third(size + limits.edits), limits.edits).withColumnRenamed("key", "r")
    # The neighbourhoods are far larger than the words they come from: never broadcast.
    near = one.join(two.hint("merge"), "rest").where(F.abs(F.length("l") - F.length("r")) <= limits.edits).select("l", "r").distinct()
    edits = F.levenshtein("l", "r", limits.edits)
    enough = (F.col("edits") >= 0) & (F.col("edits") * 3 <= F.length("l"))
    a, b = grams(F.col("l")), grams(F.col("r"))
    both = F.size(F.array_intersect(a, b))
    near = near.withColumn("edits", edits).where(enough).withColumn("jaccard", both / (F.size(a) + F.size(b) - both)).where(F.col("jaccard") >= limits.jaccard)
    far = similar_sets(left.where(size > _LISTED), right.where(size > _LISTED - limits.edits), limits.jaccard).withColumn("edits", edits).where(enough)
    return near.select("l", "r", "jaccard", "edits").union(far.select("l", "r", "jaccard", "edits"))


_LEET = str.maketrans("0134578", "oleastb")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text in order; digits within a word are read as the letters they look like."""
    for batch in batches:
        w = W.split(W.plain(batch["text"]))
        words = w.texts().dictionary_encode()
        fixed = [t.translate(_LEET) if sum(c.isalpha() for c in t) * 2 > len(t) else t for t in words.dictionary.to_pylist()]
        words = pa.array(fixed, pa.string()).take(words.indices) if fixed else pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays([batch["id"], W.lists_of(words, w.first)], names=["id", "words"])


def word_lists(df: DataFrame, id: str, text: str) -> DataFrame:
    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_tokens, f"id {kind}, words array<string>")


def _is_short_for(token: Column, word: Column) -> Column:
    """A token that is the word, a slip of it, or an abbreviation keeping its first letter and the order of letters."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(token, r"(.)", "$1.*"), F.lit("$"))
    return F.coalesce((token == word) | ((F.length(token) >= 4) & (F.levenshtein(token, word) <= 2)) | ((F.length(token) >= 2) & token.rlike("^[a-z]+$") & F.regexp_like(word, pattern)), F.lit(False))


def map_names(records: DataFrame, companies: DataFrame, listed: DataFrame, *, limits: NameLimits = NameLimits()) -> DataFrame:
    """Best canonical entry of each record: ``id``, ``whole``, ``ticker`` (``NONE`` when no listed one is named).

    ``records``: ``id``, ``text`` and ``whole`` (the text is a name and nothing else); ``companies``: ``ticker``,
    ``company``; ``listed``: ``alias``, ``ticker`` of reviewed aliases.  A ticker symbol counts only as
    written in capitals on its own, or as a listed alias that is the whole text.  A company of one word is named by
    that word, as listed; longer names also by their words with slips or shortened; a whole text also by its
    likeness to a whole name or alias.  Of several names in
    one text the closest counts, then the one that comes first, then the lowest ticker.  Null or empty texts map to ``NONE``; repeated
    records are each mapped, provided ids are unique per ``whole``; empty lists map everything to ``NONE``.
    """
    records = cut(records.select(F.xxhash64("id", "whole").alias("rid"), "id", "whole", "text"))
    words = written(word_lists(records, "rid", "text").withColumnRenamed("id", "rid"))
    firms = companies.where("ticker is not null and company is not null").select("ticker", F.col("company").alias("text"))
    firms = written(word_lists(firms, "ticker", "text").select(F.col("id").alias("ticker"), F.filter("words", lambda x: ~x.isin(*LEGAL_FORMS)).alias("w")).where("size(w) >= 1"))
    all_names = firms.select("ticker", F.array_join("w", " ").alias("name"))
    single = firms.where("size(w) = 1").select("ticker", F.col("w")[0].alias("w1"))
    firms = firms.where("size(w) >= 2").select("ticker", F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2"), F.get("w", F.lit(2)).alias("sector"))

    # 1. A listed alias or company name that is the whole text, or a ticker symbol.
    squeeze = lambda c: F.array_join(F.filter(c, lambda x: ~x.isin(*LEGAL_FORMS)), " ")
    known = listed.where("ticker is not null and alias is not null").select(F.col("ticker"), F.col("alias").alias("text"))
    known = word_lists(known.withColumn("k", F.concat_ws("\u0001", "ticker", "text")), "k", "text").select(F.substring_index("id", "\u0001", 1).alias("ticker"), squeeze("words").alias("name")).union(all_names)
    known = known.where("name <> ''").groupBy("name").agg(F.min("ticker").alias("ticker"), F.max("ticker").alias("other")).where("ticker = other").drop("other")
    whole = words.join(records.where("whole").select("rid"), "rid").select("rid", squeeze("words").alias("name"))
    exact = whole.join(known, "name").select("rid", "ticker", F.lit(0.0).alias("cost"), F.lit(0).alias("pos"))
    symbols = records.select("rid", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?:^|[^A-Za-z0-9])([A-Z][A-Z0-9]{1,7})(?![A-Za-z0-9])"), F.lit(1))).alias("pos", "ticker"))
    symbols = symbols.join(companies.where("ticker is not null").select("ticker").distinct(), "ticker").select("rid", "ticker", F.lit(0.0).alias("cost"), "pos")

    # 2. Words of the texts that are, or resemble, words of the names.
    forms = firms.select(
        "ticker", "w1", "w2", "sector",
        F.explode(
            F.array_compact(F.array(
                F.struct(F.col("w1").alias("form"), F.lit("1").alias("part")),
                F.struct(F.col("w2").alias("form"), F.lit("2").alias("part")),
                F.struct(F.concat("w1", "w2").alias("form"), F.lit("b").alias("part")),
                F.struct(F.concat("w2", "w1").alias("form"), F.lit("b").alias("part")),
                F.when(F.length("w1") > limits.short + 1, F.struct(F.substring("w1", 1, limits.short + 1).alias("form"), F.lit("s").alias("part"))),
                F.when(F.length("w1") > limits.short, F.struct(F.substring("w1", 1, limits.short).alias("form"), F.lit("s").alias("part"))),
            ))
        ).alias("f"),
    ).select("ticker", "w1", "w2", "sector", "f.form", "f.part")
    forms = cut(forms)
    spots = words.select("rid", F.posexplode("words").alias("pos", "token"), "words").select(
        "rid", "pos", "token", F.get("words", F.col("pos") - 1).alias("before"), F.get("words", F.col("pos") + 1).alias("next")
    )
    # A one-word name is that word, as it stands; short words and those with figures are never taken for a slip of another.
    lone = spots.join(single, F.col("token") == F.col("w1")).select("rid", "ticker", F.lit(0.3).alias("cost"), "pos")
    spots = cut(spots.where((F.length("token") >= 4) & F.col("token").rlike(r"^\D+$")))
    right = forms.select(F.col("form").alias("key")).distinct()
    tokens = spots.select(F.col("token").alias("key")).distinct()
    odd = cut(tokens.join(right, "key", "left_anti").withColumn("tokens", grams(F.col("key"))))
    near = close_words(odd, cut(right.withColumn("tokens", grams(F.col("key")))), limits)
    near = near.select(F.col("l").alias("token"), F.col("r").alias("form"), (F.col("edits") + 1 - F.col("jaccard")).alias("cost"))
    same = tokens.join(right, "key").select(F.col("key").alias("token"), F.col("key").alias("form"), F.lit(0.0).alias("cost"))
    to_form = cut(same.union(near))

    # 3. Both words of one entry side by side, or one with the other's initial or short form, or both in one.
    hits = spots.join(to_form, "token").join(forms, "form")
    # A shortened first word is only as good as the second one beside it.
    hits = hits.select("rid", "ticker", "w1", "sector", F.struct("pos", "part", "cost", "before", "next").alias("h"))
    per = hits.groupBy("rid", "ticker").agg(F.any_value("w1").alias("w1"), F.any_value("sector").alias("sector"), F.collect_list("h").alias("h"))
    pairs = F.flatten(F.transform("h", lambda x: F.transform(
        F.filter("h", lambda y: (y["part"] == "2") & x["part"].isin("1", "s") & (F.abs(x["pos"] - y["pos"]) == 1)),
        lambda y: F.struct((x["cost"] + y["cost"] + F.when(x["part"] == "s", F.lit(0.5)).otherwise(0.0)).alias("cost"), F.least(x["pos"], y["pos"]).alias("pos"), F.when(x["pos"] > y["pos"], x["next"]).otherwise(y["next"]).alias("next")))))
    alone = F.transform(
        F.filter("h", lambda x: (x["part"] == "b") | ((x["part"] == "2") & (F.length(x["before"]) == 1) & F.col("w1").startswith(x["before"]))),
        lambda x: F.struct((x["cost"] + F.when(x["part"] == "b", F.lit(0.2)).otherwise(0.6)).alias("cost"), x["pos"].alias("pos"), x["next"].alias("next")))
    named = per.select("rid", "ticker", "sector", F.array_min(F.concat(pairs, alone)).alias("m")).where("m is not null").select("rid", "ticker", "sector", "m.cost", "m.pos", "m.next")
    # The line of business tells companies of one name apart; another line than any listed is another company.
    lines = firms.where("sector is not null").groupBy("sector").agg(F.count(F.lit(1)).alias("n")).select(F.col("sector").alias("next"), F.lit(True).alias("a_line"))
    fits = _is_short_for(F.col("next"), F.col("sector"))
    named = named.join(lines, "next", "left").withColumn("fits", fits).where(F.col("fits") | F.col("a_line").isNull())
    named = named.select("rid", "ticker", (F.col("cost") - F.when(F.col("fits"), F.lit(0.9)).otherwise(0.0)).alias("cost"), "pos")

    # 4. A whole text that resembles a whole name or alias, where nothing else was found: the closest by Jaccard similarity.
    decided = exact.select("rid").union(symbols.select("rid")).union(named.select("rid")).union(lone.select("rid")).distinct()
    left = cut(whole.join(decided, "rid", "left_anti").where("length(name) >= 4"))
    open_names = cut(left.select(F.col("name").alias("key")).distinct().withColumn("tokens", grams(F.col("key"))))
    alike = similar_sets(open_names, cut(known.select(F.col("name").alias("key"), grams(F.col("name")).alias("tokens"))), limits.name)
    alike = left.join(alike, F.col("name") == F.col("l")).join(known.select(F.col("name").alias("r"), "ticker"), "r").select("rid", "ticker", (5 - F.col("jaccard")).alias("cost"), F.lit(0).alias("pos"))

    best = exact.withColumn("cost", F.lit(-9.0)).union(symbols.withColumn("cost", F.lit(-5.0))).union(named).union(lone).union(alike).groupBy("rid").agg(F.min(F.struct("cost", "pos", "ticker")).alias("b"))
    return records.join(best, "rid", "left").select("id", "whole", F.coalesce("b.ticker", F.lit("NONE")).alias("ticker"))
