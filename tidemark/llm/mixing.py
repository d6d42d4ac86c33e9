"""Mixing sources to target weights of the total size in tokens.

Every document gets a random key from the hash of its id.  Within a source the documents are
ranged by key in slices; token counts are added up per slice, a prefix sum over the (few) slices
finds the one in which the budget runs out, and only there rows are ordered and added up one by
one.  Whole epochs of a source come before the cut.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut, written

_ENCODERS: dict[str, object] = {}


def source_key(c: Column) -> Column:
    """Spellings of a source that differ in case, blanks or ``_`` for ``-`` are one."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "-"), F.lit(""))


def _encoder(path: str, pattern: str):
    """A byte-level BPE of a .tiktoken file of ranks; built once in a worker process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(df: DataFrame, *, id: str, text: str, keep: list[Column], tokenizer_path: str, pattern: str) -> DataFrame:
    """``id``, ``keep`` and ``tokens``: the length of each whole text in tokens (0 for null or empty)."""
    held = df.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text"), *keep)
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    names = [c for c in held.columns if c not in ("__id", "__text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer_path, pattern)
        for batch in batches:
            texts = pc.fill_null(batch["__text"], "").to_pylist()
            n = np.fromiter((len(enc.encode_ordinary(t)) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch["__id"], *[batch[c] for c in names], pa.array(n)], names=[id, *names, "tokens"])

    schema = ", ".join([f"`{id}` {kinds['__id']}", *[f"`{c}` {kinds[c]}" for c in names], "tokens bigint"])
    return held.mapInArrow(run, schema)


def mix_sources(
    sized: DataFrame,
    targets: DataFrame,
    *,
    id: str,
    source: str = "source",
    tokens: str = "tokens",
    weight: str = "weight",
    max_repeats: str = "max_repeats",
    total_tokens: int | None = None,
    seed: int = 0,
    slice_rows: int = 50_000,
) -> tuple[DataFrame, DataFrame]:
    """Documents of the mixture (``id``, ``source``, ``repeats``) and its report per target source.

    ``sized`` has one row per document with its source and tokens, ``targets`` one row per source.
    Each source's budget is its weight (over the sum of weights) of ``total_tokens``, by default the
    tokens of all documents of the listed sources.  A source too small for its budget is taken
    whole up to ``max_repeats`` times; the report then shows the missing share as ``gap``.  The last, partial epoch takes documents
    in random order until the one that brings the sum closest to the budget.

    Documents of unlisted or null sources and of 0 or null tokens are not used; a listed source
    without documents is reported with its whole weight as gap; null or negative weights and
    repeats count as 0.  Source names must be unique in ``targets``.  Repeated ids are drawn
    together.  Empty documents give an empty mixture and a report of gaps.
    """
    docs = written(sized.where((F.col(tokens) > 0) & F.col(source).isNotNull()).select(F.col(id).alias("__id"), F.col(source).alias("s"), F.col(tokens).cast("bigint").alias("n")))
    goals = targets.where(F.col(source).isNotNull()).select(F.col(source).alias("s"), F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0)).cast("double").alias("w"), F.greatest(F.coalesce(max_repeats, F.lit(0)), F.lit(0)).cast("bigint").alias("cap"))
    goals = goals.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1))))
    slices = max(1, -(-docs.count() // slice_rows)) * 4
    # The key is uniform on [0, 2^52), so equal ranges of it are equal slices of a source.
    key = F.shiftrightunsigned(F.xxhash64(F.col("__id"), F.lit(seed)), 12)
    ranged = docs.withColumn("key", key).withColumn("slice", F.floor(F.col("key") / F.lit(float(2**52)) * slices).cast("int"))
    sums = cut(ranged.groupBy("s", "slice").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")))
    have = sums.groupBy("s").agg(F.sum("n").alias("available"), F.sum("d").alias("documents"))
    budget = goals.join(have, "s", "left").fillna(0, ["available", "documents"])
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.sum("available").over(Window.partitionBy(F.lit(1))).cast("double")
    budget = budget.withColumn("goal", F.col("w") * total)
    epochs = F.when(F.col("available") > 0, F.least(F.floor(F.col("goal") / F.col("available")), F.col("cap"))).otherwise(F.lit(0)).cast("bigint")
    budget = budget.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("epochs") < F.col("cap"), F.col("goal") - F.col("epochs") * F.col("available")).otherwise(F.lit(0.0)))
    budget = cut(budget)
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    place = cut(sums.withColumn("end", upto).join(budget.select("s", "epochs", "rest"), "s").withColumn("begin", F.col("end") - F.col("n")).drop("n", "d"))
    tagged = ranged.join(place, ["s", "slice"])
    whole = tagged.where("end <= rest").select("__id", "s", "n", (F.col("epochs") + 1).alias("repeats"))
    none = tagged.where("begin >= rest").select("__id", "s", "n", F.col("epochs").alias("repeats"))
    line = Window.partitionBy("s", "slice").orderBy("key", "__id").rowsBetween(Window.unboundedPreceding, 0)
    edge = tagged.where("end > rest and begin < rest").withColumn("sum", F.col("begin") + F.sum("n").over(line))
    # The document across the cut is taken when that comes closer to the budget.
    edge = edge.select("__id", "s", "n", (F.col("epochs") + (F.col("sum") - F.col("n") / 2 <= F.col("rest")).cast("bigint")).alias("repeats"))
    mixture = cut(whole.union(none).union(edge).where("repeats > 0"))
    taken = mixture.groupBy("s").agg(F.sum(F.col("n") * F.col("repeats")).alias("taken"), F.count(F.lit(1)).alias("used"), F.max("repeats").alias("most"))
    report = budget.join(taken, "s", "left").fillna(0, ["taken", "used", "most"])
    all_taken = F.sum("taken").over(Window.partitionBy(F.lit(1)))
    report = report.select(
        F.col("s").alias(source),
        F.round("w", 6).alias("target_share"),
        F.col("available").alias("available_tokens"),
        F.round("goal", 0).cast("bigint").alias("goal_tokens"),
        F.col("taken").alias("taken_tokens"),
        F.col("used").alias("documents_used"),
        F.col("most").alias("most_repeats"),
        F.coalesce(F.round(F.col("taken") / F.nullif(all_taken, F.lit(0)), 6), F.lit(0.0)).alias("actual_share"),
        F.round(F.greatest(F.lit(0.0), F.col("w") - F.coalesce(F.col("taken") / F.nullif(total, F.lit(0.0)), F.lit(0.0))), 6).alias("gap") if total_tokens is not None else F.round(F.greatest(F.lit(0.0), F.col("w") - F.coalesce(F.col("w") * F.col("taken") / F.nullif("goal", F.lit(0.0)), F.lit(0.0))), 6).alias("gap"),
    )
    return mixture.select(F.col("__id").alias(id), F.col("s").alias(source), "repeats"), report
