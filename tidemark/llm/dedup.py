"""Deduplicating new deliveries against all history by content-defined chunks.

A body is cut where a rolling hash over its last two words hits a pattern, so an edit changes only
the chunks around it.  A persistent chunk-to-record table finds earlier records sharing chunks;
the bytes of the shared chunks against the smaller record decide, together with the figures of the
two texts (an article with figures of its own is another one).  Pages (normalised urls) and
titles, where a body is missing, decide the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.components import components
from tidemark.session import cut, release, remove, written

_YEARS = set(W.split(pa.array([str(y) for y in range(1900, 2100)])).hash.tolist())


@dataclass(frozen=True)
class DedupLimits:
    """Thresholds; one title and two common figures make up for missing coverage.

    coverage: least share of the smaller body's bytes in shared chunks; figures: least share of the
    smaller body's figures in both; lone: least coverage where the smaller body has one figure or none;
    divisor: a chunk ends at one word of so many on average."""

    coverage: float = 0.2
    figures: float = 0.6
    lone: float = 0.6
    divisor: int = 4


def page_key(url: Column) -> Column:
    """One key for all addresses of a page: no scheme, www./m., fragment, tracking parameters or closing slash."""
    u = F.lower(F.trim(url))
    rest = F.regexp_replace(F.regexp_replace(u, r"#.*$", ""), r"^[a-z]+://(?:(?:www|m|mobile|amp)\.)?", "")
    rest = F.regexp_replace(rest, r"(?<=[?&])(?:utm_[a-z]+|ref|source|fbclid|gclid|mc_cid|mc_eid)=[^&]*&?", "")
    return F.nullif(F.regexp_replace(rest, r"[/?&]+$", ""), F.lit(""))


# A signature: one bit for each figure (several may share one), and above them how many figures there are.
_BITS, _MOST = 58, 63
# Figures (each once, the longest first) and chunks are known by 31 bits of their hashes.
_FEATURES = "id bigint, page bigint, title bigint, title_text string, halves array<bigint>, body bigint, bytes int, figures array<int>, chunks array<int>, sig bigint"


@dataclass
class _Titles:
    """Keys of a column of titles: hash of the words (``some`` tells where there are any), the words, the hashes of the two halves."""

    key: np.ndarray
    some: np.ndarray
    texts: pa.Array
    halves: pa.Array


def _titles(column: pa.Array) -> _Titles:
    n = len(column)
    t = W.split(pc.replace_substring_regex(pc.replace_substring_regex(W.plain(column), r"\s+[-|]\s+[a-z]+\s*$", ""), r"\busd\b", ""))
    key = np.zeros(n, np.uint64)
    some = t.first[:-1] < t.first[1:]
    key[some] = W.runs(t.hash, t.first[:-1][some])
    # The two halves of a title: an error in one word leaves the other half whole.
    place = np.arange(len(t.hash)) - t.first[t.row]
    n_words = np.diff(t.first)
    begins = np.flatnonzero((place == 0) | (place == (n_words // 2)[t.row])) if len(t.hash) else np.zeros(0, np.int64)
    long = n_words[t.row[begins]] >= 4
    return _Titles(key, some, pc.binary_join(W.lists_of(t.texts(), t.first), " "), W.lists(t.row[begins][long], W.runs(t.hash, begins)[long], n))


def title_features(df: DataFrame) -> DataFrame:
    """``id``, ``title``, ``title_text``, ``halves`` and ``body`` of rows of ``id``, ``title`` and ``body`` (a key, passed on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _titles(batch["title"])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(t.key.view(np.int64), mask=~t.some), t.texts, t.halves, batch["body"]], names=["id", "title", "title_text", "halves", "body"])

    return df.select("id", "title", "body").mapInArrow(run, "id bigint, title bigint, title_text string, halves array<bigint>, body bigint")


def _features(divisor: int):
    years = np.array(sorted(_YEARS), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            b = W.split(pc.replace_substring_regex(W.plain(batch["body"]), r"^\s*\([a-z .]{2,40}\) - ", ""))
            t = _titles(batch["title"])
            # Body: drop a currency word, cut into chunks, note figures.
            usd = W.split(pa.array(["usd"])).hash[0]
            keep = b.hash != usd
            h, row, size, number = b.hash[keep], b.row[keep], b.size[keep], b.number[keep]
            first = np.searchsorted(row, np.arange(n + 1))
            fresh = np.zeros(len(h), bool)
            fresh[first[:-1][first[:-1] < first[1:]]] = True
            with np.errstate(over="ignore"):
                rolling = W.mix(h + np.where(fresh, np.uint64(0), np.concatenate([[np.uint64(0)], h])[: len(h)]) * np.uint64(31))
            ends = (rolling % np.uint64(divisor)) == 0
            begin = np.flatnonzero(fresh | np.concatenate([[False], ends[:-1]])) if len(h) else np.zeros(0, np.int64)
            chunk = W.runs(h, begin)
            length = np.minimum(np.add.reduceat(size, begin), 255) if len(begin) else np.zeros(0, np.int64)
            figure = np.flatnonzero(number)
            figure = figure[~np.isin(h[figure], years)]
            chunk = (chunk & ~np.uint64(0xFF)) | length.astype(np.uint64)
            crow = row[begin]
            short = lambda v: (v & np.uint64(0x7FFFFFFF)).astype(np.int32)
            parts = short(chunk)
            # The figures of a body, each once, the longest first: they are the rarest.
            fig, frow, fsize = short(h[figure]), row[figure], size[figure]
            order = np.lexsort((fig, -fsize, frow))
            fig, frow = fig[order], frow[order]
            once = np.concatenate([[True], (fig[1:] != fig[:-1]) | (frow[1:] != frow[:-1])]) if len(fig) else np.zeros(0, bool)
            fig, frow = fig[once], frow[once]
            # Signature of a body's figures: pairs with too few bits in common have too few figures in common.
            bits = np.zeros(n, np.uint64)
            np.bitwise_or.at(bits, frow, np.uint64(1) << ((fig >> 8) % _BITS).astype(np.uint64))
            sig = bits | (np.minimum(np.bincount(frow, minlength=n), _MOST).astype(np.uint64) << np.uint64(_BITS))
            body = np.zeros(n, np.uint64)
            full = first[:-1] < first[1:]
            body[full] = W.runs(h, first[:-1][full])
            none = lambda v, ok: pa.array(v.view(np.int64), pa.int64(), mask=~ok)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    batch["page"],
                    none(t.key, t.some),
                    t.texts,
                    t.halves,
                    none(body, full),
                    pa.array(np.bincount(crow, weights=length, minlength=n).astype(np.int32)),
                    W.lists(frow, fig, n, pa.int32()),
                    W.lists(crow, parts, n, pa.int32()),
                    pa.array(sig.view(np.int64)),
                ],
                names=["id", "page", "title", "title_text", "halves", "body", "bytes", "figures", "chunks", "sig"],
            )

    return run


def article_features(df: DataFrame, *, id: str, url: str, title: str, body: str, limits: DedupLimits = DedupLimits()) -> DataFrame:
    """Page, title and body keys, chunks and figures of each record (one row per input row with an id)."""
    cols = [F.col(id).cast("bigint").alias("id"), page_key(F.col(url)).alias("page"), F.col(title).cast("string").alias("title"), F.col(body).cast("string").alias("body")]
    rows = df.where(F.col(id).isNotNull()).select(*cols).withColumn("page", F.when(F.col("page").isNotNull(), F.xxhash64("page")))
    return rows.mapInArrow(_features(limits.divisor), _FEATURES)


def _count(sig: str) -> Column:
    return F.shiftrightunsigned(sig, _BITS).cast("int")


def _most_figures(a: str, b: str) -> Column:
    """The most figures that two texts may have in common by their signatures.

    Common figures have common bits, but for those of one text that share a bit."""
    bits = lambda c: F.col(c).bitwiseAND(F.lit((1 << _BITS) - 1))
    ones = lambda c: F.bit_count(c).cast("int")
    most = ones(bits(a).bitwiseAND(bits(b))) + F.least(_count(a) - ones(bits(a)), _count(b) - ones(bits(b)))
    return F.when(F.least(_count(a), _count(b)) == _MOST, F.lit(1 << 20)).otherwise(most)


def _needed(figures: Column, share: float) -> Column:
    """How many figures of a text of so many must stand in another one."""
    return F.ceil(F.lit(share) * figures - F.lit(1e-9)).cast("int")


# The chunks of a body are marked in so many words of 64 bits; the keys of figures are joined in so many slices, one after the other.
_WORDS, _SLICES, _NEVER = 4, 3, (1 << 10) - 1
_MARKS = [f"w{k}" for k in range(_WORDS)]


def _figure_keys(figures: np.ndarray, row: np.ndarray, n: int, title: np.ndarray, again: np.ndarray, share: float) -> list[tuple[pa.ListArray, np.ndarray]]:
    """For each slice, the keys under which bodies of two figures or more meet, and how many of them, the first, are keys of the body with fewer figures.

    A key is 31 bits of a hash of two figures, or of the title (where it stands ``again``) and a figure, and below them whether it has the title."""
    first = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(first)
    need = np.maximum(np.ceil(share * count - 1e-9).astype(np.int64), 2)
    at = np.arange(len(row)) - first[row]
    value = figures.astype(np.uint64)
    later = count[row] - 1 - at
    x = np.repeat(np.arange(len(row)), later)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
    with np.errstate(over="ignore"):
        pair = W.mix((np.minimum(value[x], value[y]) << np.uint64(32)) | np.maximum(value[x], value[y]))
        t = np.flatnonzero(again[row] & (count[row] >= 2))
        titled = W.mix(title.view(np.uint64)[row[t]] * np.uint64(31) + value[t])
    hashed = np.concatenate([pair, titled]) >> np.uint64(33)
    key = ((hashed << np.uint64(1)) | (np.arange(len(hashed)) >= len(x)).astype(np.uint64)).astype(np.uint32).view(np.int32)
    krow = np.concatenate([row[x], row[t]])
    few = (count - need)[krow] + np.concatenate([np.full(len(x), 2), np.ones(len(t), np.int64)])
    rest = np.concatenate([at[y], at[t]]) >= few
    order = np.argsort(krow * 2 + rest, kind="stable")
    out = []
    for part in range(_SLICES):
        some = order[hashed[order] % np.uint64(_SLICES) == part]
        out.append((W.lists(krow[some], key[some], n, pa.int32()), np.bincount(krow[some][~rest[some]], minlength=n)))
    return out


def _marked(reps: DataFrame, limits: DedupLimits) -> DataFrame:
    """``reps`` with each chunk once, marks of the chunks (``w0`` and so on), the keys of its figures (``keys0`` and so on, of
    which the first ``small0`` are those of the body with fewer figures), and ``size``: the bytes and, from bit 32 and 42 on, the
    fewest marks that twice the ``coverage`` and the ``coverage`` may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, column = batch.num_rows, batch["chunks"]
            chunk, row = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = np.unique((row << 31) | chunk)
            row, chunk = whole >> 31, whole & 0x7FFFFFFF
            slot, which = np.unique(row * (64 * _WORDS) + ((chunk >> 8) & (64 * _WORDS - 1)), return_inverse=True)
            weight = np.bincount(which, weights=chunk & 255, minlength=len(slot))
            srow, place = slot // (64 * _WORDS), slot % (64 * _WORDS)
            words = np.zeros((_WORDS, n), np.uint64)
            np.bitwise_or.at(words, (place >> 6, srow), np.uint64(1) << (place & 63).astype(np.uint64))
            # Of the heaviest marks, so many are below the share.
            order = np.lexsort((-weight, srow))
            w, r = weight[order], srow[order]
            before = np.cumsum(w) - w
            before -= before[np.searchsorted(r, r)]
            total, size = np.bincount(srow, weights=weight, minlength=n), batch["bytes"].to_numpy(zero_copy_only=False)
            least = [np.where(total < (need := share * size - 1e-6), _NEVER, np.bincount(r[before < need[r]], minlength=n)).astype(np.int64) for share in (2 * limits.coverage, limits.coverage)]
            packed = size.astype(np.int64) | (least[0] << 32) | (least[1] << 42)
            figures, frow = pc.list_flatten(batch["figures"]).to_numpy(zero_copy_only=False), pc.list_parent_indices(batch["figures"]).to_numpy(zero_copy_only=False).astype(np.int64)
            again = batch["again"].to_numpy(zero_copy_only=False).astype(bool)
            keys = _figure_keys(figures, frow, n, pc.fill_null(batch["title"], 0).to_numpy(zero_copy_only=False), again, limits.figures)
            columns = [batch["code"], batch["bytes"], pc.list_value_length(batch["figures"]), batch["sig"], W.lists(row, chunk.astype(np.int32), n, pa.int32()), *(pa.array(x.view(np.int64)) for x in words), pa.array(packed)]
            columns += [c for k, m in keys for c in (k, pa.array(m.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["code", "bytes", "n_figures", "sig", "chunks", *_MARKS, "size", *(c for k in range(_SLICES) for c in (f"keys{k}", f"small{k}"))]
    kind = "code bigint, bytes int, n_figures int, sig bigint, chunks array<int>, " + "".join(f"{w} bigint, " for w in _MARKS) + "size bigint" + "".join(f", keys{k} array<int>, small{k} int" for k in range(_SLICES))
    return reps.select("code", "title", "bytes", "figures", "sig", "again", "chunks").mapInArrow(run, kind)


def _marked_bytes(parts: str, suffix: str = "") -> Column:
    """Bytes of the chunks of ``parts`` that have a mark in the words of another body: no less than what both share."""
    word = lambda c: F.shiftright(c, 14).bitwiseAND(F.lit(_WORDS - 1))

    def there(c: Column) -> Column:
        words = F.lit(0).cast("bigint")
        for k, w in enumerate(_MARKS):
            words = F.when(word(c) == k, F.col(w + suffix)).otherwise(words)
        return F.call_function("shiftright", words, F.shiftright(c, 8).bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1

    return F.aggregate(parts, F.lit(0), lambda s, c: s + F.when(there(c), c.bitwiseAND(F.lit(255))).otherwise(0))


def _figure_pairs(reps: DataFrame, limits: DedupLimits, part: int) -> DataFrame:
    """Pairs (a, b) that may be one text and have two figures or more in common: with all parts, all that reach the limits.

    The text with fewer figures must have ``need`` of its ``n`` in the other one, so two of any ``n - need + 2`` of them
    stand in the other: pairs of figures, in whatever order, are the key, those of the longest on one side, all on the
    other.  Of one title, one of any ``n - need + 1`` does.  What can't be one text is dropped inside the join, which adaptive
    execution may split: by the signatures of the figures, by the number of common marks of chunks, and by the bytes of the
    marked chunks; a title in common (a key of its own) needs none.  Few texts with two figures in common share any of their
    words, so it is the marks that keep the pairs from growing with the square of the texts on disk.  Of the keys, a ``part``
    of ``_SLICES`` is joined at a time.
    """
    own = lambda s: [F.col("code").alias(s), F.col("sig").alias(f"s{s}"), *[F.col(x).alias(f"{x}_{s}") for x in ("size", *_MARKS)]]
    titled = F.col("key").bitwiseAND(F.lit(1)) == 1
    small = reps.where(f"small{part} > 0").select(*own("a"), "chunks", F.slice(f"keys{part}", F.lit(1), F.col(f"small{part}")).alias("keys"))
    small = small.select("a", "sa", "size_a", *[f"{w}_a" for w in _MARKS], "chunks", F.explode("keys").alias("key")).withColumn("parts", F.when(~titled, F.col("chunks"))).drop("chunks")
    large = reps.select(*own("b"), F.explode(f"keys{part}").alias("key"))
    fewer = (_count("sa") < _count("sb")) | ((_count("sa") == _count("sb")) & ((F.col("a") < F.col("b")) | (_count("sa") == _MOST)))
    fresh = (F.col("a").bitwiseOR(F.col("b"))).bitwiseAND(F.lit(1)) == 1
    most = _most_figures("sa", "sb")
    # Two figures are enough only with twice the coverage of the smaller body, unless the title is the same.
    size = lambda s: F.col(f"size_{s}").bitwiseAND(F.lit(0xFFFFFFFF))
    smaller = F.when(size("a") <= size("b"), F.col("size_a")).otherwise(F.col("size_b"))
    marks = sum((F.bit_count(F.col(f"{w}_a").bitwiseAND(F.col(f"{w}_b"))).cast("int") for w in _MARKS), F.lit(0))
    least = F.when(most >= 3, F.shiftright(smaller, 42)).otherwise(F.shiftright(smaller, 32).bitwiseAND(F.lit(_NEVER)))
    share = F.when(most >= 3, F.lit(limits.coverage)).otherwise(F.lit(2 * limits.coverage))
    covered = titled | ((marks >= least) & (_marked_bytes("parts", "_b") >= share * smaller.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1e-6)))
    joined = small.join(large, "key").where((F.col("a") != F.col("b")) & fewer & fresh & (most >= _needed(_count("sa"), limits.figures)) & covered)
    half = lambda c: F.floor(c / 2)
    return joined.select(half(F.least("a", "b")).alias("a"), half(F.greatest("a", "b")).alias("b")).distinct()


def _body_links(feats: DataFrame, limits: DedupLimits, keep) -> DataFrame:
    """Verified links (a, b) between records that may be one text, at least one of them fresh."""
    # Of one body under one title, one record (an old one, if any) stands for all; the copies are linked by their body.
    heads = cut(feats.where("body is not null").groupBy("body", "title").agg(F.coalesce(F.min(F.when(~F.col("fresh"), F.col("id"))), F.min("id")).alias("id")).select("id", "title"))
    again = heads.where("title is not null").groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("title", F.lit(True).alias("again"))
    heads = cut(heads.join(again, "title", "left").select("id", F.coalesce("again", F.lit(False)).alias("again")))
    cols = [(F.col("id") * 2 + F.col("fresh").cast("int")).alias("code"), "title", "bytes", "figures", "sig", "chunks"]
    reps = keep(_marked(feats.select("id", *cols).join(heads, "id").drop("id"), limits))
    release(feats.sparkSession)
    pairs = None
    for part in range(_SLICES):
        some = cut(_figure_pairs(reps, limits, part))
        pairs = some if pairs is None else pairs.union(some)
        release(feats.sparkSession)
    pairs = cut(pairs.union(_lone_pairs(reps, limits)).distinct())
    release(feats.sparkSession)
    held = keep(feats.select("id", "title", "bytes", "figures", "chunks").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi"))
    release(feats.sparkSession)
    side = lambda s: held.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("title", "bytes", "figures", "chunks")])
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").where(same_text(limits)).select("a", "b"))


def _bitmap(spark, chunks: DataFrame) -> DataFrame:
    """One row with a bitmap of ``_MAP`` bits (128 KB, however many chunks) that tells chunks of ``chunks`` from nearly all others."""
    at = _place(F.col("chunk"))
    words = chunks.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63))).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(_MAP // 64, np.int64)
    held[words["word"].to_numpy()] = words["bits"].to_numpy()
    return F.broadcast(spark.createDataFrame(pa.table([pa.array([held.tolist()], pa.list_(pa.int64()))], names=["map"])))


_MAP = 1 << 20


def _place(chunk: Column) -> Column:
    """Bit of a chunk: its hash without the length in the lowest byte."""
    return F.shiftright(chunk, 8).bitwiseAND(F.lit(_MAP - 1))


def _in_map(chunk: Column) -> Column:
    at = _place(chunk)
    return F.get("map", F.shiftright(at, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)))) != 0


def _only(df: DataFrame, some: DataFrame) -> DataFrame:
    """Rows of ``df`` with those of their ``chunks`` that stand among ``some`` (column ``chunk``), and a few more; rows left without any go.

    A bitmap of 16 bits a chunk, 8 MB at most, tells them; what passes beyond is dropped by the joins that follow."""
    spark = df.sparkSession
    bits = int(np.clip(np.ceil(np.log2(16 * max(some.count(), 1))), 20, 26))
    at = F.shiftright((F.col("chunk").cast("bigint") * _SPREAD).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - bits)
    words = some.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(1 << (bits - 6), np.int64)
    held[words["word"].to_numpy()] = words["bits"].to_numpy()
    known = spark.sparkContext.broadcast(held.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["chunks"]
            flat, row = pc.list_flatten(column).to_numpy(zero_copy_only=False), pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
            place = ((flat.astype(np.uint64) * np.uint64(_SPREAD)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)
            there = (known.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            lists = W.lists(row[there], flat[there], batch.num_rows, pa.int32())
            out = pa.RecordBatch.from_arrays([lists if c == "chunks" else batch[c] for c in batch.schema.names], names=batch.schema.names)
            yield out.filter(pc.greater(pc.list_value_length(lists), 0))

    return df.mapInArrow(run, df.schema)


_SPREAD = 2654435761


def _lone_pairs(reps: DataFrame, limits: DedupLimits) -> DataFrame:
    """Pairs (a, b) that may be one text with one common figure or none, which one of them must have few figures for: all that reach ``limits.lone``.

    The smaller body must share that part of its bytes, so it shares one of its rarest chunks that together
    are more than the part it may lack.  Only chunks of bodies with so few figures come into question; bitmaps of
    them keep nearly all chunks of all other bodies out of any shuffle, and marks of all chunks tell inside the join
    which bodies may share enough.
    """
    size = lambda c: c.bitwiseAND(F.lit(255))
    bodies = reps.select(F.floor(F.col("code") / 2).alias("id"), (F.col("code") % 2 == 1).alias("fresh"), "bytes", (_needed(F.col("n_figures"), limits.figures) <= 1).alias("lone"), "chunks")
    known = _only(bodies, bodies.where("lone").select(F.explode("chunks").alias("chunk")))
    total = F.aggregate("chunks", F.lit(0), lambda s, c: s + size(c))
    # The smaller body of a pair: one with few figures, or one of which enough stands in such.
    small = known.where(F.col("lone") | (total >= limits.lone * F.col("bytes") - F.lit(1e-6)))
    small = cut(small.select("id", "fresh", "bytes", "lone", F.explode("chunks").alias("chunk")))
    every = _only(bodies, small.select("chunk")).select("lone", F.explode("chunks").alias("chunk"))
    # A body with few figures is laid against all, any other against those with few.
    counts = every.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("lone").cast("bigint")).alias("n_lone"))
    cost = small.join(counts, "chunk").withColumn("cost", F.when(F.col("lone"), F.col("n")).otherwise(F.col("n_lone"))).where("cost > 0")
    order = Window.partitionBy("id").orderBy("cost", "chunk")  # the chunks of one body
    spare = F.sum(size(F.col("chunk"))).over(Window.partitionBy("id")) - limits.lone * F.col("bytes") + 1e-6
    before = F.sum(size(F.col("chunk"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size(F.col("chunk"))
    probes = cut(cost.select("*", spare.alias("spare"), before.alias("before")).where("before <= spare").select("chunk", F.col("id").alias("p"), F.col("bytes").alias("bytes_p"), F.col("lone").alias("lone_p"), F.col("fresh").alias("fresh_p")))
    release(reps.sparkSession)
    marks = reps.select(F.floor(F.col("code") / 2).alias("id"), (F.col("code") % 2 == 1).alias("fresh"), "bytes", (_needed(F.col("n_figures"), limits.figures) <= 1).alias("lone"), "chunks", *_MARKS)
    hit = _only(marks, probes.select("chunk")).select("id", "fresh", "bytes", "lone", *_MARKS, F.explode("chunks").alias("chunk"))
    probes = probes.join(bodies.select(F.col("id").alias("p"), F.col("chunks").alias("parts")), "p")
    pairs = probes.join(hit, "chunk").where((F.expr("p != id and bytes_p <= bytes and (lone or lone_p) and (fresh or fresh_p)")) & (_marked_bytes("parts") >= limits.lone * F.col("bytes_p") - F.lit(1e-6)))
    return pairs.select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()


def same_text(limits: DedupLimits) -> Column:
    """Whether the bodies of a pair with columns ``*_a`` and ``*_b`` are one text, whole or in part."""
    shared = F.aggregate(F.array_intersect("chunks_a", "chunks_b"), F.lit(0), lambda s, c: s + c.bitwiseAND(F.lit(255)))
    covered = shared / F.greatest(F.least("bytes_a", "bytes_b"), F.lit(1))
    fewest = F.least(F.size(F.array_distinct("figures_a")), F.size(F.array_distinct("figures_b")))
    both = F.size(F.array_intersect("figures_a", "figures_b"))
    ratio = F.when(fewest > 0, both / fewest).otherwise(F.lit(1.0))
    return (ratio >= limits.figures) & (covered >= F.when((both >= 2) & F.coalesce(F.col("title_a") == F.col("title_b"), F.lit(False)), F.lit(0.0)).when(both >= 3, F.lit(limits.coverage)).when(both == 2, F.lit(2 * limits.coverage)).otherwise(F.lit(limits.lone)))


def _stars(rows: DataFrame, key: str) -> DataFrame:
    """Links from each row to the first row with its key; with a column ``fresh``, only for keys of fresh rows."""
    rows = rows.where(F.col(key).isNotNull())
    fresh = F.col("fresh") if "fresh" in rows.columns else F.lit(True)
    lo = rows.groupBy(key).agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n"), F.max(fresh).alias("touched")).where("n > 1 and touched").select(key, "a")
    return rows.select(key, F.col("id").alias("b")).join(lo, key).where("a < b").select("a", "b")


def _title_links(feats: DataFrame, label: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Links of rows without a body to the one article that bears their title, or its title but for a typing error.

    A title that stands over several articles decides nothing.  With a column ``fresh``, only titles of fresh rows are looked at.
    """
    titled = feats.where("title is not null")
    fresh = F.col("fresh") if "fresh" in feats.columns else F.lit(True)
    if "fresh" in feats.columns:
        titled = titled.join(feats.where("fresh and title is not null").select("title").distinct(), "title", "left_semi")
    rows = titled.select("id", "title", F.col("body").isNotNull().alias("full")).join(label, "id", "left").select("id", "title", "full", F.coalesce("first", "id").alias("art"))
    rows = cut(rows)
    heads = rows.groupBy("title").agg(F.min(F.when(F.col("full"), F.col("art"))).alias("lo"), F.max(F.when(F.col("full"), F.col("art"))).alias("hi"), F.min("id").alias("first_id"), F.min("full").alias("all_full")).where("not all_full")
    heads = cut(heads)
    exact = rows.where("not full").join(heads.where("lo is null or lo = hi").select("title", F.coalesce("lo", "first_id").alias("a")), "title").select("a", F.col("art").alias("b")).distinct()
    # Bridge typing errors for the titles that stand over no body at all.
    alone = feats.where("body is null").select("id", "title_text", "halves", fresh.alias("fresh")).join(heads.where("lo is null").select(F.col("first_id").alias("id")), "id")
    if known is not None:  # and those known before that are still alone: a fresh body may fit
        old = feats.where("body is null and not fresh and title is not null").select("id", "title_text", "halves", "fresh")
        alone = alone.union(old.join(known.select("id"), "id", "left_anti").join(known.select(F.col("first").alias("id")), "id", "left_anti"))
    # A slip changes no figure: half of a title and its figures make the key, and a bitmap of the keys asked for keeps all other titles where they are.
    key = F.xxhash64("half", "digits").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("chunk")
    ends = cut(alone.select(F.col("id").alias("b"), F.col("title_text").alias("text_b"), F.col("fresh").alias("fresh_b"), _digits(F.col("title_text")).alias("digits"), F.explode("halves").alias("half")).select("b", "text_b", "fresh_b", "half", key))
    full = feats.where("title is not null and body is not null")
    full = full.select(F.col("id").alias("a"), F.col("title_text").alias("text_a"), fresh.alias("fresh_a"), "halves", _digits(F.col("title_text")).alias("digits"))
    full = full.select("a", "text_a", "fresh_a", "digits", F.explode("halves").alias("half")).select("a", "text_a", "fresh_a", "half", key)
    full = full.crossJoin(_bitmap(feats.sparkSession, ends.select("chunk"))).where(_in_map(F.col("chunk"))).drop("map")
    spots = full.join(ends, ["chunk", "half"]).where("fresh_a or fresh_b")
    near = cut(spots.where(_one_slip("text_a", "text_b")).select("a", "b").distinct())
    near = near.join(label.select(F.col("id").alias("a"), "first"), "a", "left").groupBy("b").agg(F.min(F.coalesce("first", "a")).alias("lo"), F.max(F.coalesce("first", "a")).alias("hi"))
    return exact.union(near.where("lo = hi").select(F.col("lo").alias("a"), "b"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.]+", " ")


def _one_slip(a: str, b: str) -> Column:
    """Titles alike but for a slip of the pen: the same figures, and a few letters apart."""
    return (F.abs(F.length(a) - F.length(b)) <= 4) & (F.levenshtein(a, b, 4) >= 0) & (_digits(F.col(a)) == _digits(F.col(b)))


def resolve_articles(feats: DataFrame, limits: DedupLimits = DedupLimits(), known: DataFrame | None = None, keep=cut) -> DataFrame:
    """Article of each record whose article is new or another than before: ``id``, ``first`` (fresh records that are alone are left out).

    ``feats`` needs a column ``fresh``; of records that are not fresh, ``known`` tells the article (``id``, ``first``; none
    for those alone).  Only the articles that a fresh record touches are labelled.  ``keep`` holds on to wide intermediate tables.
    """
    spark = feats.sparkSession
    known = spark.createDataFrame([], "id bigint, first bigint") if known is None else known
    links = _body_links(feats, limits, keep)
    release(spark)
    links = links.union(_stars(feats, "page")).union(_stars(feats, "body"))
    old = lambda c: known.select(F.col("id").alias(c), F.col("first").alias(f"old_{c}"))
    lift = lambda d: d.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("old_a", "a").alias("a"), F.coalesce("old_b", "b").alias("b")).where("a != b")
    links = cut(lift(links.select("a", "b")))
    release(spark)
    touched = cut(components(links).select(F.col("id").alias("art"), F.col("first").alias("now")))
    release(spark)
    # Titles join whole articles; only those so joined are labelled anew.
    placed = feats.select("id").join(known, "id", "left").select("id", F.coalesce("first", "id").alias("art")).join(touched, "art", "left").select("id", F.coalesce("now", "art").alias("first"))
    placed = cut(placed)
    titled = cut(_title_links(feats, placed, known).where("a != b"))
    to = lambda c: placed.select(F.col("id").alias(c), F.col("first").alias(f"f{c}"))
    merged = components(titled.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("fa", "a").alias("a"), F.coalesce("fb", "b").alias("b")))
    final = placed.join(merged.select(F.col("id").alias("first"), F.col("first").alias("new")), "first", "left").select("id", F.coalesce("new", "first").alias("first"))
    before = known.select("id", F.col("first").alias("was"))
    changed = final.join(before, "id", "left").where(F.col("first") != F.coalesce("was", "id"))
    # The first row of a new article of several names itself.
    return changed.select("id", "first")


class ArticleStore:
    """Features, chunks and articles of everything accepted so far, as parquet under ``path``.

    Rows with a null id are ignored; null or empty urls, titles and bodies never match, and a row
    with none of the three is an article of its own.  Within a delivery and across deliveries the
    lowest id of an article is the one accepted.  A delivery that joins articles taken for different ones before
    merges them, and the later ones' rows are stored anew with the article they now belong to.  An empty delivery gives an empty result.

    ``ingest`` checks a delivery against the store, returns its rows that bring an article already
    accepted (``id``, ``first``), and appends the delivery.  No text of the history is read or chunked
    again, no two rows of the history are compared, and only the articles the delivery touches are labelled.
    A part counts once its last table is written, under a name of its own: a store may be reopened at any time,
    by another session too, and a delivery that failed leaves nothing behind that is read.
    """

    def __init__(self, spark, path: str, limits: DedupLimits = DedupLimits()):
        self.spark, self.path, self.limits = spark, path, limits

    def parts(self) -> list[str]:
        """Names of the deliveries stored so far, in order."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        done = [n.removeprefix("articles-") for n in names if n.startswith("articles-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(done)

    def articles(self) -> DataFrame | None:
        """Article of each record that has company, or None if nothing is stored: ``id``, ``first``."""
        parts = self.parts()
        if not parts:
            return None
        rows = [self.spark.read.schema("id bigint, first bigint").parquet(f"{self.path}/articles-{p}").withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
        all_rows = rows[0]
        for r in rows[1:]:
            all_rows = all_rows.union(r)
        return all_rows.groupBy("id").agg(F.max_by("first", "part").alias("first"))

    def ingest(self, df: DataFrame, *, id: str, url: str, title: str, body: str) -> DataFrame:
        parts = self.parts()
        name = f"{len(parts):06d}-{uuid.uuid4().hex[:12]}"
        here = f"{self.path}/features-{name}"
        article_features(df, id=id, url=url, title=title, body=body, limits=self.limits).write.parquet(here)
        fresh = self.spark.read.schema(_FEATURES).parquet(here)
        feats, known = fresh.withColumn("fresh", F.lit(True)), None
        if parts:
            old = self.spark.read.schema(_FEATURES).parquet(*[f"{self.path}/features-{p}" for p in parts])
            feats, known = feats.unionByName(old.withColumn("fresh", F.lit(False))), self.articles()
        at, work = f"{self.path}/articles-{name}", f"{self.path}/work-{name}"
        keep = lambda d: written(d, work)
        resolve_articles(feats, self.limits, None if known is None else cut(known), keep).write.parquet(at)
        remove(self.spark, work)
        release(self.spark)
        return self.spark.read.schema("id bigint, first bigint").parquet(at).join(fresh.select("id"), "id", "left_semi")
