"""Same or near-same records across splits: a weighted cosine join.

Texts are vectors of term weights, the inverse document frequency: exact for the most frequent terms,
one common value for all that are rarer than these.  The likeness of two texts is the cosine of these
vectors (``cosine``).  A second cosine, of the weights raised to a power (``rare``), must be reached
too: it is ruled by the rare terms, and it is the one that prunes.  By it terms are ordered from heavy
to light; a record is posted in the inverted lists of its leading terms only, as far as the
norm of what remains could still reach the threshold, so a list holds a term at its maximum weight first.  A pair is
dropped on the spot when the two residual norms at its common term can't reach the threshold, or when bit
signatures show that too few figures are common.  The dot products of the pairs left are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.components import components
from tidemark.llm.dedup import _stars, _title_links, title_features
from tidemark.session import cut, written


@dataclass(frozen=True)
class CosineLimits:
    """cosine: least similarity; rare: least similarity by the weights to the ``power``; figures: least share of the
    smaller text's figures in both; lone: least rare similarity where the smaller text has one figure or none;
    terms: how many of the most frequent terms have frequencies of their own; pairs of a list
    compared in one block (a longer list is parted into blocks, and all of its pairs are compared)."""

    cosine: float = 0.5
    rare: float = 0.35
    figures: float = 0.6
    power: float = 2.5
    lone: float = 0.55
    terms: int = 1 << 19
    pairs: int = 1_000_000


@dataclass
class TermWeights:
    """Inverse document frequencies: of the terms in ``known`` (ascending hashes), and of all others."""

    known: np.ndarray
    idf: np.ndarray
    other: float
    _table: tuple | None = None

    def _slots(self) -> tuple[np.ndarray, np.ndarray, np.uint64, np.uint64, np.ndarray]:
        """A table in which nearly every known term stands in one of two slots, and the places of those that don't."""
        bits = max(4, int(4 * len(self.known)).bit_length())
        mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
        place = np.full(1 << bits, -1, np.int64)
        n = np.arange(len(self.known))
        for slot in (self.known & mask, (self.known >> shift) & mask):
            free = n[place[slot[n]] < 0]
            place[slot[free]] = free
            n = n[place[slot[n]] != n]
        return np.where(place < 0, np.uint64(0), self.known[place]), np.where(place < 0, self.other, self.idf[place]), mask, shift, n

    def of(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(terms), self.other)
        if self._table is None:
            self._table = self._slots()
        held, idf, mask, shift, rest = self._table
        one = terms & mask
        out = np.where(held[one] == terms, idf[one], np.nan)
        left = np.flatnonzero(np.isnan(out))
        two = (terms[left] >> shift) & mask
        out[left] = np.where(held[two] == terms[left], idf[two], np.nan)
        left = left[np.isnan(out[left])]
        at = np.searchsorted(self.known[rest], terms[left]) if len(rest) else np.zeros(len(left), np.int64)
        at = np.minimum(at, max(len(rest) - 1, 0))
        out[left] = np.where(self.known[rest][at] == terms[left], self.idf[rest][at], self.other) if len(rest) else self.other
        return out

    def __getstate__(self):
        return {"known": self.known, "idf": self.idf, "other": self.other, "_table": None}


_YEARS = W.split(pa.array([str(y) for y in range(1900, 2100)])).hash
_USD = W.split(pa.array(["usd"])).hash[0]


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text: row, hash, whether a figure.

    Terms are the words and every two figures that follow each other: one number stands in many
    texts, two in a row in few.
    """
    w = W.split(W.plain(column))
    keep = w.hash != _USD
    row, h, fig = w.row[keep], w.hash[keep], w.number[keep]
    at = np.flatnonzero(fig & ~np.isin(h, _YEARS))
    at = at[:-1][row[at[:-1]] == row[at[1:]]] if len(at) > 1 else at[:0]
    if len(at):
        nxt = np.flatnonzero(fig & ~np.isin(h, _YEARS))
        nxt = nxt[np.searchsorted(nxt, at) + 1]
        with np.errstate(over="ignore"):
            twin = W.mix(h[at] * np.uint64(3) + h[nxt])
        row, h, fig = np.concatenate([row, row[at]]), np.concatenate([h, twin]), np.concatenate([fig, np.zeros(len(at), bool)])
    order = np.argsort((row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))  # batches are far smaller than 65536 rows
    row, h, fig = row[order], h[order], fig[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new], fig[new]


def term_weights(texts: DataFrame, text: str, limits: CosineLimits) -> TermWeights:
    """Weights of terms, from document frequencies over all texts.

    The driver gets the ``limits.terms`` most frequent terms of at least two texts, however many texts there are.  All
    other terms stand in no more texts than the rarest of these and weigh alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(_terms(batch["text"])[1])
            n += batch.num_rows
            if sum(map(len, held)) >= 2_000_000:
                yield counted(held)
                held = []
        yield counted(held)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["term", "n"])

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        t, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    counts = cut(texts.select(F.col(text).cast("string").alias("text")).where("text is not null").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).where("term is null or n > 1"))
    total = (counts.where("term is null").first() or {"n": 0})["n"]
    top = counts.where("term is not null").orderBy(F.desc("n"), "term").limit(limits.terms).toArrow()
    known, n = top["term"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(known)
    rest = int(n.min()) if len(n) == limits.terms else 1
    idf = lambda df: np.log((total + 1) / (df + 0.5)).clip(0.05)
    return TermWeights(known[order], idf(n[order]).astype(np.float32), float(np.float32(idf(np.float64(rest)))))


def _postings(batch_texts: pa.Array, weights: TermWeights, limits: CosineLimits) -> tuple[np.ndarray, ...]:
    """Leading terms of each text with the residual norm from each on: row, term, residual; and figures, signature of each text."""
    row, h, fig = _terms(batch_texts)
    n = len(batch_texts)
    number = fig & ~np.isin(h, _YEARS)
    figures = np.bincount(row[number], minlength=n)
    signature = np.zeros(n, np.uint64)
    np.bitwise_or.at(signature, row[number], np.uint64(1) << (h[number] >> np.uint64(58)))
    w = weights.of(h).astype(np.float32)
    # One key for (row, weight from heavy to light, term): the bits of a positive number rise with it.
    order = np.argsort((row.astype(np.uint64) << np.uint64(48)) | (np.uint64(0xFFFFFFFF) - w.view(np.uint32).astype(np.uint64)) << np.uint64(16) | (h >> np.uint64(48)))
    row, h, w = row[order], h[order], w[order].astype(np.float64)
    energy = w ** (2 * limits.power)
    total = np.bincount(row, weights=energy, minlength=n)
    run = np.cumsum(energy)
    first = np.searchsorted(row, np.arange(n))
    before = run - energy - (run[first[row]] - energy[first[row]] if len(row) else 0)
    left = np.sqrt(np.clip(1 - before / total[row], 0, 1)) if len(row) else before
    keep = left >= limits.rare
    return row[keep], h[keep], left[keep], figures, signature


def cosine_candidates(records: DataFrame, weights, limits: CosineLimits) -> DataFrame:
    """Pairs (a, b) of a training and an evaluation record that may reach the threshold.

    ``records``: ``id``, ``train`` (boolean), ``text``; ``weights``: the broadcast table.
    """
    threshold = limits.rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h, left, figures, signature = _postings(batch["text"], weights.value, limits)
            at = pa.array(row)
            cols = [pa.array(h.view(np.int64)), batch["id"].take(at), batch["train"].take(at), pa.array(left.astype(np.float32)), pa.array(np.minimum(figures, 32767).astype(np.int16)[row]), pa.array(signature.view(np.int64)[row])]
            yield pa.RecordBatch.from_arrays(cols, names=["term", "id", "train", "left", "figures", "bits"])

    # Written, as both the counts and the join read it: one pass over the texts.
    posted = written(records.mapInArrow(run, "term bigint, id bigint, train boolean, left float, figures smallint, bits bigint"))
    n = lambda c: F.sum(c.cast("bigint"))
    lists = posted.groupBy("term").agg(n(F.col("train")).alias("nt"), n(~F.col("train")).alias("ne"))
    both = cut(posted.join(lists.where("nt > 0 and ne > 0"), "term"))
    # The training side of a long list is dealt into blocks, the other side goes to each: no key has more than about ``limits.pairs`` pairs.
    both = both.withColumn("blocks", F.greatest(F.lit(1), F.least(F.col("nt"), F.ceil(F.col("nt") * F.col("ne") / limits.pairs))).cast("int"))
    one = both.where("train").select("term", F.pmod(F.hash("id"), F.col("blocks")).alias("block"), F.col("id").alias("a"), F.col("left").alias("la"), F.col("figures").alias("fa"), F.col("bits").alias("sa"))
    two = both.where("not train").select("term", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("b"), F.col("left").alias("lb"), F.col("figures").alias("fb"), F.col("bits").alias("sb"))
    # Common figures have common bits, but for those of one text that share a bit.
    ones = lambda c: F.bit_count(c).cast("int")
    most = ones(F.col("sa").bitwiseAND(F.col("sb"))) + F.least(F.col("fa") - ones(F.col("sa")), F.col("fb") - ones(F.col("sb")))
    return one.join(two, ["term", "block"]).where((F.col("la") * F.col("lb") >= threshold) & (most >= limits.figures * F.least("fa", "fb"))).select("a", "b").distinct()


def _judge(weights, limits: CosineLimits):
    """Exact dot products and common figures of pairs of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            n = batch.num_rows
            side = []
            for c, k in (("ta", "a"), ("tb", "b")):
                # A record stands in many pairs: its terms are made once in a batch.
                _, at, use = np.unique(batch[k].to_numpy(), return_index=True, return_inverse=True)
                row, h, fig = _terms(batch[c].take(pa.array(at)))
                w = table.of(h)
                norm = [np.sqrt(np.bincount(row, weights=w ** (2 * p), minlength=len(at))) for p in (1, limits.power)]
                first = np.searchsorted(row, np.arange(len(at) + 1))
                size = np.diff(first)[use]
                out = np.repeat(np.arange(n), size)
                take = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[use], size)
                fig = fig & ~np.isin(h, _YEARS)
                side.append((out, h[take], fig[take], w[take], [x[use] for x in norm]))
            (ra, ha, fa, wa, na), (rb, hb, fb, _, nb) = side
            key = lambda r, h: W.mix(h + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ka, kb = key(ra, ha), np.sort(key(rb, hb))
            common = kb[np.minimum(np.searchsorted(kb, ka), max(len(kb) - 1, 0))] == ka if len(kb) else np.zeros(len(ka), bool)
            cosine, rare = (np.bincount(ra[common], weights=wa[common] ** (2 * p), minlength=n) / np.maximum(x * y, 1e-12) for p, x, y in zip((1, limits.power), na, nb))
            figures = np.bincount(ra[common & fa], minlength=n)
            fewest = np.minimum(np.bincount(ra[fa], minlength=n), np.bincount(rb[fb], minlength=n))
            ok = (cosine >= limits.cosine) & (figures >= limits.figures * fewest) & (rare >= np.where(fewest > 1, limits.rare, np.maximum(limits.rare, limits.lone)))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(ok)), batch["b"].filter(pa.array(ok)), pa.array(cosine[ok])], names=["a", "b", "cosine"])

    return run


def judged(pairs: DataFrame, a: DataFrame, b: DataFrame, weights, limits: CosineLimits) -> DataFrame:
    """Pairs whose texts (tables ``id``, ``text``) reach the cosines and have their figures in common."""
    full = pairs.join(a.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(b.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(_judge(weights, limits), "a bigint, b bigint, cosine double")


def cross_split_overlaps(
    records: DataFrame, *, id: str, split: str, train: str, title: str, body: str, limits: CosineLimits = CosineLimits()
) -> DataFrame:
    """Class of every record that has its like in the other part: ``id``, ``first``.

    Records with one ``first`` are the same article; one row per record, so copies are not expanded
    into pairs here.  Bodies decide; a record without a body counts by its title, if that
    stands over one article only.  Records with a null id or split are ignored, as are those with
    neither title nor body; exact copies are compared once.  Empty splits give an empty result.
    """
    rows = records.where(F.col(id).isNotNull() & F.col(split).isNotNull()).select(F.col(id).cast("bigint").alias("id"), (F.col(split) == train).alias("train"), F.col(title).cast("string").alias("title"), F.col(body).cast("string").alias("body"))
    spark = records.sparkSession
    feats = written(title_features(rows.select("id", "title", F.when(F.trim("body") != "", F.xxhash64("body")).alias("body"))))
    weights = spark.sparkContext.broadcast(term_weights(rows, "body", limits))
    # Of exact copies in a part, the first stands for all.
    copies = _stars(feats.select("id", "body"), "body")
    later = cut(feats.where("body is not null").select("id", "body").join(rows.select("id", "train"), "id").groupBy("body", "train").agg(F.min("id").alias("id")).select("id"))
    texts = rows.where("body is not null").select("id", "train", F.col("body").alias("text"))
    pairs = cut(cosine_candidates(texts.join(later, "id", "left_semi"), weights, limits))
    links = judged(pairs, texts.where("train"), texts.where("not train"), weights, limits).select("a", "b")
    # Bodies under one title that a record without a body bears: are they one article?  The title is evidence, so less likeness will do.
    wanted = feats.where("body is null and title is not null").select("title").distinct()
    under = feats.where("body is not null").select("title", "id").join(wanted, "title", "left_semi")
    peers = under.join(under.groupBy("title").agg(F.min("id").alias("a")), "title").where("id > a").select("a", F.col("id").alias("b"))
    links = links.union(judged(cut(peers), texts, texts, weights, replace(limits, cosine=limits.cosine * 0.6, rare=limits.rare / 3)).select("a", "b"))
    label = cut(components(links.union(copies)))
    titled = cut(_title_links(feats, label).where("a != b"))
    to = lambda c: label.select(F.col("id").alias(c), F.col("first").alias(f"f{c}"))
    merged = components(titled.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("fa", "a").alias("a"), F.coalesce("fb", "b").alias("b"))).select(F.col("id").alias("old"), F.col("first").alias("new"))
    placed = label.union(titled.select("b", "b")).union(titled.select("a", "a")).groupBy("id").agg(F.min("first").alias("first"))
    return cut(placed.join(merged, F.col("first") == F.col("old"), "left").select("id", F.coalesce("new", "first").alias("first")))
