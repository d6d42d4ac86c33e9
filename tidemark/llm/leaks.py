"""Evaluation texts inside a training corpus, by a generalised suffix automaton.

The automaton holds every word sequence of the evaluation items.  A document's words are streamed
through it; at each word it knows the longest sequence ending there that stands in some item.
Maximal matches are laid against the item, near ones on one course are joined (so light rewording
does not part them), and the item's words so covered decide.  A match that stands in one item only
is evidence by its length; what stands in several items too (stock phrases) fills up a passage
but does not make one.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W


@dataclass(frozen=True)
class LeakLimits:
    """share: least part of an item's words in the passage; least: shortest match in words that counts;
    gap: most words between matches of one piece; pieces: parts a passage may be in;
    evidence: words that the pieces must hold in matches standing in this item only (its likes apart);
    alone: fewest such words of a piece that count for it (a sentence of stock wording has fewer);
    own: four-word sequences (``least`` words) standing in no other item that a document must hold;
    shard_words: items are streamed in shards of at most so many words, which bounds the automaton."""

    share: float = 0.3
    least: int = 4
    gap: int = 4
    pieces: int = 2
    evidence: int = 25
    alone: int = 15
    own: int = 3
    shard_words: int = 200_000


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of integers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = [[]]
        start = 0
        self.starts = []
        for seq in sequences:
            self.starts.append(start)
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c, ends)
                ends[last].append(start + i)
            start += len(seq)
        self._collect(ends)

    def _extend(self, last: int, c: int, ends: list[list[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, c, ends)
        cur = self._new({}, length[last] + 1, ends)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c, ends)
        return cur

    def _new(self, edges: dict[int, int], length: int, ends: list[list[int]]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        ends.append([])
        return len(self.next) - 1

    def _clone(self, p: int, q: int, c: int, ends: list[list[int]]) -> int:
        clone = self._new(dict(self.next[q]), self.length[p] + 1, ends)
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _collect(self, ends: list[list[int]]) -> None:
        """End positions of every state, as ranges of one array in the order of the link tree."""
        children: list[list[int]] = [[] for _ in self.next]
        for s in range(1, len(self.next)):
            children[self.link[s]].append(s)
        order, lo, hi = [], [0] * len(self.next), [0] * len(self.next)
        stack = [(0, False)]
        while stack:
            s, done = stack.pop()
            if done:
                hi[s] = len(order)
                continue
            lo[s] = len(order)
            order.extend(ends[s])
            stack.append((s, True))
            stack.extend((k, False) for k in children[s])
        self.order, self.lo, self.hi = order, lo, hi

    def matches(self, seq: list[int], least: int) -> list[tuple[int, int, int]]:
        """Maximal matches (last place in ``seq``, length, state) of at least ``least``."""
        nxt, link, length = self.next, self.link, self.length
        out, s, n = [], 0, 0
        for i, c in enumerate(seq):
            to = nxt[s].get(c)
            if to is None:
                if n >= least:
                    out.append((i - 1, n, s))
                while s and to is None:
                    s = link[s]
                    to = nxt[s].get(c)
                if to is None:
                    s = n = 0
                    continue
                n = length[s]
            s = to
            n += 1
        if n >= least:
            out.append((len(seq) - 1, n, s))
        return out


class LeakFinder:
    """The automaton of one shard of items with what is needed to judge matches."""

    def __init__(self, items: list[tuple[list[int], list[int]]], limits: LeakLimits):
        self.limits = limits
        self.ids = [i for i, _ in items]
        self.sizes = [len(s) for _, s in items]
        vocabulary: dict[int, int] = {}
        coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in s] for _, s in items]
        self.automaton = SuffixAutomaton(coded)
        known = np.array(sorted(vocabulary), np.uint64)
        self.known, self.codes = known, np.array([vocabulary[int(w)] for w in known], np.int64)
        self.item_of = np.repeat(np.arange(len(items)), self.sizes)
        a = self.automaton
        flat = np.concatenate([np.array(s, np.int64) for s in coded]) if coded else np.zeros(0, np.int64)
        key, inside = self._grams(flat, self.item_of)
        grams = defaultdict(set)
        for g, k in zip(key[inside].tolist(), self.item_of[: len(key)][inside].tolist()):
            grams[g].add(k)
        self.family = _families(grams, len(items))
        # A match in one item of a family hides shorter ones in its likes: each of several likes is streamed through alone.
        members = Counter(self.family)
        self.likes = {k: coded[k] for k, f in enumerate(self.family) if members[f] > 1}
        self.alone: dict[int, SuffixAutomaton] = {}
        owner = np.array(self.family, np.int64)[self.item_of[np.array(a.order, np.int64)]] if a.order else np.zeros(0, np.int64)
        #: The one family of items a state's sequences stand in, else -1; and, filled as needed, the places of each state by item.
        self.sole = [int(owner[x]) if y > x and owner[x] == owner[y - 1] and (y - x == 1 or (owner[x:y] == owner[x]).all()) else -1 for x, y in zip(a.lo, a.hi)]
        self.places: dict[int, dict[int, list[int]]] = {}
        #: All sequences of ``least`` words, and the one family each stands in, else -1.
        self.grams = np.array(sorted(grams), np.uint64)
        families = [{self.family[k] for k in grams[g]} for g in sorted(grams)]
        self.gram_family = np.array([min(f) if len(f) == 1 else -1 for f in families], np.int64)

    def _grams(self, codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.limits.least
        if len(codes) < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        n = len(codes) - k + 1
        key = np.zeros(n, np.uint64)
        inside = row[:n] == row[k - 1 :]
        with np.errstate(over="ignore"):
            for j in range(k):
                key = key * np.uint64(0x100000001B3) + codes[j : j + n].astype(np.uint64)
                inside = inside & (codes[j : j + n] >= 0)
        return key, inside

    def find(self, column: pa.Array) -> tuple[list[int], list[int], list[float]]:
        """(row, item, share of the item) for each leak into the texts of ``column``."""
        text = W.plain(pc.replace_substring_regex(pc.fill_null(column.cast(pa.string()), ""), r"<[^<>]{1,60}>", " "))
        hashes, row, first = W.split_joined(text)
        rows, items, shares = [], [], []
        if not len(hashes) or not len(self.known):
            return rows, items, shares
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        codes = np.where(self.known[at] == hashes, self.codes[at], -1)
        key, inside = self._grams(codes, row)
        if not len(key) or not len(self.grams):
            return rows, items, shares
        spot = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        hit = inside & (self.grams[spot] == key)
        # Only documents with enough sequences that stand in one family of items are streamed.
        place = np.flatnonzero(hit & (self.gram_family[spot] >= 0))
        pair, n = np.unique(row[place] * len(self.family) + self.gram_family[spot[place]], return_counts=True)
        wanted = defaultdict(set)
        for p in pair[n >= self.limits.own].tolist():
            wanted[p // len(self.family)].add(p % len(self.family))
        for r, families in wanted.items():
            lo, hi = int(first[r]), int(first[r + 1])
            # Every match lies within words whose sequences of ``least`` are all known; the rest needs no streaming.
            inner = np.zeros(hi - lo, bool)
            at = np.flatnonzero(hit[lo : min(hi, len(hit))])
            for j in range(self.limits.least):
                inner[at + j] = True
            found = self.judge(np.where(inner, codes[lo:hi], -1).tolist(), families)
            for k, share in found.items():
                for i in self.ids[k]:
                    rows.append(r)
                    items.append(i)
                    shares.append(share)
        return rows, items, shares

    def judge(self, seq: list[int], families: set[int]) -> dict[int, float]:
        """Items of ``families`` of which the matches of one document cover enough, with the share covered."""
        a, lim = self.automaton, self.limits
        matches = a.matches(seq, lim.least)
        alone: dict[int, int] = defaultdict(int)
        for _, n, s in matches:
            if (f := self.sole[s]) >= 0:
                alone[f] += n
        families = {f for f in families if alone[f] >= lim.evidence}
        wanted = [k for k, f in enumerate(self.family) if f in families] if families else []
        by_item: dict[int, list[tuple[int, int, int, bool]]] = defaultdict(list)
        for end, n, s in matches if wanted else ():
            places = self.places.get(s)
            if places is None:
                places = defaultdict(list)
                for e in a.order[a.lo[s] : a.hi[s]]:
                    places[int(self.item_of[e])].append(e - a.starts[int(self.item_of[e])])
                self.places[s] = places
            for k in wanted:
                if k not in self.likes:
                    for e in places.get(k, ()):
                        by_item[k].append((end - n + 1, e - n + 1, n, self.sole[s] >= 0))
        for k in wanted:
            if k in self.likes:
                if k not in self.alone:
                    self.alone[k] = SuffixAutomaton([self.likes[k]])
                one = self.alone[k]
                sole = np.zeros(len(seq) + 1, np.int64)  # words of the document in matches of this family only
                for end, n, s in matches:
                    if self.sole[s] == self.family[k]:
                        sole[end - n + 1 : end + 1] = 1
                sole = np.cumsum(sole)
                by_item[k] = [(end - n + 1, e - n + 1, n, bool(2 * (sole[end] - (sole[end - n] if end >= n else 0)) >= n)) for end, n, s in one.matches(seq, lim.least) for e in one.order[one.lo[s] : one.hi[s]]]
        out = {}
        for k, found in by_item.items():
            need = lim.share * self.sizes[k]
            if sum(n for _, _, n, _ in found) < need * 0.5:
                continue
            found.sort()
            pieces: list[list] = []  # document end, item end, item start, matches
            for d, i, n, sole in found:
                for p in pieces:
                    step, jump = d - p[0], i - p[1]
                    if -n < step <= lim.gap and -n < jump <= lim.gap and abs(step - jump) <= 2:
                        p[0], p[1] = d + n, max(p[1], i + n)
                        p[3].append((i, i + n, sole))
                        break
                else:
                    pieces.append([d + n, i + n, i, [(i, i + n, sole)]])
            good = []
            for _, hi, lo, parts in pieces:
                covered, sole = np.zeros(self.sizes[k], bool), np.zeros(self.sizes[k], bool)
                for x, y, one in parts:
                    covered[x:y] = True
                    if one:
                        sole[x:y] = True
                if sole.any():
                    good.append((int(sole.sum()), int(covered.sum()), lo, hi))
            # The piece with most evidence leads; those that cover most go with it.
            good.sort(reverse=True)
            good[1:] = sorted(good[1:], key=lambda g: -g[1])
            if sum(g[0] for g in good[: lim.pieces] if g[0] >= lim.alone) < lim.evidence:
                continue
            taken = np.zeros(self.sizes[k], bool)
            for _, _, lo, hi in good[: lim.pieces]:
                taken[lo:hi] = True
            if taken.sum() >= need:
                out[k] = float(taken.sum()) / self.sizes[k]
        return out


def _families(grams: dict[int, set[int]], n: int) -> list[int]:
    """Family of each of ``n`` items: those sharing more than half of the larger one's sequences are one."""
    own: list[list[int]] = [[] for _ in range(n)]
    for g, ks in grams.items():
        for k in ks:
            own[k].append(g)
    sets = [set(x) for x in own]
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for k in range(n):
        # Who shares more than half of these sequences shares one of the rarer half.
        own[k].sort(key=lambda g: len(grams[g]))
        for j in {j for g in own[k][: len(own[k]) // 2 + 1] for j in grams[g]}:
            if root(j) != root(k) and 2 * len(sets[j] & sets[k]) > max(len(sets[j]), len(sets[k])):
                parent[max(root(j), root(k))] = min(root(j), root(k))
    return [root(k) for k in range(n)]


def leaked_items(documents: DataFrame, items: DataFrame, *, doc_id: str, doc_text: str, item_id: str, item_text: str, limits: LeakLimits = LeakLimits()) -> DataFrame:
    """Rows (``doc_id``, ``item_id``, ``share``): documents holding a passage of an evaluation item.

    ``share`` is the part of the item's words in the passage.  Items come to the driver in shards of at
    most ``limits.shard_words`` words (evaluation sets are small: one shard holds over a thousand items); each shard is a broadcast of
    bounded size of its own, and the documents are streamed once for each, to their ends, and never shuffled.  Null or
    empty texts on either side match nothing; items of one word sequence are looked for once and all reported; items
    under ``limits.evidence`` words never match; repeated documents are each reported, repeated
    item ids once per document.  Empty tables give an empty result.
    """
    rows = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint"), F.col(item_text).cast("string")).orderBy(item_id)
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"{doc_id} {kind}, {item_id} bigint, share double"
    texts = documents.select(F.col(doc_id).alias("id"), F.col(doc_text).cast("string").alias("text"))
    found = None
    for shard in _shards(rows, limits.shard_words):
        one = texts.mapInArrow(_scan(documents.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, shard)), limits, doc_id, item_id), schema)
        found = one if found is None else found.union(one)
    if found is None:
        return documents.sparkSession.createDataFrame([], schema)
    return found if found is one else found.groupBy(doc_id, item_id).agg(F.max("share").alias("share"))


def _shards(rows: DataFrame, most: int) -> Iterator[list[tuple[list[int], list[int]]]]:
    """Items as (ids, words) in lists of at most ``most`` words; one word sequence is one entry of a list."""
    same: dict[tuple, list[int]] = {}
    size = 0
    for r in rows.toLocalIterator():
        words = tuple(W.split_joined(W.plain(pc.replace_substring_regex(pa.array([r[1]], pa.string()), r"<[^<>]{1,60}>", " ")))[0].tolist())
        if not words:
            continue
        if size and size + len(words) > most:
            yield [(list(dict.fromkeys(ids)), list(w)) for w, ids in same.items()]
            same, size = {}, 0
        same.setdefault(words, []).append(r[0])
        size += len(words)
    if same:
        yield [(list(dict.fromkeys(ids)), list(w)) for w, ids in same.items()]


def _scan(held, limits: LeakLimits, doc_id: str, item_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = held.value
        finder = _FINDERS.get(name)
        if finder is None:
            _FINDERS.clear()  # one shard at a time
            finder = _FINDERS[name] = LeakFinder(shard, limits)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                best: dict[tuple[int, int], float] = {}
                for r, k, share in zip(*finder.find(part["text"])):
                    best[r, k] = max(share, best.get((r, k), 0.0))
                if best:
                    r, k = zip(*best)
                    yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(r)), pa.array(k, pa.int64()), pa.array(list(best.values()), pa.float64())], names=[doc_id, item_id, "share"])

    return run


_FINDERS: dict[str, LeakFinder] = {}  # of this worker process: building the automaton once is enough
