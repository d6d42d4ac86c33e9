"""Vectorised words of Arrow string columns: no Python loop over rows or words.

Texts are lower-cased, accents folded and entities undone with Arrow kernels; the rest is numpy on
the byte buffer.  A word is a run of letters and digits; ``.`` and ``,`` between digits and ``'``
between letters belong to it, but only ``.`` between digits counts in its hash.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ENTITIES = {"&amp;": "&", "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&mdash;": "-", "&ndash;": "-"}
_P = np.uint64(0x9E3779B97F4A7C15)
_POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(127, np.uint64(1099511628211))]).astype(np.uint64))
_FOLD = {ord(c): unicodedata.normalize("NFKD", c)[0] for c in map(chr, range(0xC0, 0x250)) if unicodedata.normalize("NFKD", c)[0].isascii() and unicodedata.normalize("NFKD", c)[0].isalpha()} | {0xA0: " ", 0x2018: "'", 0x2019: "'", 0x201C: " ", 0x201D: " ", 0x2013: "-", 0x2014: "-", 0x2026: " ", 0xAD: None, 0x200B: None, 0xFEFF: None, 0xDF: "ss"}

#: Byte classes: 1 letter (bytes of other alphabets too), 2 digit, 3 full stop or comma, 4 apostrophe.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[0x80:] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord("."), ord(",")]] = 3
_CLASS[ord("'")] = 4


@dataclass
class Words:
    """Words of a column: byte range in ``data``, row, 64-bit hash, length; ``first`` has the first word of each row (n_rows + 1)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    size: np.ndarray
    number: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def texts(self) -> pa.Array:
        """All words as one Arrow string array, without a loop."""
        keep = np.zeros(len(self.data) + 1, np.int32)
        keep[self.start] += 1  # no two words begin or end at one place
        keep[self.end] -= 1
        inside = np.cumsum(keep[:-1]) > 0
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[inside])))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (uint64 in, uint64 out)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def plain(column: pa.Array) -> pa.Array:
    """Null as '', entities undone, accents folded, lower case."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    column = pc.fill_null(column, "")
    if pc.any(pc.match_substring(column, "&")).as_py():
        for a, b in _ENTITIES.items():
            column = pc.replace_substring(column, a, b)
    odd = pc.invert(pc.string_is_ascii(column))
    if pc.any(odd).as_py():
        fixed = pa.array([s.translate(_FOLD) for s in column.filter(odd).to_pylist()], pa.string())
        column = pc.replace_with_mask(column, odd, fixed)
    return pc.utf8_lower(column)


def split(column: pa.Array) -> Words:
    """Words of a string column already made :func:`plain`."""
    n = len(column)
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[: n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _CLASS[data]
    prev = np.concatenate([[0], kind[:-1]]).astype(np.uint8)
    nxt = np.concatenate([kind[1:], [0]]).astype(np.uint8)
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    if len(data):
        prev[edge] = 0
        nxt[edge[edge > 0] - 1] = 0
    joins = ((kind == 3) & (prev == 2) & (nxt == 2)) | ((kind == 4) & (prev == 1) & (nxt == 1))
    word = (kind == 1) | (kind == 2) | joins
    before = np.concatenate([[False], word[:-1]])
    if len(data):
        before[edge] = False
    begins = word & ~before
    after = np.concatenate([word[1:], [False]])
    if len(data):
        after[edge[edge > 0] - 1] = False
    start = np.flatnonzero(begins)
    end = np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(n), np.diff(first))
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(data, z, z, z, z.astype(np.uint64), z, z.astype(bool), first)
    counts = word & (kind != 4) & ~(joins & (data == ord(",")))
    at = np.flatnonzero(counts)
    head = np.cumsum(counts)[start] - 1  # a word's first byte always counts
    size = np.diff(np.concatenate([head, [len(at)]]))
    place = np.arange(len(at)) - np.repeat(head, size)
    with np.errstate(over="ignore"):
        value = (data[at].astype(np.uint64) + np.uint64(1)) * _POW[np.minimum(place, 127)]
        hashed = mix(np.add.reduceat(value, head) * _P)
    number = np.logical_or.reduceat(kind[at] == 2, head)
    return Words(data, start, end, row, hashed, size, number, first)


def runs(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Order-dependent hash of the runs of ``values`` that start at the ascending positions ``begin``."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    place = np.arange(len(values)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(values)]])))
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(values + place.astype(np.uint64) * _P), begin))


def lists(row: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """Values with ascending row numbers as a list column of ``n`` rows."""
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind))


def lists_of(values: pa.Array, first: np.ndarray) -> pa.ListArray:
    """Arrow values as a list column, given where each row's begin (n_rows + 1 places)."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


def split_joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rows of words parted by white space only, read by their letters and digits alone,
    and the first word of each row (n_rows + 1 places); for a column already made :func:`plain`."""
    n = len(column)
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[: n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _CLASS[data]
    at = np.flatnonzero((kind == 1) | (kind == 2))
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    gap = np.cumsum(data <= 32, dtype=np.int32)[at]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))[at]
    head = np.flatnonzero(np.concatenate([[True], (gap[1:] != gap[:-1]) | (row[1:] != row[:-1])]))
    place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    with np.errstate(over="ignore"):
        value = (data[at].astype(np.uint64) + np.uint64(1)) * _POW[np.minimum(place, 127)]
        hashed = mix(np.add.reduceat(value, head) * _P)
    rows = row[head].astype(np.int64)
    return hashed, rows, np.searchsorted(rows, np.arange(n + 1))
