"""Vectorised word hashing over Arrow text batches, shared by the operators of this subpackage.

A batch of texts is one byte buffer.  Words are maximal runs of word bytes (a 256-entry
table), so a pattern whose class is decided byte by byte in UTF-8, such as
``[^\\x20\\x09-\\x0D]+``, is matched exactly.  Everything is numpy over the whole buffer; there is
no Python loop over words.

Hashes are 64-bit polynomials over a seeded random byte table, finalised by a mixer.  They are
identical on every executor because the tables come from a fixed seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD1342543DE82EF95)

#: ASCII white space of the contracts: space and \t \n \v \f \r.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SPACE_WORDS = np.array([b not in SPACES for b in range(256)])
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, non-ASCII.
ALNUM_WORDS = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80
                        for b in range(256)])
#: Terms of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: letters and non-ASCII.
LETTER_WORDS = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
KEEP_CASE = np.arange(256, dtype=np.uint8)
LOWER_CASE = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 constants)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _tables(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MUL**i and its inverse modulo 2**64 for i < n, grown by doubling; the first 4 Mi are kept."""
    out = []
    for name, base in (("up", int(_MUL)), ("down", pow(int(_MUL), -1, 1 << 64))):
        p = _POWERS[name]
        while len(p) < n:
            p = np.concatenate([p, p * _U(pow(base, len(p), 1 << 64))])
        _POWERS[name] = p if len(p) <= 1 << 22 else p[: 1 << 22].copy()
        out.append(p[:n])
    return out[0], out[1]


@dataclass
class Words:
    """Words of a batch: byte bounds, the word count of each text and one hash per word."""

    data: np.ndarray  # folded bytes of all texts, end to end
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # words of text i are [bounds[i], bounds[i + 1])
    hash: np.ndarray

    def doc(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and their offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = col.buffers()[2]
    raw = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def cut_words(col: pa.Array, keep: np.ndarray, fold: np.ndarray) -> Words:
    """Bounds of the words of every text in ``col``, without hashes; arguments as in ``split_words``."""
    raw, off = text_bytes(col)
    data = fold[raw] if fold is not KEEP_CASE else raw
    n = len(data)
    none = np.zeros(0, np.uint64)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(len(off), np.int64), none)
    word = keep[data]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    gap = np.empty(n, bool)  # no word runs on from the byte before
    gap[0] = True
    np.logical_not(word[:-1], out=gap[1:])
    gap[cut] = True
    start = np.flatnonzero(word & gap)
    gap[:-1] = ~word[1:]
    gap[-1] = True
    gap[cut - 1] = True
    end = np.flatnonzero(word & gap) + 1
    return Words(data, start, end, np.searchsorted(start, off), none)


def split_words(col: pa.Array, keep: np.ndarray, fold: np.ndarray, seed: int = 1, *,
                more_seeds: tuple[int, ...] = ()) -> Words | tuple:
    """Words of every text in ``col``; with ``more_seeds`` also further independent hashes.

    keep: 256 booleans, the bytes of words.  fold: 256 bytes applied first (lower-casing).
    """
    w = cut_words(col, keep, fold)
    n = len(w.data)
    if n == 0:
        return (w, *[w.hash for _ in more_seeds]) if more_seeds else w
    up, down = _powers(n)
    length = (w.end - w.start).astype(np.uint64) * _STEP

    def hashed(s: int) -> np.ndarray:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_tables(s)[w.data] * up, out=total[1:])
        return mix((total[w.end] - total[w.start]) * down[w.start] + length) if len(w.start) else total[:0]

    w.hash = hashed(seed)
    return (w, *[hashed(s) for s in more_seeds]) if more_seeds else w


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive entries (length n - k + 1), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = None, 0
    block, size, size_power = h, 1, int(_STEP)
    while True:
        if k & size:
            if out is None:
                out = block[: n + (k - size)] if size < k else block[:n]
                done = size
            else:
                m = min(len(out), len(block) - done)
                out = out[:m] * _U(size_power) + block[done:done + m]
                done += size
        if done == k:
            return mix(out[:n])
        m = len(block) - size
        block = block[:m] * _U(size_power) + block[size:size + m]
        size_power = size_power * size_power % (1 << 64)
        size *= 2


def batches(frames: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` text bytes; a longer text is a slice of its own, never cut."""
    for b in frames:
        if not b.num_rows:
            continue
        _, off = text_bytes(b.column(b.schema.get_field_index(text)))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to
