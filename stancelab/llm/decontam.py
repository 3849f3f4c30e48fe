"""Benchmark decontamination with a generalised suffix automaton over the test items.

The automaton holds every item's normalised words (at most ``block_words`` of them; a larger
benchmark is cut into blocks of items, each with its own pass over the documents).  A task streams
its documents through it and tracks, word by word, the longest match that ends there; a match as
long as a window means that the window occurs.  Words are integers: the items' vocabulary is looked
up for a whole batch at once, and only runs of known words are long enough to be streamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .others import packed, unpacked
from .scratch import TEXT_ROWS, Scratch
from .words import ALNUM_WORDS, LOWER_CASE, batches, split_words, text_bytes

#: Words of benchmark items per automaton: about 300 bytes a word on every executor.
BLOCK_WORDS = 1 << 18


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton over integer sequences.

    A state stands for a set of substrings with the same end positions; ``length`` is its longest.
    ``next``: transitions per state; ``link``: the state of the longest suffix in another class.
    """

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that holds exactly the strings of ``p`` followed by ``c``."""
        q = self.next[p][c]
        if self.length[p] + 1 == self.length[q]:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, words: list[int]) -> list[int]:
        """Add a sequence; the state after each of its words."""
        at, passed = 0, []
        for c in words:
            if c in self.next[at]:
                at = self._split(at, c)
            else:
                new = self._state(self.length[at] + 1, {}, 0)
                p = at
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c)
                at = new
            passed.append(at)
        return passed

    def step(self, at: int, long: int, c: int) -> tuple[int, int]:
        """State and length of the longest suffix match after one more word."""
        nxt, link = self.next, self.link
        while at and c not in nxt[at]:
            at = link[at]
            long = self.length[at]
        to = nxt[at].get(c)
        return (0, 0) if to is None else (to, long + 1)


@dataclass
class TestItems:
    """One block of items: the automaton, its vocabulary, and where each window ends."""

    vocabulary: np.ndarray  # sorted word hashes; a word's id is its place
    automaton: SuffixAutomaton
    full: dict[int, list[int]]  # state of a whole window of full length -> items
    short: dict[int, list[int]]  # length of a short item -> states are in short_at
    short_at: dict[tuple[int, int], list[int]]  # (state, length) -> items shorter than a window
    least: int  # words of the shortest window
    window: int


def build_items(items: list[tuple[str, str | None]], window: int) -> TestItems:
    """items: (item id as string, text).  Items without words have no window."""
    col = pa.array([t or "" for _, t in items], pa.string())
    w = split_words(col, ALNUM_WORDS, LOWER_CASE)
    vocabulary, ids = np.unique(w.hash, return_inverse=True)
    auto, sequences = SuffixAutomaton(), []
    for i in range(len(items)):
        seq = ids[w.bounds[i]:w.bounds[i + 1]].tolist()
        auto.add(seq)
        sequences.append(seq)
    full: dict[int, list[int]] = {}
    short_at: dict[tuple[int, int], list[int]] = {}
    for i, seq in enumerate(sequences):
        span = min(window, len(seq))
        at, long = 0, 0
        for c in seq:
            at, long = auto.step(at, long, c)
            if long > span:  # the window alone, without what stands before it
                long = span
            while auto.length[auto.link[at]] >= long and at:
                at = auto.link[at]
            if span and long == span:
                mine = full.setdefault(at, []) if span == window else short_at.setdefault((at, span), [])
                if not mine or mine[-1] != i:
                    mine.append(i)
    lengths: dict[int, list[int]] = {}
    for state, n in short_at:
        lengths.setdefault(n, []).append(state)
    least = min([*lengths, window if full else 1 << 62])
    return TestItems(vocabulary, auto, full, lengths, short_at, least, window)


def hits(test: TestItems, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans [from, to) of the windows that occur in ``words`` and the items they belong to."""
    auto, spans, found = test.automaton, [], set()
    at, long, cap = 0, 0, test.window
    for i, c in enumerate(words):
        at, long = auto.step(at, long, c)
        if long > cap:
            long = cap
        while at and auto.length[auto.link[at]] >= long:
            at = auto.link[at]
        if long < test.least:
            continue
        if long == cap and at in test.full:
            spans.append((i + 1 - cap, i + 1))
            found.update(test.full[at])
        for n in test.short:
            if n <= long:
                s = at
                while auto.length[auto.link[s]] >= n:
                    s = auto.link[s]
                mine = test.short_at.get((s, n))
                if mine:
                    spans.append((i + 1 - n, i + 1))
                    found.update(mine)
    return spans, found


def _known_runs(known: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """[from, to) of runs of known words inside one text, at least ``least`` words long."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = bounds[(bounds > 0) & (bounds < len(known))]
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    begin[cut] = known[cut]
    stop = known.copy()
    stop[:-1] &= ~known[1:]
    stop[cut - 1] = known[cut - 1]
    lo, hi = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = hi - lo >= least
    return lo[long], hi[long]


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def _scanner(shared, columns: list[str]):
    """Adds to each row the word spans and items this block of items hits in it."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, names = shared.value
        for b in batches(frames, "text"):
            w = split_words(b.column("text"), ALNUM_WORDS, LOWER_CASE)
            spans = b.column("spans").to_pylist()
            items = b.column("items").to_pylist()
            ids = np.searchsorted(test.vocabulary, w.hash)
            known = ids < len(test.vocabulary)
            known[known] = test.vocabulary[ids[known]] == w.hash[known]
            lo, hi = _known_runs(known, w.bounds, test.least)
            doc = np.searchsorted(w.bounds, lo, side="right") - 1
            for d, a, e in zip(doc.tolist(), lo.tolist(), hi.tolist()):
                where, which = hits(test, ids[a:e].tolist())
                if where:
                    base = a - int(w.bounds[d])
                    flat = spans[d]
                    every = [*zip(flat[::2], flat[1::2]), *((x + base, y + base) for x, y in where)]
                    spans[d] = [v for span in _merged(every) for v in span]
                    items[d] = [*items[d], *(names[i] for i in sorted(which) if names[i] is not None)]
            out = {c: b.column(c) for c in columns}
            out |= {"n_words": pa.array(np.diff(w.bounds).astype(np.int64)),
                    "spans": pa.array(spans, pa.list_(pa.int64())),
                    "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.record_batch(out)
    return run


def _cutter(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without the words of ``spans`` and what separates them."""
    for b in batches(frames, "text"):
        w = split_words(b.column("text"), ALNUM_WORDS, LOWER_CASE)
        raw, off = text_bytes(b.column("text"))
        texts = []
        for d, flat in enumerate(b.column("spans").to_pylist()):
            at, parts = int(off[d]), []
            for x, y in zip(flat[::2], flat[1::2]):
                parts.append(raw[at:int(w.start[w.bounds[d] + x])].tobytes())
                at = int(w.end[w.bounds[d] + y - 1])
            parts.append(raw[at:int(off[d + 1])].tobytes())
            texts.append(b"".join(parts).decode())
        keep = [n for n in b.schema.names if n not in ("text", "spans")]
        yield pa.record_batch({**{n: b.column(n) for n in keep}, "text": pa.array(texts, pa.string())})


#: The operator's words before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _item_blocks(benchmark: DataFrame, block_words: int, scratch: Scratch) -> Iterator[tuple[list[tuple[str | None, str]], bool]]:
    """Distinct items in blocks of about ``block_words`` / 2 words, by hash, and whether a block is the last.

    Words are counted as the operator takes them.  One block at a time reaches the driver; an item
    longer than a block makes its block that much longer.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD)) + 1), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_words))
    if n > 1:
        items = scratch.table(items.withColumn("block", F.expr(f"pmod(xxhash64(item_id, text), {n})")), "items")
    for i in range(n):
        own = items.where(F.col("block") == i) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in own.select("item_id", "text").collect()], i + 1 == n


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep_text: bool = False,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of ``docs`` (text only with ``keep_text``) plus n_words, n_hit, spans and items.

    docs: any columns, among them text.  benchmark: item_id, text.  Texts are lower-cased (A-Z) and
    cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is ``window`` consecutive words of
    an item, or all of an item that has fewer but some.  spans: flat [from, to, ...] word numbers
    inside any occurrence of a window, merged; n_hit: words in them; items: distinct ids, sorted as
    strings, of the items with occurring windows.

    Null or empty texts have no words; null item texts are no items; an item without an id counts for
    spans and n_hit and is not in items; items that repeat an id share it; an empty benchmark hits nothing.  Columns of ``docs`` named n_words, n_hit, spans or
    items are replaced.  Each block of items is one pass; with more than one block the rows are
    written to the checkpoint folder in between.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    own = ("n_words", "n_hit", "spans", "items")
    every, docs = docs.columns, packed(docs, "doc_id", "text")
    rows = docs.withColumn("text", F.col("text").cast("string"))
    rows = rows.withColumns({"spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")})
    for block, last in _item_blocks(benchmark, block_words, scratch):
        columns = [c for c in docs.columns if c != "text" or keep_text or not last]
        shared = spark.sparkContext.broadcast((build_items(block, window), [name for name, _ in block]))
        schema = T.StructType([*(rows.schema[c] for c in columns), T.StructField("n_words", T.LongType()),
                               T.StructField("spans", T.ArrayType(T.LongType())),
                               T.StructField("items", T.ArrayType(T.StringType()))])
        rows = rows.mapInArrow(_scanner(shared, columns), schema)
        if not last:
            rows = scratch.table(rows.drop("n_words"), "block", batch_rows=TEXT_ROWS)
            shared.destroy()
    signed = F.transform("spans", lambda at, i: F.when(i % 2 == 1, at).otherwise(-at))
    n_hit = F.aggregate(signed, F.lit(0).cast("long"), lambda total, at: total + at)
    found = rows.withColumn("n_hit", n_hit).withColumn("items", F.array_sort(F.array_distinct("items")))
    return unpacked(found, [c for c in every if c != "text" or keep_text], *own)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, coverage: float = 0.5,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the spans that match the benchmark, and without documents mostly covered.

    A document with at least ``coverage`` of its words in matches goes; from the others every
    matched span is cut, again if the cut brings new windows together, until none is left.
    Untouched documents pass unchanged, null and empty texts too.  n_chars, if there, is renewed
    for the texts that were cut.  Columns named like those of ``find_overlaps`` keep their values.
    """
    every, docs = docs.columns, packed(docs, "text", "n_chars")
    spark = docs.sparkSession
    scratch = Scratch(spark, "cut")
    columns = docs.columns
    found = find_overlaps(docs, benchmark, window, keep_text=True, block_words=block_words)
    mostly = F.col("n_hit") >= F.lit(coverage) * F.col("n_words")
    hit = scratch.table(found.where((F.col("n_hit") == 0) | ~mostly), "found", batch_rows=TEXT_ROWS)
    clean = hit.where("n_hit = 0").select(*columns)
    while True:
        dirty = hit.where("n_hit > 0")
        if dirty.isEmpty():
            return unpacked(clean, every)
        dirty = dirty.select(*columns, "spans")
        order = [c for c in dirty.columns if c not in ("text", "spans")] + ["text"]
        cut = dirty.mapInArrow(_cutter, T.StructType([dirty.schema[c] for c in order])).select(*columns)
        if "n_chars" in columns:
            cut = cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
        cut = scratch.table(cut, "left", batch_rows=TEXT_ROWS)  # else each task would hold two Python workers
        hit = scratch.table(find_overlaps(cut, benchmark, window, keep_text=True, block_words=block_words), "cut",
                            batch_rows=TEXT_ROWS)
        clean = clean.union(hit.where("n_hit = 0").select(*columns))
