"""Substring dedup by seed and extend: winnowed anchors, extension both ways, maximal repeats.

1. Seeds.  Every window of ``window`` words picks the least hashed ``seed``-gram inside it.  Equal
   windows pick the same anchor at the same place, so only occurrences of one anchor can hold equal
   windows.  One row per anchor occurrence, about one per twelve words.
2. Extension.  An occurrence is extended both ways over all windows it anchors; a digest stands for
   the extended span.  An anchor that occurs once repeats nothing; one whose occurrences all extend
   alike repeats in full, however many there are.
3. Occurrences of an anchor that extend differently (the edges of a repeat) are extended word by
   word: each *distinct* extension emits its windows once, with its number of occurrences, and
   windows are counted by digest.  Copies are never paired with each other.
4. Windows that occur more than once merge into maximal spans per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .others import packed, unpacked
from .scratch import Scratch
from .words import KEEP_CASE, SPACE_WORDS, batches, grams, mix, split_words, text_bytes
from .winnow import anchored_runs

_U = np.uint64
_STEP = 0xD1342543DE82EF95
SEED_WORDS = 12


def _span_digests(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Digest of the words [lo, hi) by prefix sums over an independent word hash."""
    up = np.cumprod(np.concatenate([[_U(1)], np.full(len(h), _U(_STEP))]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[_U(1)], np.full(len(h), _U(pow(_STEP, -1, 1 << 64)))]), dtype=np.uint64)
    total = np.concatenate([[_U(0)], np.cumsum(h * up[:-1], dtype=np.uint64)])
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def _occurrences(window: int, seed: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, "text"):
            w, second = split_words(b.column("text"), SPACE_WORDS, KEEP_CASE, more_seeds=(2,))
            text, at, count, anchor, g = anchored_runs(w.hash, w.bounds, window, seed)
            if not len(text):
                continue
            yield pa.record_batch({
                "anchor": pa.array(g[anchor].view(np.int64)),
                "span": pa.array(_span_digests(second, at, at + count + window - 1).view(np.int64)),
                "k1": b.column("k1").take(pa.array(text)), "k2": b.column("k2").take(pa.array(text)),
                "at": pa.array((at - w.bounds[text]).astype(np.int32)), "windows": pa.array(count.astype(np.int32))})
    return run


def _emit_windows(window: int):
    """Every window of the listed runs of each text: two digests, the run's occurrences, the place."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, "text"):
            w, second = split_words(b.column("text"), SPACE_WORDS, KEEP_CASE, more_seeds=(2,))
            runs = b.column("runs")
            flat = runs.flatten()
            n = np.diff(runs.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), n)
            at, count, times = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
            if not len(at):
                continue
            heads = np.cumsum(count) - count
            place = np.repeat(at, count) + np.arange(count.sum()) - np.repeat(heads, count)
            row_of = np.repeat(row, count)
            where = w.bounds[row_of] + place
            take = pa.array(row_of)
            yield pa.record_batch({
                "w1": pa.array(grams(w.hash, window)[where].view(np.int64)),
                "w2": pa.array(grams(second, window)[where].view(np.int64)),
                "times": pa.array(np.repeat(times, count)),
                "k1": b.column("k1").take(take), "k2": b.column("k2").take(take),
                "at": pa.array(place.astype(np.int32))})
    return run


def _cutter(names: list[str]):
    """n_words, n_removed, merged spans and the kept words of each text."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, "text"):
            raw, off = text_bytes(b.column("text"))
            spans = b.column("ranges").to_pylist()
            n_words, n_removed, merged, kept = [], [], [], []
            for i in range(b.num_rows):
                words = raw[off[i]:off[i + 1]].tobytes().split()
                out: list[int] = []
                for r in sorted((r["lo"], r["hi"]) for r in spans[i] or ()):
                    if out and r[0] <= out[-1]:
                        out[-1] = max(out[-1], r[1])
                    else:
                        out += r
                n_words.append(len(words))
                n_removed.append(sum(out[1::2]) - sum(out[::2]))
                merged.append(out)
                for lo, hi in zip(out[-2::-2], out[::-2]):
                    del words[lo:hi]
                kept.append(b" ".join(words).decode())
            yield pa.record_batch({**{c: b.column(c) for c in names},
                                   "n_words": pa.array(n_words, pa.int64()),
                                   "n_removed": pa.array(n_removed, pa.int64()),
                                   "spans": pa.array(merged, pa.list_(pa.int64())),
                                   "kept_text": pa.array(kept, pa.string())})
    return run


def remove_repeats(docs: DataFrame, window: int = 35, seed: int = SEED_WORDS) -> DataFrame:
    """Columns of ``docs`` except text, plus n_words, n_removed, spans and kept_text.

    docs: doc_id, text and others.  Words ``[^\\x20\\x09-\\x0D]+`` are taken unchanged.  A word goes
    if a window of ``window`` consecutive words over it also starts anywhere else, in another row
    or at another place of the same one; windows are judged on the input.  spans: flat merged
    [from, to, ...] word numbers that go; kept_text: the other words joined by one space.

    Null and empty texts have no words.  Rows are told apart by place, not by doc_id: null ids,
    repeated ids and repeated rows are separate documents (repeated rows repeat each other).
    Columns named n_words, n_removed, spans or kept_text are replaced.
    """
    if not 0 < seed <= window:
        raise ValueError("the seed must fit into the window")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    own = ("n_words", "n_removed", "spans", "kept_text")
    carried = packed(docs, "doc_id", "text")
    names = [c for c in carried.columns if c != "text"]
    keyed = carried.select(*names, F.col("text").cast("string").alias("text")).withColumns({
        "_k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        "_k2": F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))})
    texts = keyed.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "text")
    key = ["k1", "k2"]
    seeds = texts.mapInArrow(_occurrences(window, seed),
                             "anchor long, span long, k1 long, k2 long, at int, windows int")
    again = seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("s0"),
                                        F.max("span").alias("s1")).where("n > 1")
    # a table of its own, so that a join with one very common anchor is split by size
    again = scratch.table(again.select("anchor", (F.col("s0") != F.col("s1")).alias("mixed")), "anchors")
    found = scratch.table(seeds.join(again, "anchor"), "repeated")
    mixed = found.where("mixed")
    kinds = scratch.table(
        mixed.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("times"),
                                            F.min(F.struct("k1", "k2", "at", "windows")).alias("r")), "extensions")
    runs = kinds.select("r.k1", "r.k2", F.struct("r.at", "r.windows", "times").alias("run")).groupBy(*key).agg(
        F.collect_list("run").alias("runs"))
    # rows that repeat a key hold the same text, and the runs already count each of them
    one = texts.join(runs, key).groupBy(*key).agg(F.first("text").alias("text"), F.first("runs").alias("runs"))
    windows = scratch.table(one.mapInArrow(
        _emit_windows(window), "w1 long, w2 long, times long, k1 long, k2 long, at int"), "windows")
    many = windows.groupBy("w1", "w2").agg(F.sum("times").alias("n")).where("n > 1").select("w1", "w2")
    # an extension's windows are settled if it occurs twice itself; else its one place is known
    edge = windows.where("times = 1").join(many, ["w1", "w2"], "left_semi").select(
        *key, F.col("at").alias("lo"), (F.col("at") + window).alias("hi"))
    whole = found.where("NOT mixed").select(*key, "at", "windows").union(
        mixed.join(kinds.where("times > 1").select("anchor", "span"), ["anchor", "span"], "left_semi")
        .select(*key, "at", "windows")).select(
        *key, F.col("at").alias("lo"), (F.col("at") + F.col("windows") + (window - 1)).alias("hi"))
    ranges = scratch.table(whole.union(edge).groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")),
                           "ranges")
    joined = keyed.join(ranges, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left").select(
        *names, "text", "ranges")
    schema = T.StructType([*(joined.schema[c] for c in names), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()),
                           T.StructField("spans", T.ArrayType(T.LongType())),
                           T.StructField("kept_text", T.StringType())])
    return unpacked(joined.mapInArrow(_cutter(names), schema), [c for c in docs.columns if c != "text"], *own)
