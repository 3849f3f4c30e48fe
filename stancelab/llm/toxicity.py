"""Toxicity: a bidirectional GRU with attention over words and characters scores every window.

The classifier is fitted on the driver in numpy on a bounded sample of labelled rows; executors then
score all overlapping windows of every whole text.  A document's score is its worst window's.
Labels are per document, so training is by multiple instances: a toxic document stands for its
currently worst windows, a clean one for those that look worst.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bigru import GRAMS, Adam, BiGru, TextWords, joined, read_words, windows
from .others import packed, unpacked
from .scratch import ready
from .words import batches

#: Labelled rows the classifier is fitted on, per label, and the longest text among them.
SAMPLE_ROWS = 1000
SAMPLE_CHARS = 12_000
CHANCE = 4.0
#: Words of the table: in at least so many of the sample's documents.
WORD_DOCS = 3


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, toxic): at most ``rows`` labelled ids of each label, by md5 of doc_id, and their texts.

    An id is not used for fitting if crc32(doc_id as text) mod 5 is 0, or if it or its label is
    null; a text is not if it is null, empty or longer than ``chars``.  The ids are chosen from the
    labels alone, so only 2 * ``rows`` of them are broadcast to fetch the texts.
    """
    key = F.col("doc_id").cast("string")
    lab = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(F.crc32(F.encode(key, "UTF-8")) % 5 != 0)
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("_order", F.md5(key)))
    parts = [lab.where(F.col("toxic") == v).orderBy("_order", "doc_id").limit(rows) for v in (1, 0)]
    picked = parts[0].union(parts[1]).select(F.col("doc_id").alias("_picked"), "_order", "toxic")
    text = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where(
        F.length("text").between(1, chars))
    return (text.join(F.broadcast(picked), F.col("doc_id") == F.col("_picked"))
            .orderBy("_order", "doc_id", "text").limit(4 * rows).select("text", "toxic"))


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 5, epochs: int = 3, seed: int = 3) -> BiGru:
    """Train on whole texts with document labels; one class only gives a model that says so."""
    t = joined([read_words(pa.array([x], pa.string())) for x in texts])  # a text at a time: little is held at once
    toxic = np.asarray(toxic, dtype=np.float32)
    share = min(max(float(toxic.mean()) if len(toxic) else 0.0, 1e-6), 1 - 1e-6)
    vocabulary, first, docs = _evidence(_distinct(t.hash, t.bounds), toxic, share)
    often = docs >= min(WORD_DOCS, max(1, len(texts) // 10))
    ends = np.append(t.heads, len(t.gram))[t.bounds]
    grams, gram_first, _ = _evidence(_distinct(t.gram, ends), toxic, share)
    gram_start = np.zeros(GRAMS)
    gram_start[grams.astype(np.int64)] = gram_first
    model = BiGru(vocabulary[often], first[often], gram_start, seed)
    text, start, length = windows(t.bounds)
    if not len(text) or toxic.min() == toxic.max():
        model.p["bias"][:] = 4.0 if len(toxic) and toxic.min() == 1 else -4.0
        model.p["out"][:] = 0
        return model
    rng = np.random.default_rng(seed)
    # the tables, which could learn single texts by heart, stay as the evidence has them
    adam = Adam(model.p, 0.003, {"words": 0.0, "grams": 0.0})
    strength = np.concatenate([[0], np.cumsum(model.p["words"][model.rows(t), 0])])
    look = strength[start + length] - strength[start]
    target = toxic[text]
    for _ in range(rounds):
        order = np.lexsort((-look, text))
        place = np.empty(len(order), np.int64)
        heads = np.flatnonzero(np.diff(text[order], prepend=-1))
        place[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
        chosen = np.flatnonzero(np.where(target == 1, place < 1, (place < 2) | (rng.random(len(place)) < 0.02)))
        weight = np.where(target[chosen] == 1, 0.5 / max(1, (target[chosen] == 1).sum()),
                          0.5 / max(1, (target[chosen] == 0).sum())) * len(chosen)
        for _ in range(epochs):
            mixed = rng.permutation(len(chosen))
            for i in range(0, len(mixed), 512):
                own = mixed[i:i + 512]
                at = chosen[own]
                sub, sub_first = _subset(t, start[at], length[at])
                _, grad = model.gradients(sub, sub_first, length[at], target[at], weight[own])
                adam.step(grad)
        look = model.logits(t, start, length)
    # the documents' scores are maxima over windows: place the threshold between the labels
    best = np.full(len(texts), -30.0)
    np.maximum.at(best, text, look)
    model.p["bias"] -= np.float32(_threshold(best, toxic))
    return model


def _distinct(items: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct items of each document, end to end, and the document of each."""
    own = [np.unique(items[a:b]) for a, b in zip(bounds, bounds[1:])]
    return np.concatenate([items[:0], *own]), np.repeat(np.arange(len(own)), [len(x) for x in own])


def _evidence(pairs: tuple[np.ndarray, np.ndarray], toxic: np.ndarray, share: float):
    """How surely each item goes with a label: signed root of its likelihood ratio over documents.

    What chance does for the best of some ten thousand items, about ``CHANCE``, counts as nothing.
    Returns the distinct items, their evidence (scaled, within -2 and 2) and document counts."""
    found, at = np.unique(pairs[0], return_inverse=True)
    total = np.bincount(at, minlength=len(found)).astype(float)
    bad = np.bincount(at, weights=toxic[pairs[1]], minlength=len(found))

    def part(x: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / expected), 0)

    ratio = 2 * (part(bad, total * share) + part(total - bad, total * (1 - share)))
    sign = np.sign(bad / np.maximum(total, 1) - share)
    return found, np.clip(sign * np.maximum(np.sqrt(np.maximum(ratio, 0)) - CHANCE, 0) / 4, -2, 2), total


def _subset(t, first: np.ndarray, length: np.ndarray):
    """The words of some windows as a batch of their own, and where each window starts in it."""
    heads = np.cumsum(length) - length
    words = np.repeat(first - heads, length) + np.arange(length.sum())
    n = t.lengths[words]
    char_heads = np.cumsum(n) - n
    chars = np.repeat(t.heads[words] - char_heads, n) + np.arange(n.sum())
    return TextWords(t.hash[words], np.append(heads, len(words)), t.gram[chars], char_heads, n), heads


def _threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the widest gap among the cuts with the fewest errors: where little is known, the common label wins."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], toxic[order] == 1
    below_bad = np.concatenate([[0], np.cumsum(y)])
    above_good = (~y).sum() - np.concatenate([[0], np.cumsum(~y)])
    wrong = below_bad + above_good
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    gap = np.diff(edges)
    ok = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    i = ok[np.argmax(gap[ok])]
    return float((edges[i] + edges[i + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> BiGru:
    sample = fit_sample(docs, labels, rows).collect()
    return fit([r["text"] for r in sample], np.array([r["toxic"] for r in sample]))


def score_documents(docs: DataFrame, model: BiGru, keep_text: bool = True) -> DataFrame:
    """``docs`` (text only with ``keep_text``) plus score (0 to 1) and predicted (score >= 0.5), from the text alone.

    Every window of every whole text is scored.  Null and empty texts, and texts without letters
    or digits, get the fixed score NO_WORDS.  Columns named score or predicted are replaced.
    """
    spark = docs.sparkSession
    ready(spark)
    every, docs = docs.columns, packed(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    kept = [c for c in docs.columns if c != "text" or keep_text]
    shared = spark.sparkContext.broadcast(model)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, "text"):
            yield b.select(kept).append_column("score", pa.array(shared.value.scores(b.column("text"))))

    scored = docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())]))
    return unpacked(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")),
                    [c for c in every if c != "text" or keep_text], "score", "predicted")
