"""How far each source's use of terms lies from the other sources of its language.

Kept terms are found by iceberg prefix refinement.  A level is a length in bytes, from
``first_level`` on three times as long each time.  Terms that share a prefix of that length are
counted together, in distinct documents; a prefix below the threshold goes, and with it every term
that begins with it, so the next level looks only at terms whose prefix is left.  The levels end
when no prefix left belongs to a longer term.  Prefixes are counted by 64-bit hashes and remembered
in one bitmap of fixed size: both can only keep too much.  The terms that come through are then
counted by their own bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import LETTER_WORDS, LOWER_CASE, Words, batches, cut_words, mix

SCALE = 1_000_000_000
#: Bits of the bitmap of prefixes that are left: 4 MiB whatever the corpus, the only thing broadcast.
FILTER_BITS = 1 << 25
#: How many times longer the prefixes of the next level are.
STEP = 3
#: Distinct prefixes, or (lang, source, term) rows, that a task gathers before it puts them out.
HELD = 1 << 18
#: Terms of one block of the sums over pairs of sources, and sources of one tile.
BLOCK_TERMS = 2048
TILE_SOURCES = 1024

_U = np.uint64
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


# ---- levels ----------------------------------------------------------------------------------

def _prefix_hash(w: Words, pick: np.ndarray, level: int, salt: np.ndarray) -> np.ndarray:
    """Hash of the first ``level`` bytes (all, if fewer) of the words ``pick``, and of a salt each."""
    data = np.concatenate([w.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(w.data) + 1,), "<u8", data.data, strides=(1,))  # the 8 bytes from each place on
    start = w.start[pick]
    size = np.minimum(w.end[pick] - start, level)
    h = mix(salt ^ size.astype(np.uint64))
    for at in range(0, int(size.max(initial=0)), 8):
        more = np.flatnonzero(size > at)
        part = eight[start[more] + at] & _MASK[np.minimum(size[more] - at, 8)]
        h[more] = mix(h[more] * _U(0x9E3779B97F4A7C15) + part)
    return h


def _lang_salts(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


def _left(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of these hashes are set."""
    at = (h & _U(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _open_words(w: Words, doc: np.ndarray, salt: np.ndarray, below: int, bitmap: np.ndarray | None) -> np.ndarray:
    """Words longer than the level ``below`` whose prefix of that level is left."""
    pick = np.flatnonzero(w.end - w.start > below)
    if below and len(pick):
        pick = pick[_left(bitmap, _prefix_hash(w, pick, below, salt[doc[pick]]))]
    return pick


def _prefix_counter(level: int, below: int, bitmap):
    """Per prefix of ``level`` bytes: documents that hold it, and whether a longer term has it."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def total():
            h, n, more = (np.concatenate(x) for x in zip(*held))
            keys, at = np.unique(h, return_inverse=True)
            docs = np.bincount(at, n).astype(np.int64)
            longer = np.zeros(len(keys), bool)
            longer[at[more]] = True
            held[:] = [(keys, docs, longer)]

        def put_out():
            h, n, more = held.pop()
            return pa.record_batch({"h": pa.array(h.view(np.int64)), "n": pa.array(n), "more": pa.array(more)})

        size = 0
        for b in batches(frames, "text"):
            w = cut_words(b.column("text"), LETTER_WORDS, LOWER_CASE)
            doc, salt = w.doc(), _lang_salts(b.column("lang").to_pylist())
            pick = _open_words(w, doc, salt, below, bitmap.value if bitmap else None)
            if not len(pick):
                continue
            keys, at = np.unique(_prefix_hash(w, pick, level, salt[doc[pick]]), return_inverse=True)
            once = np.unique(doc[pick] * len(keys) + at) % len(keys)  # each (document, prefix) once
            longer = np.zeros(len(keys), bool)
            longer[at[w.end[pick] - w.start[pick] > level]] = True
            held.append((keys, np.bincount(once, minlength=len(keys)), longer))
            size += len(keys)
            if size > 2 * HELD:
                total()
                size = len(held[0][0])
                if size > HELD:
                    yield put_out()
                    size = 0
        if held:
            total()
            yield put_out()
    return run


def _term_counter(levels: list[int], bitmap):
    """Per (lang, term) of the terms that came through, each source's occurrences and documents."""
    def by_term(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.sort_by([("lang", "ascending"), ("term", "ascending")])
        for at in range(0, len(t), 1 << 16):  # a term on two slices is two rows
            b = t.slice(at, 1 << 16).combine_chunks()
            lang, term = b["lang"].combine_chunks(), b["term"].combine_chunks()
            new = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(new) + 1])
            uses = pa.StructArray.from_arrays([b[c].combine_chunks() for c in ("source", "n", "docs")], ["source", "n", "docs"])
            yield pa.record_batch({"lang": lang.take(pa.array(first)), "term": term.take(pa.array(first)),
                                   "uses": pa.ListArray.from_arrays(pa.array(np.append(first, len(b)), pa.int32()), uses)})

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def total() -> pa.Table:
            t = pa.concat_tables(held).group_by(["lang", "term", "source"]).aggregate([("n", "sum"), ("docs", "sum")])
            held[:] = [t.rename_columns(["lang", "term", "source", "n", "docs"])]
            return held[0]

        size = 0
        for b in batches(frames, "text"):
            w = cut_words(b.column("text"), LETTER_WORDS, LOWER_CASE)
            langs, sources = b.column("lang").to_pylist(), b.column("source").to_pylist()
            doc, salt = w.doc(), _lang_salts(langs)
            length = w.end - w.start
            through = np.zeros(len(length), bool)
            for below, level in zip([0, *levels], levels):  # the level at which a term was whole
                pick = np.flatnonzero((length > below) & (length <= level))
                through[pick] = _left(bitmap.value, _prefix_hash(w, pick, level, salt[doc[pick]]))
            pick = np.flatnonzero(through)
            if not len(pick):
                continue
            words = _strings(w, pick).dictionary_encode()
            code, terms = words.indices.to_numpy().astype(np.int64), words.dictionary
            groups = {g: i for i, g in enumerate(dict.fromkeys(zip(langs, sources)))}
            group = np.array([groups[g] for g in zip(langs, sources)], np.int64)
            keys, n = np.unique(code * len(groups) + group[doc[pick]], return_counts=True)
            once = np.unique(doc[pick] * len(terms) + code)
            _, docs = np.unique(once % len(terms) * len(groups) + group[once // len(terms)], return_counts=True)
            names = list(groups)
            g = keys % len(groups)
            held.append(pa.table({
                "lang": pa.array([x for x, _ in names], pa.string()).take(pa.array(g)),
                "term": terms.take(pa.array(keys // len(groups))),
                "source": pa.array([x for _, x in names], pa.string()).take(pa.array(g)), "n": pa.array(n), "docs": pa.array(docs)}))
            size += len(keys)
            if size > 2 * HELD:
                size = len(total())
                if size > HELD:
                    yield from by_term(held.pop())
                    size = 0
        if held:
            total()
            yield from by_term(held.pop())
    return run


def _strings(w: Words, pick: np.ndarray) -> pa.Array:
    """The words ``pick`` as an Arrow array."""
    length = w.end[pick] - w.start[pick]
    to = np.cumsum(length)
    at = np.arange(to[-1]) + np.repeat(w.start[pick] - (to - length), length)
    return pa.Array.from_buffers(pa.large_string(), len(pick), [
        None, pa.py_buffer(np.concatenate([[0], to]).astype(np.int64)), pa.py_buffer(w.data[at])]).cast(pa.string())


def kept_terms(docs: DataFrame, min_docs: int = 10, first_level: int = 4, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of every term in at least ``min_docs`` documents of its lang.

    docs: lang, source, text.  n: occurrences in the source, at least one; lang_n: in the lang.
    first: true for one row of each (lang, term).  A row is a document, repeated rows included.
    Null lang, source and text count as ''; a term of any length is kept whole.
    filter_bits: a power of two; fewer bits make the levels coarser, not the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    narrow = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    bits = np.zeros(filter_bits // 8, np.uint8)
    level, below, levels, sent = first_level, 0, [], None
    while True:
        counted = narrow.select("lang", "text").mapInArrow(_prefix_counter(level, below, sent), "h long, n long, more boolean")
        left = scratch.table(counted.groupBy("h").agg(F.sum("n").alias("n"), F.max("more").alias("more"))
                             .where(F.col("n") >= min_docs).select("h", "more"), f"level{level}")
        place = (F.col("h").bitwiseAND(filter_bits - 1) + 1).alias("place")  # bitmaps count from 1
        chunks = (left.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
                  .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect())
        for c in chunks:  # at most filter_bits / 32,768 rows of 4 KiB
            at = (c["bucket"] - 1) * 4096
            own = np.frombuffer(c["bits"], np.uint8)[: len(bits) - at]
            bits[at:at + len(own)] |= own
        if sent is not None:
            sent.destroy()
        sent = spark.sparkContext.broadcast(bits.copy())
        levels.append(level)
        if not left.where("more").limit(1).count():
            break
        below, level = level, STEP * level
    # a term's sources travel together; all that follows keeps the partitioning by (lang, term)
    counts = narrow.mapInArrow(_term_counter(levels, sent),
                               "lang string, term string, uses array<struct<source: string, n: long, docs: long>>")
    counts = counts.repartition("lang", "term").select("lang", "term", F.inline("uses"))
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row for each source of a term
    counts = (counts.withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term))
              .withColumn("first", F.row_number().over(term.orderBy("source")) == 1).where(F.col("lang_docs") >= min_docs))
    out = scratch.table(counts.select("lang", "source", "term", "n", "lang_n", "first"), "kept")
    sent.destroy()
    return out


# ---- divergence ------------------------------------------------------------------------------

def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * n / total) by long division, exact while 1000 * total fits into 64 bits."""
    whole, rest = F.lit(0).cast("long"), n
    for _ in range(3):  # SCALE is 1000 ** 3
        whole, rest = whole * 1000 + _div(rest * 1000, total), rest * 1000 % total
    return whole + 1


def _gain(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)); both are at most SCALE + 1, so the square fits."""
    return _div((p - q) * (p - q), p + q)


def _pair_sums(key, cells: pa.Table, sources: pa.Table) -> pa.Table:
    """The gain summed over the terms of one block, for every two sources of a pair of tiles.

    Terms that no source of the two tiles has are not among the cells: ``terms`` says how many are.
    """
    ids, tile, none = (sources[c].to_numpy() for c in ("s", "tile", "none"))
    place = dict(zip(ids.tolist(), range(len(ids))))
    words = cells["term"].combine_chunks().dictionary_encode()
    p = np.tile(none, (len(words.dictionary), 1))
    p[words.indices.to_numpy(), [place[i] for i in cells["s"].to_pylist()]] = cells["p"].to_numpy()
    left, right = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile == tile.max())
    a, b = np.repeat(ids[left], len(right)), np.tile(ids[right], len(left))
    total = np.concatenate([((p[:, i:i + 1] - p[:, right]) ** 2 // (p[:, i:i + 1] + p[:, right])).sum(axis=0)
                            for i in left])
    if tile.min() != tile.max():
        a, b, total = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(total, 2)
    return pa.table({"lang": pa.array([sources["lang"][0].as_py()] * len(a), pa.string()), "a": a, "b": b,
                     "sum": total, "terms": np.full(len(a), len(p), np.int64)})


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, first_level: int = 4,
                      filter_bits: int = FILTER_BITS, block_terms: int = BLOCK_TERMS,
                      tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each (lang, source) group apart.

    p of a group and a kept term: 1 + floor(10**9 * (occurrences + 2) / (N + 2 V)), N the group's
    occurrences of kept terms, V the kept terms of the lang; q the same of another group or of the
    whole lang.  The gain is floor((p - q)**2 / (p + q)), in whole numbers throughout.
    part 'pair': one row per other source of the lang, the gain summed over all kept terms, all ranks.
    part 'term': the ``top`` terms of the group with p > q, against the whole lang.
    Rank from 1, value descending, item ascending by its bytes.  Null lang, source and text count as
    ''; a group without terms has its pairs all the same; without kept terms the value is 0.
    Empty tables give no rows.  Columns beyond lang, source and text are not read.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    kept = kept_terms(docs, min_docs, first_level, filter_bits)
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count_if("first").alias("v"))
    whole = Window.partitionBy("lang")
    # one row for each (lang, source); s numbers the sources of a lang
    stats = scratch.table(
        groups.join(used, ["lang", "source"], "left").na.fill(0, ["n_all", "v"])
        .withColumn("v", F.sum("v").over(whole)).withColumn("lang_all", F.sum("n_all").over(whole))
        .withColumn("s", F.row_number().over(whole.orderBy("source")).cast("long") - 1)
        .withColumn("tile", _div(F.col("s"), F.lit(tile_sources)))
        .withColumn("tiles", F.max("tile").over(whole))
        .withColumn("blocks", _div(F.col("v") + block_terms - 1, F.lit(block_terms)))
        .withColumn("none", F.when(F.col("v") > 0, _share(F.lit(2).cast("long"), F.col("n_all") + 2 * F.col("v")))),
        "groups")
    shared = kept.join(stats, ["lang", "source"]).withColumn(
        "p", _share(F.col("n") + 2, F.col("n_all") + 2 * F.col("v")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    against = shared.withColumn("q", _share(F.col("lang_n") + 2, F.col("lang_all") + 2 * F.col("v"))).where("p > q")
    terms = against.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                           _gain(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # every two tiles of a lang's sources meet once in each block of its terms
    meeting = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), "tiles"), lambda other: F.struct(
        F.least("tile", other).alias("t1"), F.greatest("tile", other).alias("t2"))))
    key = ["lang", "t1", "t2", "block"]
    cells = (shared.withColumn("block", F.expr("pmod(xxhash64(term), blocks)")).withColumn("m", meeting)
             .select("lang", "m.t1", "m.t2", "block", "term", "s", "p"))
    sides = (stats.toDF(*stats.columns).where("v > 0").withColumn("m", meeting)
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("lang", "m.t1", "m.t2", "block", "s", "tile", "none"))
    sums = (cells.groupBy(*key).cogroup(sides.groupBy(*key))
            .applyInArrow(_pair_sums, "lang string, a long, b long, sum long, terms long")
            .groupBy("lang", "a", "b").agg(F.sum("sum").alias("sum"), F.sum("terms").alias("terms")))
    one = stats.select("lang", "source", F.col("s").alias("a"), "v", F.col("none").alias("none_a"))
    two = stats.select("lang", F.col("source").alias("item"), F.col("s").alias("b"), F.col("none").alias("none_b"))
    unseen = (F.col("v") - F.col("terms")) * _gain(F.col("none_a"), F.col("none_b"))
    pairs = (one.join(two, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")  # as many rows as are returned
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     F.coalesce(F.col("sum") + unseen, F.lit(0).cast("long")).alias("value"))
             .withColumn("rank", F.row_number().over(ranked)))
    return pairs.unionByName(terms)
