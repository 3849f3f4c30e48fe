"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

1. One pass over the texts gives each document its shingle count, a 128-bit digest of its
   shingle set, the band keys of its sketch and one bit of each sketch coordinate.
2. Documents with equal shingle sets are one class, whatever their number; only classes go on.
3. Classes that share a band are candidates.  A band's classes are never paired with one another:
   - two rounds of stars link each class to the leader it most likely belongs to (first a seeded
     leader per band, then, for classes still apart from it, the one most classes chose);
   - what still lies apart within a narrow band is compared exactly: classes outside the band's
     largest component against all its classes;
   - wide bands with the same largest component are searched together, by the differences of their
     classes to one class of it, the pivot (:meth:`_Linker.across`).
   So every linked pair that shares a band ends in one component.  With 32 bands of 4 rows a pair
   at similarity 0.85 is missed with probability 5e-11 (0.80: 5e-8).
4. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .idfilter import mark_suspects
from .scratch import TEXT_ROWS, Scratch
from .sketch import band_keys, sketches
from .words import LOWER_CASE, SPACE_WORDS, Words, batches, grams, split_words

_U = np.uint64

COORDINATES = 128
ROWS = 4
#: Bands with more classes are searched by differences to a pivot; a matter of cost, not of results.
WIDE_BAND = 48
#: Four bits of each coordinate are kept; they agree with probability q = s + (1 - s) / 16.  Pairs that
#: agree in fewer coordinates than so many deviations below the mean at the threshold are no
#: candidates: a linked pair fails this with probability under 1e-6.
DEVIATIONS = 5.2
BITS = 4


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, end to end, and their bounds.

    Fewer than k words: the whole sequence is the only shingle; no words: the empty set."""
    n = np.diff(words.bounds)
    texts = len(n)
    g = grams(words.hash, k)
    doc = words.doc()[:len(g)]
    inside = np.arange(len(g)) + k <= words.bounds[1:][doc]
    g, doc = g[inside], doc[inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = [grams(words.hash[words.bounds[i]:words.bounds[i + 1]], int(n[i]))[0] ^ _U(int(n[i])) for i in short]
        g, doc = np.concatenate([g, np.array(extra, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    if len(g):
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
        g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(texts + 1))


def _digests(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128-bit digest of each set as 16 bytes: two sums of differently mixed hashes."""
    from .words import mix
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    for j, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        total = np.concatenate([[_U(0)], np.cumsum(mix(g ^ _U(salt)), dtype=np.uint64)])
        out[:, j] = mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Fixed-width uint64 rows as a binary column."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * 8
    off = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(off), pa.py_buffer(raw)])


def _longs(rows: np.ndarray) -> pa.Array:
    off = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))


def _sketcher(k: int, id_type: pa.DataType):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, "text"):
            g, bounds = shingle_sets(split_words(b.column("text"), SPACE_WORDS, LOWER_CASE), k)
            sk = sketches(g, bounds, COORDINATES)
            low = (sk & _U(2 ** BITS - 1)).astype(np.uint8)
            bits = np.ascontiguousarray(low[:, ::2] | (low[:, 1::2] << BITS)).view(np.uint64)
            yield pa.record_batch({
                "doc_id": b.column("doc_id").cast(id_type),
                "n_shingles": pa.array(np.diff(bounds).astype(np.int64)),
                "cls": _binary(_digests(g, bounds)),
                "bands": _longs(band_keys(sk, ROWS)),
                "bits": _longs(bits),
            })
    return run


def _digester(k: int):
    """Adds each text's digest."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, "text"):
            sets = shingle_sets(split_words(b.column("text"), SPACE_WORDS, LOWER_CASE), k)
            yield pa.record_batch({"cls": _binary(_digests(*sets)), "text": b.column("text")})
    return run


def _confirmer(k: int, percent: int):
    """The pairs (a, b) whose texts reach the threshold."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches(frames, "ta"):
            (va, oa), (vb, ob) = (shingle_sets(split_words(f.column(c), SPACE_WORDS, LOWER_CASE), k)
                                  for c in ("ta", "tb"))
            common = np.array([len(np.intersect1d(va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]], assume_unique=True))
                               for i in range(f.num_rows)], np.int64)
            union = np.diff(oa) + np.diff(ob) - common
            yield f.drop_columns(["ta", "tb"]).filter(pa.array(100 * common >= percent * union))
    return run


def _differences(k: int):
    """For each class the sizes of its own and its pivot's shingle set, and what only one of them has."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches(frames, "text"):
            v, o = shingle_sets(split_words(f.column("text"), SPACE_WORDS, LOWER_CASE), k)
            _, heads, at = np.unique(np.array(f.column("pivot").to_pylist(), dtype=object),
                                     return_index=True, return_inverse=True)
            pv, po = shingle_sets(split_words(f.column("pivot_text").take(pa.array(heads)), SPACE_WORDS, LOWER_CASE), k)
            apart = [np.setxor1d(v[o[i]:o[i + 1]], pv[po[j]:po[j + 1]], assume_unique=True) for i, j in enumerate(at)]
            off = np.cumsum([0, *[len(x) for x in apart]]).astype(np.int32)
            yield pa.record_batch({
                "main": f.column("main"), "cls": f.column("cls"), "root": f.column("root"),
                "n": pa.array(np.diff(o).astype(np.int64)), "m": pa.array(np.diff(po)[at].astype(np.int64)),
                "items": pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(apart).view(np.int64)))})
    return run


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, cls, bands, bits) of every row of ``docs`` (doc_id, text)."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("cls", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("bits", T.ArrayType(T.LongType()))])
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_sketcher(k, pa.int64()), schema)


def _agreement(a: str, b: str):
    """Coordinates, out of 128, whose kept bits agree: those with no bit set in the difference."""
    each = int("1" * 16, 16)
    apart = []
    for i in range(COORDINATES * BITS // 64):
        x = F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        apart.append(F.bit_count(x.bitwiseAND(F.lit(each))))
    return F.lit(COORDINATES) - sum(apart[1:], apart[0])


def _first_shared_band(a: str, b: str):
    """Number of the first band that both share, so that a pair comes up once."""
    return F.array_position(F.zip_with(f"{a}.bands", f"{b}.bands", lambda x, y: x == y), True) - 1


class _Linker:
    """The candidate search over classes; keeps what several of its steps read."""

    def __init__(self, docs: DataFrame, rows: DataFrame, k: int, percent: int, scratch: Scratch):
        self.scratch, self.percent, self.k = scratch, percent, k
        s = percent / 100
        q = s + (1 - s) / 2 ** BITS
        self.least_bits = int(COORDINATES * q - DEVIATIONS * (COORDINATES * q * (1 - q)) ** 0.5)
        self.classes = classes = scratch.table(
            rows.where("n_shingles > 0").groupBy("cls")
            .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"),
                 F.first("bands").alias("bands"), F.first("bits").alias("bits")), "classes")
        keyed = classes.select("cls", F.posexplode("bands").alias("band", "key"))
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        self.members = members = scratch.table(keyed.join(shared, "key"), "members")
        self.near = scratch.table(classes.join(members.select("cls").distinct(), "cls", "left_semi"), "near")
        wanted = self.near.select(F.col("doc_id").alias("_rep"), F.col("cls").alias("_cls"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # only texts that may be asked for are shuffled
        texts = mark_suspects(texts, "doc_id", wanted.select("_rep")).where("_suspect").drop("_suspect")
        texts = texts.join(wanted.select("_rep"), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
        # a doc_id may stand for several texts: what counts is the text's own class
        texts = texts.select("text").mapInArrow(_digester(k), "cls binary, text string")
        self.texts = scratch.table(
            texts.join(wanted.select(F.col("_cls").alias("cls")), "cls", "left_semi")
            .groupBy("cls").agg(F.first("text").alias("text")), "texts", batch_rows=TEXT_ROWS)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs``, all binary columns, whose a and b reach the threshold on full sets."""
        x = self.texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
        y = self.texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
        return pairs.join(x, "a").join(y, "b").select(*pairs.columns, "ta", "tb").mapInArrow(
            _confirmer(self.k, self.percent), ", ".join(f"{c} binary" for c in pairs.columns))

    def star(self, pairs: DataFrame) -> DataFrame:
        """Confirmed links of each class to its likeliest leader, of (cls, leader)."""
        m = self.near.select("cls", "n", "bits").alias("m")
        lead = self.near.select(F.col("cls").alias("leader"), "n", "bits").alias("l")
        s = self.percent
        scored = (pairs.distinct().join(m, "cls").join(lead, "leader")
                  .withColumn("score", _agreement("m", "l"))
                  .where((F.col("score") >= self.least_bits) & (F.col("m.n") * 100 >= F.col("l.n") * s)
                         & (F.col("l.n") * 100 >= F.col("m.n") * s)))
        best = scored.groupBy("cls").agg(F.max(F.struct("score", "leader")).alias("top"))
        return self.confirm(best.select(F.col("cls").alias("a"), F.col("top.leader").alias("b")))

    def labelled(self, labels: DataFrame) -> DataFrame:
        """The members with their classes' labels."""
        return self.scratch.table(self.members.join(labels, "cls"), "labelled")

    def across(self, wide: DataFrame, pivots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What may be linked in wide bands: (a, b) labels found linked, (a, b, ra, rb) pairs to confirm.

        Let D(X) be the shingles that only one of X and the pivot P has.  X and Y are linked if
        |D(X) ^ D(Y)| <= c (|X| + |Y|), c = (100 - percent) / (100 + percent).  All X with
        |D(X)| <= c (|X| + |P|) are linked to P and thus one component.  Any other X is linked to Y only
        if D(X) and D(Y) share (|D(X)| + |D(Y)| - c (|X| + |Y|)) / 2 items.  That is more than
        (|D(X)| - c (|X| + |P|)) / 2 and more than (|D(Y)| - c (|Y| - |P|)) / 2.  So with the items of
        each in one order, rarest first, a linked pair shares one of the first that leave fewer than
        this; where its first shared item stands bounds what it can share.  Items of one component
        alone count as rarest.
        """
        plus, minus = F.lit(100 + self.percent), F.lit(100 - self.percent)
        rows = (wide.select("main", "cls", "root").distinct().join(pivots, "main")
                .join(self.texts.select(F.col("cls").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
                .join(self.texts, "cls").select("main", "cls", "root", "pivot", "text", "pivot_text"))
        diffs = self.scratch.table(rows.mapInArrow(
            _differences(self.k), "main binary, cls binary, root binary, n long, m long, items array<long>"),
            "differences", batch_rows=TEXT_ROWS)
        over = F.size("items") * plus - (F.col("n") + F.col("m")) * minus
        diffs = diffs.withColumns({"d": F.size("items").cast("long"), "rest": over > 0})
        diffs = diffs.withColumn("side", F.when(F.col("rest"), F.col("root")).otherwise(F.col("main")))
        linked = diffs.where("NOT rest AND root <> main").select(F.col("root").alias("a"), F.col("main").alias("b"))
        sides = diffs.groupBy("main").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
        diffs = diffs.join(sides.where("lo <> hi").select("main"), "main", "left_semi")
        # a row for each item, once; dealt by class, so that no task gets all items of a large group
        items = self.scratch.table(diffs.repartition("main", "cls").select(
            "main", "cls", "side", "n", "m", "d", "rest", F.explode("items").alias("item")), "items")
        shared = items.groupBy("main", "item").agg(
            F.count(F.lit(1)).alias("often"), F.min("side").alias("lo"), F.max("side").alias("hi"))
        own = Window.partitionBy("main", "cls")
        ranked = items.join(shared.where("lo <> hi").select("main", "item", "often"), ["main", "item"]).withColumn(
            "rank", F.col("d") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("often", "item")))
        # items that a linked pair shares at least, told by one of the two
        first = F.ceil((F.col("d") * plus - (F.col("n") + F.col("m")) * minus) / (2 * plus))
        other = F.ceil((F.col("d") * plus - (F.col("n") - F.col("m")) * minus) / (2 * plus))
        ranked = ranked.withColumn("left", F.col("d") - F.col("rank")).withColumns({
            "as_first": F.col("rest") & (F.col("left") + 1 >= first),
            "as_other": F.col("left") + 1 >= F.greatest(F.lit(1), other, F.when(F.col("rest"), first))})
        ranked = self.scratch.table(ranked.where("as_first OR as_other"), "ranked")
        a, b = ranked.where("as_first").alias("a"), ranked.where("as_other").alias("b")
        need = (F.col("a.d") + F.col("b.d")) * plus - (F.col("a.n") + F.col("b.n")) * minus
        pairs = a.join(b, (F.col("a.main") == F.col("b.main")) & (F.col("a.item") == F.col("b.item"))
                       & (F.col("a.side") != F.col("b.side")) & (~F.col("b.rest") | (F.col("a.cls") < F.col("b.cls")))
                       & ((F.least("a.left", "b.left") + 1) * 2 * plus >= need))
        return linked, pairs.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"),
                                    F.col("a.side").alias("ra"), F.col("b.side").alias("rb")).distinct()

    def apart(self, lab: DataFrame, pivots: DataFrame) -> DataFrame:
        """Links between the labels of classes that still share a band, each pair of labels once.

        A label is a class that its classes are known to be connected to, so this links whole
        groups without a row for every pair of their classes."""
        s = self.percent
        per = lab.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
        main = per.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"),
                                      F.count(F.lit(1)).alias("parts")).where("parts > 1")
        lab = self.scratch.table(lab.join(main.select("key", F.col("top.root").alias("main")), "key"), "apart")
        narrow = lab.where(F.col("size") <= WIDE_BAND).join(self.near.select("cls", "n", "bands", "bits"), "cls")
        a, b = narrow.where("root <> main").alias("a"), narrow.alias("b")
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root"))
                       & ((F.col("b.root") == F.col("b.main")) | (F.col("a.cls") < F.col("b.cls")))
                       & (F.col("a.n") * 100 >= F.col("b.n") * s) & (F.col("b.n") * 100 >= F.col("a.n") * s)
                       & (_agreement("a", "b") >= self.least_bits)
                       & (_first_shared_band("a", "b") == F.col("a.band")))
        linked, wide = self.across(lab.where(F.col("size") > WIDE_BAND), pivots)
        found = self.confirm(pairs.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"),
                                          F.col("a.root").alias("ra"), F.col("b.root").alias("rb")).union(wide))
        return found.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).union(linked).distinct()

    def links(self) -> DataFrame:
        """Links with the components of all confirmed ones.  Equal labels say that classes are
        connected, and only classes of unequal labels are compared further.  In the first round
        labels need not be whole components."""
        seeded = self.members.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "cls"), "cls")).alias("lead"))
        pairs = self.members.join(seeded.select("key", F.col("lead.cls").alias("leader")), "key")
        first = self.scratch.table(self.star(pairs.where("cls <> leader").select("cls", "leader")), "star1",
                                   batch_rows=TEXT_ROWS)
        # a class is linked to its leader, and that to its own
        labels = self.near.select("cls").join(first.select(F.col("a").alias("cls"), F.col("b").alias("to")), "cls", "left")
        labels = labels.select("cls", F.coalesce("to", "cls").alias("to")).join(
            first.select(F.col("a").alias("to"), F.col("b").alias("next")), "to", "left")
        lab = self.labelled(self.scratch.table(labels.select("cls", F.coalesce("next", "to").alias("root")), "labels"))
        chosen = first.groupBy(F.col("b").alias("cls")).agg(F.count(F.lit(1)).alias("votes"))
        lead = lab.join(chosen, "cls", "left").groupBy("key").agg(
            F.max(F.struct(F.coalesce("votes", F.lit(0)), "cls", "root")).alias("top"))
        pairs = lab.join(lead.select("key", F.col("top.cls").alias("leader"), F.col("top.root").alias("lead_root")), "key")
        second = self.scratch.table(self.star(pairs.where("root <> lead_root").select("cls", "leader")), "star2",
                                    batch_rows=TEXT_ROWS)
        found = components(first.union(second), self.scratch).select(F.col("node").alias("cls"), "root")
        labels = self.scratch.table(self.near.select("cls").join(found, "cls", "left").select(
            "cls", F.coalesce("root", "cls").alias("root")), "merged")
        # of each label the class that most classes chose
        pivots = labels.join(chosen, "cls", "left").groupBy(F.col("root").alias("main")).agg(
            F.max(F.struct(F.coalesce("votes", F.lit(0)), "cls")).alias("top"))
        known = labels.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))
        return known.union(self.scratch.table(
            self.apart(self.labelled(labels), pivots.select("main", F.col("top.cls").alias("pivot"))), "apart-links",
            batch_rows=TEXT_ROWS))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space.  Two rows are linked if
    their sets of distinct ``shingle_words``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100.  component_id: least doc_id reachable, the row's own included.
    kept: doc_id = component_id, one document of each group.

    Null, empty or word-less texts: empty set, linked with nothing, component_id = doc_id, kept.
    Rows with equal texts, ties and repeated rows are one class; rows that repeat a doc_id share
    its fate.  A null doc_id never becomes a component_id unless its whole component has none; such
    a component has a null component_id, and its rows are kept only if they are linked with
    nothing else.  Other columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = scratch.table(sketch_documents(docs, shingle_words), "sketches", batch_rows=TEXT_ROWS)
    linker = _Linker(docs, rows, shingle_words, percent, scratch)
    roots = components(linker.links(), scratch)
    by_class = linker.classes.select("cls", "doc_id").join(
        roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    grouped = by_class.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    ids = scratch.table(
        by_class.join(grouped, "root", "left")
        .select("cls", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
                F.col("root").isNull().alias("alone")), "ids")
    empty = rows.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    out = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "cls").join(ids, "cls").select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"),
                   F.col("alone") & F.col("component_id").isNull()).alias("kept"))
    return out.union(empty)
