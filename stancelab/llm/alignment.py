"""Alignment of two tokenizers' ids over the bytes of each text.

Tokens end at byte offsets.  Where a token of A and one of B end together, a group closes.  What a
byte range of a text says about its groups is a fragment: the tokens up to its first common end
(open prefix: the group may have begun before the range), the groups closed after that, and the
tokens behind its last common end (open suffix).  Fragments of neighbouring ranges compose, and
composition is associative, so the ranges of a long text may be composed in any tree.

A text of one range is finished where it is read.  The ranges of longer texts are composed over
Spark tasks, eight neighbours a step; texts beyond ``SEGMENT_BYTES`` are also encoded by several
tasks, cut only where both tokenizers are known to cut.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .idlists import IdLists
from .scratch import Scratch

#: Bytes of the ranges that make a fragment each, and of the parts of a text that one task encodes.
RANGE_BYTES = 1 << 16
SEGMENT_BYTES = 1 << 20
#: Neighbouring fragments that one step composes.
FAN_IN = 8
#: Words that a worker keeps with their tokens, about 200 bytes each, and the ids of A they may have.
WORDS_KEPT = 250_000
IDS_KEPT = 1 << 22
#: New words that are encoded together.
JOINED_WORDS = 500
#: Pairs of ids (17 bytes each) that are fetched and broadcast at a time; more pairs take more passes.
BLOCK_PAIRS = 1 << 20


# ---- the monoid ------------------------------------------------------------------------------

class Fragment(NamedTuple):
    """A byte range's tokens: ids as decimal lists, groups as ``a1,a2|b1;a3|b2,b3``.

    Without a common end all tokens are in the suffix.  links: the pairs of ids that end together, as
    (a << 32) + b in 64 bits each, one per common end.
    """

    prefix_a: bytes
    prefix_b: bytes
    closed: bytes
    suffix_a: bytes
    suffix_b: bytes
    links: bytes
    n_a: int
    n_b: int


EMPTY = Fragment(b"", b"", b"", b"", b"", b"", 0, 0)


def _list(x: bytes, y: bytes) -> bytes:
    return x + b"," + y if x and y else x or y


def _groups(*parts: bytes) -> bytes:
    return b";".join(p for p in parts if p)


def compose(f: Fragment, g: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative, with EMPTY as its neutral element."""
    links, n_a, n_b = f.links + g.links, f.n_a + g.n_a, f.n_b + g.n_b
    if not g.links:
        return Fragment(*f[:3], _list(f.suffix_a, g.suffix_a), _list(f.suffix_b, g.suffix_b), links, n_a, n_b)
    middle = (_list(f.suffix_a, g.prefix_a), _list(f.suffix_b, g.prefix_b))
    if not f.links:
        return Fragment(*middle, *g[2:5], links, n_a, n_b)
    return Fragment(*f[:2], _groups(f.closed, b"|".join(middle), g.closed), *g[3:5], links, n_a, n_b)


def _decimal(ids) -> bytes:
    return ",".join(map(str, ids)).encode()


@lru_cache(maxsize=1)
def _decimals(digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all ids of so many digits at most: right-aligned text with a place behind, which places count, and how many."""
    ids = np.arange(10**digits)
    text = np.stack([ids // 10**k % 10 + 48 for k in range(digits - 1, -1, -1)] + [ids * 0], axis=1).astype(np.uint8)
    size = sum((ids >= 10**k).astype(np.int64) for k in range(1, digits)) + 1
    return text, np.arange(digits + 1) >= (digits - size)[:, None], size + 1


def _write_groups(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;`` for every group as bytes, and the end of each; at_a, at_b: the last token of each group."""
    size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    # before a token of A stand the B tokens of earlier groups, before one of B also its own group's of A
    place_a = np.arange(len(a)) + np.repeat(at_b + 1 - size_b, size_a)
    place_b = np.arange(len(b)) + np.repeat(at_a + 1, size_b)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    behind = np.full(len(ids), ord(","), np.uint8)
    behind[place_a[at_a]], behind[place_b[at_b]] = ord("|"), ord(";")
    text, counts, size = _decimals(max(5, len(str(int(ids.max(initial=0))))))
    out = text[ids]
    out[:, -1] = behind
    return out[counts[ids]], np.cumsum(size[ids])[place_b[at_b]]


def _common(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of either side that end together."""
    if not len(ends_b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
    at_a = np.flatnonzero(ends_b[near] == ends_a)
    return at_a, near[at_a]


def fragment(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of the tokens whose ends lie in one range."""
    at_a, at_b = _common(ends_a, ends_b)
    if not len(at_a):
        return Fragment(b"", b"", b"", _decimal(a.tolist()), _decimal(b.tolist()), b"", len(a), len(b))
    (a0, a1), (b0, b1) = (at_a[[0, -1]] + 1, at_b[[0, -1]] + 1)
    closed, _ = _write_groups(a[a0:a1], at_a[1:] - a0, b[b0:b1], at_b[1:] - b0)
    return Fragment(_decimal(a[:a0].tolist()), _decimal(b[:b0].tolist()), closed.tobytes()[:-1], _decimal(a[a1:].tolist()),
                    _decimal(b[b1:].tolist()), _links(a[at_a], b[at_b]).tobytes(), len(a), len(b))


def _links(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int64) << 32) + b).astype("<i8")


def groups_of(f: Fragment) -> bytes:
    """All groups of a whole text."""
    return _groups(f.prefix_a + b"|" + f.prefix_b, f.closed) if f.links else b""


# ---- the tokenizers --------------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes are themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


#: The characters of which two may stand on either side of a cut.
_PLAIN = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x100)]))


class Aligner:
    """Two tokenizers side by side: A of the ``tokenizers`` library, B of ``sentencepiece``.

    Both see a space before the text: A gets it written, B adds it by itself.  Where A cuts by the
    byte-level pattern without normalising, and no piece of B goes on over a space, a single space
    between two plain characters begins a token of either, and what stands on its two sides does
    not matter to the other.  Texts are cut there and each distinct word is encoded once.  With
    other files, and around other white space, the text stays whole.
    """

    _CUT = re.compile("(?<=[!-~À-ÿ]) (?=[!-~À-ÿ])")
    _OTHER = re.compile("^ | $|[^!-~À-ÿ] | [^!-~À-ÿ]")

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        table = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
                 for t, i in self._a.get_vocab().items()}
        self._a_bytes = [table.get(i, b"") for i in range(max(table) + 1)]
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                         for p in pieces]
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        rule = spec.get("pre_tokenizer") or {}
        self._by_word = (not spec.get("normalizer") and rule.get("type") == "ByteLevel" and rule.get("use_regex")
                         and not rule.get("add_prefix_space") and self._b.encode("a") != self._b.encode(" a")
                         and not any("▁" in p.lstrip("▁") for p in pieces))
        self._sizes = tuple(np.array([len(t) for t in side], np.int64) for side in (self._a_bytes, self._b_bytes))
        self._kept: dict[str, int] = {}
        self._forget()

    def cut(self, text: str) -> list[str]:
        """The words of space + text, each without its first character, a space."""
        if not self._by_word:
            return [text]
        return self._CUT.split(text) if self._OTHER.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of A and of B of each text; None if its bytes do not come back."""
        split = [self.cut(t) for t in texts]
        words = set().union(*split)
        missing = words.difference(self._kept)
        if len(self._kept) + len(missing) > WORDS_KEPT:
            self._forget()
            missing = words
        self._learn(missing)
        n = [len(ws) for ws in split]
        at = np.fromiter(map(self._kept.__getitem__, chain.from_iterable(split)), np.int64, sum(n))
        sides = [side.take(at, np.cumsum([0, *n])) for side in self._sides]
        strange = [False] * len(texts)
        for i in np.flatnonzero(at < 0) if at.size and at.min() < 0 else ():
            strange[int(np.searchsorted(np.cumsum(n), i, "right"))] = True
        out = [None if bad else own for bad, own in zip(strange, zip(*sides))]
        if self._sides[0].used > IDS_KEPT:  # very long words, too
            self._forget()
        return out

    def _forget(self) -> None:
        self._kept.clear()
        self._sides = (IdLists(), IdLists())

    def _learn(self, words: set[str]) -> None:
        """Keeps the ids of new words, -1 for those whose bytes do not come back.

        Words that may stand beside each other are encoded as one text and cut again where they end.
        """
        plain = [w for w in words if w and w[0] in _PLAIN and w[-1] in _PLAIN] if self._by_word else []
        alone = words.difference(plain)
        for at in range(0, len(plain), JOINED_WORDS):
            own = plain[at:at + JOINED_WORDS]
            joined = " ".join(own)
            ids = self._ids(joined)
            if ids is None:
                alone.update(own)
                continue
            sizes = map(len, own) if joined.isascii() else (len(w.encode()) for w in own)
            ends = np.cumsum(np.fromiter(sizes, np.int64, len(own)) + 1)
            self._kept.update(zip(own, range(self._sides[0].count, self._sides[0].count + len(own))))
            for side, x, size in zip(self._sides, ids, self._sizes):
                side.add(x, np.searchsorted(np.cumsum(size[x]), ends) + 1)
        for w in alone:
            ids = self._ids(w)
            self._kept[w] = -1 if ids is None else self._sides[0].count
            for side, x in zip(self._sides, ids or ()):
                side.add(x, np.array([len(x)]))

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        raw = b" " + text.encode()
        a, b = self._a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self._b.encode(text)
        if not b"".join(map(self._a_bytes.__getitem__, a)) == raw == b"".join(map(self._b_bytes.__getitem__, b)):
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def finished(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        """n_a, n_b, n_groups, digest and links of each of some whole texts, all at once: a text ends where both end."""
        if not sides:
            return []
        (a, ends_a), (b, ends_b) = ((ids, np.cumsum(size[ids])) for ids, size in zip(map(np.concatenate, zip(*sides)), self._sizes))
        at_a, at_b = _common(ends_a, ends_b)
        links = _links(a[at_a], b[at_b])
        written, ends = _write_groups(a, at_a, b, at_b)
        written = written.tobytes()
        to_b = np.cumsum([len(y) for _, y in sides])
        groups = np.searchsorted(at_b, to_b - 1) + 1  # of all texts so far
        out, g0, x0 = [], 0, 0
        for (x, y), g in zip(sides, groups.tolist()):
            x1 = int(ends[g - 1])
            out.append((len(x), len(y), g - g0, hashlib.sha256(written[x0:x1 - 1]).hexdigest(), links[g0:g].tobytes()))
            g0, x0 = g, x1
        return out

    def fragments(self, sides: tuple[np.ndarray, np.ndarray], range_bytes: int) -> list[Fragment]:
        """Fragments of a text's byte ranges, in order."""
        cut = []
        for ids, size in zip(sides, self._sizes):
            ends = np.cumsum(size[ids])
            cut.append((ids, ends, (ends - 1) // range_bytes))
        out = []
        for r in range(int(cut[0][2][-1]) + 1):
            (a0, a1), (b0, b1) = (np.searchsorted(c[2], [r, r + 1]) for c in cut)
            (a, ea, _), (b, eb, _) = cut
            out.append(fragment(a[a0:a1], ea[a0:a1], b[b0:b1], eb[b0:b1]))
        return out


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


# ---- Spark -----------------------------------------------------------------------------------

_DONE = "doc long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
_OPEN = ("at long, prefix_a binary, prefix_b binary, closed binary, suffix_a binary, suffix_b binary, "
         "same boolean, segment string")
_NONE = (0, 0, 0, "", b"")


def _finished(f: Fragment) -> tuple:
    return f.n_a, f.n_b, len(f.links) // 8, hashlib.sha256(groups_of(f)).hexdigest(), f.links


def _open_row(doc: int, doc_id: int | None, at: int, f: Fragment | None, segment: str | None = None) -> tuple:
    """A fragment on its way, or a segment that another task encodes; without both the text is not the same."""
    g = f or EMPTY
    return (doc, doc_id, g.n_a, g.n_b, None, None, g.links, at, *g[:5], f is not None or segment is not None, segment)


def _reader(a_path: str, b_path: str, range_bytes: int, segment_bytes: int):
    names = [c.split()[0] for c in f"{_DONE}, {_OPEN}".split(", ")]
    kinds = {"long": pa.int64(), "string": pa.large_string(), "binary": pa.large_binary(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in f"{_DONE}, {_OPEN}".split(", ")])

    def segments(text: str, aligner: Aligner) -> Iterator[tuple[int, str]]:
        """Parts of at least ``segment_bytes`` that begin at cuts, with the number of their first range."""
        held, size, at = [], 0, 0
        for w in aligner.cut(text):
            held.append(w)
            size += len(w.encode()) + 1
            if size >= segment_bytes:
                yield at, " ".join(held)
                at += -(-size // range_bytes)
                held, size = [], 0
        if held:
            yield at, " ".join(held)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names=names)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        aligner, doc = _aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        for b in frames:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 20):
                    size += len(texts[to])
                    to += 1
                small = [i for i in range(at, to) if 0 < len(texts[i]) <= segment_bytes]
                sides = dict(zip(small, aligner.encode([texts[i] for i in small])))
                whole = [i for i in small if sides[i] and len(texts[i].encode()) < range_bytes]  # with a space: one range
                done = dict(zip(whole, aligner.finished([sides[i] for i in whole])))
                rows = []
                for i in range(at, to):
                    if i in done:
                        rows.append((doc, ids[i], *done[i], *[None] * 8))
                    elif not texts[i] or i in sides and sides[i] is None:
                        rows.append((doc, ids[i], *_NONE, *[None] * 8))
                    elif i in sides:
                        rows += [_open_row(doc, ids[i], k, f) for k, f in enumerate(aligner.fragments(sides[i], range_bytes))]
                    else:
                        rows += [_open_row(doc, ids[i], k, None, part) for k, part in segments(texts[i], aligner)]
                    doc += 1
                yield batch(rows)
                at = to

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for b in frames:
            for r in b.to_pylist():
                sides = aligner.encode([r["segment"]])[0]
                made = [None] if sides is None else aligner.fragments(sides, range_bytes)
                rows = [_open_row(r["doc"], r["doc_id"], r["at"] + i, f) for i, f in enumerate(made)]
                yield batch(rows)
    return run, encode


def _compose_rows(key, rows: pa.Table) -> pa.Table:
    """One fragment of at most FAN_IN neighbours."""
    rows = rows.sort_by("at")
    own = rows.select([*Fragment._fields]).to_pylist()
    f = reduce(compose, (Fragment(**r) for r in own), EMPTY)
    out = {c: [v] for c, v in f._asdict().items()}
    out |= {"doc": [rows["doc"][0].as_py()], "doc_id": [rows["doc_id"][0].as_py()], "at": [rows["at"][0].as_py() // FAN_IN],
            "same": [all(rows["same"].to_pylist())]}
    return pa.table({c: pa.array(out[c], rows.schema.field(c).type) for c in rows.column_names})


def _finish(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        for r in b.to_pylist():
            done = _finished(Fragment(**{c: r[c] for c in Fragment._fields})) if r["same"] else _NONE
            yield pa.RecordBatch.from_pylist([dict(zip(
                ("doc", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"), (r["doc"], r["doc_id"], *done)))])


def aligned_texts(docs: DataFrame, a_path: str, b_path: str, range_bytes: int = RANGE_BYTES,
                  segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """(doc, doc_id, n_a, n_b, n_groups, groups_sha256, links) of every row; ``doc`` numbers the rows."""
    scratch = Scratch(docs.sparkSession, "alignment")
    read, encode = _reader(a_path, b_path, range_bytes, segment_bytes)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the row numbers must not change when a task runs again, so they are written once
    first = scratch.table(narrow.mapInArrow(read, f"{_DONE}, {_OPEN}"), "read", "zstd")
    done_columns = [c.split()[0] for c in _DONE.split(", ")]
    done = first.where("at IS NULL").select(*done_columns)
    parts = first.where("segment IS NOT NULL")
    fields = ["doc", "doc_id", "at", "same", *Fragment._fields]
    spread = parts.repartition("doc", "at").mapInArrow(encode, f"{_DONE}, {_OPEN}")
    ranges = scratch.table(first.where("at IS NOT NULL AND segment IS NULL").select(*fields)
                           .unionByName(spread.select(*fields)), "ranges")
    most = ranges.agg(F.max("at")).first()[0]
    if most is None:
        return done
    for _ in range(max(1, math.ceil(math.log(most + 1, FAN_IN) - 1e-9))):
        ranges = scratch.table(ranges.withColumn("near", F.expr(f"at div {FAN_IN}")).groupBy("doc", "near")
                               .applyInArrow(lambda key, rows: _compose_rows(key, rows.drop_columns(["near"])),
                                             ranges.schema), "composed")
    return done.unionByName(scratch.table(ranges.mapInArrow(_finish, _DONE), "composed"))


def _pair_counter(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pair of ids with its links, gathered over about 32 MB of links."""
    _aligner.cache_clear()  # the words of an earlier stage
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def total():
        pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        held[:] = [(pairs, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64))]

    size = 0
    for b in frames:
        for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
            got = np.frombuffer(b"".join(part.column("links").to_pylist()), "<i8")
            pairs, n = np.unique(got, return_counts=True)
            held.append((pairs, n))
            size += len(pairs)
            if size > 1 << 21:
                total()
                size = len(held[0][0])
                if size > 1 << 20:
                    yield pa.record_batch({"pair": held[0][0], "n": held[0][1]})
                    held.clear()
                    size = 0
    if held:
        total()
        yield pa.record_batch({"pair": held[0][0], "n": held[0][1]})


def _scorer(block, last: bool):
    """Adds the counts of one block of pairs to n_best and count_sum; the last one drops the links."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _aligner.cache_clear()  # the words of an earlier stage
        pairs, counts, best = block.value
        for b in (f.slice(i, 512) for f in frames for i in range(0, f.num_rows, 512)):
            n_best, total = b.column("n_best").to_pylist(), b.column("count_sum").to_pylist()
            for i, raw in enumerate(b.column("links")):
                links = np.frombuffer(raw.as_buffer(), "<i8")
                if len(links) and len(pairs):
                    at = np.minimum(np.searchsorted(pairs, links), len(pairs) - 1)
                    at = at[pairs[at] == links]
                    n_best[i] += int(best[at].sum())
                    total[i] += int(counts[at].sum())
            for name, values in (("n_best", n_best), ("count_sum", total)):
                b = b.set_column(b.schema.get_field_index(name), name, pa.array(values, pa.int64()))
            yield b.drop_columns(["links"]) if last else b
    return run


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, range_bytes: int = RANGE_BYTES,
                     segment_bytes: int = SEGMENT_BYTES, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    docs: doc_id, text; other columns are not read.  n_a, n_b: tokens; n_groups: groups between
    common ends; n_links: pairs of tokens that end together, one per group; n_best: links whose count
    over the whole corpus is the highest of their B id (ties included); count_sum: the counts of the
    links, summed.  A null or empty text, or one whose bytes a tokenizer does not give back, has no
    tokens: zeros, an empty digest, and its links count nowhere.  Repeated rows and null ids are rows
    of their own.  An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    aligned = aligned_texts(docs, a_path, b_path, range_bytes, segment_bytes)
    counted = aligned.select("links").mapInArrow(_pair_counter, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = scratch.table(counted, "pairs")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")
    highest = counted.groupBy(b_id).agg(F.max("n").alias("most"))
    n_blocks = max(1, -(-counted.count() // block_pairs))
    pairs = counted.select("pair", "n", b_id).join(highest, "b").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"),
        F.expr(f"pmod(xxhash64(pair), {n_blocks})").alias("block"))
    if n_blocks > 1:
        pairs = scratch.table(pairs, "scored")
    out = aligned.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    for i in range(n_blocks):
        own = pairs.where(F.col("block") == i).select("pair", "n", "best").toArrow().sort_by("pair")
        sent = docs.sparkSession.sparkContext.broadcast(tuple(own[c].to_numpy() for c in ("pair", "n", "best")))
        last = i + 1 == n_blocks
        out = out.mapInArrow(_scorer(sent, last), (out.drop("links") if last else out).schema)
        if not last:  # one block at a time
            out = scratch.table(out, "block")
            sent.destroy()
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum",
                      "groups_sha256")
