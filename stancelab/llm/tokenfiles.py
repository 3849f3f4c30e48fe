"""Token-id files: independent zstandard frames with a trailing seek table.

File layout (little-endian)::

    frame 0 | frame 1 | ... | seek table | footer

    frame       one zstandard frame of uint32 ids, whole documents end to end
    seek table  per document: doc_id i64, has doc_id u32, frame u32, first id u32 (within the
                frame), ids u32, crc32 of its ids u32
                per frame:    offset u64, compressed bytes u32, ids u32, crc32 of the raw ids u32
    footer      documents u32, frames u32, crc32 of the table u32, magic "TKZ1"

A reader takes the footer, the table, and then only the frames of the documents it wants.  The
tokenizer is a file of the ``tokenizers`` library; its path is a parameter.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .idlists import IdLists
from .scratch import Scratch
from .words import batches, text_bytes

MAGIC = b"TKZ1"
#: Ids after which a frame is closed; a longer document is one frame.
FRAME_IDS = 1 << 16
_DOC = np.dtype([("key", "<i8"), ("has_key", "<u4"), ("frame", "<u4"), ("first", "<u4"), ("ids", "<u4"), ("crc32", "<u4")])
_FRAME = np.dtype([("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4"), ("crc32", "<u4")])
_FOOTER = struct.Struct("<III4s")


# ---- the format ------------------------------------------------------------------------------

def write_file(sink, documents: Iterable[tuple[int | None, np.ndarray]], frame_ids: int = FRAME_IDS, level: int = 3) -> tuple[int, int]:
    """Write (doc_id, ids) pairs to a binary sink, a frame at a time; returns (documents, ids)."""
    import zstandard
    packer = zstandard.ZstdCompressor(level=level)
    docs: list[tuple[int, int, int, int, int, int]] = []
    frames: list[tuple[int, int, int, int]] = []
    pending: list[np.ndarray] = []
    held = at = total = 0

    def close() -> None:
        nonlocal at, held
        raw = np.concatenate(pending).astype("<u4").tobytes()
        packed = packer.compress(raw)
        frames.append((at, len(packed), held, zlib.crc32(raw)))
        sink.write(packed)
        at += len(packed)
        held = 0
        pending.clear()

    for key, ids in documents:
        ids = np.asarray(ids, dtype="<u4")
        docs.append((key or 0, key is not None, len(frames), held, len(ids), zlib.crc32(ids.tobytes())))
        total += len(ids)
        pending.append(ids)
        held += len(ids)
        if held >= frame_ids:
            close()
    if pending:
        close()
    table = np.array(docs, _DOC).tobytes() + np.array(frames, _FRAME).tobytes()
    sink.write(table)
    sink.write(_FOOTER.pack(len(docs), len(frames), zlib.crc32(table), MAGIC))
    return len(docs), total


class TokenFile:
    """Random access to the documents of a seekable binary source of known size."""

    def __init__(self, source, size: int):
        import zstandard
        self._source, self._unpacker = source, zstandard.ZstdDecompressor()
        source.seek(size - _FOOTER.size)
        n_docs, n_frames, crc, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        width = n_docs * _DOC.itemsize + n_frames * _FRAME.itemsize
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(size - _FOOTER.size - width)
        table = source.read(width)
        if zlib.crc32(table) != crc:
            raise ValueError("the seek table is damaged")
        self.docs = np.frombuffer(table, _DOC, n_docs)
        self.frames = np.frombuffer(table, _FRAME, n_frames, n_docs * _DOC.itemsize)
        self._open = (-1, np.zeros(0, np.uint32))

    def __len__(self) -> int:
        return len(self.docs)

    def frame(self, i: int) -> np.ndarray:
        if self._open[0] != i:
            f = self.frames[i]
            self._source.seek(int(f["offset"]))
            raw = self._unpacker.decompress(self._source.read(int(f["bytes"])), max_output_size=int(f["ids"]) * 4)
            if zlib.crc32(raw) != f["crc32"]:
                raise ValueError(f"frame {i} is damaged")
            self._open = (i, np.frombuffer(raw, "<u4"))
        return self._open[1]

    def __getitem__(self, i: int) -> np.ndarray:
        d = self.docs[i]
        return self.frame(int(d["frame"]))[int(d["first"]):int(d["first"]) + int(d["ids"])]


# ---- encoding --------------------------------------------------------------------------------

#: Encoded words that a worker keeps between batches, about 200 bytes each.
WORDS_KEPT = 1_000_000
IDS_KEPT = 1 << 23
#: A word of ASCII or Latin-1 letters; such runs, digits and runs of ASCII marks but the apostrophe.
_PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_RUN = re.compile(_PLAIN.pattern + rb"|[0-9]|[!-&(-/:-@\[-`{-~]+")
_LETTERS = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def words_are_pieces(path: str) -> bool:
    """Whether a tokenizer file is of the kind that ``Encoder`` may encode word by word.

    It composes characters, makes white space one blank and lower-cases, nothing else; then it cuts
    out runs of letters, single digits and runs of other characters, dropping white space; and
    merges byte-level, with a mark for a piece's end.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def steps(part: str, inner: str) -> list[dict]:
        own = spec.get(part) or {}
        return own.get(inner, []) if own.get("type") == "Sequence" else [own]

    def pattern(step: dict) -> str | None:
        return (step.get("pattern") or {}).get("Regex")

    normal, cuts = steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers")
    return (spec["model"].get("type") == "BPE" and bool(spec["model"].get("end_of_word_suffix")) and not spec["model"].get("dropout")
            and [n.get("type") for n in normal] == ["NFC", "Replace", "Lowercase"]
            and pattern(normal[1]) == r"\s+" and normal[1].get("content") == " "
            and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0].get("invert") is True and cuts[0].get("behavior") == "Removed"
            and (pattern(cuts[0]) or "").endswith(_LETTERS)
            and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex"))


def _blank_before_marks(texts: list[bytes]) -> list[bytes]:
    """The texts in lower case (A-Z), with a blank before a full stop or comma that ends a word after a-z."""
    joined = b"".join([t + b"\n" for t in texts]).lower()
    data = np.frombuffer(joined, np.uint8)
    mark, after = data[1:-1], data[2:]
    marks = np.flatnonzero(((mark == 0x2E) | (mark == 0x2C)) & ((after == 0x20) | (after == 0x0A))
                           & (data[:-2] - np.uint8(0x61) < 26)) + 1
    off = np.cumsum([0, *[len(t) + 1 for t in texts]])
    off += np.searchsorted(marks, off)
    joined = np.insert(data, marks, 0x20).tobytes()
    return [joined[x:y] for x, y in zip(off, off[1:])]


class Encoder:
    """Token ids of whole texts, encoding each distinct word once.

    ``by_piece`` is for a tokenizer that drops white space, lower-cases, and cuts runs of letters
    from punctuation before merging: a text's ids then are those of its words end to end.  Words
    end at ASCII white space.  A word of plain letters goes, lower-cased and without the
    punctuation that ends it, through the same merges without the normalizer and the pattern,
    many at a time; one of several runs of plain letters, digits and ASCII marks has the ids of its
    runs end to end; all other words go through the whole tokenizer.  Otherwise, and with a file that
    is not of this kind (:func:`words_are_pieces`), whole texts do.
    """

    def __init__(self, path: str, by_piece: bool = True):
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        by_piece = by_piece and words_are_pieces(path)
        self._by_piece = by_piece
        self._forget()
        if by_piece:
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self._added = [t["content"].encode() for t in spec.get("added_tokens") or []]
            # what the pattern looks for before letters must begin with an apostrophe, which no run has
            cuts = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].removesuffix(_LETTERS)
            self._by_run = all(c.startswith("'") for c in cuts.split("|"))
            spec |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {
                "type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {
                    "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
            self._merges = Tokenizer.from_str(json.dumps(spec))
            # a piece's last token carries the mark for its end
            mark, vocabulary = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
            self._last = np.zeros(max(vocabulary.values()) + 1, bool)
            self._last[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self._by_piece:
            got = self._tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(e.ids, "<u4") for e in got]
        if len(self._kept) > WORDS_KEPT or self._ids.used > IDS_KEPT:
            self._forget()
        # in lower case and with a blank before the mark that ends a word, there are fewer different words
        split = [t.split() for t in _blank_before_marks(texts)]
        n = [len(ws) for ws in split]
        try:
            # a word not seen before gets the next number
            at = np.fromiter(map(self._kept.__getitem__, chain.from_iterable(split)), np.int64, sum(n))
            self._learn()
        except BaseException:
            self._forget()  # else words would have numbers but no ids
            raise
        return self._ids.take(at, np.cumsum([0, *n]))

    def _forget(self) -> None:
        self._kept: defaultdict[bytes, int] = defaultdict(count().__next__)
        self._ids = IdLists()

    def _new(self) -> list[bytes]:
        """The words that have a number but no ids yet, in order."""
        return [*islice(reversed(self._kept), len(self._kept) - self._ids.count)][::-1]

    def _learn(self) -> None:
        """Gives every numbered word its ids."""
        first, runs = self._ids.count, {}
        for number, w in enumerate(self._new(), first):
            if self._by_run and not w.isalpha():  # bytes: isalpha is A-Z and a-z
                own = _RUN.findall(w)
                if len(own) > 1 and sum(map(len, own)) == len(w) and not any(t in w for t in self._added):
                    runs[number] = [self._kept[r] for r in own]
        new = self._new()
        if not new:
            return
        ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(new)
        plain = [i for i, w in enumerate(new) if w.isalpha() or _PLAIN.fullmatch(w)]
        for at in range(0, len(plain), 500):
            some = plain[at:at + 500]
            got = self._merges.encode_batch_fast([b" ".join([new[i] for i in some]).decode().lower()], add_special_tokens=False)[0]
            all_ids = np.array(got.ids, np.int64)
            ends = (np.flatnonzero(self._last[all_ids]) + 1).tolist()
            for i, x, y in zip(some, [0, *ends[:-1]], ends, strict=True):
                ids[i] = all_ids[x:y]
        known = {*plain, *[n - first for n in runs]}
        rest = [i for i in range(len(new)) if i not in known]
        for at in range(0, len(rest), 20_000):
            some = rest[at:at + 20_000]
            got = self._tokenizer.encode_batch_fast([new[i].decode() for i in some], add_special_tokens=False)
            for i, e in zip(some, got):
                ids[i] = np.array(e.ids, np.int64)
        for number, own in runs.items():
            ids[number - first] = np.concatenate([ids[r - first] if r >= first else self._ids[r] for r in own])
        self._ids.add(np.concatenate(ids), np.cumsum([len(x) for x in ids]))


@lru_cache(maxsize=2)
def _encoder(path: str, by_piece: bool) -> Encoder:
    return Encoder(path, by_piece)


# ---- Spark -----------------------------------------------------------------------------------

def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow opens by its address (local or mounted paths, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1)
                                    if path.startswith("file:/") and not path.startswith("file://") else path)


def _writer(folder: str, tokenizer: str, end_id: int | None, by_piece: bool, frame_ids: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer, by_piece)
        tail = np.array([] if end_id is None else [end_id], np.uint32)

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for b in batches(frames, "text"):
                raw, off = text_bytes(b.column("text"))
                ids = encoder.encode([raw[off[i]:off[i + 1]].tobytes() for i in range(b.num_rows)])
                for key, got in zip(b.column("doc_id").to_pylist(), ids):
                    yield key, np.concatenate([got, tail])

        todo = documents()
        first = next(todo, None)
        if first is None:
            return
        # a name of its own for each attempt: only the attempt that Spark takes is in the manifest
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tkz"
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}") as sink:
            n_docs, n_ids = write_file(sink, _chained(first, todo), frame_ids)
        yield pa.record_batch({"part": pa.array([part], pa.int64()), "file": pa.array([f"{folder}/{name}"]),
                               "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})
    return run


def _chained(first, rest):
    yield first
    yield from rest


def _reader(wanted: frozenset[int] | None):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            for path, base in zip(f.column("file").to_pylist(), f.column("file_start").to_pylist()):
                fs, name = _open(path)
                with fs.open_input_file(name) as source:
                    t = TokenFile(source, source.size())
                    starts = base + np.cumsum(t.docs["ids"], dtype=np.int64) - t.docs["ids"]
                    pick = np.arange(len(t)) if wanted is None else np.flatnonzero(
                        np.isin(t.docs["key"], list(wanted)) & (t.docs["has_key"] == 1))
                    for at in range(0, len(pick), 512):
                        own = pick[at:at + 512]
                        ids = [t[int(i)] for i in own]
                        lengths = np.array([len(x) for x in ids], np.int64)
                        yield pa.record_batch({
                            "doc_id": pa.array([int(t.docs["key"][i]) if t.docs["has_key"][i] else None for i in own],
                                               pa.int64()),
                            "start": pa.array(starts[own]),
                            "ids": pa.ListArray.from_arrays(
                                pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)),
                                pa.array(np.concatenate(ids).astype(np.int64))),
                            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())})
    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = None,
                 by_piece: bool = False, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write one file per range of doc_id; returns the manifest.

    Manifest: part, file, n_docs, n_ids, file_start (ids in the files before).  Documents ascend by
    doc_id over the files in order, null ids first, ties by text; repeated rows are all written.
    Null texts are empty; a document of no ids has a place in the table all the same.  An empty
    table gives an empty manifest.  folder: default a new one under spark.checkpoint.dir; it must
    be one that all executors share.  A document must have fewer than 2**32 ids.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = folder or f"{scratch.root}/files"
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    ranged = narrow.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    manifest = scratch.table(ranged.mapInArrow(
        _writer(folder, tokenizer, end_id, by_piece, frame_ids), "part long, file string, n_docs long, n_ids long"),
        "manifest")
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return scratch.table(manifest.withColumn("file_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest")


def read_tokens(manifest: DataFrame, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """(doc_id, start, ids, ids_crc32) of the documents in the files, or only of ``doc_ids``.

    Only frames that hold requested documents are read and unpacked; every checksum is verified.
    """
    wanted = None if doc_ids is None else frozenset(doc_ids)
    files = manifest.select("file", "file_start").repartition(
        max(1, manifest.count()), "file")
    return files.mapInArrow(_reader(wanted), "doc_id long, start long, ids array<long>, ids_crc32 long")
