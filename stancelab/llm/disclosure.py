"""Personal data in texts, and the terms that give it away.

Base spans are e-mail addresses, IP addresses, card and phone numbers by pattern; each distinct
value is a protected entity.  The corpus then says which other terms disclose an entity: a term t
beside an entity c has the pointwise mutual information log2(N n(t, c) / (n(t) n(c))), in documents,
and c has the information log2(N / n(c)) to lose.  A term whose share of it passes a threshold is
generalised to its class or, beyond a second one, removed, wherever it stands.  So that copies of one
passage prove nothing, t must stand between different neighbours beside c.

Patterns and words are ASCII classes over bytes, so everything runs on UTF-8; code points are
counted at the end.  Terms and entities travel as 128-bit digests, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import ALNUM_WORDS, LOWER_CASE, Words, batches, mix, split_words, text_bytes

KINDS = ("email", "ip", "card", "phone", "term")
TERM = len(KINDS) - 1
#: Words on either side of a base span that stand beside its entity.
WINDOW = 16
#: Terms (33 bytes each) that are fetched and broadcast at a time; more terms take more passes.
BLOCK_TERMS = 1 << 20
GENERALISE, REMOVE = 1, 2

# ---- base spans ------------------------------------------------------------------------------

_LOCAL = re.compile(rb"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+)*")  # always matches, so a long run is read once
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(rb"[^0-9]+")


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Each @ with the run of local characters before it, from the last match on, and its domain."""
    done, at = 0, text.find(b"@")
    seen = 0  # behind the previous @
    while at >= 0:
        run = _LOCAL.match(text[max(done, seen):at][::-1])
        domain = _DOMAIN.match(text, at + 1) if run else None
        if domain:
            yield at - run.end(), domain.end()
            done = domain.end()
        seen = at + 1
        at = text.find(b"@", at + 1)


def _ips(text: bytes) -> Iterator[tuple[int, int]]:
    """Every four parts of a dotted run of digits."""
    for m in _DOTTED.finditer(text):
        if m.end() - m.start() < 7:
            continue
        at, parts = m.start(), m.group().split(b".")
        for i in range(0, len(parts) - 3, 4):
            own = parts[i:i + 4]
            to = at + sum(map(len, own)) + 3
            if all(len(p.lstrip(b"0")) <= 3 and int(p[-4:]) <= 255 for p in own):
                yield at, to
            at = to + 1


def luhn(digits: bytes) -> bool:
    own = [d - 48 for d in digits[::-1]]
    return (sum(own[::2]) + sum(2 * d - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def _cards(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub(b"", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub(b"", m.group())) <= 15:
            yield m.span()


_DIGIT = re.compile(rb"[0-9]")


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind, then start; leftmost and non-overlapping per kind."""
    out = [(0, *s) for s in _emails(text)] if b"@" in text else []
    if _DIGIT.search(text):
        out += [(1, *s) for s in _ips(text)]
        out += [(2, *s) for s in _cards(text)]
        out += [(3, *s) for s in _phones(text)] if b"+" in text else []
    return out


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _entity(kind: int, value: bytes) -> bytes:
    """The value's digest; cards and phones by their digits, addresses without case."""
    return _digest(KINDS[kind].encode() + b":" + (_NOT_DIGIT.sub(b"", value) if kind > 1 else value.lower()))


# ---- what stands beside an entity ------------------------------------------------------------

def _texts(b: pa.RecordBatch) -> list[bytes]:
    raw, off = text_bytes(b.column("text"))
    return [raw[x:y].tobytes() for x, y in zip(off, off[1:])]


def _beside(window: int):
    """Per document: (entity, no term) once, and (entity, term, neighbours) once each.

    first: 1 for one row of a document's entity and term, so that their sum counts documents.
    """
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, "text"):
            texts = _texts(b)
            found = {i: s for i, s in enumerate(map(base_spans, texts)) if s}
            if not found:
                continue
            w = split_words(b.column("text").take(pa.array([*found])), ALNUM_WORDS, LOWER_CASE)
            rows: list[tuple] = []
            base = 0
            for d, (i, spans) in enumerate(found.items()):
                lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
                start, end, hashed = w.start[lo:hi] - base, w.end[lo:hi] - base, w.hash[lo:hi]
                free = np.ones(hi - lo, bool)  # words that no base span touches
                for _, x, y in spans:
                    free[np.searchsorted(end, x, "right"):np.searchsorted(start, y)] = False
                ring = np.concatenate([[0], hashed, [0]]).astype(np.uint64)
                between = mix(mix(ring[:-2]) ^ ring[2:]).view(np.int64)
                seen: set[tuple] = set()
                for kind, x, y in spans:
                    entity = _entity(kind, texts[i][x:y])
                    if (entity,) not in seen:
                        seen.add((entity,))
                        rows.append((entity, None, None, None, 1))
                    before, after = int(np.searchsorted(end, x, "right")), int(np.searchsorted(start, y))
                    for k in (*range(max(0, before - window), before), *range(after, min(hi - lo, after + window))):
                        if not free[k] or (entity, hashed[k], between[k]) in seen:
                            continue
                        seen.add((entity, hashed[k], between[k]))
                        first = (entity, hashed[k]) not in seen
                        seen.add((entity, hashed[k]))
                        term = w.data[w.start[lo + k]:w.end[lo + k]].tobytes()
                        rows.append((entity, int(hashed[k].view(np.int64)), _digest(term), int(between[k]), int(first)))
                base += len(texts[i])
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _BESIDE.types)], names=_BESIDE.names)
    return run


_BESIDE = pa.schema([("entity", pa.binary()), ("h", pa.int64()), ("term", pa.binary()), ("between", pa.int64()),
                     ("first", pa.int64())])


class _Terms:
    """A block of terms, found in batches of words: by hash, then by the digest of each distinct word."""

    def __init__(self, block: pa.Table):
        self._h = np.sort(block["h"].to_numpy().view(np.uint64))
        self._actions = dict(zip(block["term"].to_pylist(), block["action"].to_pylist()))

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Indices of the words that are terms, the number of each one's term, those terms and their actions."""
        none = np.zeros(0, np.int64)
        if not len(self._h) or not len(w.hash):
            return none, none, [], none
        at = np.minimum(np.searchsorted(self._h, w.hash), len(self._h) - 1)
        pick = np.flatnonzero(self._h[at] == w.hash)
        _, one, code = np.unique(w.hash[pick], return_index=True, return_inverse=True)
        terms = [_digest(w.data[w.start[k]:w.end[k]].tobytes()) for k in pick[one]]
        known = np.array([t in self._actions for t in terms], bool)
        return pick[known[code]] if len(pick) else none, code[known[code]] if len(pick) else none, terms, np.array(
            [self._actions.get(t, 0) for t in terms], np.int64)


def _term_counter(block):
    """Documents that hold each term."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(block.value)
        for b in batches(frames, "text"):
            w = split_words(b.column("text"), ALNUM_WORDS, LOWER_CASE)
            pick, code, found, _ = terms.find(w)
            if len(pick):
                once = np.unique(w.doc()[pick] * len(found) + code) % len(found)
                n = np.bincount(once, minlength=len(found))
                held = np.flatnonzero(n)
                yield pa.record_batch({"term": pa.array([found[k] for k in held], pa.binary()), "n_term": n[held]})
    return run


def _blocks(terms: DataFrame, block_terms: int) -> Iterator[tuple[object, bool]]:
    """The terms (h, term, action) as broadcasts of about ``block_terms`` each, one held at a time."""
    n = max(1, -(-terms.count() // block_terms))
    for i in range(n):
        own = terms.where(F.expr(f"pmod(xxhash64(term), {n})") == i).select("h", "term", "action").toArrow()
        sent = terms.sparkSession.sparkContext.broadcast(own)
        yield sent, i + 1 == n
        if i + 1 < n:
            sent.destroy()


def disclosing_terms(docs: DataFrame, window: int = WINDOW, min_neighbours: int = 3, generalise_at: float = 0.95,
                     remove_at: float = 0.99, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(h, term, disclosed, action) of every term that discloses some entity; term: its digest.

    disclosed: the highest share of an entity's information that the term gives away.  action: 1 to
    generalise, 2 to remove.  A term counts beside an entity if it is one of the ``window`` words on
    either side, and has stood there between ``min_neighbours`` different pairs of words.  An entity
    in every document has nothing to lose.
    """
    scratch = Scratch(docs.sparkSession, "disclosure")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    beside = texts.mapInArrow(_beside(window), "entity binary, h long, term binary, between long, first long")
    # one row for each place between two words, so copies are one row, then one for each entity and term
    counts = scratch.table(beside.groupBy("entity", "h", "term", "between").agg(F.sum("first").alias("n"))
                           .groupBy("entity", "h", "term").agg(F.sum("n").alias("n"), F.count("between").alias("places"))
                           .where(F.col("term").isNull() | (F.col("places") >= min_neighbours)), "beside")
    pairs = counts.where("term IS NOT NULL")
    entities = counts.where("term IS NULL").select("entity", F.col("n").alias("n_entity"))
    terms = scratch.table(pairs.groupBy("h", "term").agg(F.lit(0).alias("action")), "terms")
    held = [scratch.table(texts.mapInArrow(_term_counter(sent), "term binary, n_term long")
                          .groupBy("term").agg(F.sum("n_term").alias("n_term")), "counts")
            for sent, _ in _blocks(terms, block_terms)]
    n_terms = held[0]
    for more in held[1:]:
        n_terms = n_terms.unionByName(more)
    all_docs = F.lit(float(docs.count()))
    told = F.log2(all_docs * F.col("n") / (F.col("n_term") * F.col("n_entity")))
    share = told / F.log2(all_docs / F.col("n_entity"))  # null where there is nothing to lose
    return scratch.table(
        pairs.join(entities, "entity").where(F.col("n_entity") < all_docs).join(n_terms, "term")
        .groupBy("h", "term").agg(F.max(share).alias("disclosed")).where(F.col("disclosed") >= generalise_at)
        .withColumn("action", F.when(F.col("disclosed") >= remove_at, REMOVE).otherwise(GENERALISE)), "disclosing")


# ---- sanitising ------------------------------------------------------------------------------

def _hits(b: pa.RecordBatch, terms: _Terms) -> list[np.ndarray]:
    """Per text: (start, end, action) in bytes of its disclosing terms."""
    w = split_words(b.column("text"), ALNUM_WORDS, LOWER_CASE)
    pick, code, _, action = terms.find(w)
    _, off = text_bytes(b.column("text"))
    doc = np.searchsorted(w.bounds, pick, "right") - 1
    rows = np.stack([w.start[pick] - off[doc], w.end[pick] - off[doc], action[code]], axis=1) if len(pick) else np.zeros((0, 3), np.int64)
    return np.split(rows, np.searchsorted(doc, np.arange(1, b.num_rows)))


def _marker(block):
    """Adds the hits of one block of terms to the column ``hits``."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(block.value)
        for b in batches(frames, "text"):
            more = [x + np.asarray(y, "<i8").tobytes() for x, y in zip(b.column("hits").to_pylist(), _hits(b, terms))]
            yield b.set_column(b.schema.get_field_index("hits"), "hits", pa.array(more, b.schema.field("hits").type))
    return run


def _sanitised(text: bytes, spans: list[tuple[int, int, int, int]]) -> str:
    """Base spans by the name of their kind, generalised terms by their class, removed ones by nothing."""
    out, at = [], 0
    for start, end, kind, action in sorted((s, e, k, a) for k, s, e, a in spans):
        if start >= at:
            out.append(text[at:start])
            if kind < TERM:
                out.append(f"[{KINDS[kind].upper()}]".encode())
            elif action == GENERALISE:
                out.append(b"[NUMBER]" if _DIGIT.search(text[start:end]) else b"[WORD]")
        at = max(at, end)
    return b"".join([*out, text[at:]]).decode()


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("action", pa.string())])
_ACTIONS = {0: "mask", GENERALISE: "generalise", REMOVE: "remove"}


def _finisher(block):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(block.value)
        for b in batches(frames, "text"):
            hits, all_spans, cleaned = _hits(b, terms), [], []
            for text, own, before in zip(_texts(b), hits, b.column("hits").to_pylist()):
                base = base_spans(text)
                rows = np.concatenate([own, np.frombuffer(before, "<i8").reshape(-1, 3)]).tolist()
                rows = [r for r in sorted(rows) if not any(x < r[1] and r[0] < y for _, x, y in base)] if base else sorted(rows)
                spans = [(k, s, e, 0) for k, s, e in base] + [(TERM, *r) for r in rows]
                if not spans:
                    all_spans.append([])
                    cleaned.append(text.decode())
                    continue
                cleaned.append(_sanitised(text, spans))
                if not text.isascii():  # bytes that begin a code point
                    point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    spans = [(k, int(point[s]), int(point[e]), a) for k, s, e, a in spans]
                all_spans.append([{"kind": KINDS[k], "start": s, "end": e, "action": _ACTIONS[a]} for k, s, e, a in spans])
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array(cleaned, pa.large_string()),
                                   "spans": pa.array(all_spans, pa.list_(_SPAN))})
    return run


def sanitise(docs: DataFrame, window: int = WINDOW, min_neighbours: int = 3, generalise_at: float = 0.95,
             remove_at: float = 0.99, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(doc_id, text, spans) of every row of ``docs`` (doc_id, text; other columns are not read).

    spans: array of (kind, start, end, action) in code points, end exclusive, by kind as listed in
    ``KINDS``, then start; base spans are masked, terms generalised or removed; a term that a base span
    touches is part of that span.  text: what is left to publish.  Null texts are empty and have no
    spans; repeated rows count as documents of their own; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "disclosure")
    terms = disclosing_terms(docs, window, min_neighbours, generalise_at, remove_at, block_terms)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(b"").alias("hits"))
    for sent, last in _blocks(terms, block_terms):
        if last:
            return out.mapInArrow(_finisher(sent), "doc_id long, text string, "
                                  "spans array<struct<kind: string, start: long, end: long, action: string>>")
        out = scratch.table(out.mapInArrow(_marker(sent), out.schema), "marked")
