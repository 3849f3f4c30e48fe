"""Plain single-process versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[bytes]:
    return SPACED.findall((text or "").encode())


def chat(rows):
    """rows: (conv_id, turn, role, text) -> conv_id -> (n_turns, turns sha, loss chars, loss sha)."""
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t, r, x))
    out = {}
    for c, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        loss = "".join(x or "" for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def near(rows, k, percent):
    """rows: (doc_id, text) -> list of (doc_id, n_shingles, component_id)."""
    sets = []
    for _, t in rows:
        w = words(lower(t or ""))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def repeats(rows, window):
    """rows: (doc_id, text) -> list of (doc_id, n_words, n_removed, kept sha)."""
    split = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def leaks(rows, items, window):
    """rows: (doc_id, text), items: (item_id, text) -> list of (doc_id, n_words, n_hit, sorted item ids)."""
    grams = defaultdict(set)
    for i, t in items:
        w = PLAIN.findall(lower(t or ""))
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[j:j + n])].add(str(i))
    sizes = sorted({len(g) for g in grams})
    out = []
    for d, t in rows:
        w = PLAIN.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                g = grams.get(tuple(w[j:j + n]))
                if g:
                    found |= g
                    hit[j:j + n] = [True] * n
        out.append((d, len(w), sum(hit), sorted(found)))
    return out


def fill(sizes: dict, share=1.5, epochs=2.0, cycle=(3, 1, 2)) -> dict:
    """source -> target by clamping one round at a time."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: cycle[i % 3] for i, s in enumerate(order)}
    left, open_ = share * sum(sizes.values()), set(sizes)
    target = {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > epochs * sizes[s]}
        if not above:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: epochs * sizes[s] for s in above}
        left -= sum(epochs * sizes[s] for s in above)
        open_ -= above
    return target


def neighbours(rows, queries, k):
    """rows: (vec_id, vector) -> query id -> [(score, vec_id)] of the k nearest."""
    ok = [(i, np.asarray(v, float)) for i, v in rows if v is not None and None not in list(v)
          and np.isfinite(np.asarray(v, float)).all() and np.asarray(v, float).any()]
    out = {}
    for q, v in ok:
        if q in queries:
            s = [(-(u @ v) / (np.linalg.norm(u) * np.linalg.norm(v)), i) for i, u in ok if i != q and len(u) == len(v)]
            out[q] = [(-x, i) for x, i in sorted(s)[:k]]
    return out


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def aligned(rows, a_path, b_path):
    """(doc_id, text) rows -> op12's columns per row, by whole texts and sets of byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    done = []
    for doc_id, text in rows:
        made = None
        if text:
            x = [(i, bytes(to_byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, b_bytes(i)) for i in b.encode(text)]
            raw = (" " + text).encode()
            if b"".join(t for _, t in x) == raw == b"".join(t for _, t in y):
                made = []
                for side in (x, y):
                    ends, at = [], 0
                    for i, t in side:
                        at += len(t)
                        ends.append((at, i))
                    made.append(ends)
        done.append((doc_id, made))
    pairs = Counter()
    for _, made in done:
        if made:
            last = dict(made[1])
            pairs.update((i, last[e]) for e, i in made[0] if e in last)
    most = {}
    for (_, j), n in pairs.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for doc_id, made in done:
        if not made:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        last = dict(made[1])
        cuts = [e for e, _ in made[0] if e in last]
        sides = []
        for side in made:  # the group of each token, by the cuts before its end
            lists = [[] for _ in cuts]
            for e, i in side:
                lists[bisect_left(cuts, e)].append(str(i))
            sides.append([",".join(x) for x in lists])
        groups = ["|".join(x) for x in zip(*sides)]
        links = [(i, last[e]) for e, i in made[0] if e in last]
        out.append((doc_id, len(made[0]), len(made[1]), len(cuts), len(links), sum(pairs[x] == most[x[1]] for x in links),
                    sum(pairs[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def divergence(rows, min_docs, top):
    """(lang, source, text) rows -> op11's rows."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or "")))
            for lang, source, text in rows]
    out = []
    for lang in {x for x, *_ in docs}:
        own = [(s, ts) for x, s, ts in docs if x == lang]
        held, whole, by = Counter(), Counter(), defaultdict(Counter)
        for s, ts in own:
            held.update(set(ts))
            by[s].update(ts)
        kept = sorted((t for t, n in held.items() if n >= min_docs), key=str.encode)
        for s, c in by.items():
            whole.update({t: c[t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (c[t] + 2) // total for t in kept]

        def gain(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: shares(c) for s, c in by.items()}, shares(whole)
        for s in by:
            found = [("pair", o, sum(map(gain, p[s], p[o]))) for o in by if o != s]
            against = [("term", t, gain(x, y)) for t, x, y in zip(kept, p[s], q) if by[s][t] and x > y]
            for part, limit in ((found, None), (against, top)):
                part.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, i) for i, r in enumerate(part[:limit], 1)]
    return sorted(out)


KIND_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                 "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                 "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    """[(kind, start, end)] of the base patterns in code points."""
    out = []
    for kind, pattern in KIND_PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def disclosed(texts, window, neighbours, at, remove_at):
    """{term: action} by the contract's definition, and the spans of each text."""
    read = []
    for text in texts:
        base = personal(text)
        spans = [m.span() for m in PLAIN.finditer(lower(text))]
        words = [lower(text)[x:y] for x, y in spans]
        free = [not any(s < y and x < e for _, s, e in base) for x, y in spans]
        read.append((base, spans, words, free))
    n, n_entity, n_term, places = Counter(), Counter(), Counter(), defaultdict(set)
    for text, (base, spans, words, free) in zip(texts, read):
        n_term.update(set(words))
        pairs, entities = set(), set()
        for kind, s, e in base:
            value = re.sub("[^0-9]", "", text[s:e]) if kind in ("card", "phone") else lower(text[s:e])
            entities.add((kind, value))
            left = [k for k, (x, y) in enumerate(spans) if y <= s][-window:]
            right = [k for k, (x, y) in enumerate(spans) if x >= e][:window]
            for k in left + right:
                if free[k]:
                    pairs.add(((kind, value), words[k]))
                    places[(kind, value), words[k]].add((words[k - 1] if k else None, words[k + 1] if k + 1 < len(words) else None))
        n.update(pairs)
        n_entity.update(entities)
    actions = {}
    for (c, t), both in n.items():
        if len(places[c, t]) >= neighbours and n_entity[c] < len(texts):
            share = np.log2(len(texts) * both / (n_term[t] * n_entity[c])) / np.log2(len(texts) / n_entity[c])
            if share >= at:
                actions[t] = max(actions.get(t, ""), "remove" if share >= remove_at else "generalise")
    found = [[(k, s, e, "mask") for k, s, e in base] + [("term", *x, actions[w]) for x, w, f in zip(spans, words, free)
                                                       if f and w in actions] for base, spans, words, free in read]
    return actions, found
