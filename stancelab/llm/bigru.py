"""A small bidirectional GRU with attention pooling, in numpy: forward, backward, Adam.

Input per word: a row of a word table (row 0: any other word) plus its hashed character
four-grams' rows, summed and divided by the root of its length.  Each direction runs a GRU over a window; a softmax over the window's words pools
the states of both directions; a logistic unit over them and over the words' summed first input,
past the recurrence, gives the window's score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import LOWER_CASE, mix, split_words

_U = np.uint64
GRAMS = 1 << 15
EMBED = 8
HIDDEN = 8
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 24, 8
#: Score of a text without words: there is nothing toxic in it.
NO_WORDS = 0.01
#: Bytes that take no part in the form of a word, so "Word," and "word" are one.
_INSIDE = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b == 0x27
                    for b in range(256)])


@dataclass
class TextWords:
    """Words of a batch of texts: hashes, four-gram rows per byte and the texts' bounds."""

    hash: np.ndarray
    bounds: np.ndarray
    gram: np.ndarray  # four-gram bucket of every byte that belongs to a word, word after word
    heads: np.ndarray  # first entry of each word in ``gram``
    lengths: np.ndarray


def read_words(col: pa.Array) -> TextWords:
    """Words are runs of letters, digits, apostrophes and non-ASCII bytes, lower-cased (A-Z)."""
    w = split_words(col, _INSIDE, LOWER_CASE, seed=5)
    n = len(w.data)
    if not len(w.start):
        e = np.zeros(0, np.int64)
        return TextWords(w.hash, w.bounds, e.astype(np.uint16), e, e)
    lengths = w.end - w.start
    heads = np.cumsum(lengths) - lengths
    chars = w.data[_INSIDE[w.data]].astype(np.uint32)
    # the byte before, the byte itself and two after; beyond a word's ends they count as 0
    gram = chars << np.uint32(16)
    before = np.concatenate([[np.uint32(0)], chars[:-1]])
    before[heads] = 0
    gram |= before << np.uint32(24)
    after = np.append(chars[1:], np.uint32(0))
    last = heads + lengths - 1
    after[last] = 0
    gram |= after << np.uint32(8)
    gram[:-1] |= after[1:] * (after[:-1] > 0)
    gram *= np.uint32(0x9E3779B1)
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(0x85EBCA77)
    return TextWords(w.hash, w.bounds, (gram >> np.uint32(17)).astype(np.uint16), heads, lengths)


def joined(parts: list[TextWords]) -> TextWords:
    """Batches of texts as one."""
    if not parts:
        return read_words(pa.array([], pa.string()))
    words = np.cumsum([0, *(len(p.hash) for p in parts)])
    chars = np.cumsum([0, *(len(p.gram) for p in parts)])
    return TextWords(
        np.concatenate([p.hash for p in parts]),
        np.concatenate([[0], *(p.bounds[1:] + n for p, n in zip(parts, words))]),
        np.concatenate([p.gram for p in parts]), np.concatenate([p.heads + n for p, n in zip(parts, chars)]),
        np.concatenate([p.lengths for p in parts]))


def part(t: TextWords, lo: int, hi: int) -> TextWords:
    """The words from lo to hi, without the texts' bounds."""
    first = int(t.heads[lo]) if lo < len(t.heads) else len(t.gram)
    last = int(t.heads[hi]) if hi < len(t.heads) else len(t.gram)
    return TextWords(t.hash[lo:hi], t.bounds, t.gram[first:last], t.heads[lo:hi] - first, t.lengths[lo:hi])


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all overlapping windows of all texts."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[text] + step * STRIDE
    return text, first, np.minimum(WINDOW, bounds[text + 1] - first)


def _root(lengths: np.ndarray) -> np.ndarray:
    return np.sqrt(lengths.astype(np.float32))[:, None]


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows that go to each of n places."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    heads = np.flatnonzero(np.diff(at[order], prepend=-1))
    out[at[order][heads]] = np.add.reduceat(rows[order], heads, axis=0)
    return out


class BiGru:
    """Parameters as float32 arrays in ``p``; ``vocabulary``: sorted hashes of the table's words."""

    def __init__(self, vocabulary: np.ndarray, first: np.ndarray, grams: np.ndarray | None = None, seed: int = 3):
        """first, grams: what the first value of the words' and four-grams' rows starts from."""
        r = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        words = (r.standard_normal((len(vocabulary) + 1, EMBED)) * 0.05)
        words[0] = 0
        words[1:, 0] = first
        rows = r.standard_normal((GRAMS, EMBED)) * 0.05
        rows[:, 0], rows[:, 1] = 0, 0 if grams is None else grams
        # before training the logit is the window's sum of word evidence: the network adds to it
        p = {"words": words, "grams": rows, "attend": r.standard_normal(2 * HIDDEN) * 0.3, "out": np.zeros(2 * HIDDEN),
             "past": np.ones(1), "bias": np.array([-1.0])}
        for d in "fb":
            p["w" + d] = r.standard_normal((EMBED, 3 * HIDDEN)) * (1 / EMBED) ** 0.5
            p["u" + d] = r.standard_normal((HIDDEN, 3 * HIDDEN)) * (1 / HIDDEN) ** 0.5
            p["c" + d] = np.zeros(3 * HIDDEN)
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def rows(self, t: TextWords) -> np.ndarray:
        """Row of the word table for each word."""
        at = np.searchsorted(self.vocabulary, t.hash)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] == t.hash[known]
        return np.where(known, at + 1, 0)

    def inputs(self, t: TextWords) -> np.ndarray:
        if not len(t.hash):
            return np.zeros((0, EMBED), np.float32)
        chars = np.add.reduceat(self.p["grams"][t.gram], t.heads, axis=0) / _root(t.lengths)
        return self.p["words"][self.rows(t)] + chars

    def forward(self, x: np.ndarray, first: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; x: one input row per word of the batch.

        Both directions run side by side, the backward one from a window's last place to its first;
        states at places beyond a window's words are 0.  The factors of
        sigmoid(v) = 1 / (1 + exp(-v)) and tanh(v) = 2 sigmoid(2 v) - 1 are put into the weights.
        """
        p, steps, n = self.p, int(length.max()), len(first)
        fold = np.repeat(np.array([-1, -1, -2], np.float32), HIDDEN)
        u = np.stack([p["uf"] * fold, p["ub"] * fold])
        s = np.arange(steps)[:, None]
        place = first + np.minimum(s, length - 1)
        live = (s < length).astype(np.float32)
        fed = np.empty((steps, 2, n, 3 * HIDDEN), np.float32)
        fed[:, 0] = ((x @ p["wf"] + p["cf"]) * fold)[place]
        fed[:, 1] = ((x @ p["wb"] + p["cb"]) * fold)[place[::-1]]
        on = np.stack([live, live[::-1]], axis=1)[..., None]
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        h = np.zeros((2, n, HIDDEN), np.float32)
        with np.errstate(over="ignore"):  # exp may run to infinity, which gives the limit 0
            for t in range(steps):
                a, g = fed[t], np.matmul(h, u)
                zr = a[:, :, :2 * HIDDEN] + g[:, :, :2 * HIDDEN]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
                m = r * g[:, :, 2 * HIDDEN:]
                m += a[:, :, 2 * HIDDEN:]
                np.exp(m, out=m)
                m += 1
                np.divide(2, m, out=m)
                m -= 1
                new = h - m
                new *= z
                new += m
                new *= on[t]
                if keep is not None:
                    keep.setdefault("steps", []).append((h, z, r, m, g[:, :, 2 * HIDDEN:] * np.float32(-0.5)))
                h = new
                states[t, :, :HIDDEN] = h[0]
                states[steps - 1 - t, :, HIDDEN:] = h[1]
        e = states @ p["attend"]
        e += (live - 1) * np.float32(1e9)
        e -= e.max(axis=0)
        w = np.exp(e)
        w /= w.sum(axis=0)
        pooled = np.einsum("sb,sbh->bh", w, states)
        told = (x[:, 0][place] * live).sum(axis=0)
        if keep is not None:
            keep.update(live=live, on=on, place=place, states=states, w=w, pooled=pooled, told=told)
        return pooled @ p["out"] + told * p["past"][0] + p["bias"][0]

    def logits(self, t: TextWords, first: np.ndarray, length: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.empty(len(first), np.float32)
        for i in range(0, len(first), block):
            # the words of consecutive windows lie side by side
            lo, hi = int(first[i]), int((first[i:i + block] + length[i:i + block]).max())
            out[i:i + block] = self.forward(self.inputs(part(t, lo, hi)), first[i:i + block] - lo, length[i:i + block])
        return out

    def gradients(self, t: TextWords, first: np.ndarray, length: np.ndarray, target: np.ndarray,
                  weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean logistic loss and its gradients; no word may be in two of the windows."""
        p, k = self.p, {}
        x = self.inputs(t)
        logit = self.forward(x, first, length, k)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        total = weight.sum()
        loss = float(-(weight * (target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))).sum() / total)
        d = ((prob - target) * weight / total).astype(np.float32)
        grad = {"out": k["pooled"].T @ d, "past": (k["told"] * d).sum(keepdims=True), "bias": d.sum(keepdims=True)}
        d_pool = d[:, None] * p["out"]
        w, states = k["w"], k["states"]
        d_w = np.einsum("bh,sbh->sb", d_pool, states)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        d_states = w[:, :, None] * d_pool + d_e[:, :, None] * p["attend"]
        grad["attend"] = np.einsum("sb,sbh->h", d_e, states)
        fed = np.zeros((2, len(x), 3 * HIDDEN), np.float32)
        du = np.zeros((2, HIDDEN, 3 * HIDDEN), np.float32)
        u = np.stack([p["uf"], p["ub"]])
        carry = np.zeros((2, len(first), HIDDEN), np.float32)
        last = len(k["steps"]) - 1
        for s in range(last, -1, -1):
            h, z, r, m, gn = k["steps"][s]
            g = np.stack([d_states[s, :, :HIDDEN], d_states[last - s, :, HIDDEN:]]) + carry
            g *= k["on"][s]
            dz = g * (h - m) * z * (1 - z)
            dm = g * (1 - z) * (1 - m * m)
            dr = dm * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dm * r], axis=2)
            du += np.matmul(h.transpose(0, 2, 1), dg)
            carry = g * z + np.matmul(dg, u.transpose(0, 2, 1))
            da = np.concatenate([dz, dr, dm], axis=2)
            fed[0][k["place"][s]] += da[0]
            fed[1][k["place"][last - s]] += da[1]
        for i, name in enumerate("fb"):
            grad["u" + name], grad["w" + name] = du[i], x.T @ fed[i]
            grad["c" + name] = fed[i].sum(axis=0)
        dx = fed[0] @ p["wf"].T + fed[1] @ p["wb"].T
        for place, live in zip(k["place"], k["live"]):
            dx[place, 0] += d * p["past"][0] * live
        rows = self.rows(t)
        grad["words"] = _summed(dx, rows, len(p["words"]))
        grad["grams"] = _summed(np.repeat(dx / _root(t.lengths), t.lengths, axis=0), t.gram, len(p["grams"]))
        return loss, grad

    def scores(self, col: pa.Array) -> np.ndarray:
        """Largest window probability of each text; NO_WORDS for a text without words."""
        t = read_words(col)
        text, first, length = windows(t.bounds)
        out = np.full(len(t.bounds) - 1, NO_WORDS)
        if len(text):
            logit = self.logits(t, first, length)
            heads = np.flatnonzero(np.diff(text, prepend=-1))
            best = np.maximum.reduceat(logit, heads)
            out[text[heads]] = 1 / (1 + np.exp(-np.clip(best.astype(np.float64), -30, 30)))
        return out


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float, rates: dict[str, float]):
        self.p, self.t = p, 0
        self.rate = {k: rates.get(k, rate) for k in p}
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= (self.rate[k] * (self.m[k] / (1 - 0.9 ** self.t))
                          / (np.sqrt(self.v[k] / (1 - 0.999 ** self.t)) + 1e-8)).astype(np.float32)
