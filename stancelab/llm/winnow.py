"""Winnowed anchors: the least hashed k-gram of every window, so equal windows pick equal anchors."""

from __future__ import annotations

import numpy as np

from .words import grams


def least_in_window(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value among ``width`` consecutive ones, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(h))
    span = 1
    while span * 2 <= width:
        a, b = at[:len(at) - span], at[span:]
        at = np.where(h[b] < h[a], b, a)
        span *= 2
    a, b = at[:n], at[width - span:][:n]
    return np.where(h[b] < h[a], b, a)


def anchored_runs(word_hash: np.ndarray, bounds: np.ndarray, window: int, seed_words: int):
    """Runs of windows that share an anchor: (text, first window, windows, anchor place, gram hashes).

    A window is ``window`` consecutive words of one text; its anchor is the leftmost least
    ``seed_words``-gram inside it, which depends on the window's words alone.
    """
    g = grams(word_hash, seed_words)
    places = least_in_window(g, window - seed_words + 1)  # anchor of the window that starts here
    n = np.diff(bounds)
    has = np.flatnonzero(n >= window)
    if not len(has) or not len(places):
        e = np.zeros(0, np.int64)
        return e, e, e, e, g
    windows = n[has] - window + 1
    starts = np.repeat(bounds[has] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    text = np.repeat(has, windows)
    anchor = places[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    return text[first], starts[first], count, anchor[first], g
