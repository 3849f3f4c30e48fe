"""Fast similarity sketches: rounds of hashed bin placement, and band keys over them.

Round i < t places every element into bin ``hash mod t`` with the value (i, fraction); round
i = t + b offers every element to bin b alone.  A bin keeps its least value, so a bin filled in
round i is never changed by a later one, and after 2 t rounds every bin of a non-empty set is
filled.  A set stops as soon as its bins are full: about |A| + t log t steps altogether.
Two sets agree in a coordinate with probability equal to their Jaccard similarity, with
Chernoff-type concentration (Dahlgaard, Knudsen, Thorup, FOCS 2017).
"""

from __future__ import annotations

import numpy as np

from .words import mix

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def sketches(elements: np.ndarray, bounds: np.ndarray, t: int, seed: int = 11) -> np.ndarray:
    """Sketch of each set; set i holds ``elements[bounds[i]:bounds[i + 1]]`` (64-bit hashes).

    Returns len(bounds) - 1 rows of ``t`` values; the row of an empty set is all ones.
    """
    sets = len(bounds) - 1
    free = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(sets * t, free)
    shift = _U(64 - int(2 * t - 1).bit_length())
    sizes = np.diff(bounds)
    live = np.flatnonzero(sizes)
    owner = np.repeat(np.arange(sets), sizes)
    values = elements
    for i in range(2 * t):
        if not len(live):
            break
        h = mix(values + _U((seed * 2 * t + i + 1) * _ODD % (1 << 64)))
        if i < t:
            place = owner * t + (h % _U(t)).astype(np.int64)
            value = (mix(h) >> (_U(64) - shift)) | (_U(i) << shift)
        else:
            place = owner * t + (i - t)
            value = (h >> (_U(64) - shift)) | (_U(i) << shift)
        np.minimum.at(out, place, value)
        full = (out.reshape(sets, t)[live] != free).all(axis=1)
        if full.any():
            left = np.zeros(sets, bool)
            left[live[~full]] = True
            stay = left[owner]
            values, owner, live = values[stay], owner[stay], live[~full]
    return out.reshape(sets, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; equal bands of different numbers differ."""
    bands = sketch.shape[1] // rows
    key = np.tile((np.arange(bands, dtype=np.uint64) + _U(1)) * _U(_ODD), (len(sketch), 1))
    for j in range(rows):
        key = mix(key * _U(0xD1342543DE82EF95) + sketch[:, j:bands * rows:rows])
    return key
