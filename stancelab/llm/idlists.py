"""Lists of token ids end to end, for encoders that keep each word's ids."""

from __future__ import annotations

import numpy as np


class IdLists:
    """Lists of ids end to end in one array that grows by doubling."""

    def __init__(self):
        self.count, self.used = 0, 0
        self._ids, self._ends = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64)

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Further lists: all their ids, and where each ends among them."""
        while self.used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while self.count + len(ends) > len(self._ends):
            self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
        self._ids[self.used:self.used + len(ids)] = ids
        self._ends[self.count:self.count + len(ends)] = self.used + ends
        self.used += len(ids)
        self.count += len(ends)

    def __getitem__(self, i: int) -> np.ndarray:
        return self._ids[self._ends[i - 1] if i else 0:self._ends[i]]

    def take(self, at: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
        """The lists ``at`` end to end, cut before the lists with the numbers ``cuts``; -1 counts as empty."""
        to = self._ends[at]
        size = np.where(at < 0, 0, to - np.where(at > 0, self._ends[at - 1], 0))
        ends = np.cumsum(size)
        ids = self._ids[np.repeat(to - ends, size) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int64)
        edges = np.concatenate([[0], ends])[cuts]
        return [ids[x:y] for x, y in zip(edges, edges[1:])]
