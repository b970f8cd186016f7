"""The best rows of each query, kept by a task as it reads blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Best:
    """At most k entries a query, by score from above, then by a tie key. Scores come in blocks whose rows are in tie order."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)
        self.changed: set[int] = set()

    def offered(self, scores: np.ndarray, positive: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(query, columns): of a table of scores (query, row), the columns that may be among a query's best."""
        floor = np.maximum(self.least, np.nextafter(0.0, 1.0)) if positive else self.least
        for q in np.flatnonzero(scores.max(axis=1) >= floor).tolist() if scores.shape[1] else ():
            some = np.flatnonzero(scores[q] >= floor[q])
            if len(some) > self.k:
                some = some[np.argsort(-scores[q][some], kind="stable")[: self.k]]
            yield q, some

    def take(self, query: int, score: float, tie: tuple, entry: object) -> None:
        self.rows[query].append((-score, tie, len(self.rows[query]), entry))
        self.changed.add(query)

    def cut(self) -> None:
        """Drop what is no longer among the best."""
        for q in self.changed:
            rows = self.rows[q]
            if len(rows) > self.k:
                rows.sort(key=lambda r: r[:2])
                del rows[self.k :]
            if len(rows) == self.k:
                self.least[q] = -max(r[0] for r in rows)
        self.changed.clear()

    def entries(self) -> Iterator[tuple[int, float, object]]:
        for q, rows in enumerate(self.rows):
            for r in rows:
                yield q, -r[0], r[3]
