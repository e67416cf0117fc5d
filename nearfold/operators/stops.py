"""Stop conditions of a graph search: what may enter a result, when it is too full, and when the walk ends.

A condition is told of every node that enters or leaves the result. ``fresh`` makes one for a query, given
each node's payload (a document number, say; None where the search has none).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from typing import Protocol, Self

import numpy as np


class StopCondition(Protocol):
    """``worst`` is the largest distance in the result, infinite while that is empty."""

    def fresh(self, payload: np.ndarray | None) -> Self: ...

    def entered(self, node: int, dist: float) -> None: ...

    def left(self, node: int, dist: float) -> None: ...

    def ends(self, dist: float, worst: float) -> bool:
        """Whether the walk ends before a node at this distance is expanded."""

    def takes(self, dist: float, worst: float) -> bool:
        """Whether a node at this distance may be walked to and enter the result."""

    def overfull(self) -> bool:
        """Whether the worst node has to leave the result."""

    def result(self, found: list[tuple[float, int]]) -> list[tuple[float, int]]:
        """What of the sorted result is returned."""


@dataclass
class WithinDistance:
    """Nodes at distance ``eps`` or less, at most ``most``. The walk goes on until ``least`` nodes were found, however far."""

    eps: float
    least: int
    most: int
    size: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.most:
            raise ValueError("least must be positive and at most most")

    def fresh(self, payload: np.ndarray | None) -> WithinDistance:
        return WithinDistance(self.eps, self.least, self.most)

    def entered(self, node: int, dist: float) -> None:
        self.size += 1

    def left(self, node: int, dist: float) -> None:
        self.size -= 1

    def ends(self, dist: float, worst: float) -> bool:
        return (self.size >= self.most and dist > worst) or (self.size >= self.least and dist > self.eps)

    def takes(self, dist: float, worst: float) -> bool:
        return self.size < self.most or dist < worst

    def overfull(self) -> bool:
        return self.size > self.most

    def result(self, found: list[tuple[float, int]]) -> list[tuple[float, int]]:
        return [x for x in found if x[0] <= self.eps][: self.most]


@dataclass
class Documents:
    """The nearest nodes that touch at most ``documents`` documents; the walk holds those of ``collect`` documents."""

    documents: int
    collect: int = 10
    payload: np.ndarray | None = None
    seen: Counter = field(default_factory=Counter)

    def __post_init__(self) -> None:
        if self.documents < 1:
            raise ValueError("documents must be at least 1")
        self.collect = max(self.collect, self.documents)

    def fresh(self, payload: np.ndarray | None) -> Documents:
        if payload is None:
            raise ValueError("a search by documents needs each node's document")
        return Documents(self.documents, self.collect, payload)

    def entered(self, node: int, dist: float) -> None:
        self.seen[self.payload[node]] += 1

    def left(self, node: int, dist: float) -> None:
        doc = self.payload[node]
        self.seen[doc] -= 1
        if not self.seen[doc]:
            del self.seen[doc]

    def ends(self, dist: float, worst: float) -> bool:
        return len(self.seen) >= self.collect and dist > worst

    def takes(self, dist: float, worst: float) -> bool:
        return len(self.seen) < self.collect or dist < worst

    def overfull(self) -> bool:
        return len(self.seen) > self.collect

    def result(self, found: list[tuple[float, int]]) -> list[tuple[float, int]]:
        out, docs = [], set()
        for dist, node in found:
            docs.add(self.payload[node])
            if len(docs) > self.documents:
                break
            out.append((dist, node))
        return out
