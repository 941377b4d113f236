"""Recursive graph bisection: an order of documents in which documents with shared terms stand together.

Dhulipala et al. (2016): the documents are halved; a document's gain from
changing sides is what that saves in the logarithms of the gaps between the
documents of each of its terms; as long as it pays, the documents with the
largest gains of either side change places; then each half is halved in turn.

Documents come as one array of term numbers and where each document starts in
it; a document has every term once, and at least one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS = 8
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def spans(starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the terms of ``docs``, one document after another, and how many each has."""
    n = starts[docs + 1] - starts[docs]
    ends = np.cumsum(n)
    return np.repeat(starts[docs] - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0), n


def _cost(degree: np.ndarray, docs: int) -> np.ndarray:
    return degree * np.log2(max(1, docs) / (degree + 1.0))


def halves(docs: np.ndarray, starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, own terms, for each of these how much it speaks for the left side) of ``docs``."""
    at, n = spans(starts, docs)
    own, local = np.unique(terms[at], return_inverse=True)
    first = np.cumsum(n) - n
    left = np.zeros(len(docs), bool)
    left[: len(docs) // 2] = True
    sizes = (int(left.sum()), int((~left).sum()))
    for _ in range(ROUNDS):
        a = np.bincount(local[np.repeat(left, n)], minlength=len(own)).astype(float)
        b = np.bincount(local[~np.repeat(left, n)], minlength=len(own)).astype(float)
        now = _cost(a, sizes[0]) + _cost(b, sizes[1])
        to_right = now - _cost(np.maximum(a - 1, 0), sizes[0]) - _cost(b + 1, sizes[1])
        to_left = now - _cost(a + 1, sizes[0]) - _cost(np.maximum(b - 1, 0), sizes[1])
        gain = np.where(left, np.add.reduceat(to_right[local], first), np.add.reduceat(to_left[local], first))
        out, into = np.flatnonzero(left), np.flatnonzero(~left)
        out, into = out[np.argsort(-gain[out], kind="stable")], into[np.argsort(-gain[into], kind="stable")]
        pairs = min(len(out), len(into))
        swaps = int((gain[out[:pairs]] + gain[into[:pairs]] > 1e-9).sum())  # the sums fall
        if not swaps:
            break
        left[out[:swaps]], left[into[:swaps]] = False, True
    a = np.bincount(local[np.repeat(left, n)], minlength=len(own)).astype(float)
    b = np.bincount(local[~np.repeat(left, n)], minlength=len(own)).astype(float)
    leans = (_cost(b + 1, sizes[1]) - _cost(b, sizes[1])) - (_cost(a + 1, sizes[0]) - _cost(a, sizes[0]))
    return docs[left], docs[~left], own, leans


def by_least_term(starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The documents by the smallest hash of their terms: a start for bisection that has like documents near each other."""
    hashed = (terms.astype(np.uint64) + np.uint64(1)) * _GOLDEN
    return np.argsort(np.minimum.reduceat(hashed, starts[:-1]), kind="stable") if len(starts) > 1 else np.zeros(0, np.int64)


def ordered(starts: np.ndarray, terms: np.ndarray, leaf: int) -> list[np.ndarray]:
    """All documents, in the order of bisection, in leaves of at most ``leaf``."""
    todo, out = [by_least_term(starts, terms)], []
    while todo:
        docs = todo.pop()
        if len(docs) <= leaf:
            if len(docs):
                out.append(docs)
        else:
            left, right, _, _ = halves(docs, starts, terms)
            todo += [right, left]
    return out


@dataclass
class Tree:
    """The first halvings, learned from a sample; other documents go down it by what their terms speak for."""

    leans: list[np.ndarray]  # by level, node x term
    depth: int

    @staticmethod
    def fit(starts: np.ndarray, terms: np.ndarray, n_terms: int, depth: int) -> Tree:
        levels, nodes = [], [by_least_term(starts, terms)]
        for _ in range(depth):
            leans, below = np.zeros((len(nodes), n_terms), np.float32), []
            for k, docs in enumerate(nodes):
                if len(docs) < 2:
                    below += [docs, docs[:0]]
                    continue
                left, right, own, lean = halves(docs, starts, terms)
                leans[k, own] = lean
                below += [left, right]
            levels.append(leans)
            nodes = below
        return Tree(levels, depth)

    def leaf_of(self, starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Each document's leaf: a number below 2 ** depth, in the tree's order."""
        n = np.diff(starts)
        node = np.zeros(len(n), np.int64)
        for leans in self.leans:
            if len(n):
                node = 2 * node + (np.add.reduceat(leans[np.repeat(node, n), terms], starts[:-1]) < 0)
        return node
