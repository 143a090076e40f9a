"""Recursive graph bisection: an order of documents in which those that share terms lie together.

Fitted on a bounded sample: every node of a binary tree halves its documents,
and pairs of documents change sides as long as that lowers the logarithmic gap
cost of the terms' posting lists (after Dhulipala et al., 2016).  Each node
keeps what one more document with a term would cost on either side, so any
document is routed to a leaf without the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Terms are folded to so many slots; documents of a sample, and of a leaf of the sample at least.
SLOTS, SAMPLE, LEAF = 4096, 8192, 32
ROUNDS = 12


def _cost(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    return degree * np.log2(np.maximum(size, 1) / (degree + 1))


@dataclass
class Bisection:
    """``delta[node, slot]``: how much dearer a slot is on side 1 than on side 0; nodes of level l begin at 2^l - 1."""

    depth: int
    delta: np.ndarray

    def leaves(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each of ``n`` documents, from its (document, slot) edges; ties go by turns."""
        node = np.zeros(n, np.int64)
        for level in range(self.depth):
            dearer = np.bincount(doc, self.delta[(1 << level) - 1 + node[doc], slot], n)
            node = node * 2 + np.where(dearer == 0, (np.arange(n) >> level) & 1, dearer < 0)
        return node


def fit_bisection(doc: np.ndarray, slot: np.ndarray, n: int) -> Bisection:
    """``doc`` and ``slot`` are the edges of ``n`` sampled documents, each once."""
    depth = max(0, int(np.log2(max(1, n // LEAF))))
    delta = np.zeros(((1 << depth) - 1, SLOTS), np.float32)
    node = np.zeros(n, np.int64)
    for level in range(depth):
        nodes = 1 << level
        order = np.argsort(node, kind="stable")
        first = np.searchsorted(node[order], np.arange(nodes))
        turn = np.empty(n, np.int64)
        turn[order] = np.arange(n) - first[node[order]]
        size = np.bincount(node, minlength=nodes)
        side = (turn >= size[node] // 2).astype(np.int64)
        key = node[doc] * SLOTS + slot
        for _ in range(ROUNDS):
            d1 = np.bincount(key, side[doc], nodes * SLOTS)
            d0 = np.bincount(key, minlength=nodes * SLOTS) - d1
            n1 = np.repeat(np.bincount(node, side, nodes), SLOTS)
            n0 = np.repeat(size, SLOTS) - n1
            now = _cost(d0, n0) + _cost(d1, n1)
            to1 = now - _cost(np.maximum(d0 - 1, 0), n0) - _cost(d1 + 1, n1)
            to0 = now - _cost(d0 + 1, n0) - _cost(np.maximum(d1 - 1, 0), n1)
            gain = np.bincount(doc, np.where(side[doc] == 0, to1[key], to0[key]), n)
            swapped = False
            ranked = np.lexsort((-gain, side, node))
            at = np.searchsorted(node[ranked], np.arange(nodes + 1))
            for k in range(nodes):
                own = ranked[at[k] : at[k + 1]]
                left, right = own[side[own] == 0], own[side[own] == 1]
                m = min(len(left), len(right))
                better = int(np.count_nonzero(np.minimum.accumulate(gain[left[:m]] + gain[right[:m]] > 1e-9)))
                if better:
                    side[left[:better]], side[right[:better]], swapped = 1, 0, True
            if not swapped:
                break
        d1 = np.bincount(key, side[doc], nodes * SLOTS)
        d0 = np.bincount(key, minlength=nodes * SLOTS) - d1
        n1 = np.repeat(np.bincount(node, side, nodes), SLOTS)
        n0 = np.repeat(size, SLOTS) - n1
        dearer = (_cost(d1 + 1, n1 + 1) - _cost(d1, n1)) - (_cost(d0 + 1, n0 + 1) - _cost(d0, n0))
        delta[nodes - 1 : 2 * nodes - 1] = dearer.reshape(nodes, SLOTS)
        node = node * 2 + side
    return Bisection(depth, delta)
