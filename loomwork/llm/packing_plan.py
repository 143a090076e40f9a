"""The packing plan of a length histogram: linear grouping, configurations, substitution, best fit.

Only counts per length enter (at most ``capacity`` numbers, however many
documents there are) and only runs leave: "documents of length l with ranks
s..s+n go to sequences q, q+1, ... at this offset".  The work of the driver
therefore depends on the capacity and not on the corpus.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from dataclasses import dataclass

import numpy as np


@dataclass
class Plan:
    """Runs, ascending by (length, start): rank r of a length lies in the last run that starts at or before r."""

    length: np.ndarray
    start: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray  # documents of this run in each sequence
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the documents with these lengths and ranks."""
        key = (self.length.astype(np.int64) << 44) | self.start
        at = np.searchsorted(key, (length.astype(np.int64) << 44) | rank, side="right") - 1
        turn = rank - self.start[at]
        return self.sequence[at] + turn // self.copies[at], self.offset[at] + turn % self.copies[at] * length


class _Builder:
    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.taken = np.zeros_like(self.left)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, how many)
        self.rooms: list[int] = []

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, n: int, sequence: int, copies: int, offset: int) -> None:
        self.runs.append((length, int(self.taken[length]), sequence, copies, offset))
        self.taken[length] += n
        self.left[length] -= n

    def keep(self, room: int, sequence: int, n: int) -> None:
        if room > 0 and n > 0:
            if not self.bins[room]:
                bisect.insort(self.rooms, room)
            self.bins[room].append((sequence, n))

    def best_fit(self) -> None:
        """What is left, longest first, each into the fullest sequence that still has room for it."""
        for length in range(self.capacity, 0, -1):
            while (n := int(self.left[length])) > 0:
                k = bisect.bisect_left(self.rooms, length)
                if k == len(self.rooms):
                    each = self.capacity // length
                    whole, rest = divmod(n, each)
                    for bins, copies in ((whole, each), (1, rest)):
                        if bins and copies:
                            first = self.open(bins)
                            self.put(length, bins * copies, first, copies, 0)
                            self.keep(self.capacity - copies * length, first, bins)
                    continue
                room = self.rooms[k]
                first, bins = self.bins[room].pop()
                if not self.bins[room]:
                    self.rooms.pop(k)
                used = min(n, bins)
                self.put(length, used, first, 1, self.capacity - room)
                self.keep(room, first + used, bins - used)
                self.keep(room - length, first, used)

    def plan(self) -> Plan:
        columns = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5).T
        return Plan(columns[0], columns[1], columns[2], columns[3], columns[4], self.sequences)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Fractional cutting-stock optimum over few sizes, by column generation.

    Returns (patterns, amounts): a column of patterns says how many pieces of
    each size share a sequence, its amount how many such sequences there are.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    deepest = int(capacity // sizes.min())
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price, amounts = inverse.sum(axis=0), inverse @ demand
        column = _dearest(sizes, price, capacity, deepest)
        if price @ column <= 1 + 1e-9:
            break
        direction = inverse @ column
        ok = direction > 1e-12
        leaves = int(np.argmin(np.where(ok, amounts / np.where(ok, direction, 1), np.inf)))
        basis[:, leaves] = column
    return basis, np.maximum(np.linalg.solve(basis, demand), 0)


def _dearest(sizes: np.ndarray, price: np.ndarray, capacity: int, deepest: int) -> np.ndarray:
    """The pattern of the highest total price: a knapsack, one more piece in each layer."""
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(deepest):
        options = np.zeros((len(sizes) + 1, capacity + 1))
        options[-1] = best
        for i, size in enumerate(sizes):
            options[i, :size] = -1
            options[i, size:] = best[: capacity + 1 - size] + price[i]
        pick = options.argmax(axis=0)
        pick[options.max(axis=0) <= best] = len(sizes)
        chosen.append(pick)
        best = options.max(axis=0)
    column, room = np.zeros(len(sizes)), capacity
    for pick in reversed(chosen):
        i = pick[room]
        if i < len(sizes):
            column[i] += 1
            room -= sizes[i]
    return column


def make_plan(counts: np.ndarray, capacity: int, limits: tuple[float, ...] = (1 / 4, 1 / 3, 1 / 2), groups: int = 32) -> Plan:
    """``counts[l]`` documents of length l, 0 < l <= capacity, into sequences of ``capacity``.

    The scheme needs a limit, as a share of the capacity, above which a length
    is large.  A plan takes milliseconds, so each of ``limits`` is tried and
    the plan of fewest sequences returned.
    """
    return min((_plan(counts, capacity, large, groups) for large in limits), key=lambda plan: plan.sequences)


def _plan(counts: np.ndarray, capacity: int, large: float, groups: int) -> Plan:
    build = _Builder(counts, capacity)
    if build.left[capacity]:
        n = int(build.left[capacity])
        build.put(capacity, n, build.open(n), 1, 0)
    lengths = np.nonzero(build.left)[0][::-1]
    lengths = [int(x) for x in lengths if x > large * capacity]
    total = int(sum(build.left[x] for x in lengths))
    if total:
        _linear_grouping(build, lengths, total, min(groups, total))
    build.best_fit()
    return build.plan()


def _linear_grouping(build: _Builder, lengths: list[int], total: int, groups: int) -> None:
    each = -(-total // groups)
    members: list[list[list[int]]] = [[]]  # per group its [length, count], longest first
    room = each
    for length in lengths:
        n = int(build.left[length])
        while n:
            if room == 0:
                members.append([])
                room = each
            used = min(n, room)
            members[-1].append([length, used])
            n, room = n - used, room - used
    by_size: dict[int, list[list[int]]] = {}
    for group in members:  # all of a group count as long as its longest; groups of one size are one
        by_size.setdefault(group[0][0], []).extend(group)
    sizes = np.array(list(by_size), dtype=np.int64)
    queues = [list(reversed(q)) for q in by_size.values()]
    demand = np.array([sum(n for _, n in q) for q in queues], dtype=float)
    patterns, amounts = configurations(sizes, demand, build.capacity)
    for column, amount in zip(patterns.T.round().astype(int), np.floor(amounts + 1e-7).astype(np.int64)):
        slots = [i for i, n in enumerate(column) for _ in range(n)]
        have = [sum(n for _, n in q) for q in queues]
        amount = min([int(amount), *(have[i] // column[i] for i in set(slots))])
        if amount:
            _substitute(build, queues, slots, amount)


def _substitute(build: _Builder, queues: list[list[list[int]]], slots: list[int], amount: int) -> None:
    """``amount`` sequences of one configuration, filled with actual documents; alike sequences stay one run."""
    segments = []
    for i in slots:
        need, own = amount, []
        while need:
            length, n = queues[i][-1]
            used = min(n, need)
            own.append((length, used))
            need -= used
            queues[i][-1][1] -= used
            if not queues[i][-1][1]:
                queues[i].pop()
        segments.append(own)
    cuts = sorted({0, *(int(c) for own in segments for c in np.cumsum([n for _, n in own]))})
    first = build.open(amount)
    where = [0] * len(segments)
    ends = [own[0][1] for own in segments]
    for a, b in zip(cuts, cuts[1:]):
        offset = 0
        for s, own in enumerate(segments):
            while ends[s] <= a:
                where[s] += 1
                ends[s] += own[where[s]][1]
            length = own[where[s]][0]
            build.put(length, b - a, first + a, 1, offset)
            offset += length
        build.keep(build.capacity - offset, first + a, b - a)
