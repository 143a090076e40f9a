"""Numpy parts of weak supervision: the generative label model and the linear classifier.

Both work on a bounded sample (rows are bounded by the caller's
``train_rows``, columns by its ``voters`` and ``features``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LabelModel:
    """P(votes | class) as a tree of voters: each depends on its class and on the vote of its parent.

    ``rates[y, u, j]``: how often voter j votes on class y when its parent's
    vote is u (a root, of parent -1, has the same rate for both).  Where
    ``speaks[j]`` is false a 0 of voter j is an abstention and says nothing.
    """

    prior: float
    parent: np.ndarray
    rates: np.ndarray
    speaks: np.ndarray

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log-odds of toxic against clean, given the votes, per row of a 0/1 matrix."""
        above = np.where(self.parent >= 0, votes[:, self.parent], 0).astype(int)
        on = np.log(self.rates[1]) - np.log(self.rates[0])
        off = np.where(self.speaks, np.log1p(-self.rates[1]) - np.log1p(-self.rates[0]), 0.0)
        column = np.arange(votes.shape[1])
        says = np.where(votes > 0, on[above, column], off[above, column])
        return says.sum(axis=1) + np.log(self.prior) - np.log1p(-self.prior)

    def accuracies(self, votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Share of each voter's votes that fall on toxic rows, given P(toxic) per row."""
        return (p @ votes) / np.maximum(votes.sum(axis=0), 1e-9)


def dependence(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Mutual information of every two voters within the classes, of which row i is toxic with probability p[i]."""
    total = np.zeros((votes.shape[1],) * 2)
    for q in (p, 1 - p):
        mass = q.sum()
        if mass <= 1:
            continue
        one = (q @ votes + 0.5) / (mass + 1)
        both = ((votes * q[:, None]).T @ votes + 0.25) / (mass + 1)
        for joint, a, b in ((both, one[:, None], one[None]), (one[:, None] - both, one[:, None], 1 - one[None]), (one[None] - both, 1 - one[:, None], one[None]), (1 - one[:, None] - one[None] + both, 1 - one[:, None], 1 - one[None])):
            joint = np.maximum(joint, 1e-9)
            total += mass / len(p) * joint * np.log(joint / np.maximum(a * b, 1e-12))
    np.fill_diagonal(total, 0.0)
    return total


def spanning_tree(weight: np.ndarray, least: float) -> np.ndarray:
    """Parent of every voter in the tree of greatest total dependence; edges of at most ``least`` are left out."""
    n = len(weight)
    parent, best, link, done = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1), np.zeros(n, bool)
    for _ in range(n):
        at = int(np.argmax(np.where(done, -np.inf, best))) if (~done & (best > least)).any() else int(np.flatnonzero(~done)[0])
        parent[at] = link[at] if best[at] > least else -1
        done[at] = True
        closer = ~done & (weight[at] > best)
        best[closer], link[closer] = weight[at][closer], at
    return parent


def fit_label_model(votes: np.ndarray, prior: float, start: np.ndarray, speaks: np.ndarray, rounds: int = 30, tree: bool = True, labels: np.ndarray | None = None) -> tuple[LabelModel, np.ndarray]:
    """EM on a 0/1 matrix of votes; also P(toxic) per row, given its votes alone.

    ``prior`` is the share of toxic rows and ``start`` a first guess of
    P(toxic) per row, which says what class is which.  With ``labels`` the
    voters' rates are calibrated on them, half and half with what the votes
    say by themselves; no row's own label enters its posterior.  Voters that depend on one another within the classes are joined in
    a tree (of none, without ``tree``), so that copies of one voter count once.
    """
    votes, p = votes.astype(float), np.clip(start.astype(float), 1e-6, 1 - 1e-6)
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    parent = np.full(votes.shape[1], -1)
    for k in range(rounds):
        if tree and k % 5 == 0:
            # By chance alone, twice the rows times the information is about a chi-square of two degrees.
            parent = spanning_tree(dependence(votes, p), 7 / max(1, len(p)))
        above = np.where(parent >= 0, votes[:, parent], 0)
        toxic = p if labels is None else (p + labels) / 2
        rates = np.empty((2, 2, votes.shape[1]))
        for y, q in ((0, 1 - toxic), (1, toxic)):
            for u in (0, 1):
                own = q[:, None] * np.where(parent >= 0, above == u, True)
                mean = (q @ votes + 0.5) / (q.sum() + 1)
                rates[y, u] = ((own * votes).sum(axis=0) + 2 * mean) / (own.sum(axis=0) + 2)
        model = LabelModel(prior, parent, np.clip(rates, 1e-4, 1 - 1e-4), speaks)
        p = 1 / (1 + np.exp(-np.clip(model.odds(votes), -30, 30)))
    return model, p


def fit_logistic(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, width: int, l2: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on 0/1 features given as (row, column) pairs, for soft targets."""
    w, b, n = np.zeros(width), 0.0, max(1, len(target))
    m1, m2 = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(rows, w[columns], len(target)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.append(np.bincount(columns, error[rows], width) + l2 * w, error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def calibrate(odds: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Scale and shift that make 1 / (1 + exp(-(scale * odds + shift))) the likeliest probability of the labels."""
    mean, deviation = float(odds.mean()), float(odds.std()) + 1e-9
    x = np.stack([(odds - mean) / deviation, np.ones_like(odds)], axis=1)
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    a, penalty = np.array([1.0, np.log(share / (1 - share))]), np.diag([1e-1, 1e-3])

    def loss(a: np.ndarray) -> float:
        z = x @ a
        return float((np.logaddexp(0, z) - label * z).sum() + 0.5 * a @ penalty @ a)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - label) + penalty @ a)
        step = 1.0
        while step > 1e-4 and loss(a - step * move) > loss(a):
            step /= 2
        a = a - step * move
    scale = max(0.02, float(a[0])) / deviation
    return scale, float(a[1]) - scale * mean
