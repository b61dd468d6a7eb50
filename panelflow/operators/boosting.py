"""Boosted regression trees on cells: distinct feature vectors with the
number of rows and the mean of the target.

For squared error the rows of a cell enter a tree only through their count
and mean, so growing on cells gives the trees that growing on rows gives.
A tree is grown level by level; a split's candidates are the boundaries
between a feature's distinct values, counted with one histogram per feature
and level.  Missing values go to the side that gains more.

Parameters that speak of rows are defined on counts: ``min_child_weight`` is a
least count on either side of a split; with ``subsample`` below 1 a round
draws each of a cell's rows with that probability (a binomial count) and
takes the drawn rows' mean to be the cell's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Params:
    max_iter: int = 300
    max_depth: int = 5
    learning_rate: float = 0.1
    subsample: float = 0.9
    colsample: float = 0.9
    min_child_weight: float = 3.0
    gamma: float = 0.0          # least gain of a split
    reg_alpha: float = 0.0      # penalties of leaf values
    reg_lambda: float = 1.0
    patience: int = 0           # rounds without a gain on the watched cells (0: none are watched)
    seed: int = 42


@dataclass
class Fit:
    prediction: np.ndarray      # of every cell given
    gains: np.ndarray           # per feature, shares of the total gain
    rounds: int                 # kept


def binned(x: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(code per cell and feature, bins per feature): code 0 is a missing
    value; the others count the boundaries, half-way between the distinct
    values of the cells ``used`` for training, that lie below the value."""
    codes, bins = np.zeros(x.shape, np.int64), []
    for f in range(x.shape[1]):
        present = ~np.isnan(x[:, f])
        values = np.unique(x[used & present, f])
        codes[present, f] = 1 + np.searchsorted((values[1:] + values[:-1]) / 2, x[present, f], side="left")
        bins.append(max(2, len(values) + 1))
    return codes, bins


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def _score(g: np.ndarray, n: np.ndarray, p: Params) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n + p.reg_lambda > 0, _shrunk(g, p.reg_alpha) ** 2 / (n + p.reg_lambda), 0.0)


def _tree(codes: np.ndarray, bins: list[int], g: np.ndarray, n: np.ndarray, columns: np.ndarray, p: Params,
          gains: np.ndarray) -> np.ndarray:
    """Leaf value of each cell for gradient sums ``g`` and counts ``n`` per cell."""
    value, at, node = np.zeros(len(g)), np.arange(len(g)), np.zeros(len(g), np.int64)
    for level in range(p.max_depth + 1):
        k = int(node.max(initial=-1)) + 1
        if not k:
            break
        g_all, n_all = (np.bincount(node, weights=v[at], minlength=k) for v in (g, n))
        own = _score(g_all, n_all, p)
        best, feature, cut, missing_left = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64), np.ones(k, bool)
        for f in columns if level < p.max_depth else ():
            slot = node * bins[f] + codes[at, f]
            gh, nh = (np.bincount(slot, weights=v[at], minlength=k * bins[f]).reshape(k, bins[f]) for v in (g, n))
            gl, nl = np.cumsum(gh, axis=1)[:, :-1], np.cumsum(nh, axis=1)[:, :-1]
            for left in (True, False):          # the missing values' side
                if not left:
                    if not nh[:, 0].any():
                        continue
                    gl, nl = gl - gh[:, :1], nl - nh[:, :1]
                gr, nr = g_all[:, None] - gl, n_all[:, None] - nl
                gain = 0.5 * (_score(gl, nl, p) + _score(gr, nr, p) - own[:, None]) - p.gamma
                least = max(p.min_child_weight, 1e-9)
                gain[(nl < least) | (nr < least)] = -np.inf
                c = np.argmax(gain, axis=1)
                top = gain[np.arange(k), c]
                better = top > np.maximum(best, 1e-12 * (1.0 + own))
                best[better], feature[better], cut[better], missing_left[better] = top[better], f, c[better], left
        split = feature >= 0
        leaf = ~split[node]
        with np.errstate(divide="ignore", invalid="ignore"):
            leaf_value = np.where(n_all + p.reg_lambda > 0, _shrunk(g_all, p.reg_alpha) / (n_all + p.reg_lambda), 0.0)
        value[at[leaf]] = leaf_value[node[leaf]]
        np.add.at(gains, feature[split], best[split])
        at, node = at[~leaf], node[~leaf]
        code = codes[at, feature[node]]
        right = np.where(code == 0, ~missing_left[node], code > cut[node])
        number = np.cumsum(split) - 1
        node = 2 * number[node] + right
        _, node = np.unique(node, return_inverse=True)
    return value


def boost(x: np.ndarray, n: np.ndarray, mean: np.ndarray, p: Params, watched: np.ndarray | None = None,
          watched_n: np.ndarray | None = None, watched_mean: np.ndarray | None = None) -> Fit:
    """Fit on the cells with n > 0 and predict all cells of ``x`` (missing: NaN).

    ``watched`` cells (with their own counts and means) give the error by
    which early stopping keeps the best round."""
    rng, used = np.random.default_rng(p.seed), n > 0
    gains = np.zeros(x.shape[1])
    total = n[used].sum()
    prediction = np.full(len(x), (n[used] * mean[used]).sum() / total if total else 0.0)
    if not total:
        return Fit(prediction, gains, 0)
    codes, bins = binned(x, used)
    target = np.where(used, mean, 0.0)
    tried = max(1, int(round(p.colsample * x.shape[1])))
    best, kept, least = prediction, 0, np.inf
    for r in range(1, p.max_iter + 1):
        drawn = n if p.subsample >= 1 else rng.binomial(n.astype(np.int64), p.subsample).astype(float)
        columns = np.arange(x.shape[1]) if tried == x.shape[1] else np.sort(rng.choice(x.shape[1], tried, replace=False))
        step = _tree(codes, bins, drawn * (target - prediction), drawn, columns, p, gains)
        prediction = prediction + p.learning_rate * step
        if p.patience and watched is not None and watched.any():
            miss = (watched_n[watched] * (watched_mean[watched] - prediction[watched]) ** 2).sum()
            if miss < least:
                least, best, kept = miss, prediction, r
            elif r - kept >= p.patience:
                break
        else:
            best, kept = prediction, r
    whole = gains.sum()
    return Fit(best, gains / whole if whole else gains, kept)
