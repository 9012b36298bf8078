"""Exact shares of marked points among the nearest, by small balls of points: of each ball only the shell that can hold neighbours is compared."""

from __future__ import annotations

import numpy as np

#: Points of a ball, where they aren't all copies of one.
LEAF = 96
#: Distances held at a time (32 MB).
HELD = 1 << 22


def leaves(points: np.ndarray, most: int = LEAF) -> np.ndarray:
    """The ball of each point: halves by two means until at most ``most`` points or copies of one are left."""
    out, found, stack = np.zeros(len(points), np.int32), 0, [np.arange(len(points))]
    while stack:
        i = stack.pop()
        x = points[i]
        if len(i) <= most or (x.max(axis=0) == x.min(axis=0)).all():
            out[i] = found
            found += 1
            continue
        some = x[:: max(1, len(x) // 1000)]
        some = some - some.mean(axis=0)
        along = x @ np.linalg.eigh(some.T @ some)[1][:, -1]
        upper = along > np.median(along)
        for _ in range(3):
            if upper.all() or not upper.any():
                break
            high, low = x[upper].mean(axis=0), x[~upper].mean(axis=0)
            upper = (x - (high + low) / 2) @ (high - low) > 0
        if upper.all() or not upper.any():
            upper = np.zeros(len(i), bool)
            upper[np.argpartition(along, len(i) // 2)[: len(i) // 2]] = True
        stack += [i[upper], i[~upper]]
    return out


def marked_near(points: np.ndarray, marked: np.ndarray, leaf: np.ndarray, k: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(places, how many marked ones are among the k nearest others) for the points of every ``parts``-th ball. Points at the distance of the k-th share what places are left.

    Distances are taken in single precision first; those too near the k-th for that are taken again in double precision."""
    order = np.argsort(leaf, kind="stable")
    start = np.flatnonzero(np.diff(leaf[order], prepend=-1))
    size = np.diff(np.append(start, len(leaf)))
    ball = np.repeat(np.arange(len(size)), size)
    x = points[order]
    centre = np.add.reduceat(x, start, dtype=float) / size[:, None]
    r = np.concatenate([np.sqrt(((x[at : at + 65_536] - centre[ball[at : at + 65_536]]) ** 2).sum(axis=1)) for at in range(0, len(x), 65_536)])
    within = np.lexsort((r, ball))
    order, r = order[within], r[within]
    x = points[order]
    del points
    mark, stop = marked[order], start + size
    nearest, farthest = r[start], r[stop - 1]
    span = 2 * r.max() + 1
    key = ball * span + r
    rounding = 1e-12 * span * (len(size) + 1)
    single = np.float32
    whole = x.mean(axis=0, dtype=float)
    rows = np.ones((len(x), x.shape[1] + 2), single)  # x from the mean, its square, 1
    for at in range(0, len(x), 65_536):
        rows[at : at + 65_536, :-2] = x[at : at + 65_536] - whole
        rows[at : at + 65_536, -2] = (rows[at : at + 65_536, :-2].astype(float) ** 2).sum(axis=1)
    taken, far_held, below_held = np.empty(rows.shape, single), np.empty(max(HELD, len(x)), single), np.empty(max(HELD, len(x)), bool)
    out = np.zeros(len(x))
    mine = np.arange(part, len(size), parts)
    for l in mine:
        own = np.arange(start[l], stop[l])
        middle = centre[l]
        local, back = np.unique(x[own], axis=0, return_inverse=True) if len(own) > 1 else (x[own], np.zeros(1, np.int64))
        local, back = local.astype(float), back.ravel()
        asked = np.zeros((len(local), 5))  # nearer ones, marked ones of them, those at the k-th distance, marked ones of them (itself included), whether itself is nearer
        moved = (centre - middle).astype(single)
        far = np.einsum("ij,ij->i", moved, moved)
        closest = np.argsort(far)
        first = closest[: np.searchsorted(np.cumsum(size[closest]), 2 * k + 2) + 1]
        guess = spread(start[first], stop[first])
        if len(guess) > 16 * k + 4096:
            guess = guess[:: len(guess) // (8 * k + 2048)]  # any k + 1 bound from above
        g = x[guess] - middle
        gg = (g * g).sum(axis=1)
        for at in range(0, len(local), LEAF):
            q = local[at : at + LEAF] - middle
            qq = (q * q).sum(axis=1)
            bound = np.partition(qq[:, None] + gg - 2 * q @ g.T, k, axis=1)[:, k] * (1 + 1e-9) + 1e-12 * qq
            reach = np.sqrt(np.maximum(bound, 0))
            away = (-2 * q).astype(single) @ moved.T
            away += far
            away += qq[:, None].astype(single)
            np.sqrt(np.maximum(away, 0, out=away), out=away)
            wide = (reach * (1 + 1e-5) + 1e-3 * np.sqrt(qq))[:, None].astype(single)
            low, high = (away * single(1 - 1e-5) - wide).min(axis=0).astype(float), (away * single(1 + 1e-5) + wide).max(axis=0).astype(float)
            live = np.flatnonzero((low <= farthest) & (high >= nearest))
            s = np.searchsorted(key, live * span + np.maximum(low[live], 0) - rounding)
            e = np.searchsorted(key, live * span + np.minimum(high[live], farthest[live]) + rounding, side="right")
            idx = spread(np.maximum(s, start[live]), np.minimum(e, stop[live]))
            c = np.take(rows, idx, axis=0, out=taken[: len(idx)], mode="clip")
            q = local[at : at + LEAF] - whole
            qq = (q * q).sum(axis=1)
            turned = np.concatenate([-2 * q, np.ones((len(q), 1)), qq[:, None]], axis=1).astype(single)
            wrong = 2e-6 * (4 * bound + 8 * qq)  # far above the rounding of these sums for any within the bound
            upper = (bound + 2 * wrong).astype(single)
            step = max(1, HELD // max(len(idx), 1))
            for low_ in range(0, len(q), step):
                some = turned[low_ : low_ + step]
                shape = len(some), len(idx)
                d = np.matmul(some, c.T, out=far_held[: shape[0] * shape[1]].reshape(shape))
                place = np.flatnonzero(np.less_equal(d, upper[low_ : low_ + step, None], out=below_held[: d.size].reshape(shape)))
                value = d.ravel()[place]
                edge = np.searchsorted(place, np.arange(len(d) + 1) * len(idx))
                for i in range(len(d)):
                    j = low_ + i
                    v, w = value[edge[i] : edge[i + 1]], place[edge[i] : edge[i + 1]] - i * len(idx)
                    kth = np.partition(v, k)[k]
                    sure = idx[w[v < kth - 2 * wrong[j]]]
                    near = idx[w[np.abs(v - kth) <= 2 * wrong[j]]]
                    exact = ((x[near] - local[at + j]) ** 2).sum(axis=1)
                    kth = np.partition(exact, k - len(sure))[k - len(sure)]
                    band = 1e-11 * kth
                    less, tied = exact < kth - band, np.abs(exact - kth) <= band
                    asked[at + j] = len(sure) + np.count_nonzero(less), np.count_nonzero(mark[sure]) + np.count_nonzero(mark[near[less]]), np.count_nonzero(tied), np.count_nonzero(mark[near[tied]]), kth > 0
        n, n_marked, tied, tied_marked, inner = asked[back].T
        n, n_marked = n - inner, n_marked - mark[own] * inner
        tied, tied_marked = tied - (1 - inner), tied_marked - mark[own] * (1 - inner)
        out[own] = n_marked + (k - n) * tied_marked / np.maximum(tied, 1)
    chosen = spread(start[mine], stop[mine])
    return order[chosen], out[chosen]


def spread(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All whole numbers from each start up to its stop."""
    size = stop - start
    start, size = start[size > 0], size[size > 0]
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
