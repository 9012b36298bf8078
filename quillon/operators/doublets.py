"""Doublet scores: cells against simulated sums of pairs, within each batch."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.frames import Dataset
from quillon.operators import balls
from quillon.plans.steps import Steps

#: Points of a batch that one task compares with all of it.
SHARE = 90_000
#: Points in a row of a written batch.
PIECE = 4096


def running_quantile(x: np.ndarray, y: np.ndarray, q: float, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(middles, quantiles of y) of equal bins of x, half open; an empty bin has the quantile of the one before."""
    step = (x.max() - x.min()) / bins
    middle = x.min() + step * (np.arange(bins) + 0.5)
    place = np.floor((x - x.min()) / max(step, 1e-300)).astype(np.int64)  # the largest x lies past the last bin
    out = pd.Series(y).groupby(place).quantile(q).reindex(np.arange(bins)).ffill().to_numpy()
    return middle[~np.isnan(out)], out[~np.isnan(out)]


def least_at(f, start: float, low: float = -60.0, high: float = 10.0) -> float:
    """Where f of a positive number is least near ``start``: downhill in powers of two as far as it goes, then golden sections of that bracket."""
    at = math.log2(start)
    step = 0.5 if f(2 ** (at + 0.5)) < f(2**at) else -0.5
    while low < at + step < high and f(2 ** (at + step)) < f(2**at):
        at += step
    a, b, ratio = at - 0.5, at + 0.5, (math.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    for _ in range(40):
        if f(2**c) <= f(2**d):
            b = d
        else:
            a = c
        c, d = b - ratio * (b - a), a + ratio * (b - a)
    return 2 ** ((a + b) / 2)


def v_scores(mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Fano factor over what counting noise and baseline noise explain, of genes with a positive mean.

    The commonest Fano factor (of 200 bins of its logarithm, 1 at least) is what counting noise makes; the part that grows with the mean is
    fitted to the running tenth percentile of squared variation over 50 bins of the logarithm of the mean, by least absolute errors."""
    fano = var / mean
    live = fano > 0
    if live.sum() < 3:
        return fano
    middle, low = running_quantile(np.log(mean[live]), np.log(fano[live] / mean[live]), 0.1, 50)
    count, edges = np.histogram(np.log(fano[live]), bins=200)
    common = max(1.0, math.exp((edges[count.argmax()] + edges[count.argmax() + 1]) / 2))
    baseline = least_at(lambda b: np.abs(np.log(common * np.exp(-middle) + b) - low).sum(), 0.1)
    return fano / (common + baseline * mean)


def modes(height: np.ndarray) -> np.ndarray:
    """Where a histogram turns from rising to falling; a plateau counts at its end."""
    change = np.sign(np.diff(height))
    moving = np.flatnonzero(change)
    before = np.concatenate([[1], change[moving][:-1]])
    return moving[(change[moving] < 0) & (before > 0)]


def valley(score: np.ndarray, bins: int = 256, rounds: int = 10_000) -> float:
    """The emptiest place between the two modes of the histogram of simulated scores, smoothed until two are left. A place with fewer than a twentieth
    above it parts off some extreme scores only: these are set aside and it is looked for again. Without two modes, the 95th percentile."""
    left = score
    for _ in range(20):
        if len(left) < 2 or left.max() <= left.min():
            break
        height, edges = np.histogram(left, bins=bins)
        height = height.astype(np.float32)
        for _ in range(rounds):
            ends = np.concatenate([height[:1], height, height[-1:]])
            height = (ends[:-2] + ends[1:-1] + ends[2:]) / 3
            if len(tops := modes(height)) < 3:
                break
        if len(tops) != 2:
            break
        low = tops[0] + int(height[tops[0] : tops[1] + 1].argmin())
        cut = float((edges[low] + edges[low + 1]) / 2)
        if (left > cut).mean() >= 0.05:
            return cut
        left = left[left <= cut]
    return float(np.quantile(score, 0.95))


class Sparse:
    """Cells by genes as (row, column, value), and products with dense matrices, centred by ``shift`` and divided by ``scale`` of columns."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, m: int, shift: np.ndarray, scale: np.ndarray) -> None:
        self.shape, self.shift, self.scale = (n, m), shift, scale
        self.by_row, self.by_col = (self.sorted_by(a, b, value) for a, b in ((row, col), (col, row)))

    @staticmethod
    def sorted_by(to: np.ndarray, of: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
        """(the indices that have entries, where their entries begin, the other index, value)"""
        order = np.lexsort((of, to))
        first = np.flatnonzero(np.diff(to[order], prepend=-1))
        return to[order][first], first, of[order], value[order]

    @staticmethod
    def times(entries: tuple[np.ndarray, ...], n: int, q: np.ndarray) -> np.ndarray:
        """Sums by the first index, of value times row of q, a column at a time."""
        to, first, of, value = entries
        out = np.zeros((q.shape[1], n))
        for j in range(q.shape[1] if len(first) else 0):
            out[j, to] = np.add.reduceat(value * np.ascontiguousarray(q[:, j])[of], first)
        return np.ascontiguousarray(out.T)

    def right(self, q: np.ndarray) -> np.ndarray:
        q = q / self.scale[:, None]
        return self.times(self.by_row, self.shape[0], q) - self.shift @ q

    def left(self, y: np.ndarray) -> np.ndarray:
        return (self.times(self.by_col, self.shape[1], y) - np.outer(self.shift, y.sum(axis=0))) / self.scale[:, None]

    def dense(self) -> np.ndarray:
        z = np.zeros(self.shape)
        to, first, of, value = self.by_row
        z[np.repeat(to, np.diff(np.append(first, len(of)))), of] = value
        return (z - self.shift) / self.scale


def leading(z: Sparse, k: int, seed: int, small: int = 2048, most: int = 200, rounds: int = 50) -> np.ndarray:
    """The k leading right singular vectors: from the smaller of the two products where that has at most ``small`` columns, else from Krylov spaces of at
    most ``most`` vectors (fewer than ``small``), each of which begins where the one before ended, until no value changes by more than a millionth."""
    n, m = z.shape
    if min(n, m) <= small:
        first = n < m
        if n * m <= 1 << 25:
            d = z.dense()
            product = d @ d.T if first else d.T @ d
        else:
            unit = np.eye(min(n, m))
            product = np.concatenate([z.right(z.left(unit[:, at : at + 32])) if first else z.left(z.right(unit[:, at : at + 32])) for at in range(0, len(unit), 32)], axis=1)
        values, vectors = np.linalg.eigh((product + product.T) / 2)
        lead = vectors[:, ::-1][:, :k]
        return z.left(lead) / np.sqrt(np.maximum(values[::-1][:k], 1e-12)) if first else lead
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, k + 10)))[0]
    before = np.zeros(k)
    for _ in range(rounds):
        basis, width = [q], q.shape[1]
        small_ = np.zeros((most // width * width,) * 2)  # products of the basis with itself, the upper half
        while (len(basis) + 1) * width <= most:
            y = z.left(z.right(basis[-1]))
            for again in range(2):
                for i, b in enumerate(basis):
                    part = b.T @ y
                    if not again:
                        small_[i * width : (i + 1) * width, (len(basis) - 1) * width : len(basis) * width] = part
                    y -= b @ part
                y, rest = np.linalg.qr(y)
                if not again:
                    below = rest
            small_[(len(basis) - 1) * width : len(basis) * width, len(basis) * width : (len(basis) + 1) * width] = (rest @ below).T
            basis.append(y)
        last = z.right(basis[-1])
        small_[(len(basis) - 1) * width : len(basis) * width, (len(basis) - 1) * width : len(basis) * width] = last.T @ last
        del last
        small_ = np.triu(small_[: len(basis) * width, : len(basis) * width])
        values, turn = np.linalg.eigh(small_ + np.triu(small_, 1).T)
        turn = turn[:, ::-1][:, : q.shape[1]]
        q = np.linalg.qr(sum(b @ turn[i * q.shape[1] : (i + 1) * q.shape[1]] for i, b in enumerate(basis)))[0]
        now = values[::-1][:k]
        if np.abs(now - before).max() <= 1e-6 * now[0]:
            break
        before = now
    return q[:, :k]


def simulated(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, m: int, ratio: float = 2.0, components: int = 30, seed: int = 0) -> np.ndarray:
    """Projections, in single precision, of the n cells and, after them, of the simulated doublets, for the entries of n cells by m genes. Doublets are simulated in the projected space."""
    rng = np.random.default_rng(seed)
    total = np.maximum(np.bincount(row, value, n), 1e-12)
    x = value / total[row] * np.median(total)
    stored = np.bincount(col, minlength=m)
    mean = np.bincount(col, x, m) / n
    var = (np.bincount(col, (x - mean[col]) ** 2, m) + (n - stored) * mean**2) / n
    ok = (mean > 0) & (var > 0) & (np.bincount(col, x >= 3, m) >= 3)
    if ok.sum() >= 20:
        v = v_scores(mean[ok], var[ok])
        ok[np.flatnonzero(ok)[v < np.quantile(v, 0.85)]] = False
    else:
        ok = var > 0
    place = np.cumsum(ok) - 1
    of = ok[col]
    z = Sparse(row[of], place[col[of]], x[of], n, int(ok.sum()), mean[ok], np.maximum(np.sqrt(var[ok]), 1e-9))
    turn = leading(z, min(components, *z.shape), seed)
    a, b = rng.integers(0, n, int(ratio * n)), rng.integers(0, n, int(ratio * n))
    # The sum of two cells, normalized by the sum of their totals, is a weighted mean of the two.
    w = (total[a] / (total[a] + total[b]))[:, None]
    real = z.right(turn)
    fake = w * real[a] + (1 - w) * real[b]
    return np.concatenate([real, fake]).astype(np.float32)


def nearest_of(n: int, points: int) -> int:
    """How many neighbours a point has, of n cells and the doublets simulated from them."""
    return min(max(1, int(round(0.5 * np.sqrt(n) * points / n))), points - 1)


def likelihood(found: np.ndarray, near: int, r: float, rate: float) -> np.ndarray:
    """The scores of points with so many simulated ones among ``near`` neighbours, of r simulated ones a cell."""
    q = (found + 1) / (near + 2)
    return q * rate / r / np.maximum(1 - rate - q * (1 - rate - rate / r), 1e-12)


def score_batch(row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, m: int, ratio: float = 2.0, rate: float = 0.05, components: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(scores of cells, scores of simulated doublets, threshold) for the entries of n cells by m genes."""
    points = simulated(row, col, value, n, m, ratio, components, seed)
    near = nearest_of(n, len(points))
    found = np.empty(len(points))
    at, counts = balls.marked_near(points, np.arange(len(points)) >= n, balls.leaves(points), near)
    found[at] = counts
    score = likelihood(found, near, (len(points) - n) / n, rate)
    return score[:n], score[n:], valley(score[n:])


def entries_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, column, value, columns) of cells with their lists of genes and values."""
    gene, value = t.column("gene_id").combine_chunks(), t.column("value").combine_chunks()
    stored = np.diff(gene.offsets.to_numpy())
    genes, col = np.unique(gene.flatten().to_numpy(), return_inverse=True)
    return np.repeat(np.arange(t.num_rows, dtype=np.int32), stored), col.astype(np.int32), value.flatten().to_numpy().astype(float), len(genes)


def scrublet(ds: Dataset, batch: str | None = None, ratio: float = 2.0, rate: float = 0.05, seed: int = 0, least: int = 10) -> DataFrame:
    """(cell_id, batch, score, threshold, doublet): a batch is one capture; batches of fewer than ``least`` cells get no score.
    Counts must be whole numbers, since sums of normalized values are no doublets.

    One task projects a batch; its points are then compared in parts of about SHARE, each a task's input with the whole batch."""
    steps = Steps(ds.x.sparkSession, "doublets")
    labels = ds.cells.select("cell_id", (F.col(batch).cast("string") if batch else F.lit("all")).alias("batch"))
    entries = ds.counts.groupBy("cell_id").agg(F.collect_list(F.struct("gene_id", "value")).alias("e"))
    entries = entries.select("cell_id", F.col("e.gene_id").cast("array<long>").alias("gene_id"), F.col("e.value").cast("array<double>").alias("value"))
    none = F.array().cast
    rows = labels.join(entries, "cell_id", "left").select("cell_id", "batch", F.coalesce("gene_id", none("array<long>")).alias("gene_id"), F.coalesce("value", none("array<double>")).alias("value"))
    rows = steps.keep(rows.withColumn("batch", F.coalesce(F.concat(F.lit("b"), "batch"), F.lit("-"))))  # missing names are one batch
    if not rows.where(F.exists("value", lambda v: v != F.floor(v))).isEmpty():
        raise ValueError("doublets are simulated from raw counts, and these aren't whole numbers; normalize afterwards")

    def project(key: tuple, t: pa.Table) -> pa.Table:
        names = ["batch", "cells", "parts", "cell_id", "leaf", "points"]
        made: list[tuple] = []
        n = t.num_rows
        if n >= least:
            t = t.sort_by("cell_id")
            ids = t.column("cell_id").to_numpy()
            row, col, value, m = entries_of(t)
            del t
            if len(row):
                points = simulated(row, col, value, n, m, ratio, seed=seed)
                del row, col, value
                leaf = balls.leaves(points)
                ids = np.concatenate([ids, np.full(len(points) - n, -1)])
                for at in range(0, len(points), PIECE):
                    of = slice(at, at + PIECE)
                    made.append((key[0].as_py(), n, -(-len(points) // SHARE), np.stack([ids[of], np.arange(len(points))[of]]).tobytes(), leaf[of].tobytes(), points[of].tobytes()))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in made], kind) for i, kind in enumerate(kinds)], names)

    def score(key: tuple, t: pa.Table) -> pa.Table:
        n, part, parts = t.column("cells")[0].as_py(), key[1].as_py(), t.column("parts")[0].as_py()
        pieces = [np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in t.column("cell_id")]
        count = sum(p.shape[1] for p in pieces)
        ids, leaf, points = np.empty(count, np.int64), np.empty(count, np.int32), None
        for (own, place), l, p in zip(pieces, t.column("leaf"), t.column("points")):
            p = np.frombuffer(p.as_py(), np.float32).reshape(len(own), -1)
            points = np.empty((count, p.shape[1]), np.float32) if points is None else points
            ids[place], leaf[place], points[place] = own, np.frombuffer(l.as_py(), np.int32), p
        del t, pieces
        near = nearest_of(n, count)
        at, found = balls.marked_near(points, np.arange(count) >= n, leaf, near, part, parts)
        return pa.table([pa.array([key[0].as_py()] * len(at), pa.string()), pa.array(ids[at]), pa.array(at >= n), pa.array(likelihood(found, near, (count - n) / n, rate))], ["batch", "cell_id", "simulated", "score"])

    def cut(key: tuple, t: pa.Table) -> pa.Table:
        scores = np.sort(t.column("score").to_numpy())
        return pa.table([pa.array([key[0].as_py()]), pa.array([valley(scores)])], ["batch", "threshold"])

    points = steps.keep(rows.groupBy("batch").applyInArrow(project, "batch string, cells long, parts int, cell_id binary, leaf binary, points binary"))
    tasks = points.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    scored = steps.keep(tasks.groupBy("batch", "part").applyInArrow(score, "batch string, cell_id long, simulated boolean, score double"))
    cuts = scored.where("simulated").select("batch", "score").groupBy("batch").applyInArrow(cut, "batch string, threshold double")
    out = rows.select("cell_id", "batch").join(scored.where("not simulated").select("cell_id", "score"), "cell_id", "left").join(cuts, "batch", "left")
    return out.select("cell_id", F.when(F.col("batch") != "-", F.expr("substring(batch, 2)")).alias("batch"), "score", "threshold", (F.col("score") > F.col("threshold")).alias("doublet"))
