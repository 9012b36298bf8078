"""Batch correction of an embedding by soft clustering with a diversity penalty and ridge regression within clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.frames import Dataset, n_rows
from quillon.operators.decompose import pca
from quillon.operators.graph import to_matrix
from quillon.operators.select import shared_genes, variable_genes
from quillon.plans.steps import Steps


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 25) -> np.ndarray:
    """Centres by k-means++ and Lloyd's iterations on a sample."""
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        p = near / near.sum() if near.sum() > 0 else None
        centres.append(x[rng.choice(len(x), p=p)])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        label = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(axis=1)
        for j in range(k):
            if (label == j).any():
                c[j] = x[label == j].mean(axis=0)
    return c


def harmony(emb: DataFrame, batches: DataFrame, steps: Steps, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, n_clusters: int | None = None, max_iter: int = 10, inner: int = 4, seed: int = 0, tol: float = 1e-3) -> DataFrame:
    """(cell_id, v): ``emb`` with the differences between batches (cell_id, batch) taken out, cluster by cluster.

    The state on the driver is the centres and tables of clusters by batches. Every pass assigns all cells softly
    with the penalty ((2 E + 1) / (O + E + 1)) ** theta and sends sums back; within a partition, blocks of cells see the tallies of the
    pass before, where a sequential method would see those of the block before. The correction regresses the original embedding.
    """
    n = n_rows(emb)
    levels = [r[0] for r in batches.where("batch is not null").select("batch").distinct().orderBy("batch").collect()]
    at = F.array_position(F.array(*map(F.lit, levels)), F.col("batch")) - 1
    data = steps.keep(emb.join(batches.where("batch is not null"), "cell_id").select("cell_id", "v", at.cast("int").alias("b")))
    share = np.zeros(len(levels))
    for r in data.groupBy("b").count().collect():
        share[r.b] = r["count"]
    share /= max(share.sum(), 1)
    k = n_clusters or max(1, min(100, int(round(n / 30))))
    sample = np.array([r.v for r in data.orderBy(F.xxhash64("cell_id", F.lit(seed))).select("v").limit(20_000).collect()])
    dim = sample.shape[1]
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    centres = unit(kmeans(unit(sample), min(k, len(sample)), seed))
    k, nb = len(centres), len(levels)
    correction = np.zeros((k, nb, dim))
    observed = np.zeros((k, nb))

    def corrected(v: np.ndarray, b: np.ndarray, r: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return v - np.einsum("nk,nkd->nd", r, shift[:, b].transpose(1, 0, 2))

    def assign(z: np.ndarray, b: np.ndarray, y: np.ndarray, tally: np.ndarray) -> np.ndarray:
        expected = tally.sum(axis=1, keepdims=True) * share[None]
        penalty = theta * np.log((2 * expected + 1) / (tally + expected + 1))
        score = -2 * (1 - unit(z) @ y.T) / sigma + penalty[:, b].T
        score -= score.max(axis=1, keepdims=True)
        r = np.exp(score)
        return r / r.sum(axis=1, keepdims=True)

    shift, old_r_state = correction, (centres, observed)
    before = np.inf
    for _ in range(max_iter):
        for _ in range(inner):
            y, tally, last, state = centres, observed, shift, old_r_state

            def tallies(parts: Iterator[pa.RecordBatch], y=y, tally=tally, last=last, state=state) -> Iterator[pa.RecordBatch]:
                out = np.zeros((k, nb + dim + 1))
                for part in parts:
                    v, b = to_matrix(part.column("v")), part.column("b").to_numpy()
                    if not len(v):
                        continue
                    z = corrected(v, b, assign(v, b, *state), last) if last.any() else v
                    r = assign(z, b, y, tally)
                    np.add.at(out[:, :nb].T, b, r)
                    out[:, nb : nb + dim] += r.T @ unit(z)
                    out[:, -1] += (r * 2 * (1 - unit(z) @ y.T)).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(out), pa.list_(pa.float64()))], ["i", "row"])

            sums = np.zeros((k, nb + dim + 1))
            for r in data.mapInArrow(tallies, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
                sums[r.i, r.j] = r.x
            observed, centres = sums[:, :nb], unit(sums[:, nb : nb + dim])
        y, tally, last, state = centres, observed, shift, old_r_state

        def normal(parts: Iterator[pa.RecordBatch], y=y, tally=tally, last=last, state=state) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k, nb, dim + 1))
            for part in parts:
                v, b = to_matrix(part.column("v")), part.column("b").to_numpy()
                if not len(v):
                    continue
                z = corrected(v, b, assign(v, b, *state), last) if last.any() else v
                r = assign(z, b, y, tally)
                for j in range(nb):
                    mine = b == j
                    out[:, j, 0] += r[mine].sum(axis=0)
                    out[:, j, 1:] += r[mine].T @ v[mine]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(list(out.reshape(k, -1)), pa.list_(pa.float64()))], ["i", "row"])

        sums = np.zeros((k, nb * (dim + 1)))
        for r in data.mapInArrow(normal, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
            sums[r.i, r.j] = r.x
        sums = sums.reshape(k, nb, dim + 1)
        shift = np.zeros((k, nb, dim))
        for c in range(k):
            weight, total = sums[c, :, 0], sums[c, :, 1:]
            a = np.zeros((nb + 1, nb + 1))
            a[0, 0], a[0, 1:], a[1:, 0] = weight.sum(), weight, weight
            a[1:, 1:] = np.diag(weight + ridge)
            shift[c] = np.linalg.solve(a + 1e-9 * np.eye(nb + 1), np.concatenate([total.sum(axis=0, keepdims=True), total]))[1:]
        old_r_state = (centres, observed)
        now = float(np.abs(shift).sum())
        if abs(before - now) <= tol * max(now, 1e-12):
            break
        before = now

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            v, b = to_matrix(part.column("v")), part.column("b").to_numpy()
            if len(v):
                yield pa.RecordBatch.from_arrays([part.column("cell_id"), pa.array(list(corrected(v, b, assign(v, b, *old_r_state), shift)), pa.list_(pa.float64()))], ["cell_id", "v"])

    return data.mapInArrow(finish, "cell_id long, v array<double>")


def integrate_datasets(ds: Dataset, batch: str, steps: Steps, n_top: int = 500, k: int = 20) -> DataFrame:
    """Variable genes among those found in every batch, components of all cells, then :func:`harmony`. ``ds.x`` is normalized, not logarithmic."""
    ds = shared_genes(ds.with_frames(x=steps.keep(ds.x)), batch)
    ds = ds.with_frames(x=steps.keep(ds.x), genes=steps.keep(ds.genes))
    chosen = steps.keep(variable_genes(ds, n_top, min_cells=0).where("highly_variable").select("gene_id"))
    logged = ds.x.join(chosen, "gene_id", "left_semi").withColumn("value", F.log(1 + F.col("value")))
    small = ds.with_frames(genes=ds.genes.join(chosen, "gene_id", "left_semi"), x=logged)
    scores, _, _ = pca(small, k)
    return harmony(scores, ds.cells.select("cell_id", F.col(batch).alias("batch")), steps)


def batch_gap(emb: DataFrame, labels: DataFrame) -> float:
    """Mean distance between the centroids of the groups (cell_id, label)."""
    rows = emb.join(labels, "cell_id").select("label", F.posexplode("v").alias("j", "x")).groupBy("label", "j").agg(F.avg("x").alias("x")).toPandas()
    c = rows.pivot(index="label", columns="j", values="x").to_numpy()
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
    return float(d[np.triu_indices(len(c), 1)].mean())


