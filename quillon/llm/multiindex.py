"""Nearest neighbours by inner product over an inverted multi-index.

Vectors are cut in two halves, each quantised by its own codebook, so an entry lies in the cell of a pair of centroids.
For a query all pairs of centroids are traversed with a heap by summed distance (least first; for inner products, the
negated inner products with both centroids) until enough entries are met, and these are reranked on the original vectors in double
precision. Codebooks grow with the root of the table up to MOST_CENTROIDS and are fitted on a bounded sample; every row is indexed.
How many entries are enough is measured, not guessed: the true neighbours of TRIALS queries are found among all rows, and RECALL of them
must lie in the cells traversed.

Cells are laid out in shards of about SHARD entries; a cell with more is split over several. A query goes only to shards
that hold a cell on its way, with those cells, and streams past the shard's entries; a shard is copied only as often as TOGETHER queries visit it.
Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part;
vectors of each length are searched among themselves; ties go to the smaller id; repeated rows are candidates each, also for each
other, and where an id repeats each of its rows is a query with ranks of its own; a table with fewer candidates gives all of
them, an empty one no rows; a product that isn't a number (of infinite parts) ranks as the least; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, table, thinned
from quillon.llm.vectors import exact_dot, matrix, numbered

K = 20
#: Entries a cell should hold on average; at most this many centroids a codebook; sampled rows at least, and for each centroid.
CELL = 64
MOST_CENTROIDS = 512
SAMPLE = 8192
SAMPLE_EACH = 32
#: Queries whose true neighbours are found among all rows, and the part of these neighbours that must be met.
TRIALS = 128
RECALL = 0.97
SHARD = 4096
TOGETHER = 65_536
BLOCK = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ centre.T - (centre * centre).sum(axis=1) / 2).argmax(axis=1)
        count = np.bincount(near, minlength=len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centre)
    return centre


class MultiIndex:
    """Two codebooks, the number of entries in each cell, and the number of entries to meet."""

    def __init__(self, sample: np.ndarray, centroids: int) -> None:
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, : self.half], centroids), kmeans(sample[:, self.half :], centroids)]
        self.counts = np.zeros(self.cells, np.int64)
        self.enough = 0

    @property
    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def cell(self, x: np.ndarray) -> np.ndarray:
        first, second = ((part @ b.T - (b * b).sum(axis=1) / 2).argmax(axis=1) for part, b in zip((x[:, : self.half], x[:, self.half :]), self.books))
        return first * len(self.books[1]) + second

    def traverse(self, query: np.ndarray, enough: float) -> list[int]:
        """Cells in order of the summed distances of their centroids to the query's halves, until ``enough`` entries are met."""
        far = [-(b @ part) for part, b in zip((query[: self.half], query[self.half :]), self.books)]
        order = [np.argsort(d, kind="stable").tolist() for d in far]
        near = [np.sort(d, kind="stable").tolist() for d in far]
        width, heights = len(order[1]), [0] * len(order[0])
        heap, out, met = [(near[0][0] + near[1][0], 0, 0)], [], 0
        counts = self.counts
        while heap and met < enough:
            _, i, j = heapq.heappop(heap)
            cell = order[0][i] * width + order[1][j]
            if n := int(counts[cell]):
                out.append(cell)
                met += n
            if j + 1 < width:
                heapq.heappush(heap, (near[0][i] + near[1][j + 1], i, j + 1))
            if j == 0 and i + 1 < len(heights):
                heapq.heappush(heap, (near[0][i + 1] + near[1][0], i + 1, 0))
        return out

    def calibrate(self, queries: np.ndarray, neighbours: list[list[int]], recall: float = RECALL) -> None:
        """The number of entries that must be met so that this part of the neighbours, given by their cells, is among them."""
        needed: list[int] = []
        for q, cells in zip(queries, neighbours):
            far = (-(self.books[0] @ q[: self.half])[:, None] - (self.books[1] @ q[self.half :])[None, :]).ravel()
            order = np.argsort(far, kind="stable")
            met = np.empty(len(order), np.int64)
            met[order] = np.cumsum(self.counts[order])
            needed += met[cells].tolist()
        self.enough = int(np.quantile(needed, recall, method="higher")) if needed else int(self.counts.sum())


def best(x: np.ndarray, rows: np.ndarray, keys: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of the k best entries of each query but itself, among those allowed (a row a query)."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.nan_to_num(q @ x.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        ok = rows[None, :] != own[:, None]
        if allowed is not None:
            ok &= allowed
        rough[~ok] = -np.inf
        if len(x) > k:
            kth = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
            top = np.where(np.isfinite(rough), np.abs(rough), 0).max(axis=1)
            ok &= rough >= np.where(np.isfinite(kth), kth - 1e-9 * (1 + top), kth)[:, None]
        i, j = np.nonzero(ok)
        score = np.nan_to_num(exact_dot(x[j], q[i]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    order = np.lexsort((rows[j], keys[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], score[place < k]


FOUND = "query long, query_id long, row long, vec_id long, score double"


def found_batch(i: np.ndarray, j: np.ndarray, score: np.ndarray, own: np.ndarray, names: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(names[i]), pa.array(rows[j]), pa.array(keys[j]), pa.array(score)], ["query", "query_id", "row", "vec_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.expr("row_number() over (partition by query order by score desc, vec_id, row)").cast("int")).where(f"rank <= {k}")


def arrays(batch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = batch.column("v")
    return batch.column("row").to_numpy(), batch.column("key").to_numpy(), matrix(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v, dim)


def true_neighbours(indexed: DataFrame, trials: tuple[np.ndarray, np.ndarray, np.ndarray], dim: int, k: int) -> DataFrame:
    """Of each trial query (rows, ids, vectors): the k best of all rows, and their cells."""
    shared = indexed.sparkSession.sparkContext.broadcast(trials)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names, q = shared.value
        for batch in batches:
            if batch.num_rows:
                rows, keys, x = arrays(batch, dim)
                i, j, score = best(x, rows, keys, q, own, k)
                made = found_batch(i, j, score, own, names, rows, keys)
                yield pa.RecordBatch.from_arrays([*made.columns, batch.column("cell").take(pa.array(j))], [*made.schema.names, "cell"])

    return ranked(indexed.mapInArrow(run, FOUND + ", cell int"), k)


def laid_out(counts: np.ndarray, shard: int) -> np.ndarray:
    """(first shard, shards) of each cell: cells side by side until a shard is full; a cell beyond that gets shards of its own."""
    out, at, room = np.empty((len(counts), 2), np.int64), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if n > shard:
            at += room > 0
            out[cell] = at, -(-n // shard)
            at, room = at + int(out[cell, 1]), 0
        else:
            if room + n > shard:
                at, room = at + 1, 0
            out[cell] = at, 1
            room += n
    return out


def search_length(good: DataFrame, dim: int, n: int, queries, k: int, scratch: Scratch) -> DataFrame:
    """The search among ``n`` vectors (row, key, v) of one length."""
    spark = good.sparkSession
    centroids = int(min(MOST_CENTROIDS, max(2, (n / CELL) ** 0.5)))
    size = max(SAMPLE, SAMPLE_EACH * centroids)
    picked = thinned(good, ["row"], size, n).orderBy(F.xxhash64("row"), "row").limit(size).toArrow()
    index = MultiIndex(matrix(picked.column("v").combine_chunks(), dim), centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.array(index.cell(matrix(batch.column("v"), dim)).astype(np.int32)), batch.column("v")], ["row", "key", "cell", "v"])

    indexed = scratch.keep(good.mapInArrow(assign, "row long, key long, cell int, v array<double>"))
    for r in indexed.groupBy("cell").count().collect():  # MOST_CENTROIDS squared rows at most
        index.counts[r.cell] = r["count"]
    asking = indexed.where(queries)
    n_queries = asking.count()
    tried = thinned(asking, ["row"], TRIALS, n_queries).orderBy(F.xxhash64("row"), "row").limit(TRIALS).select("row", "key", "v").toArrow()
    if not tried.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trials = tuple(np.array(a) for a in arrays(tried, dim))
    place = {row: i for i, row in enumerate(trials[0].tolist())}
    cells: list[list[int]] = [[] for _ in place]
    for r in true_neighbours(indexed, trials, dim, k).select("query", "cell").collect():  # k rows a trial
        cells[place[r["query"]]].append(r.cell)
    index.calibrate(trials[2], cells)
    shared = spark.sparkContext.broadcast((index, laid_out(index.counts, SHARD)))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, where = shared.value
        for batch in batches:
            if batch.num_rows:
                cell, rows = batch.column("cell").to_numpy(), batch.column("row").to_numpy()
                first, parts = where[cell].T
                mixed = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                shard = (first + (mixed % parts.astype(np.uint64)).astype(np.int64)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32)), pa.array(cell))
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("row"), batch.column("key"), listed, batch.column("v")], ["shard", "row", "key", "cells", "v"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, where = shared.value
        for batch in batches:
            v = matrix(batch.column("v"), dim)
            for low in range(0, len(v), 64):
                out: list[tuple] = []
                for i in range(low, min(low + 64, len(v))):
                    way = np.array(found.traverse(v[i], found.enough))
                    first, parts = where[way].T
                    for s in np.unique(np.concatenate([first, *(first[parts > p] + p for p in range(1, int(parts.max(initial=1))))])):
                        out.append((int(s), i, np.sort(way[(first <= s) & (s < first + parts)]).astype(np.int32)))
                at = pa.array([o[1] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), batch.column("row").take(at), batch.column("key").take(at), pa.array([o[2] for o in out], pa.list_(pa.int32())), batch.column("v").take(at)], ["shard", "row", "key", "cells", "v"])

    schema = "shard int, row long, key long, cells array<int>, v array<double>"
    asked = scratch.keep(asking.select("row", "key", "v").mapInArrow(route, schema))
    copies = scratch.keep(asked.groupBy("shard").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("groups")))  # a row a shard
    entries = indexed.mapInArrow(settle, schema).join(copies, "shard").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    visits = asked.join(copies, "shard").withColumn("g", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int"))
    columns = ["shard", "g", "asks", "row", "key", "cells", "v"]
    met = entries.withColumn("asks", F.lit(False)).select(columns).union(visits.withColumn("asks", F.lit(True)).select(columns))
    dealt = met.repartition("shard", "g").sortWithinPartitions("shard", "g", "asks")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds the entries of one shard while the queries that visit it stream past."""
        at, parts, made = None, [], None
        for batch in batches:
            group = np.stack([batch.column("shard").to_numpy(), batch.column("g").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)], axis=1)
            edge = [*np.flatnonzero((np.diff(group, axis=0, prepend=group[:1] - 1) != 0).any(axis=1)).tolist(), len(group)] if len(group) else []
            for low, high in zip(edge, edge[1:]):
                shard, g, asks = group[low].tolist()
                part = batch.slice(low, high - low)
                if at != (shard, g):
                    at, parts, made = (shard, g), [], None
                if not asks:
                    parts.append((*arrays(part, dim), part.column("cells").flatten().to_numpy()))
                    continue
                if not parts:
                    continue
                if made is None:
                    rows, keys, x, cell = (np.concatenate(p) for p in zip(*parts))
                    present, code = np.unique(cell, return_inverse=True)
                    made = rows, keys, x, present, code
                rows, keys, x, present, code = made
                own, names, q = arrays(part, dim)
                listed = part.column("cells").to_pylist()
                for first in range(0, len(q), BLOCK):
                    some = slice(first, first + BLOCK)
                    visited = np.zeros((len(q[some]), len(present)), bool)
                    for i, way in enumerate(listed[some]):
                        visited[i, np.isin(present, way, assume_unique=True)] = True
                    yield found_batch(*best(x, rows, keys, q[some], own[some], k, visited[:, code]), own[some], names[some], rows, keys)

    return ranked(dealt.mapInArrow(rerank, FOUND), k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, queries, key: str = "vec_id", column: str = "embedding", k: int = K, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates found nearest to each row that satisfies ``queries`` (of ``key``), itself left out."""
    scratch = scratch or Scratch(rows.sparkSession, "multiindex")
    good = numbered(rows, key, column, scratch).where("v is not null")
    lengths = sorted((r.d, r.n) for r in good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect())  # a row for each length
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim, n in lengths:
        found = search_length(good.where(F.size("v") == dim) if len(lengths) > 1 else good, dim, n, queries, k, scratch)
        out = found if len(lengths) == 1 else out.union(found)
    return out


def op5_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.expr("key % 20 = 0"))


QUERIES = {"op5_inverted_multi_index": op5_inverted_multi_index}
