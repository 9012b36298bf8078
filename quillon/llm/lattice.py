"""Embedding near-dedup by lattice hashing.

In each of several tables a unit vector is projected at random to one or more blocks of eight dimensions, scaled, shifted and decoded
to the nearest point of the E8 lattice in each block; together these are its home cell. It also probes the PROBES neighbouring cells, one
block moved along a minimal vector, that it lies nearest to. Vectors that meet at a home cell are compared by cosine in double precision.

Blocks are added as the table grows, so that the random vectors a vector meets stay about CANDIDATES, whatever the size. The number of
tables is then found by simulation: tables are added until RECALL of random pairs exactly at the threshold meet in one of them (closer
pairs meet the more). Both depend on the angle only, not on the data.

Copies are one class, hashed once. Only cells where somebody can meet are filled with vectors. A pair of classes counts once, where it
meets first; of a cell's links only the counts of each class and a spanning forest leave it, never the pairs. A cell with more than BLOCK
members is split into blocks that meet pairwise, so no group is unbounded and no pair is lost.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths
don't link, each length is a table of its own; lengths of any magnitude are compared without overflow; a cosine within 1e-9 of the
threshold is computed again in extended precision and links if it isn't below; repeated rows link with each other, and where an id repeats
with different vectors each row has its own links; ``kept`` holds for every row whose id names its component; a row without an id links
with nothing, has no component and isn't kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, table
from quillon.llm.components import connected_components, forest
from quillon.llm.vectors import by_length, numbered, scaled

COSINE = 0.9
RECALL = 0.98
PROBES = 6
CANDIDATES = 64
BLOCK = 2048
#: Scales of one, two and more blocks for vectors of 64 dimensions; others are scaled by the root of theirs, as projections shrink so.
SCALES = (6.0, 4.0, 3.0)
MOST_TABLES = 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer point whose entries add up to an even number."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(x[odd] - near[odd]).argmax(axis=1)
    near[odd, worst] += np.where(x[odd, worst] >= near[odd, worst], 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


class Tables:
    """Random projections to lattice cells; ``tables`` may grow after the fact, the first ones stay the same."""

    def __init__(self, dim: int, blocks: int = 1, tables: int = 8, probes: int = PROBES, seed: int = 7) -> None:
        self.dim, self.blocks, self.probes, self.seed = dim, blocks, probes, seed
        self.scale = SCALES[min(blocks, len(SCALES)) - 1] * (max(dim, 8) / 64) ** 0.5
        rng = np.random.default_rng(seed)
        self.near = minimal_vectors()
        self.mix = rng.integers(1, 1 << 62, (blocks, 8), dtype=np.int64) | 1
        self.aside = (np.rint(2 * self.near).astype(np.int64) @ self.mix.T).T.ravel()  # what a step in each block adds to a name
        self.tables = tables

    def table(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng((self.seed, t))
        turns = [np.linalg.qr(rng.normal(size=(max(self.dim, 8), 8)))[0][: self.dim] for _ in range(self.blocks)]
        return np.concatenate(turns, axis=1) * self.scale, rng.random(8 * self.blocks)

    def cells(self, unit: np.ndarray, t: int) -> np.ndarray:
        """Names of the home cell and the probed ones in table t: one row a vector. Two cells that share a name cost needless comparisons only."""
        turn, shift = self.table(t)
        x = unit @ turn + shift
        name, gain = np.zeros(len(x), np.int64), []
        for b in range(self.blocks):
            part = x[:, 8 * b : 8 * b + 8]
            home = nearest_e8(part)
            name += np.rint(2 * home).astype(np.int64) @ self.mix[b]
            gain.append((part - home) @ self.near.T)
        side = np.argpartition(-np.concatenate(gain, axis=1), self.probes, axis=1)[:, : self.probes]
        return np.concatenate([name[:, None], name[:, None] + self.aside[side]], axis=1)

    def every(self, unit: np.ndarray) -> np.ndarray:
        return np.stack([self.cells(unit, t) for t in range(self.tables)], axis=1)


def fitting(dim: int, n: int, cosine: float = COSINE, recall: float = RECALL, candidates: int = CANDIDATES, trials: int = 1500) -> Tables:
    """Blocks by the number of vectors, tables by simulated pairs at the threshold."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x, y = unit(rng.normal(size=(trials, dim))), rng.normal(size=(trials, dim))
    if dim > 1:
        y = unit(y - (x * y).sum(axis=1)[:, None] * x)
    near = cosine * x + (1 - cosine * cosine) ** 0.5 * y if dim > 1 else x
    blocks = 0
    while True:
        blocks += 1
        one = Tables(dim, 1)
        one.scale = SCALES[min(blocks, len(SCALES)) - 1] * (max(dim, 8) / 64) ** 0.5
        _, sizes = np.unique(one.cells(unit(rng.normal(size=(4 * trials, dim))), 0)[:, 0], return_counts=True)
        chance = max(1e-6, float((sizes * (sizes - 1.0)).sum()) / (4 * trials) ** 2) ** blocks
        made, apart, t = Tables(dim, blocks), np.ones(trials, bool), 0
        while apart.mean() > 1 - recall and t < MOST_TABLES:
            a, b = made.cells(x[apart], t), made.cells(near[apart], t)
            apart[np.flatnonzero(apart)] = ~((a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1))
            t += 1
        if blocks > 1 and t == MOST_TABLES:  # no finer cells can be had at this recall
            return before
        made.tables = t
        if n * chance * t * (1 + 2 * PROBES) <= candidates or blocks > dim // 8:
            return made
        before = made


def at_least(unit: np.ndarray, i: np.ndarray, j: np.ndarray, cos: np.ndarray, cosine: float) -> np.ndarray:
    """cos >= cosine for pairs of rows; close ones are computed again in extended precision."""
    out = cos >= cosine
    close = np.flatnonzero(np.abs(cos - cosine) < 1e-9)
    for at in range(0, len(close), 4096):
        some = close[at : at + 4096]
        x, y = unit[i[some]].astype(np.longdouble), unit[j[some]].astype(np.longdouble)
        out[some] = ((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))).astype(np.float64) >= cosine
    return out


def meetings(cells: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether rows i and j of the cells (row, table, home and probes) meet in a table before their t."""
    out = np.zeros(len(i), bool)
    for k in range(int(t.max(initial=0))):
        some = np.flatnonzero(~out & (t > k))
        a, b = cells[i[some], k], cells[j[some], k]
        out[some] = (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    return out


def candidates(low: np.ndarray, high: np.ndarray, homes: np.ndarray, unit: np.ndarray, norm: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row at home, visiting row, cosine) of groups of rows low .. high whose last ``homes`` rows are at home, visitors before them.
    Pairs of small groups are taken together row by row, large groups by matrix products."""
    visits = high - low - homes
    large = homes * visits > 4096
    for a, b, n in zip(low[large].tolist(), high[large].tolist(), homes[large].tolist()):
        step = max(1, most // (b - a - n))
        for first in range(b - n, b, step):
            last = min(b, first + step)
            cos = (unit[first:last] @ unit[a : b - n].T) / (norm[first:last][:, None] * norm[a : b - n][None, :])
            x, y = np.nonzero(cos >= -1)
            yield first + x, a + y, cos[x, y]
    small = np.flatnonzero(~large & (visits > 0) & (homes > 0))
    sums = np.cumsum(homes[small] * visits[small])
    for part in np.split(small, np.searchsorted(sums, np.arange(most, sums[-1] if len(sums) else 0, most))):
        if not len(part):
            continue
        n, v, each = homes[part], visits[part], homes[part] * visits[part]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        i = np.repeat(low[part] + v, each) + place // np.repeat(v, each)
        j = np.repeat(low[part], each) + place % np.repeat(v, each)
        yield i, j, np.einsum("ij,ij->i", unit[i], unit[j]) / (norm[i] * norm[j])


def compared(ids: np.ndarray, tables: np.ndarray, edges: np.ndarray, home: np.ndarray, v: np.ndarray, cells: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks of cells (rows between edges, visitors first): pairs (row at home, visiting row) that link and meet nowhere before."""
    unit = scaled(v)
    norm = np.linalg.norm(unit, axis=1)
    ii, jj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, cos in candidates(edges[:-1], edges[1:], np.add.reduceat(home.astype(np.int64), edges[:-1]), unit, norm):
        near = (cos >= cosine - 1e-9) & (ids[i] != ids[j])
        i, j, cos = i[near], j[near], cos[near]
        ok = at_least(unit, i, j, cos, cosine)
        i, j = i[ok], j[ok]
        # Both at home here, or each visiting the other's home: the one of the smaller number counts it.
        t = tables[i]
        mutual = (cells[i, t, 0] == cells[j, t, 0]) | (cells[i, t] == cells[j, t, :1]).any(axis=1)
        ok = ~mutual | (ids[i] < ids[j])
        i, j, t = i[ok], j[ok], t[ok]
        ok = ~meetings(cells, i, j, t)
        ii.append(i[ok])
        jj.append(j[ok])
    return np.concatenate(ii), np.concatenate(jj)


def links(classes: DataFrame, scratch: Scratch, cosine: float = COSINE) -> DataFrame:
    """(u, v, n) of classes (cls, size, v: array<double>): counts have v = -1 and the number n of rows that u's rows link with in some cells;
    links have n = 0, and are as many as connect what links connect."""
    found = {r.d: fitting(r.d, r.n, cosine) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each length

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                for dim, part, v in by_length(whole.slice(at, 1024)):
                    unit = scaled(v)
                    cells = found[dim].every(unit / np.linalg.norm(unit, axis=1)[:, None])
                    flat = cells.reshape(len(v), -1)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("size"), pa.array(np.full(len(v), dim, np.int32)), pa.array([x.tobytes() for x in v], pa.binary()), listed], ["cls", "size", "d", "raw", "cells"])

    placed = scratch.keep(classes.select("cls", "size", "v").mapInArrow(hashed, "cls long, size long, d int, raw binary, cells array<long>"))
    wide = 1 + PROBES
    spread = placed.select("cls", "d", F.posexplode("cells").alias("at", "cell")).select("cls", "d", F.expr(f"at div {wide}").cast("int").alias("t"), "cell", (F.col("at") % wide == 0).alias("home"))
    counted = spread.groupBy("d", "t", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("all")).where("homes > 0 and all > 1")
    met = scratch.keep(counted.select("d", "t", "cell", F.ceil(F.col("homes") / BLOCK).cast("int").alias("hs"), F.ceil(F.col("all") / BLOCK).cast("int").alias("vs")))
    inside = spread.join(met, ["d", "t", "cell"])
    mine = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A home member meets every block of visitors, and is a visitor itself.
    at_home = inside.where("home").select("cls", "d", "t", "cell", mine("hs").alias("hb"), every("vs").alias("vb"), F.lit(True).alias("home"))
    visiting = inside.select("cls", "d", "t", "cell", every("hs").alias("hb"), mine("vs").alias("vb"), F.lit(False).alias("home"))
    keys = ["d", "t", "cell", "hb", "vb"]
    members = scratch.keep(at_home.union(visiting))
    brought = members.join(placed.select("cls", "size", "raw", "cells"), "cls").select(*keys, "home", "cls", "size", "raw", "cells")
    dealt = brought.repartition(*keys).sortWithinPartitions(*keys, "home")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(part: pa.Table) -> Iterator[pa.RecordBatch]:
            key = [part.column(k).to_numpy() for k in keys]
            edge = np.append(np.flatnonzero(np.any([np.diff(k, prepend=k[:1] - 1) != 0 for k in key], axis=0)), part.num_rows)
            home, ids, sizes = part.column("home").to_numpy(), part.column("cls").to_numpy(), part.column("size").to_numpy()
            for dim in np.unique(key[0]).tolist():
                low, high = np.searchsorted(key[0], [dim, dim + 1])
                edges = edge[(edge >= low) & (edge <= high)] - low
                group, own, size = part.slice(low, high - low), ids[low:high], sizes[low:high]
                v = np.frombuffer(b"".join(group.column("raw").to_pylist()), np.float64).reshape(-1, dim)
                cells = pa.concat_arrays(group.column("cells").chunks).flatten().to_numpy().reshape(len(v), -1, wide)
                i, j = compared(own, key[1][low:high], edges, home[low:high], v, cells, cosine)
                names, code = np.unique(own, return_inverse=True)
                each = np.bincount(code[i], size[j], len(names)) + np.bincount(code[j], size[i], len(names))
                some = each > 0
                node, root = forest(own[i], own[j])
                far = node != root
                counts, links_ = (names[some], np.full(some.sum(), -1), each[some].astype(np.int64)), (node[far], root[far], np.zeros(far.sum(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(counts, links_)], ["u", "v", "n"])

        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            last = [held.column(k).to_numpy() for k in keys]
            same = np.all([k == k[-1] for k in last], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from linked(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from linked(held.combine_chunks())

    return dealt.mapInArrow(compare, "u long, v long, n long")


def near_duplicates(rows: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE, scratch: Scratch | None = None) -> DataFrame:
    """key, n_links, component_id, kept for every row."""
    scratch = scratch or Scratch(rows.sparkSession, "lattice")
    every = numbered(rows, key, column, scratch)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            at, flat = v.offsets.to_numpy(), v.values.to_numpy() + 0.0  # zeros have one sign
            names = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), v, pa.array(names, pa.binary())], ["row", "key", "v", "name"])

    good = scratch.keep(every.where("v is not null").mapInArrow(named, "row long, key long, v array<double>, name binary"))
    classes = scratch.keep(good.groupBy("name").agg(F.min("row").alias("cls"), F.min("key").alias("least"), F.count("*").alias("size"), F.first("v").alias("v")))
    found = scratch.keep(links(classes, scratch, cosine))
    degree = scratch.keep(found.where("n > 0").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("others")))
    roots = scratch.keep(connected_components(found.where("v >= 0").select("u", "v"), scratch).withColumnRenamed("node", "cls"))
    rooted = scratch.keep(classes.select("name", "cls", "least", "size").join(degree, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    least = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of_class = scratch.keep(rooted.join(least, "root").select("name", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    linked = scratch.keep(good.select("row", "key", "name").join(of_class, "name").select(F.col("key").alias(key), "n_links", "component_id"))
    alone = every.where("v is null").select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    scratch.drop(good, classes, found, degree, roots, rooted, least, of_class)
    return linked.union(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def op3_lattice_hashing(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_lattice_hashing": op3_lattice_hashing}
