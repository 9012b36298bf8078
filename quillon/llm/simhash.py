"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. The anchors are the words of a covering code, the direct sum of perfect codes (two binary Golay codes of 23
bits, a Hamming code of 15 and a repetition code of 3), so that every point has exactly one anchor within the covering radii
(3, 3, 1, 1): its home. A fingerprint is replicated to every anchor within the covering radii plus the threshold: those whose distances in
the four parts go beyond the radii by no more than the threshold in all (about 170 for two bits). If two fingerprints
differ in at most that many bits, each visits the other's home, so they are compared there: visitors with those at home.

Only anchors that are a home are filled. Of an anchor with more than GROUP fingerprints, which have to be alike, the fingerprints are
compared through the points within half the threshold of them instead, of which any two that link share one; such a point has at most 65
fingerprints around it for two bits, so no group is unbounded and none is dropped.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like any other; fingerprints exactly at
the threshold link; repeated rows and copies share one fingerprint, which is compared once; rows whose doc_id is null belong to
their component but never name it; an empty table gives no rows; very long texts are hashed whole, in parts; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, chunks, table
from quillon.llm.components import connected_components, forest

THRESHOLD = 2
SHINGLE = 3
GROUP = 1024
SPAN = 1 << 16


def fingerprint(text: str | None) -> int:
    """Each bit that is set in over half the hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(SHINGLE, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends][: len(words) - size + 1]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), SPAN):
        part = [digest(joined[a : b - 1], 42) for a, b in zip(starts[at : at + SPAN], ends[at + size - 1 :])]
        ones += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Part:
    """A perfect code of ``width`` bits given by its syndromes: what separates a point from the anchors near it depends on its syndrome only.
    A word's syndrome is that of its lower half and that of its upper half together, so two small tables give them all."""

    def __init__(self, low: int, width: int, radius: int, column: list[int], beyond: int) -> None:
        """``column``: the syndrome of each bit. ``beyond``: how far past the radius anchors are listed."""
        self.low, self.mask, self.half = low, (1 << width) - 1, width // 2 + 1
        self.tables = [self.spanned(column[: self.half]), self.spanned(column[self.half :])]
        self.lists = []  # by excess: differences, sorted by syndrome, and where each syndrome's begin
        bits = np.array(column)
        near: list[tuple[np.ndarray, np.ndarray]] = []
        for weight in range(min(width, radius + beyond) + 1):
            chosen = list(combinations(range(width), weight))
            places = np.array(chosen, np.int64).reshape(len(chosen), weight)
            near.append(((1 << places).sum(axis=1), np.bitwise_xor.reduce(bits[places], axis=1)))
        for k in range(beyond + 1):
            own = near[: radius + 1] if k == 0 else near[radius + k : radius + k + 1]
            masks, syndromes = (np.concatenate([x[i] for x in own]) if own else np.zeros(0, np.int64) for i in range(2))
            order = np.argsort(syndromes, kind="stable")
            self.lists.append((masks[order].astype(np.uint64) << np.uint64(low), np.searchsorted(syndromes[order], np.arange(int(np.bitwise_or.reduce(bits)) + 2))))

    @staticmethod
    def spanned(column: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for c in column:
            out = np.concatenate([out, out ^ c])
        return out

    def syndrome(self, points: np.ndarray) -> np.ndarray:
        word = (points >> np.uint64(self.low)).astype(np.int64) & self.mask
        return self.tables[0][word & ((1 << self.half) - 1)] ^ self.tables[1][word >> self.half]


class CoveringCode:
    GOLAY = 0b110001110101  # generator polynomial of the binary Golay code of length 23

    def __init__(self, threshold: int = THRESHOLD) -> None:
        golay = []
        for bit in range(23):
            left = 1 << bit
            for high in range(22, 10, -1):
                if left >> high & 1:
                    left ^= self.GOLAY << (high - 11)
            golay.append(left)
        self.threshold = threshold
        self.parts = [Part(0, 23, 3, golay, threshold), Part(23, 23, 3, golay, threshold), Part(46, 15, 1, list(range(1, 16)), threshold), Part(61, 3, 1, [1, 2, 3], threshold)]

    def anchors(self, points: np.ndarray, beyond: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, whether it is the row's home) of every anchor within the covering radii plus ``beyond`` (the threshold), each once."""
        syndromes = [p.syndrome(points) for p in self.parts]
        rows, anchors, homes = [], [], []
        most = self.threshold if beyond is None else beyond
        for split in product(range(most + 1), repeat=len(self.parts)):
            if sum(split) > most:
                continue
            row, difference = np.arange(len(points)), np.zeros(len(points), np.uint64)
            for part, s, k in zip(self.parts, syndromes, split):
                masks, starts = part.lists[k]
                first = starts[s[row]]
                each = starts[s[row] + 1] - first
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                difference = np.repeat(difference, each) ^ masks[np.repeat(first, each) + place]
                row = np.repeat(row, each)
            rows.append(row)
            anchors.append(points[row] ^ difference)
            homes.append(np.full(len(row), sum(split) == 0))
        return np.concatenate(rows), np.concatenate(anchors), np.concatenate(homes)


def around(points: np.ndarray, radius: int) -> np.ndarray:
    """All points within ``radius`` bits of each: one row a point."""
    masks = [sum(1 << b for b in bits) for weight in range(radius + 1) for bits in combinations(range(64), weight)]
    return points[:, None] ^ np.array(masks, np.uint64)[None, :]


def long(column: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(column).view(np.int64))


_CODES: dict[int, CoveringCode] = {}


def links(distinct: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v): enough of the pairs of distinct fingerprints (``fp``) at most ``threshold`` bits apart to connect all that are linked."""

    def replicate(beyond: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if threshold not in _CODES:
                _CODES[threshold] = CoveringCode(threshold)
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    fp = whole.column("fp").to_numpy()[at : at + 512].view(np.uint64)
                    row, anchor, home = _CODES[threshold].anchors(fp, beyond)
                    yield pa.RecordBatch.from_arrays([long(anchor), long(fp[row]), pa.array(home)], ["anchor", "fp", "home"])

        return run

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                fp = whole.column("fp").to_numpy()[at : at + 2048].view(np.uint64)
                z = around(fp, (threshold + 1) // 2)
                yield pa.RecordBatch.from_arrays([long(z.ravel()), long(np.repeat(fp, z.shape[1]))], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of at most GROUP fingerprints each, one after another in two lists; all pairs of a batch's groups together."""
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                homes, fps = batch.column("homes"), batch.column("fps")
                n, m = (np.diff(c.offsets.to_numpy()).astype(np.int64) for c in (homes, fps))
                own, others = homes.flatten().to_numpy().view(np.uint64), fps.flatten().to_numpy().view(np.uint64)
                each = n * m
                place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                i = np.repeat(np.cumsum(n) - n, each) + place // np.repeat(m, each)
                j = np.repeat(np.cumsum(m) - m, each) + place % np.repeat(m, each)
                u, v = own[i], others[j]
                near = (u != v) & (np.bitwise_count(u ^ v) <= threshold)
                node, root = forest(u[near].view(np.int64), v[near].view(np.int64))
                far = node != root
                yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], ["u", "v"])

    schema = "anchor long, fp long, home boolean"
    homes = distinct.select("fp").mapInArrow(replicate(0), schema).select("anchor").distinct()
    homes = scratch.keep(homes)
    visits = distinct.select("fp").mapInArrow(replicate(threshold), schema).join(homes, "anchor")
    visits = scratch.keep(visits)
    sizes = scratch.keep(visits.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    near = scratch.keep(visits.join(sizes, "anchor"))
    scratch.drop(homes, visits, sizes)
    small = near.where(f"n <= {GROUP}").groupBy("anchor").agg(F.collect_list(F.when(F.col("home"), F.col("fp"))).alias("homes"), F.collect_list("fp").alias("fps"))
    found = small.mapInArrow(compare, "u long, v long")
    large = near.where(f"n > {GROUP}")
    if large.isEmpty():
        return found
    shared = large.select("fp").distinct().mapInArrow(points, "anchor long, fp long")
    return found.union(shared.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select(F.col("fps").alias("homes"), "fps").mapInArrow(compare, "u long, v long"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id that links reach) of every document."""
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs))
    classes = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = scratch.keep(connected_components(links(classes, scratch, threshold), scratch))
    rooted = scratch.keep(classes.join(labels, classes.fp == labels.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of_fp = scratch.keep(rooted.join(named, "root").select("fp", "component_id"))
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op10_simhash_covering(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_covering": op10_simhash_covering}
