"""Packing documents into sequences by non-negative least squares.

Documents are tokenized, cut at every full window, and what is left of each is a piece shorter than the
window.  Shallow combinations of piece lengths that fill a window are enumerated, the number of times to
use each is solved against the histogram of lengths by non-negative least squares and rounded down, and
the pieces left over are packed greedily.  All of this works on the histogram, which is bounded by the
window; pieces then find their places by their rank among the pieces of their length.  A full window is a sequence by itself
and isn't ranked; pieces of one length are ranked in shares of about RANKED pieces, so no length is ranked by one task.

Defined results: null text counts as empty; every document holds the separator id at least, so an empty one
is a piece of length 1; ties go by (doc_id, start); repeated documents are packed each on its own, and rows without an id as any other;
an empty table gives no rows; very long texts are read whole and cut; sequences are numbered from 0, those of full windows after all others with
gaps between; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import byte_symbols
from quillon.llm.common import Scratch, chunks, give_back, table

WINDOW = 2048
SEPARATOR = 1
#: Pieces of one length are ranked in shares of about so many.
RANKED = 65_536
MEMO_PIECES = 500_000

LOWER = "a-zß-öø-ÿ"
SIMPLE = re.compile(r"[\t-\r\x20-~À-ÖØ-öø-ÿ]*").fullmatch
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LOWER}]+|[0-9]|[^\s{LOWER}0-9]+").findall


class WordIds:
    """Ids of whole texts. A text of plain letters needs no normalizing but lower case: it is split into the pieces that are
    merged on their own, pieces go to the library's model as it spells them, and those met lately are remembered. Any other text goes
    to the library as it is."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.spelled = dict(enumerate(byte_symbols()))
        self.memo: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.memo) + len(pieces) > MEMO_PIECES:
            self.memo.clear()
        memo, merge, spelled = self.memo, self.merge, self.spelled
        for piece in pieces:
            if piece not in memo:
                memo[piece] = array("I", [t.id for t in merge(piece if piece.isascii() else piece.encode().decode("latin-1").translate(spelled))]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [PIECES(t.lower()) if SIMPLE(t) and "<|" not in t else None for t in texts]
        self.learn(set().union(*(pieces for pieces in split if pieces)))
        get = self.memo.__getitem__
        return [b"".join(map(get, pieces)) if pieces is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, pieces in zip(texts, split)]


_TOKENIZERS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, separator: int = SEPARATOR, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (binary): every document cut at each full window."""
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = WordIds(tokenizer)
        words = _TOKENIZERS[tokenizer]
        for batch in chunks(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")[: 5 + with_ids]}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                for at in range(0, len(ids), 4 * window):
                    part = ids[at : at + 4 * window]
                    for k, v in zip(out, (doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], list(out))
        words.memo.clear()  # waiting workers hold no pieces
        give_back()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 of least |a x - b|, by accelerated projected gradient steps from zero."""
    step = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / nt * (new - x), new, nt
    return x


def combinations(have: np.ndarray, window: int, depth: int = 3, per_length: int = 4) -> list[tuple[int, ...]]:
    """Combinations of at most ``depth`` lengths that fill the window: for each length the partners of which most pieces exist."""
    lengths = np.flatnonzero(have)
    found = {(window,)} if have[window] else set()
    for n in lengths:
        rest = window - n
        if 0 < rest <= n and have[rest]:
            found.add((int(n), int(rest)))
        if depth < 3:
            continue
        mid = lengths[(lengths <= min(n, rest - 1))]
        mid = mid[(rest - mid <= mid)]
        mid = mid[have[rest - mid] > 0]
        best = mid[np.argsort(-np.minimum(have[mid], have[rest - mid]), kind="stable")][:per_length]
        found |= {(int(n), int(m), int(rest - m)) for m in best}
    return sorted(found, reverse=True)


def solve(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of sequences that hold every piece of the histogram once."""
    have = np.zeros(window + 1, np.int64)
    for n, count in histogram.items():
        have[n] = count
    left, plan = have.copy(), []
    if left[window]:
        plan.append(((window,), int(left[window])))
        left[window] = 0
    shapes = combinations(left, window)
    if shapes:
        rows = np.flatnonzero(left)
        at = {n: i for i, n in enumerate(rows.tolist())}
        a = np.zeros((len(rows), len(shapes)))
        for j, shape in enumerate(shapes):
            for n in shape:
                a[at[n], j] += 1
        weight = 1 / np.sqrt(np.maximum(left[rows], 1))
        times = np.floor(nnls(a * weight[:, None], left[rows] * weight) + 1e-6).astype(np.int64)
        for j in np.argsort(-times, kind="stable"):
            shape = shapes[j]
            uses = {n: shape.count(n) for n in shape}
            n_times = min([int(times[j]), *(int(left[n]) // k for n, k in uses.items())])
            if n_times > 0:
                plan.append((shape, n_times))
                for n, k in uses.items():
                    left[n] -= k * n_times
    # Greedily: the longest piece, then again and again the longest that still fits; the shape is repeated as often as pieces last.
    while left.any():
        shape, room = [], window
        free = left.copy()
        while room > 0 and len(fit := np.flatnonzero(free[: room + 1])):
            n = int(fit[-1])
            shape.append(n)
            free[n] -= 1
            room -= n
        uses = {n: shape.count(n) for n in shape}
        n_times = min(int(left[n]) // k for n, k in uses.items())
        plan.append((tuple(shape), n_times))
        for n, k in uses.items():
            left[n] -= k * n_times
    return plan


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, offset): the pieces of a length with these ranks lie in consecutive sequences."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for shape, times in plan:
        offset = 0
        for n in shape:
            out.append((n, used[n], used[n] + times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, separator: int = SEPARATOR, scratch: Scratch | None = None) -> DataFrame:
    """Every piece with sequence_id and offset. The ids are left out: (doc_id, start, length) tells them, ids_crc32 proves them."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    kept = scratch.keep(pieces(docs, tokenizer, window, separator, with_ids=False))
    histogram = {r.length: r.n for r in kept.where(F.col("length") < window).groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer rows than the window
    shares = {n: -(-count // RANKED) for n, count in histogram.items()}
    split = F.broadcast(spark.createDataFrame(sorted(shares.items()), "length long, shares long"))  # as few
    share = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("shares"))
    short = kept.join(split, "length").withColumn("share", share)
    first = {n: np.zeros(k, np.int64) for n, k in shares.items()}  # how many pieces of a length lie in the shares before each
    for r in short.where("shares > 1").groupBy("length", "share").agg(F.count("*").alias("n")).collect():  # a row for each share, one share for RANKED pieces
        first[r.length][r.share] = r.n
    first = {n: np.cumsum(c) - c for n, c in first.items()}
    plan = solve(histogram, window)
    spans: dict[int, list] = defaultdict(list)
    for n, low, _, sequence, offset in places(plan):
        spans[n].append((low, sequence, offset))
    shared = spark.sparkContext.broadcast({n: (first[n], *np.array(v, np.int64).T) for n, v in spans.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, own, r = (batch.column(c).to_numpy() for c in ("length", "share", "r"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                before, low, base, at = shared.value[n]
                rows = np.flatnonzero(length == n)
                rank = before[own[rows]] + r[rows] - 1
                i = np.searchsorted(low, rank, "right") - 1
                sequence[rows], offset[rows] = base[i] + rank - low[i], at[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), pa.array(sequence), pa.array(offset)], [*COLUMNS, "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    ranked = short.withColumn("r", F.expr("row_number() over (partition by length, share order by doc_id, start, ids_crc32)"))
    full = kept.where(F.col("length") == window).select(*COLUMNS, (F.monotonically_increasing_id() + sum(times for _, times in plan)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(place, schema).union(full)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def op1_nnls_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op1_nnls_packing": op1_nnls_packing}
