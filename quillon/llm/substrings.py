"""Exact substring dedup by seed and extend.

Documents are sequences of words. Anchors are winnowed runs of GRAM words: every window of ``window`` words
has one, the least hash among its runs, so equal windows have equal anchors at equal places.  Documents are
joined on anchors that occur twice or more.  Each occurrence is a seed and is extended both ways as far as its windows reach:
occurrences with equal surroundings are one class, whose first occurrence is the source of all others. Where one anchor
has different surroundings, the windows of the classes' first occurrences are compared one by one, so a match is found up
to its exact ends.  Matches of a document with the same source, along the same shift, are then extended through each other
while they touch, over any number of anchors: these are the maximal repeats, of at least ``window`` words, and what they cover is cut.

Defined results: null and empty text has no words; texts shorter than the window lose nothing; rows of one doc_id are one document, so
repeated rows are not earlier than each other, and where their texts differ a word is cut from each row at the places that were
found in any; of equal windows the first by doc_id, then place, is the source; rows with a null doc_id keep all words and
count as nobody's earlier document; an empty table gives no rows; very long texts are read whole; other columns are kept
as they are by ``remove_repeats`` and ignored otherwise, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, chunks, table

WINDOW = 20
GRAM = 5
SPAN = 1 << 21

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits without visible structure."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)])) for b in (self.base, self.inverse))
        return self.up, self.down


POWERS = [Powers(b) for b in (0x9E3779B97F4A7C15 | 3, 0xD6E8FEB86659FD93 | 3, 0xA0761D6478BD642F | 3, 0xE7037ED1A0B428DB | 3)]
BYTES = [mix(np.arange(256, dtype=U) + U(256 * k)) for k in range(2)]


class Rolling:
    """Hashes of any run of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, powers: Powers) -> None:
        self.up, self.down = powers.upto(len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(values * self.up[: len(values)], dtype=U)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


class Words:
    """The words of a chunk of texts: two independent hashes each, and where each text's words start."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        start, end = edge[0::2], edge[1::2]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(start, bounds)  # of each text, and the number of words
        self.hashes = [Rolling(table[data], powers).of(start, end) for table, powers in zip(BYTES, POWERS)]
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, ...]:
        """For each anchor: text, place, hash, hash of its surroundings; windows start from place - a to place - b."""
        n = len(self.text)
        if n < window:
            return tuple(np.zeros(0, t) for t in (int, int, U, U, int, int))
        left, right = Rolling(self.hashes[0], POWERS[2]), Rolling(self.hashes[1], POWERS[3])
        at = np.arange(n - gram + 1)
        grams = left.of(at, at + gram)
        start = np.flatnonzero(self.text[: n - window + 1] == self.text[window - 1 :])
        view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
        place = np.concatenate([start[i : i + SPAN] + view[start[i : i + SPAN]].argmin(axis=1) for i in range(0, max(1, len(start)), SPAN)])
        if not len(start):
            return tuple(np.zeros(0, t) for t in (int, int, U, U, int, int))
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(self.text[start], prepend=-1) != 0))
        low, high, place = start[new], start[np.append(new[1:], len(start)) - 1], place[new]
        around = mix(right.of(low, high + window) ^ mix((place - low).astype(U) * U(1 << 20) + (place - high).astype(U)))
        text = self.text[low]
        return text, place - self.first[text], grams[place], around, place - low, place - high


def as_bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of each document with one source along one shift, extended through each other where they touch."""
    kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("source", pa.int64()), ("source_low", pa.int32())]))
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            spans = batch.column("spans")
            size = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten()
            low, high, source, origin = (flat.field(i).to_numpy().astype(np.int64) for i in range(4))
            row, shift = np.repeat(np.arange(len(size)), size), low - origin
            order = np.lexsort((low, shift, source, row))
            row, shift, source, low, high = (x[order] for x in (row, shift, source, low, high))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])
            group = np.cumsum(new) - 1
            wide = int(high.max(initial=0)) + 1
            reach = np.maximum.accumulate(high + group * wide) - group * wide  # the furthest end so far along this shift
            new[1:] |= low[1:] > reach[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1
            made = pa.StructArray.from_arrays([pa.array(low[first].astype(np.int32)), pa.array(reach[last].astype(np.int32)), pa.array(source[first]), pa.array((low - shift)[first].astype(np.int32))], fields=list(kind.value_type))
            offsets = np.searchsorted(row[first], np.arange(len(size) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), made)], ["doc_id", "spans"])


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, spans): for each document that loses words, its maximal repeats: word ranges [low, high) that lie in the document ``source`` from
    ``source_low`` on, earlier. Repeats of different sources may overlap."""
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def winnow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            text, place, h, c, a, b = Words(as_bytes(batch)).anchors(window, gram)
            doc = batch.column("doc_id").to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), *(pa.array(x.astype(np.int32)) for x in (place, a, b))], ["h", "c", "doc_id", "place", "a", "b"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(as_bytes(batch))
            starts = [np.zeros(0, int)]
            for i, seeds in enumerate(batch.column("seeds").to_pylist()):
                low = np.array([s["place"] - s["a"] for s in seeds])
                size = np.array([s["a"] - s["b"] + 1 for s in seeds])
                run = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                starts.append(np.unique(run) + words.first[i])
            start = np.concatenate(starts)
            start = start[start + window <= len(words.text)]  # rows of one doc_id whose texts differ
            g = [Rolling(h, p).of(start, start + window).view(np.int64) for h, p in zip(words.hashes, POWERS[2:])]
            text = words.text[start]
            yield pa.RecordBatch.from_arrays([pa.array(g[0]), pa.array(g[1]), pa.array(batch.column("doc_id").to_numpy()[text]), pa.array((start - words.first[text]).astype(np.int32))], ["g1", "g2", "doc_id", "start"])

    anchors = docs.mapInArrow(winnow, "h long, c long, doc_id long, place int, a int, b int")
    repeated = scratch.keep(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    seeds = scratch.keep(anchors.join(repeated, "h"))
    classes = scratch.keep(seeds.groupBy("h", "c").agg(F.min(F.struct("doc_id", "place", "a", "b")).alias("first"), F.count("*").alias("n")))
    whole = seeds.join(classes.where("n > 1").select("h", "c", "first"), ["h", "c"]).where("doc_id <> first.doc_id or place <> first.place")
    covered = scratch.keep(whole.selectExpr("doc_id", "place - a as low", f"place - b + {window} as high", "first.doc_id as source", "first.place - first.a as source_low"))
    varied = scratch.keep(classes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    firsts = classes.join(varied, "h", "left_semi").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("first.place", "first.a", "first.b")).alias("seeds"))
    windows = scratch.keep(docs.join(scratch.keep(firsts), "doc_id").mapInArrow(extend, "g1 long, g2 long, doc_id long, start int"))
    scratch.drop(repeated, seeds, varied)
    earliest = scratch.keep(windows.groupBy("g1", "g2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("g1", "g2", "first"))
    single = windows.join(earliest, ["g1", "g2"]).where("doc_id <> first.doc_id or start <> first.start").selectExpr("doc_id", "start as low", f"start + {window} as high", "first.doc_id as source", "first.start as source_low")
    matched = covered.union(single).groupBy("doc_id").agg(F.collect_list(F.struct("low", "high", "source", "source_low")).alias("spans"))
    spans = scratch.keep(matched.mapInArrow(maximal, "doc_id long, spans array<struct<low: int, high: int, source: long, source_low: int>>"))
    scratch.drop(windows, earliest, covered, classes)
    return spans


def kept_words(text: str | None, spans: list | None) -> tuple[list[bytes], np.ndarray]:
    words = (text or "").encode().split()
    change = np.zeros(len(words) + 1, np.int64)
    if spans:
        low, high = (np.minimum(np.array([s[k] for s in spans]), len(words)) for k in ("low", "high"))
        np.add.at(change, low, 1)
        np.add.at(change, high, -1)
    return words, np.cumsum(change[:-1]) == 0


def with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name, which none of theirs has."""
    name = "_spans"
    while name in docs.columns or f"{name}_doc" in docs.columns:
        name += "_"
    found = spans.select(F.col("doc_id").alias(f"{name}_doc"), F.col("spans").alias(name))
    return docs.join(found, F.col("doc_id").cast("long") == F.col(f"{name}_doc"), "left").drop(f"{name}_doc"), name


def digest(docs: DataFrame, spans: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            total, removed, shas = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist()):
                words, keep = kept_words(text, found)
                total.append(len(words))
                removed.append(int(len(words) - keep.sum()))
                left = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
                shas.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(docs, spans)[0].mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``: the words left are joined by a space, untouched texts stay as they are.
    A column n_chars follows the text where there is one, and documents of which nothing is left go."""
    spans = find_repeats(docs, window, gram, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts, gone = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column(extra).to_pylist()):
                if found:
                    words, keep = kept_words(text, found)
                    gone.append(bool(len(words)) and not keep.any())
                    text = b" ".join(w for w, k in zip(words, keep.tolist()) if k).decode()
                else:
                    gone.append(False)
                texts.append(text)
            made = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            out = pa.RecordBatch.from_arrays([made[n] if n == "text" or n == "n_chars" and spans_of[i] else batch.column(n) for i, n in enumerate(names)], names)
            yield out.filter(pa.array([not g for g in gone], pa.bool_()))

    names = docs.columns
    changed, extra = with_spans(docs, spans)
    spans_of = [n == "n_chars" and dict(docs.dtypes)[n] == "bigint" for n in names]
    return changed.mapInArrow(run, docs.schema)


def op7_seed_extend(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(docs, find_repeats(docs))


QUERIES = {"op7_seed_extend": op7_seed_extend}
