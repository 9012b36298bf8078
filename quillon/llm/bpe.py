"""BPE encoding and decoding over a minimal acyclic transducer lexicon.

The frequent words of the whole corpus are compiled, with their ids, into a minimal acyclic automaton
(shared prefixes and suffixes).  Every arc carries an integer output; the outputs on a word's path add up
to the word's number in the lexicon, whose row in a flat table holds its ids.  The automaton is a few flat
arrays that each worker maps into memory and walks as they are: an arc is found by binary search for its state and label.
Words that the lexicon lacks are merged exactly by rank, long ones with a heap.

Defined results: null text counts as empty; an empty text has no ids; of equal ranks the leftmost pair is merged first; repeated
rows are encoded alike; an empty table gives no rows; very long texts and words are read whole, in time that grows little
more than with their length; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, chunks, table

#: Parameters. LEXICON_WORDS bounds the lexicon and so what is broadcast; SKETCH_WORDS bounds what a task counts with.
LEXICON_WORDS = 32_768
SKETCH_WORDS = 100_000
MEMO_WORDS = 300_000
#: Words of more bytes are merged with a heap, shorter ones by looking at all pairs, which is faster for them; the ids are the same.
SHORT_WORD = 64

#: The byte-level split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same pattern over texts of printable ASCII, tab to carriage return and the letters of Latin-1.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
SIMPLE = re.compile(rf"[\t-\r\x20-~{LATIN}]*").fullmatch
SIMPLE_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+").findall
ALL_WORDS = regex.compile(PATTERN).findall


def words_of(text: str) -> list[str]:
    """The pieces that are merged on their own."""
    return SIMPLE_WORDS(text) if SIMPLE(text) else ALL_WORDS(text)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1 ones stand for themselves, the rest follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Merger:
    """The vocabulary file: exact merging by rank, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.rank: dict[int, tuple[int, int]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = (n, vocab[a + b])

    def merge(self, word: bytes) -> list[int]:
        """Merges the adjacent pair of least rank, leftmost first, until none is known."""
        if len(word) > SHORT_WORD:
            return self.merge_long(word)
        ids, rank = [self.first[b] for b in word], self.rank
        none = (1 << 60, -1)
        found = [rank.get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i, n = found.index(best), best[1]
            ids[i : i + 2] = [n]
            del found[i]
            if i:
                found[i - 1] = rank.get(ids[i - 1] << 32 | n, none)
            if i < len(found):
                found[i] = rank.get(n << 32 | ids[i + 1], none)
        return ids


    def merge_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list; pairs that no longer stand are passed over."""
        ids, rank = [self.first[b] for b in word], self.rank
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank.get(a << 32 | b))]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            new = ids[i] = rank[a << 32 | b][1]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if r := rank.get(new << 32 | ids[k]):
                    heappush(heap, (r[0], i, new, ids[k]))
            if (h := before[i]) >= 0 and (r := rank.get(ids[h] << 32 | new)):
                heappush(heap, (r[0], h, ids[h], new))
        return [x for x in ids if x >= 0]


class Lexicon:
    """A minimal acyclic transducer: words (bytes) to numbers, numbers to ids.

    Arrays: ``step`` (of each arc, in order: state * 256 + label), ``to`` and ``out`` (of each arc), ``final`` (of
    each state), ``start`` and ``ids`` (rows of ids).
    """

    NAMES = ("step", "to", "out", "final", "start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray], root: int) -> None:
        self.root = root
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, words: Iterable[bytes], ids: dict[bytes, list[int]]) -> Lexicon:
        """Adds words in order; every finished tail is replaced with an equal state met before."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        ordered = sorted(set(words))
        path: list[list] = [[False, []]]  # [final, arcs]; the nodes of the last word
        last = b""
        for word in ordered:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            for depth in range(len(last), common, -1):
                path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
            for _ in word[common:]:
                path.append([False, []])
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
        root = freeze(path[0])
        # The number of words from each state on gives the arcs' outputs; states were frozen children first.
        count = [0] * len(states)
        step, to, out = [], [], []
        for s, (final, arcs) in enumerate(states):
            n = int(final)
            for byte, target in arcs:
                step.append(s * 256 + byte)
                to.append(target)
                out.append(n)
                n += count[target]
            count[s] = n
        rows = [ids[w] for w in ordered]
        arrays = {
            "step": np.array(step, np.int64), "to": np.array(to, np.int32), "out": np.array(out, np.int32), "final": np.array([f for f, _ in states], np.uint8),
            "start": np.cumsum([0, *map(len, rows)]).astype(np.int32), "ids": np.array([i for r in rows for i in r], np.uint32),
        }
        return cls(arrays, root)

    def dumps(self) -> bytes:
        parts = [getattr(self, n) for n in self.NAMES]
        head = json.dumps({"root": self.root, "arrays": [[n, p.dtype.str, len(p)] for n, p in zip(self.NAMES, parts)]}).encode()
        body = b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)
        return len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8) + body

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Maps the arrays read-only: from a file that lies in memory and has no name or folder, where the system has such files."""
        if hasattr(os, "memfd_create"):
            with os.fdopen(os.memfd_create("lexicon"), "r+b") as f:
                f.write(data)
                f.flush()
                view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            view = mmap.mmap(-1, len(data))
            view.write(data)
        size = int.from_bytes(view[:8], "little")
        head = json.loads(view[8 : 8 + size])
        at, arrays = 8 + size + -size % 8, {}
        for name, dtype, n in head["arrays"]:
            arrays[name] = np.frombuffer(view, dtype, n, at)
            at += arrays[name].nbytes + -arrays[name].nbytes % 8
        return cls(arrays, head["root"])

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that aren't in the lexicon; all words step together."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        sizes, data = sizes[order], np.frombuffer(b"".join(words) or b"\0", np.uint8)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, n))])[:-1][order]
        state, number = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        depth = 0
        while len(live := live[sizes[live] > depth]):
            wanted = state[live] * 256 + data[at[live] + depth]
            arc = np.searchsorted(self.step, wanted)
            known = arc < len(self.step)
            known[known] = self.step[arc[known]] == wanted[known]
            state[live[~known]] = -1
            live, arc = live[known], arc[known]
            number[live] += self.out[arc]
            state[live] = self.to[arc]
            depth += 1
        ok = state >= 0
        ok[ok] = self.final[state[ok]] > 0
        result = np.empty(n, np.int64)
        result[order] = np.where(ok, number, -1)
        return result


class Encoder:
    """Texts to ids and back. Words met lately are remembered, at most MEMO_WORDS of them."""

    def __init__(self, merger: Merger, lexicon: Lexicon | None) -> None:
        self.merger, self.lexicon = merger, lexicon
        self.memo: dict[str, bytes] = {}
        self.split = re.compile("(" + "|".join(map(re.escape, merger.special)) + ")").split if merger.special else None

    def learn(self, words: set[str]) -> None:
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        raw = [w.encode() for w in new]
        found = self.lexicon.find(raw).tolist() if self.lexicon and new else [-1] * len(new)
        for word, b, n in zip(new, raw, found):
            ids = self.lexicon.ids[self.lexicon.start[n] : self.lexicon.start[n + 1]] if n >= 0 else np.array(self.merger.merge(b), "<u4")
            self.memo[word] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers. Special tokens' strings become their ids."""
        split: list[list[str]] = []
        wanted: set[str] = set()
        for text in texts:
            if self.split and "<|" in text:
                words = []
                for i, part in enumerate(self.split(text)):
                    words += [part] if i % 2 else words_of(part)
            else:
                words = words_of(text)
            split.append(words)
            wanted.update(words)
        self.learn(wanted - self.merger.special.keys())
        special = {t: i.to_bytes(4, "little") for t, i in self.merger.special.items()}
        get = (self.memo | special).__getitem__ if special.keys() & wanted else self.memo.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merger.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple, Encoder] = {}


def frequent_words(docs: DataFrame, n: int = LEXICON_WORDS) -> list[str]:
    """The n most frequent words over all documents.

    Each task keeps a bounded frequent-items summary of everything it reads (counts of at most 2 * SKETCH_WORDS words;
    when full, the median count is subtracted from all), the summaries are added up by word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in chunks(batches):
            for text in batch.column("text").to_pylist():
                total.update(words_of(text or ""))
            if len(total) > 2 * SKETCH_WORDS:
                cut = sorted(total.values(), reverse=True)[SKETCH_WORDS]
                total = Counter({w: c - cut for w, c in total.items() if c > cut})
        words = [w for w in total if len(w) <= 64]
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array([total[w] for w in words], pa.int64())})

    counted = docs.select("text").mapInArrow(count, "word string, n long").where("n > 1")
    summed = Scratch(docs.sparkSession, "words").keep(counted.groupBy("word").agg(F.sum("n").alias("n")))
    # The driver gets little more than it keeps: words of the bins of counts (a few hundred at most) that hold the first n.
    bins = summed.groupBy(F.floor(8 * F.log2("n")).cast("int").alias("bin")).agg(F.count("*").alias("k"), F.min("n").alias("low")).orderBy(F.desc("bin")).collect()
    met, least = 0, 0
    for r in bins:
        met, least = met + r.k, r.low
        if met >= n:
            break
    top = summed.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(n)
    return [r.word for r in top.collect()]


def encode_documents(docs: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary, UTF-8) of every document."""
    spark = docs.sparkSession
    merger = Merger(tokenizer)
    words = [w.encode() for w in frequent_words(docs, lexicon_words)]
    lexicon = Lexicon.build(words, {w: merger.merge(w) for w in words})
    shared, made = spark.sparkContext.broadcast(lexicon.dumps()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, made)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(Merger(tokenizer), Lexicon.mapped(shared.value))
        encoder = _ENCODERS[key]
        for batch in chunks(batches):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(encoder.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op8_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op8_bpe_transducer": op8_bpe_transducer}
