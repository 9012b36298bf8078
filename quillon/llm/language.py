"""Language identification by a linear-chain conditional random field over words.

A word's features are its character n-grams with marked ends (so the outer ones are its affixes) and the word itself
(the lexicon), hashed into weights for every language; neighbouring words are tied by learned transitions.  The chain of
a line of text is labelled by forward-backward, so text that switches between languages gets a distribution for each word;
a document's language is the one with the largest mean probability over its words.

Defined results: null text, empty text and text without any letter is ``und`` with score 0 (numbers that aren't decimal digits, as in
``½ ²``, aren't letters), and so is everything in ``predict`` when no labelled row can be learnt from, while ``keep_known`` then keeps
every text that has a letter; repeated rows are labelled each on its own and alike; ties go to the language that sorts first; an empty
table gives no rows; very long texts are read whole, one at a time; other columns are ignored by ``predict``, whatever their names, and
kept as they are by ``keep_known``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, chunks, table, thinned

#: Parameters. The model is fitted on at most SAMPLE labelled rows, picked by hash; their whole texts are cut into passages of PASSAGE
#: words, of which it sees at most PASSAGES, picked by hash among all of them.
SAMPLE = 2000
PASSAGE = 80
PASSAGES = 12_000
CHAIN = 40
BUCKETS = 1 << 16
LONGEST = 4
STEPS = 320
MEMO_WORDS = 250_000

UND = "und"


def other_numbers() -> str:
    """Characters that count as alphanumeric but are neither letters nor decimal digits, as ranges of a character class."""
    points = [c for c in range(sys.maxunicode + 1) if (s := chr(c)).isnumeric() and not s.isalpha() and not s.isdecimal()]
    starts = [c for c, before in zip(points, [-1, *points]) if c != before + 1]
    ends = [c for c, after in zip(points, [*points[1:], -1]) if after != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


LETTERS = re.compile(rf"[^\W\d_{other_numbers()}]+|\n").findall
NEARLY = re.compile(r"[^\W\d_]+|\n").findall  # much faster, but takes these numbers for letters


def tokens_of(texts: list[str]) -> tuple[list[list[str]], set[str]]:
    """Runs of letters, and line breaks, of each text in lower case, and the different ones."""
    found = [NEARLY(t.lower()) for t in texts]
    different = set().union(*found)
    if odd := {w for w in different if not w.isalpha() and w != "\n"}:
        found = [LETTERS(t.lower()) if not odd.isdisjoint(f) else f for t, f in zip(texts, found)]
        different = set().union(*found)
    return found, different


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words one after another, where each word's begin)."""
    text = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(first + sizes, sizes) - np.arange(len(points))  # characters from here to the word's end
    found, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        ok = left[: len(h)] >= n
        found.append(h[ok])
        owners.append(owner[: len(h)][ok])
    powers = np.multiply.accumulate(np.full(int(sizes.max(initial=1)), 0xD6E8FEB86659FD93, np.uint64))
    place = np.arange(len(points)) - first[owner]
    found.append(np.add.reduceat(points * powers[place], first) if len(words) else h)
    owners.append(np.arange(len(words)))
    key, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    key = key[order]
    key ^= key >> np.uint64(29)
    bucket = (key * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 16)
    return bucket.astype(np.int64), np.searchsorted(owner[order], np.arange(len(words)))


def forward_backward(e: np.ndarray, start: np.ndarray, size: np.ndarray, move: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Marginals of each word. Scores e by word; chains lie at start .. start + size; all chains step together.
    The expected number of each transition is added to ``pairs``."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    start, size = start[size > 0], size[size > 0]
    x, m = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32), np.exp(move).astype(np.float32)
    alpha, beta = np.empty_like(x), np.empty_like(x)
    if not len(start):
        return alpha
    ends = np.searchsorted(-size, -np.arange(int(size[0])))  # the number of chains longer than t
    state = None
    for t, live in enumerate(ends.tolist()):
        at = start[:live] + t
        state = x[at] if t == 0 else (state[:live] @ m) * x[at]
        state /= state.sum(axis=1, keepdims=True)
        alpha[at] = state
    state = np.ones((0, x.shape[1]), np.float32)
    for t in range(len(ends) - 1, -1, -1):
        live = int(ends[t])
        at = start[:live] + t
        grown = np.ones((live, x.shape[1]), np.float32)
        if len(state):
            back = (state * x[start[: len(state)] + t + 1]) @ m.T
            grown[: len(state)] = back / back.sum(axis=1, keepdims=True)
        state = grown
        beta[at] = state
    if pairs is not None:
        inner = np.ones(len(x), bool)
        inner[start] = False
        now = np.flatnonzero(inner)
        both = alpha[now - 1][:, :, None] * m * (x[now] * beta[now])[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    alpha *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha


class Model:
    def __init__(self, langs: list[str]) -> None:
        self.langs = langs
        self.weights = np.zeros((BUCKETS, len(langs)), np.float32)
        self.move = np.zeros((len(langs), len(langs)), np.float32)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {"\n": 0}
        self.scores = np.zeros((1, len(self.langs)), np.float32)

    def __getstate__(self) -> dict:
        self.forget()
        return self.__dict__

    def score(self, words: list[str]) -> np.ndarray:
        bucket, first = features(words)
        return np.add.reduceat(self.weights[bucket], first, axis=0) if words else np.zeros((0, len(self.langs)), np.float32)

    def learn(self, words: set[str]) -> None:
        """Scores of words met lately are remembered, at most MEMO_WORDS of them."""
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.forget()
        new = sorted(words - self.memo.keys())
        parts = [self.scores]
        for at in range(0, len(new), 20_000):
            parts.append(self.score(new[at : at + 20_000]))
        if new:
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
            self.scores = np.concatenate(parts)

    def label(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[str]]]:
        """Marginals of each text's words, and the words."""
        tokens, different = tokens_of(texts)
        self.learn(different)
        index = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(tokens)), np.int64, sum(map(len, tokens)))
        owner = np.repeat(np.arange(len(texts)), list(map(len, tokens)))
        word = index > 0
        line = np.cumsum(~word)[word]
        owner, e = owner[word], self.scores[index[word]]
        n = len(owner)
        new = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        gamma = forward_backward(e, new, np.diff(np.append(new, n)), self.move) if n else e
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [gamma[a:b] for a, b in zip(bounds, bounds[1:])], tokens

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for gamma in self.label(texts)[0]:
            mean = gamma.mean(axis=0, dtype=np.float64) if len(gamma) else None
            best = int(mean.argmax()) if mean is not None else -1
            langs.append(self.langs[best] if best >= 0 else UND)
            scores.append(min(1.0, float(mean[best])) if best >= 0 else 0.0)
        return langs, scores

    def fit(self, texts: list[list[str]], labels: list[int], steps: int = STEPS, batch: int = 64, rate: float = 0.3, seed: int = 0) -> None:
        """Adaptive gradient steps on the likelihood of the labels of chains of words; some chains switch between two rows."""
        rng = np.random.default_rng(seed)
        vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        bucket, first = features(list(vocabulary))
        ends = np.append(first[1:], len(bucket))
        rows = [np.array([vocabulary[w] for w in t]) for t in texts]
        by = [np.flatnonzero(np.array(labels) == k) for k in range(len(self.langs))]
        by = [b for b in by if len(b)]
        squared, squared_move = np.full_like(self.weights, 1e-3), np.full_like(self.move, 1e-3)
        for _ in range(steps):
            words, tags, sizes = [], [], []
            for _ in range(batch):
                size = 0
                for _ in range(1 + (rng.random() < 0.3)):
                    i = int(rng.choice(by[rng.integers(len(by))]))
                    at = int(rng.integers(0, max(1, len(rows[i]) - CHAIN // 2)))
                    part = rows[i][at : at + int(rng.integers(1, CHAIN))]
                    words.append(part)
                    tags.append(np.full(len(part), labels[i]))
                    size += len(part)
                sizes.append(size)
            word, tag, size = np.concatenate(words), np.concatenate(tags), np.array(sizes)
            start = np.cumsum(size) - size
            length = ends[word] - first[word]
            flat = bucket[np.repeat(first[word] - np.cumsum(length) + length, length) + np.arange(length.sum())]
            e = np.add.reduceat(self.weights[flat], np.cumsum(length) - length, axis=0)
            pair = np.zeros_like(self.move)
            gamma = forward_backward(e, start, size, self.move, pair)
            grad = gamma.copy()
            grad[np.arange(len(tag)), tag] -= 1
            used, inverse = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(inverse, np.repeat(grad[:, k], length), len(used)) for k in range(len(self.langs))], axis=1) / batch + 1e-4 * self.weights[used]
            squared[used] += g * g
            self.weights[used] -= rate * g / np.sqrt(squared[used])
            inner = np.ones(len(tag), bool)
            inner[start] = False
            now = np.flatnonzero(inner)
            np.add.at(pair, (tag[now - 1], tag[now]), -1)
            pair /= batch
            squared_move += pair * pair
            self.move -= rate * 0.2 * pair / np.sqrt(squared_move)


def held_out() -> F.Column:
    return F.expr("crc32(cast(doc_id as string)) % 5 = 0")


def train(docs: DataFrame, sample: int = SAMPLE, passages: int = PASSAGES, scratch: Scratch | None = None) -> Model | None:
    """Fitted on passages of rows picked by hash among the labelled ones that aren't held out; None where there is none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: list[tuple] = []
            for h, lang, found in zip(batch.column("h").to_pylist(), batch.column("lang").to_pylist(), tokens_of(batch.column("text").to_pylist())[0]):
                words = [w for w in found if w != "\n"]
                out += [(h, i, lang, " ".join(words[i : i + PASSAGE])) for i in range(0, len(words), PASSAGE)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["h", "place", "lang", "words"])

    labelled = docs.where(~held_out()).where("text is not null and lang is not null").select(F.xxhash64("doc_id").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    marked = docs.where(~held_out()).where("lang is not null").select("doc_id")
    few = thinned(marked, ["doc_id"], sample, marked.count())
    picked = few.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # texts of the rows under this hash only are read
    if picked is None:
        return None
    scratch = scratch or Scratch(docs.sparkSession, "language")
    each = scratch.keep(labelled.where(F.col("h") <= picked).mapInArrow(cut, "h long, place long, lang string, words string"))
    rows = thinned(each, ["h", "place", "words"], passages, each.count()).orderBy(F.xxhash64("h", "place", "words"), "words", "lang").limit(passages).collect()
    scratch.drop(each)
    if not rows:
        return None
    model = Model(sorted({r.lang for r in rows}))
    model.fit([r.words.split(" ") for r in rows], [model.langs.index(r.lang) for r in rows])
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores = shared.value.predict(texts) if shared.value else ([UND] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose words' languages are told: those where the mean, over the words, of the surest label's probability is
    ``least`` or more, so that a text in several languages stays. Text without letters goes; without a model nothing else does."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if shared.value:
                keep = [len(g) > 0 and float(g.max(axis=1).mean()) >= least for g in shared.value.label(texts)[0]]
            else:
                keep = [any(w != "\n" for w in found) for found in tokens_of(texts)[0]]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op6_word_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_word_crf": op6_word_crf}
