"""Secret scans by a battery of randomness tests.

Besides fixed patterns (base spans), every long token of a text is a candidate, where no known alphabet holds all of it each long run
between its signs. Its encoding is inferred from its letters; chi-squared uniformity of that alphabet, the runs test around its
middle and the lag-one serial correlation are combined into one p-value for "drawn at random", and the chi-squared
statistic is held against what ordinary writing of that length gives.  The latter p-values, weighted by length, are put under
false-discovery control over the whole corpus: their histogram is of a fixed number of bins, whatever the size, and the bound is
an edge of a bin, so at most a bin's width (a factor of 1.15) stricter than asked for.

Not tested, as these tests can't tell them from words and numbers: digits alone, letters of one case alone, and letters of both cases
whose only capital is the first. Defined results: null and empty text have no spans, and base_sha256 is then that of the empty
string; candidates that meet a base span count in the control and aren't added; candidates never overlap each other; repeated rows are
scanned each on its own and count each in the control; an empty table gives no rows; very long texts and tokens are read whole,
in time that grows with their length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, chunks, table

#: Parameters of the battery.
ALPHA = 0.001
RATE = 0.01
SHORTEST = 20
BINS = 200

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").finditer
ACCESS = re.compile(r"AKIA[A-Z0-9]+").finditer
HEX = re.compile(r"[0-9a-f]{16,}").finditer  # the longest runs, as with + and a filter
TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}").finditer
KINDS = ("assign", "access", "hex", "random")

#: Alphabets by name, and the share of chi-squared per letter that ordinary writing adds (alphabet size times its index of coincidence, less one).
ENCODINGS = (
    ("hex", "0123456789abcdef", 1.2),
    ("hex", "0123456789ABCDEF", 1.2),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.1),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", 1.4),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1.4),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.0),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.2),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 3.2),
)
HOLDS = tuple(frozenset(e[1]) for e in ENCODINGS)
PLACES = tuple(np.array([e[1].find(chr(c)) for c in range(128)]) for e in ENCODINGS)
RUN = re.compile(rf"[A-Za-z0-9+]{{{SHORTEST},}}").finditer


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX(text)]
    return sorted(found)


def tail(z: float) -> float:
    """Of the standard normal distribution, above z."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer(token: str) -> int | None:
    """The number of the smallest alphabet that holds every letter, None for what isn't tested."""
    letters = set(token)
    if not letters & DIGITS and not (letters & LOWER and set(token[1:]) & UPPER) or not letters & (LOWER | UPPER):
        return None
    return next((n for n, held in enumerate(HOLDS) if letters <= held), None)


DIGITS, LOWER, UPPER = frozenset("0123456789"), frozenset("abcdefghijklmnopqrstuvwxyz"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Long tokens, and of those that mix the signs of two alphabets the long runs between - _ and /."""
    for m in TOKEN(text):
        token = m.group()
        if ("-" in token or "_" in token) and ("+" in token or "/" in token):
            yield from ((m.start() + r.start(), m.start() + r.end()) for r in RUN(token))
        else:
            yield m.span()


def battery(token: str) -> tuple[float, float] | None:
    """(p if drawn at random, p if ordinary writing), or None for a token of no known encoding."""
    token = token.rstrip("=")
    number = infer(token) if len(token) >= SHORTEST else None
    if number is None:
        return None
    _, alphabet, excess = ENCODINGS[number]
    k, n = len(alphabet), len(token)
    x = PLACES[number][np.frombuffer(token.encode(), np.uint8)]
    counts = np.bincount(x, minlength=k)
    chi = float((counts * counts).sum()) * k / n - n
    uniform = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if not a or not b:
        return 0.0, 1.0
    runs, mean = int((high[1:] != high[:-1]).sum()) + 1, 1 + 2 * a * b / n
    spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    p_runs = 2 * tail(abs(runs - mean) / spread)
    y = x - x.mean()
    r = float((y[1:] * y[:-1]).sum() / max(1e-9, (y * y).sum()))
    p_serial = 2 * tail(abs(r + 1 / n) * math.sqrt(n))
    together = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, p_runs, p_serial))  # Fisher: chi-squared of 6 degrees
    half = together / 2
    random = math.exp(-half) * (1 + half + half * half / 2)
    usual, deviation = (k - 1) + excess * (n - 1), math.sqrt(2 * (k - 1) + 4 * excess * n)
    return random, tail((usual - chi) / deviation)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans), candidates: start, end, length, p against ordinary writing of those that pass as random (else 1), and whether they meet a base span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))
        more = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n", pa.int64()), ("p", pa.float64()), ("met", pa.bool_())]))
        for batch in chunks(batches):
            bases, others = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base, found = base_spans(text), []
                at = reach = 0  # base spans that begin before a candidate's end, and how far they reach
                for start, end in candidates(text):
                    while at < len(base) and base[at][0] < end:
                        reach = max(reach, base[at][2])
                        at += 1
                    if p := battery(text[start:end]):
                        found.append({"start": start, "end": end, "n": end - start, "p": p[1] if p[0] > ALPHA else 1.0, "met": reach > start})
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                others.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, span), pa.array(others, more)], ["doc_id", "base", "candidates"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, base array<struct<start: long, kind: long, end: long>>, candidates array<struct<start: long, end: long, n: long, p: double, met: boolean>>")


def cut_off(scanned: DataFrame, rate: float = RATE) -> tuple[float, float]:
    """(mean length, bound): candidates with p * mean length / length up to the bound are discoveries at this rate."""
    each = scanned.select(F.explode("candidates").alias("c")).select("c.n", "c.p")
    whole = each.agg(F.count("*").alias("m"), F.avg("n").alias("mean")).first()
    if not whole.m:
        return 1.0, 0.0
    step = 12 / BINS  # bins of log10 from -12 to 0
    weighed = F.col("p") * whole.mean / F.col("n")
    bins = each.groupBy(F.least(F.lit(BINS), F.greatest(F.lit(0), F.ceil((F.log10(F.greatest(weighed, F.lit(1e-30))) + 12) / step))).cast("int").alias("bin")).count().collect()
    bound, rank = 0.0, 0
    for r in sorted(bins, key=lambda r: r.bin):
        rank += r["count"]
        edge = 10 ** (r.bin * step - 12)
        if r.bin < BINS and edge * whole.m / rank <= rate:
            bound = edge
    return float(whole.mean), bound


def find_secrets(docs: DataFrame, rate: float = RATE, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, base, found: arrays of (start, kind, end); ``found`` holds base spans and the discoveries that meet none of them."""
    scanned = (scratch or Scratch(docs.sparkSession, "secrets")).keep(scan(docs))
    mean, bound = cut_off(scanned, rate)
    added = F.filter("candidates", lambda c: (c.p * F.lit(mean) / c.n <= F.lit(bound)) & ~c.met)
    random = F.transform(added, lambda c: F.struct(c.start.alias("start"), F.lit(3).cast("long").alias("kind"), c.end.alias("end")))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("found"))


def joined(spans, kinds: tuple[str, ...]):
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, (s.kind + 1).cast("int")), s.start, s.end)), ",")


def op9_randomness_battery(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, b -> b.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(joined("base", KINDS), 256).alias("base_sha256"), joined("found", KINDS).alias("spans"))


QUERIES = {"op9_randomness_battery": op9_randomness_battery}
