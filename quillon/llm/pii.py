"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

The patterns (base spans) label windows of a bounded sample of rows.  Besides these windows as they are, the tagger is trained, in
numpy, on respelled ones: the same spans written so that no pattern finds them (``ann (at) mail dot com``, ``10[.]1[.]2[.]3``, cards in
groups with dots or slashes, phones without a plus), labelled as before.  So it learns to find what the patterns can't.

Whole texts are read. A span holds a digit, an ``@``, a spelled dot or a bracketed sign and never a line break, and lies within MARGIN characters of
one; characters with none near are outside any span. What remains are regions, cut into overlapping windows; the scores of a
character are averaged over its windows, more the nearer it is to their middle, and one best path is decoded for the whole text: the
characters outside being fixed, it is the best path of each region that begins and ends outside a span.  Base spans stay; spans of the
tagger that are plausible for their kind and overlap no base span are added, and where two of them begin alike there is only one, as a path has one tag a character.

Defined results: null and empty text have no spans; base_sha256 is then that of the empty string; a number that two kinds claim
is a base span of both, in order of start, then kind; ties between paths go to the first tag; repeated rows are read each on its own; an
empty table gives no rows; very long texts are read whole, in time that grows with their length; without any base span in the table
nothing is learnt and nothing added; other columns are kept by ``mask`` and ignored otherwise, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, chunks, table, thinned

#: Parameters: windows come from at most about SAMPLE_ROWS rows, picked by hash; of these the tagger is fitted on at most SAMPLE around base
#: spans and as many around other digits and signs, picked by hash; its size, the windows, and the steps of training.
SAMPLE_ROWS = 30_000
SAMPLE = 1200
HIDDEN = 20
WIDTH = 64
STRIDE = 32
MARGIN = 32
STEPS = 420

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)").finditer  # every match starts where a run of digits does
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+").finditer
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
TRIGGER = re.compile(r"[0-9@]|(?<=[A-Za-z0-9])(?: dot |\x20?[\[(](?:at|dot|\.)[\])])(?=\x20?[A-Za-z0-9])")
SIGN = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]").findall
#: How signs are respelled; spans of the tagger are read back by these before they are judged.
AT = re.compile(r"\x20?[\[(](?:at|@)[\])]\x20?|\x20at\x20|\x20?@\x20?")
DOT = re.compile(r"\x20?[\[(](?:dot|\.)[\])]\x20?|\x20dot\x20|\x20?\.\x20?")
#: Numbers in groups and spelled signs: beside base spans they may be anything, so training takes them for neither data nor none.
DOUBTFUL = re.compile(r"[+(]?[0-9](?:[\x20().+/_-]{0,3}[0-9]){8,}|[0-9]+(?:\x20?(?:[\[(]?\.[\])]?|[\[(]?dot[\])]?)\x20?[0-9]+){3}|\x20?[\[(](?:at|dot|\.)[\])]|\x20dot\x20|@")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}").fullmatch


def luhn(digits: list[str]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @, so that long runs of letters are read once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    if not SIGN.search(text):
        return []
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split("."))]
    for m in CARD(text):
        if m.end() - m.start() <= 40 and 12 <= len(d := DIGIT(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE(text) if 9 <= len(DIGIT(m.group())) <= 15]
    return sorted(found)


def codes(text: str) -> np.ndarray:
    """A number under 98 for each character: printable ASCII, other letters, anything else (also padding)."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where((points >= 32) & (points < 127), points - 32, np.where(points >= 0xC0, 95, 96)).astype(np.int64)


PAD = 97
LETTERS = 98


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Two LSTMs over characters, a linear layer on both, and transitions between tags."""

    def __init__(self, seed: int = 0, hidden: int = HIDDEN) -> None:
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.3, (2 * h, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
        for d in "fb":
            b = np.zeros(4 * h)
            b[h : 2 * h] = 1
            self.p |= {f"x{d}": rng.normal(0, 0.3, (LETTERS, 4 * h)), f"h{d}": rng.normal(0, 0.25, (h, 4 * h)), f"b{d}": b}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        n, width = x.shape
        h, wx, wh, b = self.h, self.p[f"x{d}"], self.p[f"h{d}"], self.p[f"b{d}"]
        state = cell = np.zeros((n, h), np.float32)
        out, saved = np.empty((n, width, h), np.float32), []
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            z = wx[x[:, t]] + state @ wh + b
            s, g = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            new = s[:, h : 2 * h] * cell + s[:, :h] * g
            squashed = np.tanh(new)
            if keep:
                saved.append((t, s, g, cell, squashed, state))
            cell, state = new, s[:, 2 * h :] * squashed
            out[:, t] = state
        return out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.run(d, x, False)[0] for d in "fb"], axis=2) @ self.p["out"] + self.p["bias"]

    def back(self, d: str, x: np.ndarray, saved: list, grad: np.ndarray, into: dict[str, np.ndarray]) -> None:
        h, wh = self.h, self.p[f"h{d}"]
        dz_all = np.empty((*x.shape, 4 * h), np.float32)
        dwh = np.zeros_like(wh)
        dstate = dcell = np.zeros((len(x), h), np.float32)
        for t, s, g, cell, squashed, state in reversed(saved):
            i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            dh = grad[:, t] + dstate
            dc = dcell + dh * o * (1 - squashed * squashed)
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dwh += state.T @ dz
            dz_all[:, t] = dz
            dstate, dcell = dz @ wh.T, dc * f
        flat, dz = x.ravel(), dz_all.reshape(-1, 4 * h)
        order = np.argsort(flat, kind="stable")
        values, first = np.unique(flat[order], return_index=True)
        dwx = np.zeros_like(self.p[f"x{d}"])
        dwx[values] = np.add.reduceat(dz[order], first, axis=0)
        into |= {f"x{d}": dwx, f"h{d}": dwh, f"b{d}": dz.sum(axis=0)}

    def gradient(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, by forward-backward over all paths, scaled at every step."""
        n, width = x.shape
        (hf, sf), (hb, sb) = self.run("f", x, True), self.run("b", x, True)
        hidden, move = np.concatenate([hf, hb], axis=2), self.p["move"].astype(np.float64)
        e = (hidden @ self.p["out"] + self.p["bias"]).astype(np.float64)
        top, high = e.max(axis=2), move.max()
        w, m = np.exp(e - top[:, :, None]), np.exp(move - high)
        a, b, scale = np.empty_like(e), np.ones_like(e), np.empty((n, width))
        for t in range(width):
            state = w[:, 0] if t == 0 else (a[:, t - 1] @ m) * w[:, t]
            scale[:, t] = state.sum(axis=1)
            a[:, t] = state / scale[:, t, None]
        onward = np.empty_like(e)  # what a tag at t and all after it weigh, over the scale of t
        for t in range(width - 1, -1, -1):
            if t < width - 1:
                b[:, t] = onward[:, t + 1] @ m.T
            onward[:, t] = w[:, t] * b[:, t] / scale[:, t, None]
        z = float(np.log(scale).sum() + top.sum() + n * (width - 1) * high)
        de = a * b
        rows, cols = np.arange(n)[:, None], np.arange(width)[None]
        gold = e[rows, cols, tags].sum() + move[tags[:, :-1], tags[:, 1:]].sum()
        dmove = m * (a[:, :-1].reshape(-1, TAGS).T @ onward[:, 1:].reshape(-1, TAGS))
        np.add.at(dmove, (tags[:, :-1], tags[:, 1:]), -1)
        de[rows, cols, tags] -= 1
        de = (de / n).astype(np.float32)
        grads = {"move": (dmove / n).astype(np.float32), "out": hidden.reshape(-1, 2 * self.h).T @ de.reshape(-1, TAGS), "bias": de.sum(axis=(0, 1))}
        dh = de @ self.p["out"].T
        self.back("f", x, sf, dh[:, :, : self.h], grads)
        self.back("b", x, sb, dh[:, :, self.h :], grads)
        return float(z - gold) / n, grads

    def fit(self, x: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam over random batches; returns the losses."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(batch, len(x)))
            loss, grads = self.gradient(x[pick], tags[pick])
            losses.append(loss)
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best path through each region's scores that comes from outside a span and ends there; regions of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        while order:
            longest = len(scores[order[0]])
            group, order = order[: max(1, 500_000 // longest)], order[max(1, 500_000 // longest) :]
            sizes = np.array([len(scores[i]) for i in group])
            back = np.zeros((longest, len(group), TAGS), np.int8)
            e = np.zeros((longest, len(group), TAGS), np.float32)
            for j, i in enumerate(group):
                e[: sizes[j], j] = scores[i]
            best = e[0].astype(np.float64) + self.p["move"][0]
            for t in range(1, longest):
                live = int(np.searchsorted(-sizes, -t))  # those longer than t come first
                ways = best[:live, :, None] + self.p["move"]
                back[t, :live] = ways.argmax(axis=1)
                best[:live] = ways.max(axis=1) + e[t, :live]
            for j, i in enumerate(group):
                tag, path = int((best[j] + self.p["move"][:, 0]).argmax()), np.zeros(sizes[j], np.int64)
                for t in range(sizes[j] - 1, -1, -1):
                    path[t] = tag
                    tag = int(back[t, j, tag])
                out[i] = path
        return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of lines with a trigger within MARGIN characters."""
    found: list[tuple[int, int]] = []
    line = end = 0  # the line that was looked at last
    for m in TRIGGER.finditer(text):
        if m.start() >= end:
            line, end = text.rfind("\n", end, m.start()) + 1, text.find("\n", m.start())
            end = len(text) if end < 0 else end
        low, high = max(line, m.start() - MARGIN), min(end, m.end() + MARGIN)
        if found and low <= found[-1][1] and found[-1][1] > line:
            found[-1] = (found[-1][0], max(high, found[-1][1]))
        else:
            found.append((low, high))
    return found


def scores_of(tagger: Tagger, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Scores of each region's characters, averaged over overlapping windows."""
    starts = [list(range(0, max(1, len(x) - WIDTH + STRIDE), STRIDE)) for x in parts]
    where = [(i, s) for i, own in enumerate(starts) for s in own]
    weight = (1 + np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1])).astype(np.float32)[:, None]
    total = [np.zeros((len(x), TAGS), np.float32) for x in parts]
    norm = [np.zeros((len(x), 1), np.float32) for x in parts]
    for at in range(0, len(where), 1024):
        now = where[at : at + 1024]
        x = np.full((len(now), WIDTH), PAD)
        for j, (i, s) in enumerate(now):
            part = parts[i][s : s + WIDTH]
            x[j, : len(part)] = part
        e = tagger.emissions(x)
        for j, (i, s) in enumerate(now):
            n = min(WIDTH, len(parts[i]) - s)
            total[i][s : s + n] += (e[j] * weight)[:n]
            norm[i][s : s + n] += weight[:n]
    return [t / n for t, n in zip(total, norm)]


def plausible(kind: int, found: str) -> bool:
    """Whether what the tagger found can be of this kind, once respelled signs are read back."""
    if found[0] == " " or found[-1] == " ":
        return False
    digits = DIGIT(found)
    if kind == 0:
        return ADDRESS(DOT.sub(".", AT.sub("@", found, count=1))) is not None
    if kind == 1:
        parts = DOT.sub(".", found).split(".")
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and set(found) <= set("0123456789 -./_") and found[0].isdigit() and found[-1].isdigit()
    if found.count(".") == 3 and max(map(len, found.split("."))) <= 3:
        return False  # a dotted quad that is no address is no phone either
    return 9 <= len(digits) <= 15 and found[0] in "+(0123456789" and found[-1].isdigit() and set(found) <= set("0123456789 ().-+/") and len(set(found) & set(" ().-+/")) > 0


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether a span is cut out of no longer word or number."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def added_spans(tagger: Tagger, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    where = [(i, low, high) for i, t in enumerate(texts) for low, high in regions(t)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    taken = [merged(b) for b in bases]
    starts = [[s for s, _ in t] for t in taken]
    paths = tagger.decode(scores_of(tagger, [codes(texts[i][low:high]) for i, low, high in where]))
    for (i, low, _), path in zip(where, paths):
        begin = np.flatnonzero(path % 2 == 1)
        if not len(begin):
            continue
        # A span lasts while the tag that continues its first one does.
        last = np.append(np.flatnonzero(path[1:] != path[:-1] + path[:-1] % 2) + 1, len(path))
        ends = last[np.searchsorted(last, begin, "right")]
        for first, end in zip(begin.tolist(), ends.tolist()):
            kind, s, e = (int(path[first]) - 1) // 2, low + first, low + end
            at = bisect_left(starts[i], e)  # merged base spans that begin before the end; the last of them ends last
            if (not at or taken[i][at - 1][1] <= s) and plausible(kind, texts[i][s:e]) and whole_words(texts[i], s, e):
                out[i].append((s, kind, e))
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What sorted spans cover, as stretches that don't touch."""
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def respelled(kind: int, span: str, rng: np.random.Generator) -> str:
    """Data of the same kind as people write it to escape patterns, or carelessly; names, domains and grouping vary, so that the shape is learnt and not the few in the table."""
    pick = lambda *ways: ways[int(rng.integers(len(ways)))]
    if kind == 0:
        local, _, domain = span.partition("@")
        words = [w for w in re.split(r"[^A-Za-z]+", local + "." + domain) if len(w) > 1] or ["name"]
        again = lambda w: "".join(rng.permutation(list(w)))[: int(rng.integers(2, 9))]
        local = pick(local, again(pick(*words)), again(pick(*words)) + pick(".", "_", "-", "") + again(pick(*words)), again(pick(*words)) + str(int(rng.integers(1, 100))))
        domain = pick(domain, ".".join(domain.split(".")[-2:]), again(pick(*words)) + "." + pick("com", "org", "net", "edu", again("abcdefghiklmnoprstu")[:2]))
        mixed = pick("@", " @ ", "(at)", "[at]", " (at) ", " [at] "), pick(".", "(dot)", "[dot]", "[.]", " (dot) ", " [dot] ", " . ")
        at, dot = pick((" at ", " dot "), (" at ", " dot "), ("@", " dot "), ("(at)", "."), (" (at) ", " dot "), mixed, mixed)
        at = at if at != "@" or dot != "." else " (at) "
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", pick(" . ", "[.]", "(.)", " dot ", "[dot]", " [.] "))
    digits = "".join(DIGIT(span))
    if kind == 2:
        size, sep = pick(4, 4, 4, 5, 6), pick(".", "/", "  ", " - ", "_", " / ", "--")
        return sep.join(digits[i : i + size] for i in range(0, len(digits), size))
    drawn = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    country, sep = str(int(rng.integers(1, 100))), pick(" ", "-", ".", "/")
    lead = pick("", "", "00" + country + sep, country + sep, "0")
    area, rest = drawn(pick(3, 3, 2, 4)), [drawn(n) for n in pick((3, 4), (3, 4), (4, 3), (3, 3), (2, 2, 3))]
    return lead + pick(f"({area}) ", area + sep, f"({area})") + pick("-", sep).join(rest)


def altered(piece: str, tags: np.ndarray, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """A labelled window with its whole spans respelled, cut or kept at WIDTH characters."""
    text, labels, at = "", [], 0
    while at < len(piece):
        end = at + 1
        if tags[at] % 2 == 1:
            while end < len(piece) and tags[end] == tags[at] + 1:
                end += 1
        part = piece[at:end]
        whole = tags[at] % 2 == 1 and 0 < at and end < len(piece)
        part = respelled((int(tags[at]) - 1) // 2, part, rng) if whole else part
        text += part
        labels += [int(tags[at])] + [int(tags[at]) + (tags[at] % 2 == 1)] * (len(part) - 1)
        at = end
    cut = max(0, (len(text) - WIDTH) // 2)
    text, out = text[cut : cut + WIDTH], np.zeros(WIDTH, np.int64)
    out[: len(text)] = labels[cut : cut + WIDTH]
    return text, out


def sample_windows(docs: DataFrame, bound: int = SAMPLE, rows: int = SAMPLE_ROWS, scratch: Scratch | None = None) -> list[tuple[str, np.ndarray]]:
    """Labelled windows of a sample of rows: at most ``bound`` around base spans and ``bound`` around other digits and signs, save doubtful ones, each picked by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: dict[str, list] = {"key": [], "labelled": [], "piece": [], "tags": []}
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                held = merged(sorted(spans + [(m.start(), 0, m.end()) for m in DOUBTFUL.finditer(text) if not m.group().isdigit()]))
                centres, at = [(s, True) for s in sorted({s for s, _, _ in spans})], 0
                for m in TRIGGER.finditer(text):
                    while at < len(held) and held[at][1] <= m.start():
                        at += 1
                    if at == len(held) or m.start() < held[at][0]:
                        centres.append((m.start(), False))
                starts, most = [s for s, _, _ in spans], max((e - s for s, _, e in spans), default=0)
                for centre, labelled in centres:
                    low = max(0, centre - WIDTH // 2 + centre % 16)
                    piece, tags = text[low : low + WIDTH], bytearray(WIDTH)
                    for s, kind, e in spans[bisect_left(starts, low - most) : bisect_left(starts, low + WIDTH)]:
                        for p in range(max(s, low), min(e, low + len(piece))):
                            tags[p - low] = 1 + 2 * kind + (p > s)
                    out["key"].append(len(text) * 7919 + centre)
                    out["labelled"].append(labelled)
                    out["piece"].append(piece)
                    out["tags"].append(bytes(tags))
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["labelled"], pa.bool_()), pa.array(out["piece"], pa.string()), pa.array(out["tags"], pa.binary())], list(out))

    scratch = scratch or Scratch(docs.sparkSession, "pii")
    chosen = docs.select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"))
    few = thinned(chosen, [], rows // 4, docs.count(), F.col("h")).select("text")
    each = scratch.keep(few.mapInArrow(run, "key long, labelled boolean, piece string, tags binary"))
    found = {r.labelled: r.n for r in each.groupBy("labelled").agg(F.count("*").alias("n")).collect()}
    picked = []
    for labelled, n in sorted(found.items()):
        picked += thinned(each.where(F.col("labelled") == labelled), ["key", "piece"], bound, n).orderBy(F.xxhash64("key", "piece"), "piece").limit(bound).collect()
    scratch.drop(each)
    return [(r.piece, np.frombuffer(bytes(r.tags), np.uint8).astype(np.int64)) for r in picked]


def train(docs: DataFrame, bound: int = SAMPLE, steps: int = STEPS, seed: int = 0) -> Tagger | None:
    """Fitted on the sampled windows, and on each labelled one respelled three times; None where the sample has no base span."""
    windows, rng = sample_windows(docs, bound), np.random.default_rng(seed)
    windows += [altered(piece, tags, rng) for piece, tags in windows if (tags > 0).any() for _ in range(3)]
    x, y = np.full((len(windows), WIDTH), PAD), np.zeros((len(windows), WIDTH), np.int64)
    for i, (piece, tags) in enumerate(windows):
        c = codes(piece)
        x[i, : len(c)] = c
        y[i, : len(c)] = tags[: len(c)]
    if not (y > 0).any():
        return None
    tagger = Tagger()
    tagger.fit(x, y, steps)
    return tagger


def both(tagger: Tagger | None, texts: list[str]) -> tuple[list, list]:
    bases = [base_spans(t) for t in texts]
    more = added_spans(tagger, texts, bases) if tagger else [[] for _ in texts]
    return bases, [sorted(b + m) for b, m in zip(bases, more)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_spans of the patterns, spans of both."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            bases, spans = both(shared.value, [t or "" for t in batch.column("text").to_pylist()])
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b in bases], pa.int64()) for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(map(written, bases), pa.string()), pa.array(map(written, spans), pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string")


def mask(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, as in [EMAIL]; n_chars follows the text."""
    shared, names, schema = docs.sparkSession.sparkContext.broadcast(tagger), docs.columns, docs.schema
    counted = [n == "n_chars" and dict(docs.dtypes)[n] == "bigint" for n in names]

    def hide(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for s, k, e in spans:
            if s >= at:
                out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            _, spans = both(shared.value, [t or "" for t in texts])
            new = [hide(t, s) if s else t for t, s in zip(texts, spans)]
            made = {"text": pa.array(new, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in new], pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n == "text" or c else batch.column(n) for n, c in zip(names, counted)], names)

    return docs.mapInArrow(run, schema)


def op2_bilstm_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


QUERIES = {"op2_bilstm_crf": op2_bilstm_crf}
