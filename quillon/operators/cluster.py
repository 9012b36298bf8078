"""Communities of a weighted graph: Leiden in one task for graphs that fit, synchronous Louvain rounds beyond."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.frames import n_rows
from quillon.operators.graph import modularity
from quillon.plans.steps import Steps

#: Largest number of edges (both directions) that is handed to one task.
ONE_TASK_EDGES = 20_000_000


class Graph:
    """Symmetric compressed rows. ``size`` is the number of cells a node stands for, ``loop`` the weight inside it."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, loop: np.ndarray | None = None) -> None:
        order = np.lexsort((dst, src))
        self.n, self.to, self.w = n, dst[order], w[order]
        self.at = np.searchsorted(src[order], np.arange(n + 1))
        self.loop = np.zeros(n) if loop is None else loop
        self.degree = np.bincount(src, w, n) + self.loop
        self.total = self.degree.sum()

    def merged(self, label: np.ndarray, k: int) -> Graph:
        src = np.repeat(np.arange(self.n), np.diff(self.at))
        a, b = label[src], label[self.to]
        inside = a == b
        loop = np.bincount(label, self.loop, k) + np.bincount(a[inside], self.w[inside], k)
        key = a[~inside] * k + b[~inside]
        pair, index = np.unique(key, return_inverse=True)
        return Graph(pair // k, pair % k, np.bincount(index, self.w[~inside], len(pair)), k, loop)


def quality(g: Graph, label: np.ndarray, gamma: float) -> float:
    src = np.repeat(np.arange(g.n), np.diff(g.at))
    inner = g.w[label[src] == label[g.to]].sum() + g.loop.sum()
    degree = np.bincount(label, g.degree)
    return float(inner / g.total - gamma * ((degree / g.total) ** 2).sum()) if g.total else 0.0


def move_nodes(g: Graph, label: np.ndarray, gamma: float, rng: np.random.Generator) -> np.ndarray:
    """Fast local moving: a queue of nodes; a node that moves wakes its neighbours outside its new community."""
    label = label.copy()
    degree = np.bincount(label, g.degree, g.n).tolist()
    queue = rng.permutation(g.n).tolist()
    waiting = [True] * g.n
    at, to, w, own = g.at.tolist(), g.to.tolist(), g.w.tolist(), g.degree.tolist()
    lab = label.tolist()
    free = [c for c in range(g.n - 1, -1, -1) if degree[c] == 0]
    i = 0
    while i < len(queue):
        v = queue[i]
        i += 1
        waiting[v] = False
        here, near = lab[v], {}
        for e in range(at[v], at[v + 1]):
            c = lab[to[e]]
            near[c] = near.get(c, 0.0) + w[e]
        degree[here] -= own[v]
        scale = gamma * own[v] / g.total
        best, gain = here, near.get(here, 0.0) - scale * degree[here]
        for c, x in near.items():
            if (x_ := x - scale * degree[c]) > gain + 1e-12:
                best, gain = c, x_
        if gain < -1e-12 and free:  # alone is better than anywhere
            best = free[-1]
        if best != here:
            if free and best == free[-1]:
                free.pop()
            lab[v] = best
            for e in range(at[v], at[v + 1]):
                u = to[e]
                if lab[u] != best and not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
        degree[best] += own[v]
    return np.unique(np.array(lab), return_inverse=True)[1]


def refine(g: Graph, label: np.ndarray, gamma: float, rng: np.random.Generator, theta: float = 0.01) -> np.ndarray:
    """Within each community, single nodes join well-connected parts of it, at random by gain."""
    part = np.arange(g.n).tolist()
    degree, lone = g.degree.tolist(), [True] * g.n
    whole = np.bincount(label, g.degree).tolist()
    at, to, w, own, lab = g.at.tolist(), g.to.tolist(), g.w.tolist(), g.degree.tolist(), label.tolist()
    cut = [0.0] * g.n  # weight from each part to the rest of its community
    for v in range(g.n):
        cut[v] = sum(w[e] for e in range(at[v], at[v + 1]) if lab[to[e]] == lab[v])
    for v in rng.permutation(g.n).tolist():
        if not lone[part[v]] or part[v] != v:
            continue
        if cut[v] < gamma * own[v] * (whole[lab[v]] - own[v]) / g.total:
            continue
        near: dict[int, float] = {}
        for e in range(at[v], at[v + 1]):
            if lab[to[e]] == lab[v]:
                c = part[to[e]]
                near[c] = near.get(c, 0.0) + w[e]
        options = [(c, x - gamma * own[v] * degree[c] / g.total) for c, x in near.items() if c != v and cut[c] >= gamma * degree[c] * (whole[lab[v]] - degree[c]) / g.total]
        options = [(c, x) for c, x in options if x >= 0]
        if not options:
            continue
        gains = np.array([x for _, x in options])
        p = np.exp((gains - gains.max()) / theta / max(g.total, 1e-12) * 2)
        c = options[int(rng.choice(len(p), p=p / p.sum()))][0]
        part[v] = c
        degree[c] += own[v]
        cut[c] = cut[c] + cut[v] - 2 * near[c]
        lone[c] = False
    return np.unique(np.array(part), return_inverse=True)[1]


def leiden_labels(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, gamma: float = 1.0, seed: int = 0, iterations: int = 2, refined: bool = True) -> np.ndarray:
    """Labels by size, largest first. Without refinement this is Louvain. An edge from a node to itself is weight inside it."""
    rng = np.random.default_rng(seed)
    own = src == dst
    base = Graph(src[~own], dst[~own], w[~own], n, np.bincount(src[own], w[own], n))
    label, best, best_q = np.arange(n), np.arange(n), -np.inf
    for _ in range(iterations):
        g, owner, current = base, np.arange(n), label
        while True:
            moved = move_nodes(g, current, gamma, rng)
            k = moved.max(initial=-1) + 1
            if k == g.n:
                label = moved[owner]
                break
            part = refine(g, moved, gamma, rng) if refined else moved
            m = part.max(initial=-1) + 1
            if m == g.n:
                part, m = moved, k
            above = np.zeros(m, np.int64)
            above[part] = moved
            g, owner, current = g.merged(part, m), part[owner], np.unique(above, return_inverse=True)[1]
            label = current[owner]
        q = quality(base, label, gamma)
        if q > best_q:
            best, best_q = label, q
    size = np.bincount(best)
    order = np.lexsort((np.arange(len(size)), -size))
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    return rank[best]


def communities(edges: DataFrame, cells: DataFrame, steps: Steps, gamma: float = 1.0, seed: int = 0, method: str = "leiden", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(cell_id, label). ``method``: leiden or fast (Louvain). Graphs beyond ``one_task`` edges take distributed Louvain rounds."""
    counted = edges.agg(F.count("*")).first()[0]
    if counted > one_task:
        return louvain_rounds(edges, cells, steps, gamma)
    return in_one_task(edges, cells, gamma, seed, method == "leiden")


def in_one_task(edges: DataFrame, cells: DataFrame, gamma: float, seed: int, refined: bool) -> DataFrame:
    packed = edges.select("src", "dst", "w").withColumn("one", F.lit(0)).unionByName(cells.select(F.col("cell_id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("w"), F.lit(0).alias("one")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, code = np.unique(pdf.src.to_numpy(np.int64), return_inverse=True)
        real = pdf.dst.notna().to_numpy()
        dst = np.searchsorted(ids, pdf.dst[real].to_numpy(np.int64))
        return pd.DataFrame({"cell_id": ids, "label": leiden_labels(code[real], dst, pdf.w[real].to_numpy(float), len(ids), gamma, seed, refined=refined).astype(np.int64)})

    return packed.groupBy("one").applyInPandas(run, "cell_id long, label long")


def louvain_rounds(edges: DataFrame, cells: DataFrame, steps: Steps, gamma: float = 1.0, rounds: int = 12, levels: int = 8, small: int = ONE_TASK_EDGES, polish: int = 4) -> DataFrame:
    """Louvain as joins: rounds of moves, then communities become the nodes of a smaller graph, until nothing changes. A smaller graph of at most
    ``small`` edges is divided in one task. At last ``polish`` rounds move single cells again, which counts if the whole is more modular by it."""
    label = cells.select("cell_id", F.col("cell_id").alias("label"))
    graph, nodes = edges.select("src", "dst", "w"), cells.select(F.col("cell_id").alias("node"))
    for level in range(levels):
        if level and n_rows(graph) <= small:
            moved = steps.keep(in_one_task(graph, nodes.withColumnRenamed("node", "cell_id"), gamma, 0, False)).select(F.col("cell_id").alias("node"), F.col("label").alias("to"))
            label = steps.keep(label.join(moved, F.col("label") == F.col("node")).select("cell_id", F.col("to").alias("label")))
            break
        moved, changed = move_rounds(graph, nodes, steps, gamma, rounds)
        if not changed:
            break
        label = steps.keep(label.join(moved, F.col("label") == F.col("node")).select("cell_id", F.col("to").alias("label")))
        a, b = (moved.select(F.col("node").alias(k), F.col("to").alias(f"{k}_to")) for k in ("src", "dst"))
        graph = steps.keep(graph.join(a, "src").join(b, "dst").groupBy(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).agg(F.sum("w").alias("w")))
        nodes = label.select(F.col("label").alias("node")).distinct()
    if polish:
        moved, changed = move_rounds(edges.select("src", "dst", "w"), cells.select(F.col("cell_id").alias("node")), steps, gamma, polish, label)
        other = moved.select(F.col("node").alias("cell_id"), F.col("to").alias("label"))
        if changed and quality_of(edges, other, gamma) > quality_of(edges, label, gamma):
            label = other
    return by_size(label)


def by_size(label: DataFrame) -> DataFrame:
    """Labels from 0, the largest community first."""
    ranked = label.groupBy("label").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1)  # one row a community
    return label.join(ranked, "label").select("cell_id", F.col("rank").cast("long").alias("label"))


def quality_of(edges: DataFrame, label: DataFrame, gamma: float) -> float:
    return modularity(edges, label, gamma).first().quality or 0.0


def move_rounds(edges: DataFrame, nodes: DataFrame, steps: Steps, gamma: float, rounds: int, start: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(node, to), and whether any node moved. All nodes move at once to the neighbouring community of largest gain; odd rounds let only
    moves to smaller labels pass, even ones only to larger, so that pairs don't swap for ever. Nodes begin alone, or as ``start`` labels them."""
    degree = steps.keep(nodes.join(edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")), "node", "left").fillna(0.0))
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    apart = edges.where("src <> dst")
    label, moved, idle = degree.select("node", "k", F.col("node").alias("to")), False, 0
    if start is not None:
        label = degree.join(start.select(F.col("cell_id").alias("node"), F.col("label").alias("to")), "node")
    for turn in range(rounds):
        sizes = label.groupBy("to").agg(F.sum("k").alias("kc"))
        toward = apart.join(label.select(F.col("node").alias("dst"), "to"), "dst").groupBy(F.col("src").alias("node"), F.col("to").alias("c")).agg(F.sum("w").alias("w"))
        stay = label.select("node", F.col("to").alias("c"), F.lit(0.0).alias("w"))  # its own community is an option without an edge into it too
        options = toward.union(stay).groupBy("node", "c").agg(F.sum("w").alias("w")).join(sizes.withColumnRenamed("to", "c"), "c").join(label, "node")
        inside = F.when(F.col("c") == F.col("to"), F.col("kc") - F.col("k")).otherwise(F.col("kc"))
        gains = options.withColumn("gain", F.col("w") - gamma * F.col("k") * inside / total)
        way = F.col("c") < F.col("to") if turn % 2 == 0 else F.col("c") > F.col("to")
        allowed = gains.where(way | (F.col("c") == F.col("to")))
        best = allowed.groupBy("node").agg(F.max(F.struct(F.round("gain", 12).alias("gain"), (F.col("c") == F.col("to")).alias("home"), (-F.col("c")).alias("n"))).alias("b"))
        new = steps.keep(label.join(best, "node", "left").select("node", "k", F.coalesce(-F.col("b.n"), F.col("to")).alias("to"), F.col("to").alias("was")))
        changed = new.where("to <> was").limit(1).count()
        label, moved = new.select("node", "k", "to"), moved or bool(changed)
        idle = 0 if changed else idle + 1
        if idle == 2:
            break
    return label.select("node", "to"), moved


def subcluster(edges: DataFrame, labels: DataFrame, which: str, steps: Steps, gamma: float = 1.0, seed: int = 0) -> DataFrame:
    """(cell_id, label): members of ``which`` are named which.0, which.1, ... by the communities of their own subgraph; others keep their label."""
    inside = labels.where(F.col("label") == which).select("cell_id")
    sub = edges.join(inside.select(F.col("cell_id").alias("src")), "src", "left_semi").join(inside.select(F.col("cell_id").alias("dst")), "dst", "left_semi")
    if inside.limit(3).count() < 3:
        raise ValueError("a cluster of fewer than three cells can't be divided")
    found = communities(sub, inside, steps, gamma, seed).select("cell_id", F.concat(F.lit(f"{which}."), F.col("label").cast("string")).alias("sub"))
    return labels.join(found, "cell_id", "left").select("cell_id", F.coalesce("sub", F.col("label").cast("string")).alias("label"))
