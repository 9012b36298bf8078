"""Labels by hand, and comparing labelings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.checks import nearest


def as_map(mapping: dict):
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def annotate(labels: DataFrame, mapping: dict, keep: bool = True) -> DataFrame:
    """(cell_id, label): {cluster: name} or {name: [clusters]}; clusters left out keep their label or become unassigned."""
    flat = {str(c): str(n) for n, own in mapping.items() for c in own} if any(isinstance(v, (list, tuple, set)) for v in mapping.values()) else {str(k): str(v) for k, v in mapping.items()}
    return labels.select("cell_id", F.coalesce(F.try_element_at(as_map(flat), F.col("label").cast("string")), F.col("label").cast("string") if keep else F.lit("unassigned")).alias("label"))


def merge_clusters(labels: DataFrame, groups: list[list[str]], names: list[str] | None = None) -> DataFrame:
    """(cell_id, label): each group of two or more clusters becomes one, named a+b unless named; groups must not overlap."""
    known = {r[0] for r in labels.select(F.col("label").cast("string")).distinct().collect()}
    flat, taken = {}, set()
    for i, group in enumerate(groups):
        if len(group) < 2:
            raise ValueError("a group to merge has two clusters at least")
        name = names[i] if names else "+".join(map(str, group))
        if name in known - set(map(str, group)) or name in taken:
            raise ValueError(f"the name {name!r} is taken")
        taken.add(name)
        for c in map(str, group):
            if c not in known:
                raise KeyError(f"there is no cluster {c!r}{nearest(c, [k for k in known if k])}")
            if c in flat:
                raise ValueError(f"cluster {c!r} is in two groups")
            flat[c] = name
    return annotate(labels, flat)


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(la, lb, n) of the cells (cell_id, label) that both label."""
    both = a.select("cell_id", F.col("label").alias("la")).join(b.select("cell_id", F.col("label").alias("lb")), "cell_id").dropna()
    return both.groupBy("la", "lb").agg(F.count("*").alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """One row: ari, nmi (arithmetic mean of the entropies). Degenerate denominators give 1."""
    pair = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    rows = table.groupBy("la").agg(F.sum("n").alias("m"))
    columns = table.groupBy("lb").agg(F.sum("n").alias("m"))
    total = table.agg(F.sum("n").alias("t"), F.sum(pair("n")).alias("both"))
    of = lambda df, name: df.agg(F.sum(pair("m")).alias(f"p{name}"), F.sum(F.col("m") * F.log("m")).alias(f"l{name}"))
    joint = table.agg(F.sum(F.col("n") * F.log("n")).alias("lj"))
    one = total.crossJoin(of(rows, "a")).crossJoin(of(columns, "b")).crossJoin(joint)  # single rows
    t = F.col("t").cast("double")
    expected = F.col("pa") * F.col("pb") / F.when(t > 1, t * (t - 1) / 2).otherwise(1.0)
    most = (F.col("pa") + F.col("pb")) / 2
    ha, hb = F.log(t) - F.col("la") / t, F.log(t) - F.col("lb") / t
    mutual = F.log(t) + (F.col("lj") - F.col("la") - F.col("lb")) / t
    ari = F.when(F.abs(most - expected) < 1e-12, 1.0).otherwise((F.col("both") - expected) / F.when(F.abs(most - expected) < 1e-12, 1.0).otherwise(most - expected))
    nmi = F.when(ha + hb < 1e-12, 1.0).otherwise(2 * mutual / F.when(ha + hb < 1e-12, 1.0).otherwise(ha + hb))
    return one.select(ari.alias("ari"), nmi.alias("nmi"))


def best_matches(table: DataFrame) -> DataFrame:
    """(la, lb, jaccard): for each cluster of the first labeling the one of the second that overlaps most."""
    a, b = table.groupBy("la").agg(F.sum("n").alias("na")), table.groupBy("lb").agg(F.sum("n").alias("nb"))
    scored = table.join(a, "la").join(b, "lb").withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    w = Window.partitionBy("la").orderBy(F.desc("jaccard"), "lb")
    return scored.withColumn("r", F.row_number().over(w)).where("r = 1").select("la", "lb", "jaccard")


def compare_analyses(labelings: dict[str, DataFrame]) -> dict[tuple[str, str], DataFrame]:
    names = list(labelings)
    return {(a, b): agreement(contingency(labelings[a], labelings[b])) for i, a in enumerate(names) for b in names[i + 1 :]}


def marker_overlap(matches: DataFrame, first: DataFrame, second: DataFrame, n: int = 50) -> DataFrame:
    """``matches`` (la, lb, jaccard) with the overlap of both clusters' ``n`` best markers (cluster, gene_id, rank): shared over all, null where either has none."""
    top = lambda m, key: m.where(F.col("rank") <= n).groupBy(F.col("cluster").alias(key)).agg(F.collect_set("gene_id").alias(f"{key}_genes"))  # noqa: E731  # n genes a cluster
    both = matches.join(top(first, "la"), "la", "left").join(top(second, "lb"), "lb", "left")
    return both.select("la", "lb", "jaccard", (F.size(F.array_intersect("la_genes", "lb_genes")) / F.size(F.array_union("la_genes", "lb_genes"))).alias("markers"))


def seed_noise(label_with: Callable[[int], DataFrame], seeds: list[int]) -> float:
    """The mean adjusted Rand index of a labeling with itself under other seeds; the first seed is the one compared with.
    Differences between settings smaller than 1 less this are within its own variation."""
    if len(seeds) < 2:
        raise ValueError("noise needs two seeds at least")
    base = label_with(seeds[0])
    found = [agreement(contingency(base, label_with(s))).first().ari for s in seeds[1:]]
    return sum(found) / len(found)


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))
