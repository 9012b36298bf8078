"""Marker statistics: each group against the rest, or groups against a named one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.frames import Dataset
from quillon.functions.checks import nearest
from quillon.functions.numeric import adjust_bh, normal_tail, variance
from quillon.functions.special import student_two_sided_all
from quillon.operators.qc import cluster_sizes, cluster_stats, every_pair


def full_stats(ds: Dataset, by: str, genes: DataFrame | None = None) -> DataFrame:
    """(gene_id, cluster, size, s, q, stored) of all pairs, also those without entries."""
    pairs = every_pair(ds.genes if genes is None else genes, cluster_sizes(ds.cells, by))
    return pairs.join(cluster_stats(ds, by), ["gene_id", "cluster"], "left").fillna(0)


def against_rest(ds: Dataset, by: str = "cluster", groups: list[str] | None = None, genes: DataFrame | None = None) -> DataFrame:
    """(gene_id, cluster, t, lfc, pts, p, padj, rank): Welch's t of logarithmic values, zeros included, each group against all other labelled cells.

    p is of the normal distribution; lfc is the log2 ratio of the means, +-10 where one is nothing. Genes of no spread and
    groups with fewer than two cells on either side aren't tested, and the adjustment counts tested genes only. Ranked by signed t.
    """
    stats = full_stats(ds, by, genes)
    gene = Window.partitionBy("gene_id")
    s, q, n = (F.sum(c).over(gene) - F.col(c) for c in ("s", "q", "size"))
    rest = stats.withColumn("s0", s).withColumn("q0", q).withColumn("n0", n).where("size >= 2 and n0 >= 2")
    if groups:
        rest = rest.where(F.col("cluster").isin(groups))
    m1, m0 = F.col("s") / F.col("size"), F.col("s0") / F.col("n0")
    v1, v0 = variance(F.col("s"), F.col("q"), F.col("size")), variance(F.col("s0"), F.col("q0"), F.col("n0"))
    wide = rest.select("gene_id", "cluster", m1.alias("m1"), m0.alias("m0"), F.sqrt(v1 / F.col("size") + v0 / F.col("n0")).alias("se"), (F.col("stored") / F.col("size")).alias("pts"))
    tested = wide.where("se >= 1e-12").withColumn("t", (F.col("m1") - F.col("m0")) / F.col("se"))
    lfc = F.when(F.col("m0") <= 1e-10, 10.0).when(F.col("m1") <= 1e-10, -10.0).otherwise(F.log2(F.when(F.col("m1") > 1e-10, F.col("m1")).otherwise(1.0) / F.when(F.col("m0") > 1e-10, F.col("m0")).otherwise(1.0)))
    scored = tested.select("gene_id", "cluster", "t", lfc.alias("lfc"), "pts", F.least(F.lit(1.0), 2 * normal_tail(F.abs("t"))).alias("p"))
    adjusted = adjust_bh(scored, "p", ["cluster"], "gene_id")
    return adjusted.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("t", 9)), "gene_id")))


def student(t: str, df: str) -> Column:
    """Two-sided p of Student's t, whole batches at a time: no built-in function has it."""

    def two_sided(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series(student_two_sided_all(ts.to_numpy(float), dfs.to_numpy(float)))

    return F.pandas_udf(two_sided, T.DoubleType())(t, df)


def welch(stats: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """t, df and lfc of ``stats`` (size, s, q) against ``reference`` (n0, s0, q0), joined on gene and ``by``."""
    both = stats.join(reference, ["gene_id", *by]).where("size >= 2 and n0 >= 2")
    m1, m0 = F.col("s") / F.col("size"), F.col("s0") / F.col("n0")
    a = variance(F.col("s"), F.col("q"), F.col("size")) / F.col("size")
    b = variance(F.col("s0"), F.col("q0"), F.col("n0")) / F.col("n0")
    wide = both.withColumn("m1", m1).withColumn("m0", m0).withColumn("_a", a).withColumn("_b", b)
    se2 = F.col("_a") + F.col("_b")
    ok = se2 > 0
    safe = wide.withColumn("t", F.when(ok, (F.col("m1") - F.col("m0")) / F.sqrt(F.when(ok, se2).otherwise(1.0))))
    safe = safe.withColumn("df", F.when(ok, se2 * se2 / F.when(ok, F.col("_a") * F.col("_a") / (F.col("size") - 1) + F.col("_b") * F.col("_b") / (F.col("n0") - 1)).otherwise(1.0)))
    return safe.withColumn("lfc", F.log2((F.exp("m1") - 1 + 1e-9) / (F.exp("m0") - 1 + 1e-9))).drop("_a", "_b")


def against_group(ds: Dataset, reference: str, by: str = "cluster", groups: list[str] | None = None) -> DataFrame:
    """(gene_id, cluster, t, df, lfc, pts, p, padj, rank): Student's p with Welch-Satterthwaite degrees of freedom; no spread gives no t and p 1."""
    stats = full_stats(ds, by)
    known = [r[0] for r in ds.cells.select(by).distinct().collect()]
    if reference not in known:
        raise KeyError(f"there is no group {reference!r}{nearest(reference, [k for k in known if k])}")
    base = stats.where(F.col("cluster") == reference).select("gene_id", F.col("size").alias("n0"), F.col("s").alias("s0"), F.col("q").alias("q0"))
    others = stats.where(F.col("cluster") != reference)
    if groups:
        others = others.where(F.col("cluster").isin(groups))
    found = welch(others, base, []).withColumn("pts", F.col("stored") / F.col("size")).withColumn("p", student("t", "df"))
    adjusted = adjust_bh(found, "p", ["cluster"], "gene_id")
    ranked = adjusted.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc_nulls_last(F.round("t", 9)), "gene_id")))
    return ranked.select("gene_id", "cluster", "t", "df", "lfc", "pts", "p", "padj", "rank")


def markers_long(ranked: DataFrame, genes: DataFrame, n: int = 10, groups: list[str] | None = None) -> DataFrame:
    top = ranked.where(F.col("rank") <= n)
    if groups:
        top = top.where(F.col("cluster").isin(groups))
    return top.join(genes.select("gene_id", "gene_name"), "gene_id").select(F.col("cluster").alias("group"), "rank", "gene_id", F.col("gene_name").alias("gene"), F.col("t").alias("score"), F.col("lfc").alias("logfoldchange"), F.col("padj").alias("pval_adj"), F.col("pts").alias("pct"))


def markers_wide(ranked: DataFrame, n: int = 10, groups: list[str] | None = None) -> DataFrame:
    """One column of gene ids for each group."""
    top = ranked.where(F.col("rank") <= n)
    return (top.groupBy("rank").pivot("cluster", groups) if groups else top.groupBy("rank").pivot("cluster")).agg(F.first("gene_id"))


def control_genes(genes: DataFrame, chosen: list[int], seed: int = 0) -> list[int]:
    """max(50, 5 * k) genes outside the set, picked by seeded hash, evenly and without regard to expression."""
    n = max(50, 5 * len(chosen))
    pool = genes.where(~F.col("gene_id").isin(chosen)).select("gene_id").orderBy(F.xxhash64("gene_id", F.lit(seed)), "gene_id").limit(n)
    return sorted(r[0] for r in pool.collect())


def score_genes(ds: Dataset, chosen: list[int], controls: list[int]) -> DataFrame:
    """(cell_id, score): mean over the set less mean over the controls, zeros included."""
    if not chosen:
        raise ValueError("none of the genes exists")
    inside, outside = F.col("gene_id").isin(chosen), F.col("gene_id").isin(controls)
    sums = ds.x.where(inside | outside).groupBy("cell_id").agg((F.sum(F.when(inside, F.col("value")).otherwise(0.0)) / len(chosen) - F.sum(F.when(outside, F.col("value")).otherwise(0.0)) / max(len(controls), 1)).alias("score"))
    return ds.cells.select("cell_id").join(sums, "cell_id", "left").fillna(0.0, ["score"])


def score_cell_type(ds: Dataset, markers: DataFrame) -> DataFrame:
    """(cell_id, cell_type, score): mean over the markers (cell_type, gene_id) that exist, zeros included; 0 if none does."""
    present = markers.join(ds.genes.select("gene_id"), "gene_id", "left_semi").dropDuplicates(["cell_type", "gene_id"])
    sizes = [(r.cell_type, r.k) for r in markers.select("cell_type").distinct().join(present.groupBy("cell_type").agg(F.count("*").alias("k")), "cell_type", "left").fillna(0).orderBy("cell_type").collect()]
    sums = ds.x.join(present, "gene_id").groupBy("cell_id", "cell_type").agg(F.sum("value").alias("s"))
    grid = ds.cells.select("cell_id", F.explode(F.array(*[F.struct(F.lit(c).alias("cell_type"), F.lit(k).alias("k")) for c, k in sizes])).alias("g")).select("cell_id", "g.cell_type", "g.k")
    return grid.join(sums, ["cell_id", "cell_type"], "left").select("cell_id", "cell_type", (F.coalesce("s", F.lit(0.0)) / F.greatest("k", F.lit(1))).alias("score"))
