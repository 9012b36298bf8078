"""The tables behind plots: what each would draw, small enough to hand to any plotting library. Nothing is drawn here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.frames import Dataset, is_numeric
from quillon.functions.checks import need_column
from quillon.operators.subset import gene_columns


def embedding(emb: DataFrame, cells: DataFrame, color: str, limit: int = 200_000, bins: int = 300) -> DataFrame:
    """(x, y, color) of each cell; beyond ``limit`` cells (x, y, n) of two-dimensional bins, each with its commonest or mean color."""
    need_column(cells, color)
    points = emb.select("cell_id", F.element_at("v", 1).alias("x"), F.element_at("v", 2).alias("y")).join(cells.select("cell_id", F.col(color).alias("color")), "cell_id")
    if points.count() <= limit:
        return points.select("cell_id", "x", "y", "color")
    ends = points.agg(*[f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    step = {c: ((ends[f"hi{c}"] - ends[f"lo{c}"]) / bins) or 1.0 for c in ("x", "y")}
    at = [F.least(F.lit(bins - 1), F.floor((F.col(c) - ends[f"lo{c}"]) / step[c])).cast("int").alias(c) for c in ("x", "y")]
    return points.groupBy(*at).agg(F.count("*").alias("n"), (F.avg("color") if is_numeric(points, "color") else F.mode("color")).alias("color"))


def explained_variance(variance: DataFrame) -> DataFrame:
    """(component, ratio, cumulative)."""
    return variance.select("component", "ratio", F.sum("ratio").over(Window.orderBy("component")).alias("cumulative"))  # one row a component


def violin(cells: DataFrame, value: str, groupby: str, split_by: str | None = None) -> DataFrame:
    """Of each group (and each half of it): n, least, quartiles, largest."""
    for c in filter(None, (value, groupby, split_by)):
        need_column(cells, c)
    keys = [groupby, *([split_by] if split_by else [])]
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = cells.dropna(subset=keys).groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), q.alias("q"), F.max(value).alias("high"))
    return found.select(*keys, "n", "low", F.element_at("q", 1).alias("q25"), F.element_at("q", 2).alias("median"), F.element_at("q", 3).alias("q75"), "high")


def gene_violin(ds: Dataset, gene_id: int, groupby: str) -> DataFrame:
    values = gene_columns(ds, [gene_id]).join(ds.cells.select("cell_id", groupby), "cell_id")
    return violin(values, f"gene_{gene_id}", groupby)


def scatter_qc(cells: DataFrame) -> DataFrame:
    return cells.select("cell_id", "n_counts", "n_genes")


def kept_and_removed(cells: DataFrame, condition, column: str, bins: int = 64) -> DataFrame:
    """(kept, bin, n): log-spaced histograms of the cells that a filter keeps and of those it removes, over one range."""
    positive = cells.where(F.col(column) > 0).select(F.log(column).alias("l"), F.coalesce(condition, F.lit(False)).alias("kept"))
    ends = positive.agg(F.min("l").alias("lo"), F.max("l").alias("hi")).first()
    if ends.lo is None:
        return positive.select("kept", F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    step = ((ends.hi - ends.lo) / bins) or 1.0
    return positive.groupBy("kept", F.least(F.lit(bins - 1), F.floor((F.col("l") - ends.lo) / step + 1e-9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def doublet_histogram(scores: DataFrame, bins: int = 50) -> DataFrame:
    """(batch, bin, n, threshold) of doublet scores between 0 and 1."""
    each = scores.where("score is not null").withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("int"))
    return each.groupBy("batch", "bin").agg(F.count("*").alias("n"), F.max("threshold").alias("threshold"))


def fold_changes(found: DataFrame, n: int = 6) -> DataFrame:
    """(gene_id, cluster, condition, lfc, tested): the genes that are among the ``n`` largest changes of any comparison, in all of them."""
    w = Window.partitionBy("cluster", "condition").orderBy(F.desc(F.abs("lfc")), "gene_id")
    chosen = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("gene_id").distinct()
    pairs = found.select("cluster", "condition").distinct()
    grid = chosen.join(pairs)  # chosen genes by comparisons
    return grid.join(found.select("gene_id", "cluster", "condition", "lfc"), ["gene_id", "cluster", "condition"], "left").withColumn("tested", F.col("lfc").isNotNull())


def overview(ds: Dataset) -> DataFrame:
    """One row: sizes and medians of quality metrics."""
    q = ds.cells.agg(F.count("*").alias("n_cells"), F.percentile("n_counts", F.lit(0.5)).alias("median_counts"), F.percentile("n_genes", F.lit(0.5)).alias("median_genes"))
    return q.crossJoin(ds.genes.agg(F.count("*").alias("n_genes")))  # single rows


def to_pandas(ds: Dataset) -> dict:
    """All frames on the driver, for what fits there."""
    return {"x": ds.x.toPandas(), "cells": ds.cells.toPandas(), "genes": ds.genes.toPandas(), "emb": {k: v.toPandas() for k, v in ds.emb.items()}, "edges": {k: v.toPandas() for k, v in ds.edges.items()}}
