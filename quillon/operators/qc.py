"""Quality metrics, moments and group sums of the count matrix. Everything is one or two grouped aggregates over ``x``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.frames import Dataset, n_rows
from quillon.functions.numeric import variance


def qc_metrics(ds: Dataset, prefix: str = "MT-") -> Dataset:
    """Cells get n_counts, n_genes and (if any gene's name starts with ``prefix``) pct_counts_mt; genes get n_cells, total_counts, mean_counts."""
    marked = ds.genes.where(F.col("gene_name").startswith(prefix)).select("gene_id", F.lit(True).alias("mt")) if "gene_name" in ds.genes.columns else None
    with_mt = marked is not None and not marked.isEmpty()
    x = ds.x.join(marked, "gene_id", "left") if with_mt else ds.x
    aggs = [F.sum("value").alias("n_counts"), F.count_if(F.col("value") > 0).alias("n_genes")]
    if with_mt:
        aggs.append(F.sum(F.when(F.col("mt"), F.col("value")).otherwise(0.0)).alias("_mt"))
    cells = ds.cells.drop("n_counts", "n_genes", "pct_counts_mt").join(x.groupBy("cell_id").agg(*aggs), "cell_id", "left")
    cells = cells.fillna(0, ["n_counts", "n_genes"])
    if with_mt:
        cells = cells.withColumn("pct_counts_mt", 100 * F.coalesce("_mt", F.lit(0.0)) / F.when(F.col("n_counts") == 0, 1.0).otherwise(F.col("n_counts"))).drop("_mt")
    genes = ds.genes.drop("n_cells", "total_counts", "mean_counts").join(ds.x.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("n_cells"), F.sum("value").alias("total_counts")), "gene_id", "left")
    genes = genes.fillna(0, ["n_cells", "total_counts"]).withColumn("mean_counts", F.col("total_counts") / F.lit(float(max(n_rows(ds.cells), 1))))
    return ds.with_frames(cells=cells, genes=genes)


def row_totals(x: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Total of each cell, over these genes only if given."""
    return (x.join(genes.select("gene_id"), "gene_id", "left_semi") if genes is not None else x).groupBy("cell_id").agg(F.sum("value").alias("total"))


def gene_moments(ds: Dataset) -> DataFrame:
    """gene_id, mean, var over all cells, zeros included, and detected: the number of cells above zero."""
    n = float(n_rows(ds.cells))
    sums = ds.x.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count_if(F.col("value") > 0).alias("detected"))
    full = ds.genes.select("gene_id").join(sums, "gene_id", "left").fillna(0)
    return full.select("gene_id", (F.col("s") / max(n, 1.0)).alias("mean"), variance(F.col("s"), F.col("q"), F.lit(n)).alias("var"), "detected")


def cluster_stats(ds: Dataset, by: str = "cluster") -> DataFrame:
    """(gene_id, cluster, s, q, stored): sums, sums of squares and stored entries of labelled cells. Pairs without entries have no row."""
    labels = ds.cells.where(F.col(by).isNotNull()).select("cell_id", F.col(by).alias("cluster"))
    return ds.x.join(labels, "cell_id").groupBy("gene_id", "cluster").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count("*").alias("stored"))


def cluster_sizes(cells: DataFrame, by: str = "cluster") -> DataFrame:
    return cells.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("cluster")).agg(F.count("*").alias("size"))


def every_pair(genes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(gene_id, cluster, size) of all pairs. The clusters are few and known by name, so they are written into the plan."""
    groups = [(r["cluster"], r["size"]) for r in sizes.orderBy("cluster").collect()]
    if not groups:
        return genes.select("gene_id", F.lit(None).cast("string").alias("cluster"), F.lit(0).cast("long").alias("size")).limit(0)
    listed = F.array(*[F.struct(F.lit(c).alias("cluster"), F.lit(n).cast("long").alias("size")) for c, n in groups])
    return genes.select("gene_id", F.explode(listed).alias("g")).select("gene_id", "g.cluster", "g.size")


def cluster_means(ds: Dataset, by: str = "cluster") -> DataFrame:
    """(gene_id, cluster, size, mean): zeros included."""
    pairs = every_pair(ds.genes, cluster_sizes(ds.cells, by))
    return pairs.join(cluster_stats(ds, by), ["gene_id", "cluster"], "left").select("gene_id", "cluster", "size", (F.coalesce("s", F.lit(0.0)) / F.greatest("size", F.lit(1))).alias("mean"))


def pseudobulk(ds: Dataset, keys: list[str], min_cells: int = 1) -> tuple[DataFrame, DataFrame]:
    """(units, sums): one unit for each combination of ``keys`` present in at least ``min_cells`` cells; a cell that lacks a key belongs to none.

    units: keys, n_cells; sums: keys, gene_id, counts, expressing.
    """
    whole = ds.cells.dropna(subset=keys)
    units = whole.groupBy(*keys).agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)
    sums = ds.counts.join(whole.select("cell_id", *keys), "cell_id").groupBy(*keys, "gene_id").agg(F.sum("value").alias("counts"), F.count_if(F.col("value") > 0).alias("expressing"))
    return units, sums.join(units.select(*keys), keys, "left_semi")


def column_sums(ds: Dataset) -> DataFrame:
    """(gene_id, total, mean) and what centring each column leaves: centred, the sum of squares around the mean."""
    n = float(n_rows(ds.cells))
    sums = ds.x.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    full = ds.genes.select("gene_id").join(sums, "gene_id", "left").fillna(0.0)
    return full.select("gene_id", F.col("s").alias("total"), (F.col("s") / n).alias("mean"), (F.col("q") - F.col("s") * F.col("s") / n).alias("centred"))


def gram(x: DataFrame) -> DataFrame:
    """(g1, g2, dot) with g1 <= g2: the products of all pairs of columns that meet in a cell. The cost is the sum of squared row
    lengths, so genes are to be selected first."""
    left = x.select("cell_id", F.col("gene_id").alias("g1"), F.col("value").alias("v1"))
    right = x.select("cell_id", F.col("gene_id").alias("g2"), F.col("value").alias("v2"))
    return left.join(right, "cell_id").where("g1 <= g2").groupBy("g1", "g2").agg(F.sum(F.col("v1") * F.col("v2")).alias("dot"))


def project(x: DataFrame, factor: DataFrame) -> DataFrame:
    """(cell_id, component, value): x times a factor (gene_id, component, w)."""
    return x.join(factor, "gene_id").groupBy("cell_id", "component").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def composition(cells: DataFrame, groupby: str, color_by: str) -> DataFrame:
    """Share of each ``color_by`` value within each group."""
    counted = cells.dropna(subset=[groupby, color_by]).groupBy(groupby, color_by).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(groupby)))


def log_histogram(cells: DataFrame, column: str, bins: int = 64) -> DataFrame:
    """Counts in ``bins`` bins between the least and largest positive value, even on a logarithmic scale."""
    positive = cells.where(F.col(column) > 0).select(F.log(F.col(column)).alias("l"))
    ends = positive.agg(F.min("l").alias("lo"), F.max("l").alias("hi")).first()
    if ends.lo is None:
        return cells.sparkSession.createDataFrame([], "bin int, n long")
    step = (ends.hi - ends.lo) / bins or 1.0
    return positive.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("l") - ends.lo) / step + 1e-9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def dot_plot(ds: Dataset, by: str = "cluster") -> DataFrame:
    """(gene_id, cluster, pct, mean, z): share of cells with an entry, mean, and the mean's z-score across groups (ddof 1; 0 where all are equal)."""
    pairs = every_pair(ds.genes, cluster_sizes(ds.cells, by))
    full = pairs.join(cluster_stats(ds, by), ["gene_id", "cluster"], "left").fillna(0)
    means = full.select("gene_id", "cluster", (F.col("stored") / F.greatest("size", F.lit(1))).alias("pct"), (F.col("s") / F.greatest("size", F.lit(1))).alias("mean"))
    w = Window.partitionBy("gene_id")
    spread = F.stddev_samp("mean").over(w)
    return means.withColumn("z", F.when(spread > 1e-12, (F.col("mean") - F.avg("mean").over(w)) / spread).otherwise(0.0))
