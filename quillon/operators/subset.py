"""Cells and genes to keep: masks are semi-joins on the dimension tables, so the plan itself is the view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.frames import Dataset
from quillon.functions.checks import nearest
from quillon.operators.qc import qc_metrics

DERIVED = ("n_counts", "n_genes", "pct_counts_mt", "n_cells", "total_counts", "mean_counts", "highly_variable", "score")


def keep_cells(ds: Dataset, condition: Column | str) -> Dataset:
    cells = ds.cells.where(condition)
    ids = cells.select("cell_id")
    emb = {k: e.join(ids, "cell_id", "left_semi") for k, e in ds.emb.items()}
    edges = {k: e.join(ids, e.src == ids.cell_id, "left_semi").join(ids, e.dst == ids.cell_id, "left_semi") for k, e in ds.edges.items()}
    return ds.with_frames(cells=cells, x=ds.x.join(ids, "cell_id", "left_semi"), emb=emb, edges=edges)


def keep_genes(ds: Dataset, condition: Column | str) -> Dataset:
    genes = ds.genes.where(condition)
    return ds.with_frames(genes=genes, x=ds.x.join(genes.select("gene_id"), "gene_id", "left_semi"))


def subset(ds: Dataset, cells: list | None = None, genes: list | None = None) -> Dataset:
    """By ids, or by names where they are strings; names that don't exist are errors with the nearest match."""

    def condition(frame: DataFrame, wanted: list, kind: str) -> Column:
        if wanted and isinstance(wanted[0], str):
            name = f"{kind}_name"
            found = {r[0] for r in frame.where(F.col(name).isin(wanted)).select(name).distinct().collect()}
            for w in wanted:
                if w not in found:
                    raise KeyError(f"there is no {kind} {w!r}{nearest(w, [r[0] for r in frame.select(name).limit(5000).collect()])}")
            return F.col(name).isin(wanted)
        return F.col(f"{kind}_id").isin(wanted)

    if cells is not None:
        ds = keep_cells(ds, condition(ds.cells, cells, "cell"))
    return keep_genes(ds, condition(ds.genes, genes, "gene")) if genes is not None else ds


def filter_cells(ds: Dataset, min_counts=None, max_counts=None, min_genes=None, max_genes=None, max_pct_mt=None) -> Dataset:
    """All bounds include their ends. Counts are made where they are missing; max_pct_mt needs pct_counts_mt."""
    if max_pct_mt is not None and "pct_counts_mt" not in ds.cells.columns:
        raise ValueError("max_pct_mt needs the column pct_counts_mt; compute quality metrics first")
    if not {"n_counts", "n_genes"} <= set(ds.cells.columns):
        ds = ds.with_frames(cells=qc_metrics(ds).cells)
    condition = F.lit(True)
    for column, low, high in (("n_counts", min_counts, max_counts), ("n_genes", min_genes, max_genes), ("pct_counts_mt", None, max_pct_mt)):
        condition = condition & (F.col(column) >= low if low is not None else F.lit(True)) & (F.col(column) <= high if high is not None else F.lit(True))
    return keep_cells(ds, condition)


def filter_genes(ds: Dataset, min_cells=None, min_counts=None) -> Dataset:
    """Counted over the cells that are left, which replaces older counts."""
    ds = ds.with_frames(genes=qc_metrics(ds).genes)
    condition = F.lit(True)
    for column, low in (("n_cells", min_cells), ("total_counts", min_counts)):
        condition = condition & (F.col(column) >= low if low is not None else F.lit(True))
    return keep_genes(ds, condition)


def from_counts(ds: Dataset, genes: str = "current", all_genes: DataFrame | None = None) -> Dataset:
    """A fresh analysis of the cells that are left from their raw counts; columns that earlier steps derived go."""
    genes_ = all_genes if genes == "all" and all_genes is not None else ds.genes
    raw = ds.raw if ds.raw is not None else ds.x
    x = raw.join(ds.cells.select("cell_id"), "cell_id", "left_semi").join(genes_.select("gene_id"), "gene_id", "left_semi")
    return Dataset(x, ds.cells.drop(*DERIVED), genes_.drop(*DERIVED))


def find_genes(genes: DataFrame, names: DataFrame) -> DataFrame:
    """(name, gene_id): exact matches, else matches that differ in case only (the least id of several)."""
    exact = names.join(genes.select(F.col("gene_name").alias("name"), "gene_id"), "name").groupBy("name").agg(F.min("gene_id").alias("exact"))
    loose = names.withColumn("_u", F.upper("name")).join(genes.select(F.upper("gene_name").alias("_u"), "gene_id"), "_u").groupBy("name").agg(F.min("gene_id").alias("loose"))
    return names.join(exact, "name", "left").join(loose, "name", "left").select("name", F.coalesce("exact", "loose").alias("gene_id"))


def head(ds: Dataset, n: int) -> Dataset:
    """The n cells of least id."""
    ids = ds.cells.select("cell_id").orderBy("cell_id").limit(n)
    return ds.with_frames(cells=ds.cells.join(ids, "cell_id", "left_semi"), x=ds.x.join(ids, "cell_id", "left_semi"))


def sample(ds: Dataset, n: int, seed: int = 0) -> Dataset:
    """n cells without replacement, picked by seeded hash."""
    ids = ds.cells.select("cell_id").orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(n)
    return ds.with_frames(cells=ds.cells.join(ids, "cell_id", "left_semi"), x=ds.x.join(ids, "cell_id", "left_semi"))


def gene_columns(ds: Dataset, gene_ids: list[int]) -> DataFrame:
    """cell_id and one column for each gene, zeros included."""
    wide = ds.x.where(F.col("gene_id").isin(gene_ids)).groupBy("cell_id").pivot("gene_id", gene_ids).agg(F.first("value"))
    renamed = wide.select("cell_id", *[F.col(str(g)).alias(f"gene_{g}") for g in gene_ids])
    return ds.cells.select("cell_id").join(renamed, "cell_id", "left").fillna(0.0)
