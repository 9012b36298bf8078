"""Per-value transforms. Totals come from a window over a cell's entries: one shuffle by cell, on which later steps by cell build."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.frames import Dataset
from quillon.functions.numeric import log1p


#: A column of ``x`` that holds what a cell's entries add up to, found beforehand by :func:`with_totals`.
TOTAL = "_total"


def with_totals(x: DataFrame) -> DataFrame:
    """The entries of a cell side by side, with their sum: written so, sums by cell and normalization need no shuffle of all entries."""
    return x.select("cell_id", "gene_id", "value").repartition("cell_id").withColumn(TOTAL, F.sum("value").over(Window.partitionBy("cell_id")))


def scaled(x: DataFrame, target: float, zero: float) -> DataFrame:
    total = F.col(TOTAL) if TOTAL in x.columns else F.sum("value").over(Window.partitionBy("cell_id"))
    return x.withColumn("value", F.when(total == 0, F.col("value") * zero).otherwise(F.col("value") * target / F.when(total == 0, 1.0).otherwise(total))).drop(TOTAL)


def normalize_total(ds: Dataset, target: float = 1e4) -> Dataset:
    """Each cell's values add up to ``target``; a cell of total 0 is left as it is."""
    return ds.with_x(scaled(ds.x, target, 1.0))


def log_transform(ds: Dataset) -> Dataset:
    return ds.with_x(ds.x.withColumn("value", log1p(F.col("value"))))


def renormalize(ds: Dataset, target: float = 1000.0, log: bool = True) -> Dataset:
    """Normalizes again, from raw counts of the genes that are left; a cell of remaining total 0 becomes 0."""
    x = scaled(ds.counts, target, 0.0)
    return ds.with_x(x.withColumn("value", log1p(F.col("value"))) if log else x)


def standardize(x: DataFrame, moments: DataFrame, max_value: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(stored, zeros): stored entries as clip((x - mean) / sd), and for each gene what its zeros become; sd 0 counts as 1."""
    sd = F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0)
    clip = lambda c: F.greatest(F.lit(-max_value), F.least(F.lit(max_value), c)) if max_value else c
    base = moments.select("gene_id", "mean", sd.alias("sd"))
    zeros = base.select("gene_id", clip(-F.col("mean") / F.col("sd")).alias("zero"))
    stored = x.join(base, "gene_id").select("cell_id", "gene_id", clip((F.col("value") - F.col("mean")) / F.col("sd")).alias("value"))
    return stored, zeros
