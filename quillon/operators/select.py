"""Highly variable genes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.frames import Dataset, n_rows
from quillon.functions.checks import need_choice
from quillon.functions.numeric import cut_bin, log1p
from quillon.operators.qc import cluster_stats, gene_moments


def variable_genes(ds: Dataset, n_top: int = 2000, n_bins: int = 20, min_cells: int | None = None, include: list[int] | None = None, flavor: str = "seurat", lowess_frac: float = 0.1, moments: DataFrame | None = None) -> DataFrame:
    """gene_id, mean, dispersion, bin, score, rank, highly_variable. ``ds.x`` is normalized, not logarithmic.

    Only genes found in more than ``min_cells`` cells take part (a hundredth of the cells by default). ``moments``: those of ``ds``, if they are written already.
    """
    need_choice(flavor, ("seurat", "scarf"), "flavor")
    floor = int(0.01 * n_rows(ds.cells)) if min_cells is None else min_cells
    moments = gene_moments(ds) if moments is None else moments
    scored = seurat(moments, floor, n_bins) if flavor == "seurat" else lowess_scores(moments, floor, lowess_frac)
    best = Window.orderBy(F.col("_order").desc_nulls_last(), "gene_id")
    # Ranking needs all genes side by side, which are as many as the matrix is wide, not as it is long.
    ranked = scored.where("score is not null").withColumn("_order", F.round("score", 9)).withColumn("rank", F.row_number().over(best)).drop("_order")
    out = scored.join(ranked.select("gene_id", "rank"), "gene_id", "left")
    forced = F.col("gene_id").isin(include) if include else F.lit(False)
    return out.withColumn("highly_variable", F.coalesce(F.col("rank") <= n_top, F.lit(False)) | forced)


def shared_genes(ds: Dataset, batch: str) -> Dataset:
    """``ds`` with the genes only that have entries in every batch; cells without a batch don't count."""
    n = ds.cells.where(F.col(batch).isNotNull()).agg(F.count_distinct(batch)).first()[0]
    common = cluster_stats(ds, batch).groupBy("gene_id").agg(F.count("*").alias("k")).where(F.col("k") == n).select("gene_id")
    return ds.with_frames(x=ds.x.join(common, "gene_id", "left_semi"), genes=ds.genes.join(common, "gene_id", "left_semi"))


def seurat(moments: DataFrame, floor: int, n_bins: int) -> DataFrame:
    """Dispersion (variance over mean, logarithmic) standardised within bins of the logarithmic mean."""
    mean = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    d = moments.select("gene_id", "mean", "detected", F.when(F.col("var") > 0, F.log(F.col("var") / mean)).alias("dispersion"), log1p(mean).alias("_m"))
    live = d.where(F.col("detected") > floor)
    ends = live.agg(F.min("_m").alias("lo"), F.max("_m").alias("hi")).first()
    if ends.lo is None:
        return moments.select("gene_id", "mean", F.lit(None).cast("double").alias("dispersion"), F.lit(None).cast("int").alias("bin"), F.lit(None).cast("double").alias("score"))
    binned = live.withColumn("bin", cut_bin(F.col("_m"), F.lit(ends.lo), F.lit(ends.hi), n_bins))
    per = binned.where("dispersion is not null").groupBy("bin").agg(F.avg("dispersion").alias("_avg"), F.stddev_samp("dispersion").alias("_sd"), F.count("*").alias("_k"))
    z = F.when(F.col("dispersion").isNull(), None).when(F.col("_k") == 1, 1.0).when(F.col("_sd") < 1e-12, 0.0).otherwise((F.col("dispersion") - F.col("_avg")) / F.when(F.col("_sd") < 1e-12, 1.0).otherwise(F.col("_sd")))
    return moments.select("gene_id", "mean").join(binned.join(per, "bin", "left").select("gene_id", "dispersion", "bin", z.alias("score")), "gene_id", "left")


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 0.1, passes: int = 3) -> np.ndarray:
    """Robust locally weighted linear regression (tricube weights, bisquare robustness), at the points themselves."""
    n = len(x)
    k = max(2, min(n, int(round(frac * n + 1e-10))))
    robust, fit = np.ones(n), y.astype(float).copy()
    for _ in range(passes + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = max(np.partition(d, k - 1)[k - 1], 1e-12)
            w = np.clip(1 - (d / (h * 1.0000001)) ** 3, 0, None) ** 3 * robust
            s = w.sum()
            if s <= 0:
                continue
            mx, my = (w * x).sum() / s, (w * y).sum() / s
            sxx = (w * (x - mx) ** 2).sum()
            slope = (w * (x - mx) * (y - my)).sum() / sxx if sxx > 1e-12 * s else 0.0
            fit[i] = my + slope * (x[i] - mx)
        residual = np.abs(y - fit)
        scale = max(np.median(residual), 1e-9 * (1 + np.abs(y).max()))
        robust = np.clip(1 - (residual / (6 * scale)) ** 2, 0, None) ** 2
    return fit


def bin_floors(moments: DataFrame, floor: int, bins: int = 200) -> DataFrame:
    """Left-closed bins of ln mean and, in each, the gene of least ln variance (the least id of several): bin, gene_id, m, v."""
    live = moments.where((F.col("detected") > floor) & (F.col("mean") > 0) & (F.col("var") > 0)).select("gene_id", F.log("mean").alias("m"), F.log("var").alias("v"))
    ends = live.agg(F.min("m").alias("lo"), F.max("m").alias("hi")).first()
    if ends.lo is None:
        return live.select(F.lit(0).alias("bin"), "gene_id", "m", "v").limit(0)
    step = (ends.hi + 0.1 - ends.lo) / bins
    binned = live.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("m") - ends.lo) / step)).cast("int"))
    return binned.groupBy("bin").agg(F.min(F.struct(F.round("v", 9).alias("r"), "gene_id", "m", "v")).alias("b")).select("bin", "b.gene_id", "b.m", "b.v")


def lowess_scores(moments: DataFrame, floor: int, frac: float) -> DataFrame:
    """Variance over a robust trend of the least variances: at most 200 points are fitted on the driver."""
    points = bin_floors(moments, floor).orderBy("m").collect()
    live = moments.where((F.col("detected") > floor) & (F.col("mean") > 0) & (F.col("var") > 0))
    if len(points) < 3:
        return moments.select("gene_id", "mean", F.lit(None).cast("double").alias("dispersion"), F.lit(None).cast("int").alias("bin"), F.lit(None).cast("double").alias("score"))
    m, v = np.array([p.m for p in points]), np.array([p.v for p in points])
    fit = lowess(m, v, frac, passes=100)
    knots = F.array(*[F.struct(F.lit(float(a)).alias("m"), F.lit(float(b)).alias("f")) for a, b in zip(m, fit)])
    nearest = F.try_element_at(F.filter(knots, lambda k: k["m"] <= F.log("mean")), F.lit(-1))["f"]
    scored = live.select("gene_id", F.log("var").alias("dispersion"), F.exp(F.log("var") - F.coalesce(nearest, F.lit(float(fit[0])))).alias("score"))
    return moments.select("gene_id", "mean").join(scored, "gene_id", "left").select("gene_id", "mean", "dispersion", F.lit(None).cast("int").alias("bin"), "score")
