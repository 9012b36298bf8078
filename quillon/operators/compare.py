"""Comparing conditions: cell by cell, or pseudobulk samples with a moderated linear model."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.frames import Dataset
from quillon.functions.numeric import adjust_bh
from quillon.functions.special import bh, digamma, inverse_trigamma, student_two_sided_all, trigamma
from quillon.operators.markers import student, welch
from quillon.operators.qc import pseudobulk


def unit_stats(ds: Dataset, condition: str, groupby: str, min_cells: int = 10) -> DataFrame:
    """(cluster, condition, gene_id, size, s, q, stored) for pairs of group and condition with enough cells."""
    cells = ds.cells.dropna(subset=[condition, groupby]).select("cell_id", F.col(groupby).alias("cluster"), F.col(condition).alias("condition"))
    sizes = cells.groupBy("cluster", "condition").agg(F.count("*").alias("size")).where(F.col("size") >= min_cells)
    named = sizes.select(F.struct("cluster", "condition").alias("cluster"), "size")
    stats = ds.x.join(cells, "cell_id").groupBy("gene_id", "cluster", "condition").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count("*").alias("stored"))
    kept = named.select("cluster.cluster", "cluster.condition", "size").collect()
    if not kept:
        return stats.withColumn("size", F.lit(0).cast("long")).limit(0)
    listed = F.array(*[F.struct(F.lit(r.cluster).alias("cluster"), F.lit(r.condition).alias("condition"), F.lit(r["size"]).cast("long").alias("size")) for r in kept])
    grid = ds.genes.select("gene_id", F.explode(listed).alias("g")).select("gene_id", "g.*")
    return grid.join(stats, ["gene_id", "cluster", "condition"], "left").fillna(0)


def compare_cells(ds: Dataset, condition: str, reference: str, groupby: str = "cluster", min_cells: int = 10, with_p: bool = True) -> DataFrame:
    """Each condition against ``reference`` within each group, on logarithmic values of single cells."""
    stats = unit_stats(ds, condition, groupby, min_cells)
    base = stats.where(F.col("condition") == reference).select("gene_id", "cluster", F.col("size").alias("n0"), F.col("s").alias("s0"), F.col("q").alias("q0"), (F.col("stored") / F.col("size")).alias("pct_ref"))
    found = welch(stats.where(F.col("condition") != reference), base, ["cluster"]).withColumn("pct_cond", F.col("stored") / F.col("size"))
    if not with_p:
        return found.select("cluster", "condition", "gene_id", "t", "df", "lfc", "pct_ref", "pct_cond")
    adjusted = adjust_bh(found.withColumn("p", student("t", "df")), "p", ["cluster", "condition"], "gene_id")
    return adjusted.select("cluster", "condition", "gene_id", "t", "df", "lfc", "pct_ref", "pct_cond", "p", "padj")


def expressed(counts: np.ndarray, condition: np.ndarray, min_count: float = 10, min_total: float = 15) -> np.ndarray:
    """Genes whose counts per million reach the bar in as many samples as the smallest condition has (fewer beyond ten), and whose total does."""
    lib = counts.sum(axis=0)
    k = min(np.unique(condition, return_counts=True)[1])
    k = 10 + (k - 10) * 0.7 if k > 10 else k
    bar = min_count / np.median(lib) * 1e6
    cpm = counts / np.maximum(lib, 1e-300) * 1e6
    return ((cpm >= bar).sum(axis=1) >= k - 1e-14) & (counts.sum(axis=1) >= min_total - 1e-14)


def average_ranks(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank(method="average").to_numpy()


def tmm(counts: np.ndarray, trim_m: float = 0.3, trim_a: float = 0.05) -> np.ndarray:
    """Trimmed mean of M-values: a factor for each sample, of geometric mean 1."""
    counts = counts[(counts > 0).any(axis=1)]
    lib = counts.sum(axis=0)
    if counts.shape[0] == 0 or counts.shape[1] == 1:
        return np.ones(counts.shape[1])
    upper = np.array([np.quantile(counts[:, j], 0.75) for j in range(counts.shape[1])]) / lib
    ref = int(np.argmin(np.abs(upper - upper.mean())))
    out = np.ones(counts.shape[1])
    for j in range(counts.shape[1]):
        both = (counts[:, j] > 0) & (counts[:, ref] > 0)
        a, b = counts[both, j], counts[both, ref]
        m, level = np.log2((a / lib[j]) / (b / lib[ref])), (np.log2(a / lib[j]) + np.log2(b / lib[ref])) / 2
        if not len(m) or np.abs(m).max() < 1e-6:
            continue
        v = (lib[j] - a) / lib[j] / a + (lib[ref] - b) / lib[ref] / b
        n = len(m)
        low_m, low_a = math.floor(n * trim_m) + 1, math.floor(n * trim_a) + 1
        rm, ra = average_ranks(m), average_ranks(level)
        keep = (rm >= low_m) & (rm <= n + 1 - low_m) & (ra >= low_a) & (ra <= n + 1 - low_a)
        if keep.any():
            w = (m[keep] / v[keep]).sum() / (1 / v[keep]).sum()
            out[j] = 2**w if np.isfinite(w) else 1.0
    return out / np.exp(np.log(out).mean())


def log_cpm(counts: np.ndarray, factors: np.ndarray, prior: float = 3) -> np.ndarray:
    lib = counts.sum(axis=0) * factors
    scaled = lib / lib.mean() * prior
    return np.log2((counts + scaled) / (lib + 2 * scaled) * 1e6)


def natural_spline(x: np.ndarray, inner: int) -> np.ndarray:
    """Basis of natural cubic splines with knots at the ends and ``inner`` quantiles between."""
    knots = np.quantile(x, np.linspace(0, 1, inner + 2))
    if knots[-1] - knots[0] < 1e-12:
        return np.ones((len(x), 1))
    x, knots = (x - knots[0]) / (knots[-1] - knots[0]), (knots - knots[0]) / (knots[-1] - knots[0])
    d = lambda k: (np.clip(x - knots[k], 0, None) ** 3 - np.clip(x - knots[-1], 0, None) ** 3) / max(knots[-1] - knots[k], 1e-9)
    return np.stack([np.ones(len(x)), x, *(d(k) - d(len(knots) - 2) for k in range(len(knots) - 2))], axis=1)


def fit_prior(var: np.ndarray, df: float, level: np.ndarray) -> tuple[np.ndarray, float]:
    """(prior variance of each gene along the trend, prior degrees of freedom) by moments of log variances."""
    n = len(var)
    var = np.maximum(var, 1e-5 * max(np.median(var), 1e-300))
    e = np.log(var) - digamma(df / 2) + math.log(df / 2)
    basis = natural_spline(level, 0 if n < 6 else 1 if n < 30 else 2)
    coef, _, rank, _ = np.linalg.lstsq(basis, e, rcond=None)
    trend = basis @ coef
    left = ((e - trend) ** 2).sum() / max(n - rank, 1) - trigamma(df / 2)
    if left > 0:
        d0 = 2 * inverse_trigamma(left)
        return np.exp(trend + digamma(d0 / 2) - math.log(d0 / 2)), d0
    return np.exp(trend), math.inf


def moderated(counts: np.ndarray, condition: np.ndarray, replicate: np.ndarray, reference: str) -> dict[str, np.ndarray] | None:
    """For each other condition of the kept genes: kept, lfc, t, p. None where the design can't be fitted."""
    others = sorted(set(condition) - {reference})
    if reference not in condition or not others or len(condition) < 3:
        return None
    kept = expressed(counts, condition)
    if kept.sum() < 3:
        return None
    used = counts[kept]
    y = log_cpm(used, tmm(used))
    columns = [np.ones(len(condition))]
    paired = pd.DataFrame({"r": replicate, "c": condition}).groupby("r").c.nunique().max() > 1
    if paired:
        columns += [(replicate == r).astype(float) for r in sorted(set(replicate))[1:]]
    columns += [(condition == c).astype(float) for c in others]
    x = np.stack(columns, axis=1)
    n, p = x.shape
    if n <= p or np.linalg.matrix_rank(x) < p:
        return None
    inverse = np.linalg.inv(x.T @ x)
    coef = y @ x @ inverse
    df = n - p
    var = ((y - coef @ x.T) ** 2).sum(axis=1) / df
    s0, d0 = fit_prior(var, df, y.mean(axis=1))
    post = s0 if math.isinf(d0) else (d0 * s0 + df * var) / (d0 + df)
    total = min(df + d0, df * len(var))
    out: dict[str, np.ndarray] = {"kept": kept, "ref": y[:, condition == reference].mean(axis=1)}
    for i, c in enumerate(others):
        j = p - len(others) + i
        t = coef[:, j] / np.sqrt(post * inverse[j, j])
        out[f"lfc {c}"], out[f"t {c}"] = coef[:, j], t
        out[f"mean {c}"] = y[:, condition == c].mean(axis=1)
        out[f"p {c}"] = student_two_sided_all(t, np.full(len(t), total))
    return out


RESULT = "cluster string, condition string, gene_id long, lfc double, mean_ref double, mean_cond double, pct_ref double, pct_cond double, t double, p double, padj double"


def compare_pseudobulk(ds: Dataset, condition: str, reference: str, groupby: str, sample_key: str, min_cells: int = 10) -> DataFrame:
    """Pseudobulk samples of each group fitted with a moderated linear model. A group's table (genes by samples) is one task's input;
    it is made of sums, so its size doesn't follow the number of cells."""
    keys = [groupby, condition, sample_key]
    units, sums = pseudobulk(ds, keys, min_cells)
    table = sums.join(units, keys).select(F.col(groupby).alias("cluster"), F.col(condition).alias("condition"), F.col(sample_key).alias("replicate"), "gene_id", "counts", "expressing", "n_cells")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["condition", "replicate", "gene_id"])
        wide = pdf.pivot(index="gene_id", columns=["condition", "replicate"], values="counts").fillna(0.0)
        expressing = pdf.pivot(index="gene_id", columns=["condition", "replicate"], values="expressing").fillna(0.0).to_numpy()
        cells = pdf.drop_duplicates(["condition", "replicate"]).set_index(["condition", "replicate"]).n_cells.reindex(wide.columns).to_numpy()
        cond, rep = (wide.columns.get_level_values(i).to_numpy() for i in (0, 1))
        found = moderated(wide.to_numpy(), cond, rep, reference)
        parts = []
        if found is not None:
            share = lambda c: (expressing[:, cond == c].sum(axis=1) / cells[cond == c].sum())[found["kept"]]
            for c in sorted(set(cond) - {reference}):
                p = found[f"p {c}"]
                parts.append(pd.DataFrame({"cluster": pdf.cluster.iloc[0], "condition": c, "gene_id": wide.index.to_numpy()[found["kept"]], "lfc": found[f"lfc {c}"], "mean_ref": found["ref"], "mean_cond": found[f"mean {c}"], "pct_ref": share(reference), "pct_cond": share(c), "t": found[f"t {c}"], "p": p, "padj": bh(p)}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])

    return table.groupBy("cluster").applyInPandas(fit, RESULT)


def expression_filter(sums: DataFrame, units: DataFrame, by: str, condition: str, min_count: float = 10, min_total: float = 15) -> DataFrame:
    """(by, gene_id) of genes kept by the filter of :func:`expressed`, as a plan."""
    keys = [c for c in units.columns if c != "n_cells"]
    lib = sums.groupBy(*keys).agg(F.sum("counts").alias("lib"))
    bars = lib.groupBy(by).agg(F.percentile("lib", F.lit(0.5)).alias("med"))
    smallest = lib.groupBy(by, condition).agg(F.count("*").alias("n")).groupBy(by).agg(F.min("n").alias("k"))
    k = F.when(F.col("k") > 10, 10 + (F.col("k") - 10) * 0.7).otherwise(F.col("k").cast("double"))
    each = sums.join(lib, keys).join(bars, by).join(smallest, by)
    good = (F.col("counts") / F.col("lib") * 1e6 >= F.lit(float(min_count)) / F.col("med") * 1e6)
    kept = each.groupBy(by, "gene_id").agg(F.count_if(good).alias("hits"), F.sum("counts").alias("total"), F.max(k).alias("need"))
    return kept.where((F.col("hits") >= F.col("need") - 1e-14) & (F.col("total") >= min_total - 1e-14)).select(by, "gene_id")


def unit_log_cpm(sums: DataFrame, units: DataFrame, prior: float = 3.0) -> DataFrame:
    """(keys, gene_id, log_cpm) of stored sums with library sizes as they are; the prior is scaled by library size over its mean."""
    keys = [c for c in units.columns if c != "n_cells"]
    lib = sums.groupBy(*keys).agg(F.sum("counts").alias("lib"))
    mean = lib.agg(F.avg("lib")).first()[0] or 1.0
    scaled = F.col("lib") / mean * prior
    return sums.join(lib, keys).select(*keys, "gene_id", F.log2((F.col("counts") + scaled) / (F.col("lib") + 2 * scaled) * 1e6).alias("log_cpm"))


def volcano(found: DataFrame, alpha: float = 0.05) -> DataFrame:
    return found.withColumn("significant", (F.col("padj") < alpha) & (F.abs("lfc") >= 1))


def top_fold_changes(found: DataFrame, n: int = 6) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("cluster", "condition").orderBy(F.desc(F.abs("lfc")), "gene_id"))).where(F.col("rank") <= n)
