"""Column expressions shared by operators. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def log1p(c: Column) -> Column:
    return F.log(F.lit(1.0) + c)


def normal_tail(x: Column) -> Column:
    """Upper tail of the standard normal: a polynomial below 2, the continued fraction of Mills' ratio from 2 on."""
    density = F.exp(-x * x / 2) * F.lit(0.3989422804014327)
    t = 1 / (1 + F.lit(0.2316419) * x)
    # Coefficients of the polynomial approximation 26.2.17 of Abramowitz and Stegun.
    series = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, k: k / (x + s))
    return F.when(x < 2, density * series).otherwise(density / (x + fraction))


def adjust_bh(df, p: str, by: list[str], tie: str, out: str = "padj"):
    """Benjamini-Hochberg within ``by`` over the rows given, which must be the tested ones."""
    group = Window.partitionBy(*by)
    ranked = df.withColumn("_r", F.row_number().over(group.orderBy(p, tie))).withColumn("_n", F.count("*").over(group))
    upward = group.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(upward))).drop("_r", "_n")


def cut_bin(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """The bin of x among n right-closed ones between lo and hi; the lowest edge lies a thousandth of the range below lo."""
    step = (hi - lo) / n
    rough = F.greatest(F.lit(0), F.least(F.lit(n - 1), (F.ceil((x - lo) / F.nullif(step, F.lit(0.0))) - 1).cast("int")))
    down = F.when((rough > 0) & (x <= lo + step * rough), rough - 1).otherwise(rough)
    up = F.when((down < n - 1) & (x > lo + step * (down + 1)), down + 1).otherwise(down)
    return F.when(step == 0, F.lit(0)).otherwise(up)


def variance(total: Column, squares: Column, n: Column) -> Column:
    """Sample variance from sums over n observations, implicit zeros among them; never below 0, and 0 for one observation."""
    mean = total / n
    return F.when(n < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (squares / n - mean * mean) * n / F.greatest(n - 1, F.lit(1))))


def average_rank(order: Column, by: list[str]) -> Column:
    group = Window.partitionBy(*by)
    return F.rank().over(group.orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, order)) - 1) / 2.0
