"""Marker-based annotation: weights of markers, scores of cells, decisions for clusters, the ontology above them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.frames import Dataset
from quillon.operators.qc import gene_moments

MARKERS = "cell_type string, gene string, sign int, evidence double, strength double"


def marker_table(spark, source) -> DataFrame:
    """From a dict {type: [genes]} (a gene with a trailing - is a negative marker), or a DataFrame that has cell_type and gene."""
    if isinstance(source, dict):
        rows = [(t, g.rstrip("+-"), -1 if g.endswith("-") else 1, 1.0, 1.0) for t, own in source.items() for g in own]
        return spark.createDataFrame(rows, MARKERS)
    for column, default in (("sign", F.lit(1)), ("evidence", F.lit(1.0)), ("strength", F.lit(1.0))):
        if column not in source.columns:
            source = source.withColumn(column, default)
    return source.select("cell_type", "gene", F.col("sign").cast("int").alias("sign"), F.col("evidence").cast("double").alias("evidence"), F.col("strength").cast("double").alias("strength"))


def read_gmt(spark, path: str) -> DataFrame:
    """Gene sets as lines: name, description, genes, separated by tabs."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") > 2)
    return marker_table(spark, parts.select(F.element_at("p", 1).alias("cell_type"), F.explode(F.slice("p", 3, 1_000_000)).alias("gene")).where("gene <> ''"))


def guess_species(genes: DataFrame) -> str:
    """Human names are upper case, mouse names capitalized."""
    r = genes.agg(F.count_if(F.col("gene_name") == F.upper("gene_name")).alias("up"), F.count("*").alias("n")).first()
    return "human" if r.n == 0 or r.up * 2 >= r.n else "mouse"


def to_species(markers: DataFrame, orthologs: DataFrame) -> DataFrame:
    """Genes by their orthologs (gene, other); one gene may have several, a gene without keeps its name capitalized."""
    mapped = orthologs.groupBy("gene").agg(F.array_sort(F.collect_set("other")).alias("others"))
    return markers.join(mapped, "gene", "left").withColumn("gene", F.explode(F.coalesce("others", F.array(F.initcap("gene"))))).drop("others")


def weigh(markers: DataFrame, max_markers: int = 30) -> DataFrame:
    """(cell_type, gene, sign, weight): evidence on a logarithmic scale times rarity among types, the best ``max_markers`` of a type."""
    shared = Window.partitionBy("gene", "sign")
    n = markers.select("cell_type").distinct().count()
    ends = markers.agg(F.min("evidence").alias("lo"), F.max("evidence").alias("hi")).first()
    rare = F.lit(n + 1) - F.count("*").over(shared)
    named = markers.dropDuplicates(["cell_type", "gene", "sign"]).withColumn("_rare", rare)
    span = named.agg(F.min("_rare").alias("lo"), F.max("_rare").alias("hi")).first()
    scaled = F.lit(ends.lo) if span.lo == span.hi else (F.col("_rare") - span.lo) / float(span.hi - span.lo) * (ends.hi - ends.lo) + ends.lo
    weight = (F.log10("evidence") + 1) * (F.log10(scaled) + 1)
    best = Window.partitionBy("cell_type").orderBy(F.desc(F.round("weight", 9)), F.desc("strength"), "gene", "sign")
    return named.withColumn("weight", weight).withColumn("r", F.row_number().over(best)).where(F.col("r") <= max_markers).select("cell_type", "gene", "sign", "weight")


def score_matrix(weights: DataFrame) -> DataFrame:
    """(cell_type, gene, w): signed weights over the square root of the type's sum of weights."""
    return weights.select("cell_type", "gene", (F.col("sign") * F.col("weight") / F.sqrt(F.sum("weight").over(Window.partitionBy("cell_type")))).alias("w"))


def score_cells(ds: Dataset, matrix: DataFrame) -> DataFrame:
    """(cell_id, cell_type, score): standardised values of marker genes, weighted. Zeros enter as one offset for each type."""
    genes = ds.genes.select("gene_id", F.col("gene_name").alias("gene"))
    moments = gene_moments(ds).where("var > 1e-18").select("gene_id", "mean", F.sqrt("var").alias("sd"))
    w = matrix.join(genes, "gene").join(moments, "gene_id").select("gene_id", "cell_type", (F.col("w") / F.col("sd")).alias("w"), (F.col("mean") * F.col("w") / F.col("sd")).alias("off"))
    offsets = w.groupBy("cell_type").agg(F.sum("off").alias("off"))
    types = [(r.cell_type, r.off) for r in offsets.orderBy("cell_type").collect()]
    sums = ds.x.join(w.select("gene_id", "cell_type", "w"), "gene_id").groupBy("cell_id", "cell_type").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    grid = ds.cells.select("cell_id", F.explode(F.array(*[F.struct(F.lit(t).alias("cell_type"), F.lit(o).alias("off")) for t, o in types])).alias("g")).select("cell_id", "g.*")
    return grid.join(sums, ["cell_id", "cell_type"], "left").select("cell_id", "cell_type", (F.coalesce("s", F.lit(0.0)) - F.col("off")).alias("score"))


def best_types(scores: DataFrame) -> DataFrame:
    """(cell_id, best, score, second): the best two types of each cell, ties by name."""
    w = Window.partitionBy("cell_id").orderBy(F.desc(F.round("score", 9)), "cell_type")
    top = scores.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return top.groupBy("cell_id").agg(F.max(F.when(F.col("r") == 1, F.col("cell_type"))).alias("best"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("r") == 2, F.col("cell_type"))).alias("second"))


def decide(scores: DataFrame, labels: DataFrame, least_support: float = 0.25, margin: float = 0.1, ontology: DataFrame | None = None) -> DataFrame:
    """(cluster, label, best, mean, support, runner_up): the type of the best mean score; unassigned where that isn't positive or too few
    cells score above zero; with a runner-up within ``margin``, the common ancestor of the two if an ontology (term, parent) is given."""
    named = scores.join(labels.where("cluster is not null"), "cell_id")
    per = named.groupBy("cluster", "cell_type").agg(F.avg("score").alias("mean"), F.avg((F.col("score") > 0).cast("double")).alias("support"))
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("mean", 9)), "cell_type")
    top = per.withColumn("r", F.row_number().over(w)).where("r <= 2")
    first = top.where("r = 1").select("cluster", F.col("cell_type").alias("best"), "mean", "support")
    second = top.where("r = 2").select("cluster", F.col("cell_type").alias("runner_up"), F.col("mean").alias("_m2"))
    joined = first.join(second, "cluster", "left")
    close = F.col("_m2") >= (1 - margin) * F.col("mean")
    label = F.when((F.col("mean") <= 0) | (F.col("support") < least_support), "unassigned")
    if ontology is not None:
        common = common_ancestors(ontology)
        joined = joined.join(common.select(F.col("a").alias("best"), F.col("b").alias("runner_up"), "ancestor"), ["best", "runner_up"], "left")
        label = label.when(close & F.col("ancestor").isNotNull(), F.col("ancestor"))
    return joined.select("cluster", label.otherwise(F.col("best")).alias("label"), "best", "mean", "support", F.when(close, F.col("runner_up")).alias("runner_up"))


def also_present(scores: DataFrame, labels: DataFrame, decided: DataFrame, share: float = 0.02, least: int = 10, most: int = 3) -> DataFrame:
    """(cluster, cell_type, cells): other types that enough cells of a cluster score highly for."""
    named = best_types(scores).join(labels, "cell_id").join(decided.select("cluster", F.col("best").alias("main"), "mean"), "cluster")
    strong = named.where((F.col("best") != F.col("main")) & (F.col("score") >= F.greatest(0.5 * F.col("mean"), F.lit(1.0))))
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    counted = strong.groupBy("cluster", F.col("best").alias("cell_type")).agg(F.count("*").alias("cells")).join(sizes, "cluster").where(F.col("cells") >= F.greatest(F.lit(float(least)), share * F.col("size")))
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("cells"), "cell_type"))).where(F.col("r") <= most).select("cluster", "cell_type", "cells")


def ancestors(ontology: DataFrame, rounds: int = 64) -> DataFrame:
    """(term, ancestor, steps): the closure of (term, parent), each term its own ancestor at 0; the shortest way counts."""
    terms = ontology.select("term").union(ontology.select("parent")).where("term is not null").distinct()
    found = terms.select("term", F.col("term").alias("ancestor"), F.lit(0).alias("steps"))
    front, n = found, found.count()
    up = ontology.select(F.col("term").alias("ancestor"), "parent")
    for step in range(1, rounds + 1):
        front = front.join(up, "ancestor").select("term", F.col("parent").alias("ancestor"), F.lit(step).alias("steps")).distinct()
        found = found.union(front).groupBy("term", "ancestor").agg(F.min("steps").alias("steps"))
        now = found.count()
        if now == n:
            break
        n = now
    return found


def common_ancestors(ontology: DataFrame) -> DataFrame:
    """(a, b, ancestor): of all pairs of terms the common ancestor fewest steps away in all, ties by name."""
    up = ancestors(ontology)
    pairs = up.select(F.col("term").alias("a"), "ancestor", F.col("steps").alias("sa")).join(up.select(F.col("term").alias("b"), "ancestor", F.col("steps").alias("sb")), "ancestor")
    return pairs.groupBy("a", "b").agg(F.min(F.struct((F.col("sa") + F.col("sb")).alias("d"), "ancestor")).alias("m")).select("a", "b", "m.ancestor")
