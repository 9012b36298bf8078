"""Queries that state what must hold of results that SQL can't compute: sums that rotations, signs and orders leave alone, and properties of the whole.

Each applies an operator of the numeric core to whole tables and returns numbers that SQL finds from the tables by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.adapters import cust_part, doc_token, order_brand, supp_brand, vectors
from quillon.operators import cluster, compare, curate, decompose, doublets, graph, hierarchy, integrate, layout, normalize
from quillon.plans import process
from quillon.plans.steps import Steps
from quillon.queries_graph import K, SIG, fuzzy, kept, knn, labels
from quillon.queries_matrix import CP, OB, SB, UNITS, VAR, r, tidy
from quillon.queries_models import SBN, sb

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, digits: int = 6):
    def register(f):
        QUERIES[name] = lambda s, d: tidy(f(s, d), digits)
        ORACLES[name] = sql
        return f

    return register


# Components: inner products of scores, and each gene's share of the variances, whatever the rotation within equal values.
GRID = f"{SBN}, n AS (SELECT count(*)::DOUBLE AS n FROM cells), full_ AS (SELECT c.cell_id, g.gene_id, coalesce(value, 0e0) AS value FROM cells c CROSS JOIN genes g LEFT JOIN xl ON xl.cell_id = c.cell_id AND xl.gene_id = g.gene_id), mom AS (SELECT gene_id, sum(value) / n AS mean, {VAR('sum(value)', 'sum(value * value)', 'n')} AS var FROM full_, n GROUP BY gene_id, n)"


def of_genes(parts: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    _, loadings, variance = parts
    return loadings.select("gene_id", F.posexplode("loading").alias("component", "l")).join(variance, "component").groupBy("gene_id").agg(F.sum(F.col("variance") * F.col("l") * F.col("l")).alias("variance"))


@query("r1_score_products", f"WITH {GRID}, z AS (SELECT cell_id, gene_id, value - mean AS z FROM full_ JOIN mom USING (gene_id)), f AS (SELECT gene_id, z FROM z WHERE cell_id = (SELECT min(cell_id) FROM cells)) SELECT cell_id, {r('sum(z.z * z.z)', 5)} AS own, {r('sum(z.z * f.z)', 5)} AS first FROM z JOIN f USING (gene_id) GROUP BY 1", 5)
def score_products(s, d):
    """Scores of all components keep the centred cells' inner products: each with itself and with the first cell's."""
    scores = Steps(s, "scores").keep(decompose.pca(sb(s, d), 25)[0])
    first = F.array(*[F.lit(x) for x in scores.orderBy("cell_id").first().v])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    return scores.select("cell_id", dot(F.col("v"), F.col("v")).alias("own"), dot(F.col("v"), first).alias("first"))


query("r1_gene_variances", f"WITH {GRID} SELECT gene_id, {r('var', 5)} AS variance FROM mom", 5)(lambda s, d: of_genes(decompose.pca(sb(s, d), 25)))
query("r3_randomized_gene_variances", f"WITH {GRID} SELECT gene_id, {r('var', 5)} AS variance FROM mom", 5)(lambda s, d: of_genes(decompose.pca(sb(s, d), 25, gram_genes=0)))
SCALED = f"{GRID}, z AS (SELECT cell_id, gene_id, greatest(-3e0, least(3e0, (value - mean) / CASE WHEN var > 0 THEN sqrt(var) ELSE 1e0 END)) AS z FROM full_ JOIN mom USING (gene_id))"
query("r2_scaled_gene_variances", f"WITH {SCALED} SELECT gene_id, {r('sum(z * z) / (n - 1)', 5)} AS variance FROM z, n GROUP BY gene_id, n", 5)(lambda s, d: of_genes(decompose.pca(sb(s, d), 25, scale=True, max_value=3.0)))


@query("x6_explained_variance_whole", f"WITH {GRID}, t AS (SELECT sum(var) AS t FROM mom) SELECT least((SELECT count(*) FROM genes), (SELECT count(*) FROM cells) - 1) AS components, {r('t', 5)} AS variance, 1e0 AS cumulative FROM t", 5)
def explained(s, d):
    variance = decompose.pca(sb(s, d), 25)[2]
    return variance.agg(F.count("*").alias("components"), F.sum("variance").alias("variance"), F.sum("ratio").alias("cumulative"))


@query("r3_randomized_finds_the_leading", f"WITH {CP} SELECT true AS agree, count(DISTINCT gene_id) AS genes FROM genes")
def randomized(s, d):
    """Variances by block iteration are never above those that the product of all columns gives, and the leading ones reach nine tenths of them.
    Of more than 4,096 genes that product isn't taken: there a Krylov space of 13 blocks from another start stands for it."""
    ds = normalize.log_transform(normalize.normalize_total(cust_part(s, d)))
    near, exact = (decompose.pca(ds, 3, **how)[2].select("component", F.col("variance").alias(n)) for how, n in (({"gram_genes": 0}, "near"), ({"seed": 1, "rounds": 12}, "exact")))
    off = near.join(exact, "component").agg(F.min(F.col("near") / F.col("exact")).alias("low"), F.max(F.col("near") / F.col("exact")).alias("high"))
    return off.crossJoin(ds.genes.agg(F.count_distinct("gene_id").alias("genes"))).select(((F.col("low") > 0.9) & (F.col("high") < 1 + 1e-9)).alias("agree"), "genes")  # one row each


# Batch correction
def shifted(s, d):
    emb = vectors(s, d)
    return emb.select("cell_id", F.transform("v", lambda x, i: x + F.when(i < 3, (F.col("cell_id") % 3) * 0.5).otherwise(0.0)).alias("v")), emb.select("cell_id", (F.col("cell_id") % 3).cast("string").alias("batch"))


def spread(emb: DataFrame, batch: DataFrame) -> DataFrame:
    """(batch, far): the squared distance of each batch's mean from the mean of all."""
    long = emb.join(batch, "cell_id").select("batch", F.posexplode("v").alias("j", "x"))
    whole = long.groupBy("j").agg(F.avg("x").alias("m"))
    return long.groupBy("batch", "j").agg(F.avg("x").alias("x")).join(whole, "j").groupBy("batch").agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("far"))


@query("r4_harmony_brings_batches_together", "SELECT (vec_id % 3)::VARCHAR AS batch, count(*) AS cells, vec_id % 3 <> 1 AS nearer FROM embeddings GROUP BY 1, 3")
def harmony(s, d):
    """Planted shifts of the outer batches shrink to less than half (the middle batch lies in the middle before and after); no cell is lost."""
    emb, batch = shifted(s, d)
    out = Steps(s, "harmony").keep(integrate.harmony(emb, batch, Steps(s, "harmony")))
    both = spread(emb, batch).withColumnRenamed("far", "before").join(spread(out, batch).withColumnRenamed("far", "after"), "batch")
    return both.join(out.join(batch, "cell_id").groupBy("batch").agg(F.count("*").alias("cells")), "batch").select("batch", "cells", ((F.col("before") > 0.1) & (F.col("after") < F.col("before") / 2)).alias("nearer"))


@query("r6_integrate_keeps_cells", f"WITH {CP} SELECT cluster, count(*) AS cells, 8::BIGINT AS components, count(*) AS finite FROM cells WHERE cluster IS NOT NULL GROUP BY 1")
def integrated(s, d):
    ds = normalize.normalize_total(cust_part(s, d))
    out = integrate.integrate_datasets(ds, "cluster", Steps(s, "integrate"), 100, 8)
    return out.join(ds.cells.select("cell_id", "cluster"), "cell_id").groupBy("cluster").agg(F.count("*").alias("cells"), F.max(F.size("v")).alias("components"), F.count_if(F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6))).alias("finite"))


# Doublets, k-means, diffusion
query("r5_doublets_of_batches", f"WITH {CP} SELECT cluster AS batch, count(*) AS cells, count(*) AS scored, 1::BIGINT AS thresholds, count(*) AS consistent FROM cells GROUP BY 1 HAVING count(*) >= 10")(
    lambda s, d: doublets.scrublet(cust_part(s, d), "cluster").groupBy("batch").agg(F.count("*").alias("cells"), F.count_if((F.col("score") >= 0) & (F.col("score") <= 1)).alias("scored"), F.count_distinct("threshold").alias("thresholds"), F.count_if(F.col("doublet") == (F.col("score") > F.col("threshold"))).alias("consistent")).where("cells >= 10")
)


@query("r8_kmeans_is_settled", "SELECT count(*) AS cells, 10::BIGINT AS labels, true AS settled FROM embeddings")
def settled(s, d):
    """Nearly every vector lies nearest to the mean of its own cluster."""
    emb = vectors(s, d).select("cell_id", "v")
    found = Steps(s, "kmeans").keep(emb.join(decompose.kmeans_labels(emb, 10), "cell_id"))
    means = found.select("label", F.posexplode("v").alias("j", "x")).groupBy("label", "j").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda p: p["x"]).alias("w"))
    near = found.crossJoin(means.withColumnRenamed("label", "other")).withColumn("far", graph.distance("v", "w", "euclidean")).groupBy("cell_id", "label").agg(F.min_by("other", "far").alias("best"))  # cells by ten means
    return near.agg(F.count("*").alias("cells"), F.count_distinct("label").alias("labels"), (F.avg((F.col("label") == F.col("best")).cast("double")) > 0.9).alias("settled"))


@query("r9_diffusion_components", "SELECT component::BIGINT AS component, 1e0 AS norm, true AS found FROM (VALUES (0), (1), (2)) t(component)", 5)
def diffusion(s, d):
    """Unit vectors that the normalised graph multiplies by their eigenvalues."""
    edges = Steps(s, "diffusion").keep(fuzzy(s, d))
    emb, values = decompose.diffusion_map(edges, 3)
    long = emb.select("cell_id", F.posexplode("v").alias("component", "x"))
    degree = edges.groupBy("src").agg(F.sum("w").alias("k"))
    a = edges.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("k").alias("kd")), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("k") * F.col("kd"))).alias("a"))
    times = a.join(long.withColumnRenamed("cell_id", "dst"), "dst").groupBy(F.col("src").alias("cell_id"), "component").agg(F.sum(F.col("a") * F.col("x")).alias("ax"))
    value = F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("component") + 1)
    off = long.join(times, ["cell_id", "component"], "left").withColumn("off", F.coalesce("ax", F.lit(0.0)) - value * F.col("x"))
    return off.groupBy("component").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), (F.sqrt(F.sum(F.col("off") ** 2)) < 0.02).alias("found"))


# Neighbours and communities
@query("g2_descent_against_exact", f"WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT n AS cells, n * {K - 1} AS edges, true AS near, n * {K - 1} AS true_distances FROM n")
def descent(s, d):
    """Every cell has all its neighbours, at true distances, and of the exact ones 95 % at least."""
    found = Steps(s, "descent").keep(graph.descent(vectors(s, d), Steps(s, "descent"), K))
    exact = Steps(s, "exact").keep(knn(s, d))
    points = vectors(s, d).select("cell_id", "v")
    far = found.join(points.select(F.col("cell_id").alias("src"), F.col("v").alias("a")), "src").join(points.select(F.col("cell_id").alias("dst"), F.col("v").alias("b")), "dst").withColumn("off", F.abs(graph.distance("a", "b", "euclidean") - F.col("dist")))
    own = far.agg(F.count_distinct("src").alias("cells"), F.count("*").alias("edges"), F.count_if(F.col("off") < 1e-6).alias("true_distances"))
    hit = found.join(exact.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.count("*").alias("hit"))
    return own.crossJoin(hit).select("cells", "edges", (F.col("hit") >= 0.95 * F.col("edges")).alias("near"), "true_distances")  # one row each


def communities(found: DataFrame, edges: DataFrame, given: DataFrame) -> DataFrame:
    """Facts of a labeling: cells, labels from 0 without gaps and by size, and more modular than the labels given with the vectors."""
    named = found.select("cell_id", F.col("label").cast("string").alias("label"))
    sizes = found.groupBy("label").agg(F.count("*").alias("n"))
    facts = sizes.agg(F.sum("n").alias("cells"), (F.max("label") + 1 == F.count("*")).alias("without_gaps"), F.transform(F.array_sort(F.collect_list(F.struct("label", "n"))), lambda p: p["n"]).alias("sizes"))
    quality = [graph.modularity(edges, x).select(F.col("quality").alias(n)) for x, n in ((named, "found"), (given, "given"))]
    falling = F.forall(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("sizes") - 1)), lambda i: (F.size("sizes") < 2) | (F.element_at("sizes", i) >= F.element_at("sizes", F.least(i + 1, F.size("sizes")))))
    return facts.crossJoin(quality[0]).crossJoin(quality[1]).select("cells", "without_gaps", falling.alias("by_size"), ((F.col("found") > F.col("given")) & (F.col("found") > 0.2)).alias("modular"))  # one row each


FACTS = "SELECT count(*)::BIGINT AS cells, true AS without_gaps, true AS by_size, true AS modular FROM embeddings"
for NAME, OPTIONS in (("g4_leiden_facts", {}), ("g5_louvain_facts", {"method": "fast"}), ("g5_louvain_rounds_facts", {"one_task": 0})):

    def partition(s, d, options=OPTIONS):
        edges, cells, steps = kept(s, d)
        return communities(steps.keep(cluster.communities(edges, cells, steps, **options)), edges, labels(s, d))

    query(NAME, FACTS)(partition)


@query("g9_subcluster_of_one", "SELECT vec_id AS cell_id, label::VARCHAR AS parent, label = 3 AS divided FROM embeddings")
def subcluster(s, d):
    """Members of the divided cluster are named after it, all others keep their label."""
    edges, _, steps = kept(s, d)
    return cluster.subcluster(edges, labels(s, d), "3", steps).select("cell_id", F.substring_index("label", ".", 1).alias("parent"), F.col("label").contains(".").alias("divided"))


# Hierarchy
def facts_of_merges(merges: DataFrame) -> DataFrame:
    """Merges of n cells are n - 1, the last holds all, the lowest joins the nearest pair of cells, and heights rise."""
    ordered = merges.agg(F.array_sort(F.collect_list(F.struct("step", F.coalesce("height", F.lit(float("inf"))).alias("h"), "size"))).alias("m"))  # one task's result as it is
    rising = F.aggregate("m", F.struct(F.lit(True).alias("ok"), F.lit(0.0).alias("h")), lambda a, x: F.struct((a["ok"] & (x["h"] >= a["h"] - 1e-9)).alias("ok"), x["h"].alias("h")))["ok"]
    return ordered.select(F.size("m").alias("merges"), F.element_at("m", -1)["size"].alias("largest"), F.element_at("m", 1)["h"].alias("lowest"), rising.alias("rising"))


query("g7_hierarchy_facts", f"WITH RECURSIVE {SIG}, g AS (SELECT src, dst, w FROM f WHERE w > 1e-5), k AS (SELECT src, sum(w) AS k FROM g GROUP BY 1), t AS (SELECT sum(w) AS t FROM g) SELECT (SELECT count(*) FROM k) - 1 AS merges, (SELECT count(*) FROM k)::BIGINT AS largest, {r('min(a.k * b.k / (w * t))', 4)} AS lowest, true AS rising FROM g JOIN k a ON a.src = g.src JOIN k b ON b.src = g.dst, t WHERE g.src <> g.dst", 4)(lambda s, d: facts_of_merges(hierarchy.dendrogram(kept(s, d)[0])))
query("g8_straight_cut_facts", "SELECT count(*)::BIGINT AS cells, 10::BIGINT AS clusters FROM embeddings")(lambda s, d: hierarchy.cut(kept(s, d)[0], n_clusters=10).agg(F.count("*").alias("cells"), F.count_distinct("label").alias("clusters")))


@query("g8_cuts_are_nested", "SELECT count(*)::BIGINT AS cells, 20::BIGINT AS parents FROM embeddings")
def nested(s, d):
    """A cut into 20 divides the clusters of a cut into 10: each of the 20 lies in one of them."""
    edges = kept(s, d)[0]
    both = hierarchy.cut(edges, n_clusters=20).withColumnRenamed("label", "fine").join(hierarchy.cut(edges, n_clusters=10), "cell_id")
    return both.agg(F.count("*").alias("cells"), F.count_distinct("fine", "label").alias("parents"))


query("g8_balanced_cut_facts", "SELECT count(*)::BIGINT AS cells, true AS least FROM embeddings")(
    lambda s, d: hierarchy.cut(kept(s, d)[0], max_size=100, min_size=5).groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n").alias("cells"), (F.min("n") >= 5).alias("least"))
)


# Layouts
def laid(s, d, **options) -> DataFrame:
    """Every cell has a finite place, and graph neighbours lie nearer to each other than cells do on average (twice the variance)."""
    steps = Steps(s, "layout")
    edges = steps.keep(fuzzy(s, d))
    places = steps.keep(layout.umap(edges, **options))
    xy = [c for c in places.columns if c != "cell_id"]
    flat = places.select("cell_id", *([F.element_at(xy[0], 1).alias("x"), F.element_at(xy[0], 2).alias("y")] if len(xy) == 1 else [F.col(xy[0]).alias("x"), F.col(xy[1]).alias("y")]))
    whole = flat.agg(F.count("*").alias("cells"), F.count_if(~F.isnan("x") & ~F.isnan("y")).alias("placed"), (F.var_pop("x") + F.var_pop("y")).alias("v"))
    far = edges.join(flat.withColumnRenamed("cell_id", "src"), "src").join(flat.select(F.col("cell_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2")), "dst").agg(F.avg((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2).alias("near"))
    return whole.crossJoin(far).select("cells", "placed", (F.col("near") < 2 * F.col("v")).alias("close"))  # one row each


query("g12_layout_facts", "SELECT count(*)::BIGINT AS cells, count(*)::BIGINT AS placed, true AS close FROM embeddings")(lambda s, d: laid(s, d))
query("g13_multilevel_layout_facts", "SELECT count(*)::BIGINT AS cells, count(*)::BIGINT AS placed, true AS close FROM embeddings")(lambda s, d: laid(s, d, init="multilevel", labels=labels(s, d)))


# Comparisons of analyses, pseudobulk, plans
query("c9_analyses_that_agree", "SELECT 'a' AS first, 'b' AS second, 1e0 AS ari, 1e0 AS nmi")(
    lambda s, d: (lambda found: found[("a", "b")].select(F.lit("a").alias("first"), F.lit("b").alias("second"), "ari", "nmi"))(curate.compare_analyses({"a": labels(s, d), "b": labels(s, d).select("cell_id", F.concat(F.lit("x"), "label").alias("label"))}))
)


@query("x1_plan_arithmetic", f"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS token FROM documents), x AS (SELECT doc_id, token FROM t WHERE token <> '' GROUP BY 1, 2),
n AS (SELECT (SELECT count(*) FROM documents) AS cells, (SELECT count(DISTINCT token) FROM x) AS genes, (SELECT count(*) FROM x) AS nnz)
SELECT step, bytes::BIGINT AS bytes FROM (SELECT unnest(['entries', 'totals', 'moments', 'components', 'gram', 'neighbors', 'graph']) AS step, unnest([nnz * 24, cells * 16, genes * 32, cells * 400, least(genes, 4096) * least(genes, 4096) * 8, cells * 360, cells * 720]) AS bytes FROM n)""")
def plan(s, d):
    found = process.plan(doc_token(s, d))
    return s.createDataFrame(list(found.steps.items()), "step string, bytes long")


@query("x2_max_cells_bounds", "SELECT m::BIGINT AS memory_mb, floor(m::BIGINT * 1048576 / 9600)::BIGINT AS cells FROM (VALUES (1000), (8000), (64000)) t(m)")
def bounds(s, d):
    """With a fiftieth of 20,000 genes in a cell, its 400 entries of 24 bytes are the largest step."""
    return s.createDataFrame([(m, process.max_cells(m, 20_000)) for m in (1_000, 8_000, 64_000)], "memory_mb long, cells long")


@query("x5_process_cells", f"WITH {CP}, q AS (SELECT cell_id, {r('sum(value)')} AS n_counts, count(*) AS n_genes FROM x WHERE value > 0 GROUP BY 1) SELECT cell_id, n_counts, n_genes, true AS labelled FROM q")
def processed(s, d):
    """Cells that pass the filters keep their metrics and have a community each."""
    ds = process.process(cust_part(s, d), Steps(s, "process"), n_top=200, floor=5, components=10)
    return ds.cells.select("cell_id", "n_counts", "n_genes", F.col("leiden").isNotNull().alias("labelled"))
