"""Queries over components, integration, doublets and clusters of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.adapters import cust_part, supp_brand, vectors
from quillon.operators import decompose, doublets, graph, integrate, normalize, plotframes, qc
from quillon.plans.steps import Steps
from quillon.queries_graph import fuzzy
from quillon.queries_matrix import SB, VAR, r, tidy

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    def register(f):
        QUERIES[name] = lambda s, d: tidy(f(s, d), digits)
        if sql:
            ORACLES[name] = sql
        return f

    return register


SBN = SB + ", tt AS (SELECT cell_id, sum(value) AS total FROM x GROUP BY 1), xl AS (SELECT cell_id, gene_id, ln(1e0 + value * 1e4 / total) AS value FROM x JOIN tt USING (cell_id))"
sb = lambda s, d: normalize.log_transform(normalize.normalize_total(supp_brand(s, d)))


@query("r1_total_variance", f"WITH {SBN}, n AS (SELECT count(*)::DOUBLE AS n FROM cells), m AS (SELECT gene_id, sum(value) AS s, sum(value * value) AS q FROM xl GROUP BY 1) SELECT {r('sum(' + VAR('s', 'q', 'n') + ')', 5)} AS variance FROM m, n", 5)
def total_variance(s, d):
    """The components' variances add up to the genes'."""
    return decompose.pca(sb(s, d), 25)[2].agg(F.sum("variance").alias("variance"))


query("r1_components")(lambda s, d: decompose.pca(sb(s, d), 5)[0].select("cell_id", F.posexplode("v").alias("component", "value")))
query("r1_loadings")(lambda s, d: decompose.pca(sb(s, d), 5)[1].select("gene_id", F.posexplode("loading").alias("component", "value")))
query("r2_scaled_components")(lambda s, d: decompose.pca(sb(s, d), 5, scale=True, max_value=3.0)[2])
query("r3_randomized_components")(lambda s, d: decompose.pca(normalize.log_transform(normalize.normalize_total(cust_part(s, d))), 10, gram_genes=0)[2])


@query("r4_harmony")
def harmony(s, d):
    emb = vectors(s, d)
    batch = emb.select("cell_id", (F.col("cell_id") % 3).cast("string").alias("batch"))
    shifted = emb.select("cell_id", F.transform("v", lambda x, i: x + F.when(i < 3, (F.col("cell_id") % 3) * 0.5).otherwise(0.0)).alias("v"))
    return integrate.harmony(shifted, batch, Steps(s, "harmony")).select("cell_id", F.element_at("v", 1).alias("v1"), F.element_at("v", 2).alias("v2"))


query("r5_doublets")(lambda s, d: doublets.scrublet(cust_part(s, d), "cluster"))
query("r6_integrate")(lambda s, d: integrate.integrate_datasets(normalize.normalize_total(cust_part(s, d)), "cluster", Steps(s, "integrate"), 100, 8).select("cell_id", F.element_at("v", 1).alias("v1")))
query("r8_kmeans")(lambda s, d: decompose.kmeans_labels(vectors(s, d), 10))
query("r9_diffusion_map")(lambda s, d: decompose.diffusion_map(fuzzy(s, d), 3)[0].select("cell_id", F.posexplode("v").alias("component", "value")))
@query("a10_distances_in_plan", f"WITH e AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS v, label::VARCHAR AS label FROM embeddings), m AS (SELECT label, j, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM e) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY j) AS w FROM m GROUP BY 1) SELECT cell_id, c.label AS label, {r('list_distance(v, w)')} AS dist FROM e CROSS JOIN c")
def centroid_distances(s, d):
    """Of every vector from the centroid of every label."""
    means = vectors(s, d).select("label", F.posexplode("v").alias("j", "x")).groupBy("label", "j").agg(F.avg("x").alias("x"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda p: p["x"]).alias("w"))
    return vectors(s, d).select("cell_id", "v").crossJoin(centroids).select("cell_id", "label", graph.distance("v", "w", "euclidean").alias("dist"))  # vectors by labels


query("a9_gram_packed", f"WITH {SBN} SELECT {r('sum(value * value)', 4)} AS trace, count(DISTINCT gene_id) AS genes FROM xl", 4)(
    lambda s, d: (lambda ds: qc.gram(ds.x).where("g1 = g2").agg(F.sum("dot").alias("trace"), F.count("*").alias("genes")))(sb(s, d))
)
query("x6_explained_variance")(lambda s, d: plotframes.explained_variance(decompose.pca(sb(s, d), 10)[2]))
query("x6_doublet_histogram")(lambda s, d: plotframes.doublet_histogram(doublets.scrublet(cust_part(s, d), "cluster")))
query("x6_embedding")(lambda s, d: plotframes.embedding(vectors(s, d), vectors(s, d), "label"))
query("x6_embedding_binned")(lambda s, d: plotframes.embedding(vectors(s, d), vectors(s, d), "label", limit=0, bins=20))
