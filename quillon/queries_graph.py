"""Queries over vectors and the graphs made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.adapters import vectors
from quillon.operators import cluster, curate, graph, hierarchy, layout
from quillon.plans.steps import Steps
from quillon.queries_matrix import r, tidy

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
K = 15


def query(name: str, sql: str | None = None, digits: int = 6):
    def register(f):
        QUERIES[name] = lambda s, d: tidy(f(s, d), digits)
        if sql:
            ORACLES[name] = sql
        return f

    return register


def knn(s, d, metric="euclidean"):
    return graph.exact_neighbors(vectors(s, d), K, metric)


def fuzzy(s, d):
    return graph.symmetrize(graph.smooth_weights(knn(s, d), K))


def labels(s, d):
    return vectors(s, d).select("cell_id", "label")


E_ = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::VARCHAR AS label FROM embeddings)"
D_ = E_ + ", d AS (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.id <> b.id), knn AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS rank FROM d QUALIFY rank <= 14)"
query("g1_exact_neighbors", f"WITH {D_} SELECT src, dst, {r('dist')} AS dist, rank FROM knn")(lambda s, d: knn(s, d))
query("g1_exact_neighbors_cosine", f"WITH {E_}, d AS (SELECT a.id AS src, b.id AS dst, 1 - list_cosine_similarity(a.v, b.v) AS dist FROM e a JOIN e b ON a.id <> b.id), knn AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst) AS rank FROM d QUALIFY rank <= 14) SELECT src, dst, {r('dist')} AS dist, rank FROM knn")(
    lambda s, d: knn(s, d, "cosine")
)


@query("g2_descent")
def descent(s, d):
    return graph.descent(vectors(s, d), Steps(s, "descent"), K)


SIG = D_ + """, l AS (SELECT src, list(dist ORDER BY dist) AS ds, min(dist) FILTER (WHERE dist > 0) AS rho0 FROM knn GROUP BY 1), b0 AS (SELECT src, ds, coalesce(rho0, 0) AS rho FROM l),
b AS (SELECT src, ds, rho, 0e0 AS lo, NULL::DOUBLE AS hi, 1e0 AS mid, 0 AS n FROM b0 UNION ALL
 SELECT src, ds, rho, CASE WHEN t > log2(15e0) THEN lo ELSE mid END, CASE WHEN t > log2(15e0) THEN mid ELSE hi END, CASE WHEN t > log2(15e0) THEN (lo + mid) / 2 WHEN hi IS NULL THEN mid * 2 ELSE (mid + hi) / 2 END, n + 1
 FROM (SELECT *, list_sum(list_transform(ds, lambda x: CASE WHEN x > rho THEN exp(-(x - rho) / mid) ELSE 1e0 END)) AS t FROM b WHERE n < 64)),
sg AS (SELECT src, rho, greatest(mid, list_sum(ds) / 15 * 1e-3, 1e-12) AS sigma FROM b WHERE n = 64),
w AS (SELECT src, dst, rho, sigma, CASE WHEN dist > rho THEN exp(-(dist - rho) / sigma) ELSE 1e0 END AS w FROM knn JOIN sg USING (src)),
f AS (SELECT src, dst, sum(w) - CASE WHEN count(*) > 1 THEN max(w) * min(w) ELSE 0 END AS w FROM (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w) GROUP BY 1, 2)"""
query("g3_smooth_scales", f"WITH RECURSIVE {SIG} SELECT src, {r('rho', 5)} AS rho, {r('sigma', 5)} AS sigma FROM sg", 5)(lambda s, d: graph.smooth_weights(knn(s, d), K).select("src", "rho", "sigma").distinct())
query("g3_fuzzy_graph", f"WITH RECURSIVE {SIG} SELECT src, dst, {r('w', 5)} AS w FROM f WHERE w > 1e-5", 5)(fuzzy)
query("a12_group_connectivity", f"WITH {D_}, c AS (SELECT a.label AS la, b.label AS lb, count(*) AS n FROM knn JOIN e a ON src = a.id JOIN e b ON dst = b.id GROUP BY 1, 2), z AS (SELECT label, count(*) AS size FROM e GROUP BY 1), u AS (SELECT a, b, sum(n) AS n FROM (SELECT la AS a, lb AS b, n FROM c UNION ALL SELECT lb, la, n FROM c) GROUP BY 1, 2) SELECT x.label AS a, y.label AS b, {r('CASE WHEN x.label = y.label THEN 1e0 ELSE coalesce(n, 0) / (x.size + y.size) END')} AS connectivity FROM z x CROSS JOIN z y LEFT JOIN u ON u.a = x.label AND u.b = y.label")(
    lambda s, d: graph.group_connectivity(knn(s, d), labels(s, d))
)
query("a13_modularity", f"WITH RECURSIVE {SIG}, g AS (SELECT a.label AS la, sum(CASE WHEN a.label = b.label THEN w ELSE 0 END) AS i, sum(w) AS k FROM f JOIN e a ON src = a.id JOIN e b ON dst = b.id WHERE w > 1e-5 GROUP BY 1) SELECT {r('sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k))')} AS quality FROM g")(
    lambda s, d: graph.modularity(fuzzy(s, d), labels(s, d))
)
query("j7_induced_subgraph", f"WITH {D_} SELECT src, dst, {r('dist')} AS dist FROM knn JOIN e a ON src = a.id JOIN e b ON dst = b.id WHERE a.label = '3' AND b.label = '3'")(
    lambda s, d: (lambda g, c: g.join(c.select(F.col("cell_id").alias("src")), "src", "left_semi").join(c.select(F.col("cell_id").alias("dst")), "dst", "left_semi").select("src", "dst", "dist"))(knn(s, d), labels(s, d).where("label = '3'"))
)
query("g13_group_graph", f"WITH RECURSIVE {SIG} SELECT a.label AS la, b.label AS lb, {r('sum(w)', 4)} AS w FROM f JOIN e a ON src = a.id JOIN e b ON dst = b.id WHERE w > 1e-5 GROUP BY 1, 2", 4)(lambda s, d: layout.group_graph(fuzzy(s, d), labels(s, d)))
query("g11_pseudotime", f"""WITH RECURSIVE {D_}, ed AS (SELECT src, dst, min(dist) AS w FROM (SELECT src, dst, dist FROM knn UNION ALL SELECT dst, src, dist FROM knn) GROUP BY 1, 2),
bf AS (SELECT id, CASE WHEN id = 0 THEN 0e0 END AS far, 0 AS n FROM e UNION ALL SELECT id, min(far), n FROM (SELECT id, far, n + 1 AS n FROM bf WHERE n < 24 UNION ALL SELECT ed.dst, bf.far + ed.w, bf.n + 1 FROM bf JOIN ed ON bf.id = ed.src WHERE bf.n < 24 AND bf.far IS NOT NULL) GROUP BY id, n)
SELECT id AS cell_id, {r('far / max(far) OVER ()')} AS pseudotime FROM bf WHERE n = 24""")(lambda s, d: graph.pseudotime(knn(s, d), 0, Steps(s, "time")))


def kept(s, d, name="graph"):
    steps = Steps(s, name)
    return steps.keep(fuzzy(s, d)), vectors(s, d).select("cell_id"), steps


@query("g4_leiden")
def leiden(s, d):
    return cluster.communities(*kept(s, d))


@query("g5_louvain")
def louvain(s, d):
    return cluster.communities(*kept(s, d), method="fast")


@query("g5_louvain_rounds")
def rounds(s, d):
    return cluster.communities(*kept(s, d), one_task=0)


@query("g7_hierarchy")
def tree(s, d):
    return hierarchy.dendrogram(kept(s, d)[0])


query("g8_straight_cut")(lambda s, d: hierarchy.cut(kept(s, d)[0], n_clusters=10))
query("g8_balanced_cut")(lambda s, d: hierarchy.cut(kept(s, d)[0], max_size=100, min_size=5))
query("g9_subcluster")(lambda s, d: (lambda g: cluster.subcluster(g[0], labels(s, d), "3", g[2]))(kept(s, d)))
query("g12_layout")(lambda s, d: layout.umap(kept(s, d)[0]))
query("g13_multilevel_layout")(lambda s, d: layout.umap(kept(s, d)[0], init="multilevel", labels=labels(s, d)))


@query("c9_compare_analyses")
def analyses(s, d):
    edges, cells, steps = kept(s, d)
    named = {"label": labels(s, d), "leiden": steps.keep(cluster.communities(edges, cells, steps)), "fast": steps.keep(cluster.communities(edges, cells, steps, method="fast"))}
    out = None
    for (a, b), found in curate.compare_analyses(named).items():
        row = found.select(F.lit(a).alias("first"), F.lit(b).alias("second"), "ari", "nmi")
        out = row if out is None else out.union(row)
    return out
