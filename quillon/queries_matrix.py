"""Queries over the count matrix: metrics, filters, transforms, variable genes, markers, conditions, annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.adapters import cust_part, doc_token, order_brand, supp_brand, table
from quillon.frames import Dataset
from quillon.functions import numeric
from quillon.operators import annotate, compare, curate, markers, normalize, plotframes, qc, select, subset

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (without negative zeros), whole numbers as longs."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Registers a function of (spark, sf_dir), tidied, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(f(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0e0)"


CP = """
x AS (SELECT o_custkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
cells AS (SELECT c_custkey AS cell_id, c_name AS cell_name, c_mktsegment AS cluster, CAST(c_nationkey AS VARCHAR) AS sample FROM customer),
genes AS (SELECT p_partkey AS gene_id, p_name AS gene_name FROM part)"""
NORMAL = CP + """,
totals AS (SELECT cell_id, sum(value) AS total FROM x GROUP BY 1),
xn AS (SELECT x.cell_id, gene_id, CASE WHEN total = 0 THEN value ELSE value * 1e4 / total END AS value FROM x JOIN totals USING (cell_id)),
xl AS (SELECT cell_id, gene_id, ln(1e0 + value) AS value FROM xn)"""
OB = """
brands AS (SELECT p_brand AS gene_name, min(p_partkey) AS gene_id FROM part GROUP BY 1),
x AS (SELECT l_orderkey AS cell_id, b.gene_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN brands b ON p_brand = b.gene_name GROUP BY 1, 2),
cells AS (SELECT o_orderkey AS cell_id, c_mktsegment AS cluster, o_orderstatus AS condition, CAST(c_nationkey AS VARCHAR) AS sample FROM orders JOIN customer ON o_custkey = c_custkey),
genes AS (SELECT gene_id, gene_name FROM brands)"""
SB = """
brands AS (SELECT p_brand AS gene_name, min(p_partkey) AS gene_id FROM part GROUP BY 1),
x AS (SELECT l_suppkey AS cell_id, b.gene_id, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN brands b ON p_brand = b.gene_name GROUP BY 1, 2),
cells AS (SELECT s_suppkey AS cell_id, s_name AS cell_name FROM supplier), genes AS (SELECT gene_id, gene_name FROM brands)"""
VAR = lambda s, q, n: f"(CASE WHEN {n} < 2 THEN 0e0 ELSE greatest(0e0, ({q} / {n} - ({s} / {n}) * ({s} / {n})) * {n} / greatest({n} - 1, 1)) END)"
STATS = """,
sizes AS (SELECT cluster, count(*) AS size FROM cells WHERE cluster IS NOT NULL GROUP BY 1),
sums AS (SELECT gene_id, cluster, sum(value) AS s, sum(value * value) AS q, count(*) AS stored FROM {x} JOIN cells USING (cell_id) WHERE cluster IS NOT NULL GROUP BY 1, 2),
stats AS (SELECT g.gene_id, z.cluster, z.size, coalesce(s, 0) AS s, coalesce(q, 0) AS q, coalesce(stored, 0) AS stored FROM genes g CROSS JOIN sizes z LEFT JOIN sums u ON u.gene_id = g.gene_id AND u.cluster = z.cluster)"""


def logged(spark, sf) -> Dataset:
    return normalize.log_transform(normalize.normalize_total(cust_part(spark, sf)))


# A: aggregates
query("a1_qc_cells", f"WITH {CP}, q AS (SELECT cell_id, sum(value) AS n_counts, count(*) FILTER (WHERE value > 0) AS n_genes, sum(CASE WHEN gene_name LIKE 'red%' THEN value ELSE 0 END) AS mt FROM x JOIN genes USING (gene_id) GROUP BY 1) SELECT cell_id, {r('coalesce(n_counts, 0)')} AS n_counts, coalesce(n_genes, 0) AS n_genes, {r('100 * coalesce(mt, 0) / CASE WHEN coalesce(n_counts, 0) = 0 THEN 1 ELSE n_counts END')} AS pct_counts_mt FROM cells LEFT JOIN q USING (cell_id)")(
    lambda s, d: qc.qc_metrics(cust_part(s, d), "red").cells.select("cell_id", "n_counts", "n_genes", "pct_counts_mt")
)
query("a1_qc_genes", f"WITH {CP}, q AS (SELECT gene_id, count(*) FILTER (WHERE value > 0) AS n_cells, sum(value) AS total_counts FROM x GROUP BY 1) SELECT gene_id, coalesce(n_cells, 0) AS n_cells, {r('coalesce(total_counts, 0)')} AS total_counts, {r('coalesce(total_counts, 0) / (SELECT count(*) FROM cells)')} AS mean_counts FROM genes LEFT JOIN q USING (gene_id)")(
    lambda s, d: qc.qc_metrics(cust_part(s, d), "red").genes.select("gene_id", "n_cells", "total_counts", "mean_counts")
)
query("a2_row_totals", f"WITH {CP} SELECT cell_id, {r('sum(value)')} AS total FROM x WHERE gene_id % 3 = 0 GROUP BY 1")(
    lambda s, d: (lambda ds: qc.row_totals(ds.x, ds.genes.where("gene_id % 3 = 0")))(cust_part(s, d))
)
MOMENTS = "n AS (SELECT count(*)::DOUBLE AS n FROM cells), m AS (SELECT gene_id, coalesce(sum(value), 0) AS s, coalesce(sum(value * value), 0) AS q, count(*) FILTER (WHERE value > 0) AS detected FROM genes LEFT JOIN {x} USING (gene_id) GROUP BY 1)"
query("a3_gene_moments", f"WITH {NORMAL}, {MOMENTS.format(x='xn')} SELECT gene_id, {r('s / n')} AS mean, {r(VAR('s', 'q', 'n'))} AS var FROM m, n")(
    lambda s, d: qc.gene_moments(normalize.normalize_total(cust_part(s, d))).select("gene_id", "mean", "var")
)
query("a4_gene_moments_detected", f"WITH {NORMAL}, {MOMENTS.format(x='xl')} SELECT gene_id, {r('s / n')} AS mean, {r(VAR('s', 'q', 'n'))} AS var, detected FROM m, n")(
    lambda s, d: qc.gene_moments(logged(s, d))
)
query("a5_cluster_stats", f"WITH {NORMAL} {STATS.format(x='xl')} SELECT gene_id, cluster, {r('s')} AS s, {r('q')} AS q, stored FROM sums")(
    lambda s, d: qc.cluster_stats(logged(s, d))
)
query("a5_token_stats_by_language", f"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS token FROM documents), x AS (SELECT doc_id, token, count(*)::DOUBLE AS value FROM t WHERE token <> '' GROUP BY 1, 2)
SELECT token, lang AS cluster, {r('sum(value)')} AS s, {r('sum(value * value)')} AS q, count(*) AS stored FROM x JOIN documents USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1, 2""")(
    lambda s, d: (lambda ds: qc.cluster_stats(ds).join(ds.genes, "gene_id").select(F.col("gene_name").alias("token"), "cluster", "s", "q", "stored"))(doc_token(s, d))
)
query("a6_cluster_means", f"WITH {NORMAL} {STATS.format(x='xl')} SELECT gene_id, cluster, size, {r('s / size')} AS mean FROM stats")(
    lambda s, d: qc.cluster_means(logged(s, d))
)
UNITS = "u AS (SELECT cluster, condition, sample, count(*) AS n_cells FROM cells WHERE cluster IS NOT NULL AND condition IS NOT NULL AND sample IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10), p AS (SELECT cluster, condition, sample, gene_id, sum(value) AS counts, count(*) FILTER (WHERE value > 0) AS expressing FROM x JOIN cells USING (cell_id) SEMI JOIN u USING (cluster, condition, sample) GROUP BY 1, 2, 3, 4)"
KEYS = ["cluster", "condition", "sample"]
query("a7_pseudobulk", f"WITH {OB}, {UNITS} SELECT cluster, condition, sample, gene_id, {r('counts')} AS counts, expressing, n_cells FROM p JOIN u USING (cluster, condition, sample)")(
    lambda s, d: (lambda u, p: p.join(u, KEYS))(*qc.pseudobulk(order_brand(s, d), KEYS, 10))
)
query("a8_column_sums", f"WITH {CP}, {MOMENTS.format(x='x')} SELECT gene_id, {r('s')} AS total, {r('s / n')} AS mean, {r('q - s * s / n', 4)} AS centred FROM m, n", 4)(
    lambda s, d: qc.column_sums(cust_part(s, d))
)
ORACLES["a8_column_sums"] = f"WITH {CP}, {MOMENTS.format(x='x')} SELECT gene_id, {r('s', 4)} AS total, {r('s / n', 4)} AS mean, {r('q - s * s / n', 4)} AS centred FROM m, n"
query("a9_gram", f"WITH {SB} SELECT a.gene_id AS g1, b.gene_id AS g2, {r('sum(a.value * b.value)')} AS dot FROM x a JOIN x b USING (cell_id) WHERE a.gene_id <= b.gene_id GROUP BY 1, 2")(
    lambda s, d: qc.gram(supp_brand(s, d).x)
)
query("a10_project", f"WITH {CP} SELECT cell_id, c AS component, {r('sum(value * ((gene_id * (7 + c)) % 11 - 5))', 4)} AS value FROM x CROSS JOIN (VALUES (0), (1), (2)) t(c) GROUP BY 1, 2", 4)(
    lambda s, d: (lambda ds: qc.project(ds.x, ds.genes.select("gene_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("component")).withColumn("w", ((F.col("gene_id") * (7 + F.col("component"))) % 11 - 5).cast("double"))))(cust_part(s, d))
)
ORACLES["a10_project"] = f"WITH {CP} SELECT cell_id, c::BIGINT AS component, {r('sum(value * ((gene_id * (7 + c)) % 11 - 5))', 4)} AS value FROM x CROSS JOIN (VALUES (0), (1), (2)) t(c) GROUP BY 1, 2"
query("a11_agreement", f"""WITH {CP}, t AS (SELECT cluster AS la, sample AS lb, count(*)::DOUBLE AS n FROM cells GROUP BY 1, 2), a AS (SELECT sum(n) AS m FROM t GROUP BY la), b AS (SELECT sum(n) AS m FROM t GROUP BY lb),
v AS (SELECT (SELECT sum(n) FROM t) AS t, (SELECT sum(n * (n - 1) / 2) FROM t) AS both_, (SELECT sum(m * (m - 1) / 2) FROM a) AS pa, (SELECT sum(m * (m - 1) / 2) FROM b) AS pb, (SELECT sum(m * ln(m)) FROM a) AS sa, (SELECT sum(m * ln(m)) FROM b) AS sb, (SELECT sum(n * ln(n)) FROM t) AS sj)
SELECT {r('(both_ - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2))')} AS ari, {r('2 * (ln(t) + (sj - sa - sb) / t) / (2 * ln(t) - (sa + sb) / t)')} AS nmi FROM v""")(
    lambda s, d: (lambda c: curate.agreement(curate.contingency(c.select("cell_id", F.col("cluster").alias("label")), c.select("cell_id", F.col("sample").alias("label")))))(cust_part(s, d).cells)
)
query("a14_average_ranks", f"WITH {SB} SELECT cell_id, gene_id, {r('rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0::DOUBLE')} AS rank FROM x")(
    lambda s, d: supp_brand(s, d).x.select("cell_id", "gene_id", numeric.average_rank("value", ["gene_id"]).alias("rank"))
)
query("a14_quantiles", f"WITH {SB} SELECT gene_id, {r('quantile_cont(value, 0.75::DOUBLE)')} AS q75, {r('quantile_cont(value, 0.5::DOUBLE)')} AS median FROM x GROUP BY 1")(
    lambda s, d: supp_brand(s, d).x.groupBy("gene_id").agg(F.percentile("value", F.lit(0.75)).alias("q75"), F.percentile("value", F.lit(0.5)).alias("median"))
)
query("a15_composition", f"WITH {CP}, c AS (SELECT cluster, sample, count(*) AS n FROM cells GROUP BY 1, 2) SELECT cluster, sample, n, {r('n / sum(n) OVER (PARTITION BY cluster)')} AS share FROM c")(
    lambda s, d: qc.composition(cust_part(s, d).cells, "cluster", "sample")
)
query("a15_cluster_sizes", f"WITH {CP} SELECT cluster AS label, count(*) AS n FROM cells GROUP BY 1")(
    lambda s, d: curate.cluster_sizes(cust_part(s, d).cells.select(F.col("cluster").alias("label")))
)
query("a15_qc_histogram", f"WITH {CP}, c AS (SELECT ln(sum(value)) AS l FROM x GROUP BY cell_id), e AS (SELECT min(l) AS lo, (max(l) - min(l)) / 64 AS step FROM c) SELECT CAST(least(63, floor((l - lo) / step + 1e-9)) AS BIGINT) AS bin, count(*) AS n FROM c, e GROUP BY 1")(
    lambda s, d: qc.log_histogram(qc.qc_metrics(cust_part(s, d), "none ").cells, "n_counts")
)
query("a16_dot_plot", f"WITH {NORMAL} {STATS.format(x='xl')}, m AS (SELECT gene_id, cluster, stored / size AS pct, s / size AS mean FROM stats), w AS (SELECT *, avg(mean) OVER (PARTITION BY gene_id) AS mu, stddev_samp(mean) OVER (PARTITION BY gene_id) AS sd FROM m) SELECT gene_id, cluster, {r('pct')} AS pct, {r('mean')} AS mean, {r('CASE WHEN sd > 1e-12 THEN (mean - mu) / sd ELSE 0e0 END')} AS z FROM w")(
    lambda s, d: qc.dot_plot(logged(s, d))
)

# P: subsets
query("p1_subset", f"WITH {CP} SELECT cell_id, gene_id, {r('value')} AS value FROM x WHERE cell_id % 10 = 3 AND gene_id % 7 = 1")(
    lambda s, d: subset.keep_genes(subset.keep_cells(cust_part(s, d), "cell_id % 10 = 3"), "gene_id % 7 = 1").x.select("cell_id", "gene_id", "value")
)
FILTERED = CP + ", q AS (SELECT cell_id, sum(value) AS n_counts, count(*) FILTER (WHERE value > 0) AS n_genes FROM x GROUP BY 1), kept AS (SELECT cell_id FROM cells LEFT JOIN q USING (cell_id) WHERE coalesce(n_counts, 0) >= 500 AND coalesce(n_counts, 0) <= 1500 AND coalesce(n_genes, 0) >= 20)"
filtered = lambda s, d: subset.filter_cells(cust_part(s, d), min_counts=500, max_counts=1500, min_genes=20)
query("p2_filter_cells", f"WITH {FILTERED} SELECT cell_id, coalesce(n_genes, 0) AS n_genes FROM kept LEFT JOIN q USING (cell_id)")(
    lambda s, d: filtered(s, d).cells.select("cell_id", "n_genes")
)
query("p3_filter_genes", f"WITH {FILTERED}, g AS (SELECT gene_id, count(*) FILTER (WHERE value > 0) AS n_cells, sum(value) AS total_counts FROM x SEMI JOIN kept USING (cell_id) GROUP BY 1) SELECT gene_id, n_cells, {r('total_counts')} AS total_counts FROM g WHERE n_cells >= 5 AND total_counts >= 100")(
    lambda s, d: subset.filter_genes(filtered(s, d), min_cells=5, min_counts=100).genes.select("gene_id", "n_cells", "total_counts")
)
query("p4_from_counts", f"WITH {FILTERED} SELECT cell_id, {r('sum(value)')} AS total, count(*) AS stored FROM x SEMI JOIN kept USING (cell_id) GROUP BY 1")(
    lambda s, d: subset.from_counts(normalize.log_transform(normalize.normalize_total(filtered(s, d)))).x.groupBy("cell_id").agg(F.sum("value").alias("total"), F.count("*").alias("stored"))
)
query("p6_gene_lookup", """WITH b AS (SELECT p_brand AS gene_name, min(p_partkey) AS gene_id FROM part GROUP BY 1), n AS (SELECT CASE WHEN gene_id % 2 = 0 THEN lower(gene_name) ELSE gene_name END AS name FROM b UNION ALL SELECT 'nothing')
SELECT name, coalesce((SELECT min(gene_id) FROM b WHERE gene_name = name), (SELECT min(gene_id) FROM b WHERE upper(gene_name) = upper(name))) AS gene_id FROM n""")(
    lambda s, d: (lambda g: subset.find_genes(g, g.select(F.when(F.col("gene_id") % 2 == 0, F.lower("gene_name")).otherwise(F.col("gene_name")).alias("name")).union(s.range(1).select(F.lit("nothing")))))(supp_brand(s, d).genes)
)
query("s6_head", f"WITH {CP}, h AS (SELECT cell_id FROM cells ORDER BY cell_id LIMIT 20) SELECT cell_id, gene_id, {r('value')} AS value FROM x SEMI JOIN h USING (cell_id)")(
    lambda s, d: subset.head(cust_part(s, d), 20).x.select("cell_id", "gene_id", "value")
)
query("s6_column_values", f"WITH {CP} SELECT cell_id, {r('coalesce(max(value) FILTER (WHERE gene_id = 7), 0)')} AS gene_7 FROM cells LEFT JOIN x USING (cell_id) GROUP BY 1")(
    lambda s, d: subset.gene_columns(cust_part(s, d), [7])
)
query("s6_sample")(lambda s, d: subset.sample(cust_part(s, d), 50).cells.select("cell_id"))
query("s16_gene_columns", f"WITH {CP} SELECT cell_id, " + ", ".join(f"{r(f'coalesce(max(value) FILTER (WHERE gene_id = {g}), 0)')} AS gene_{g}" for g in (1, 2, 3)) + " FROM cells LEFT JOIN x USING (cell_id) GROUP BY 1")(
    lambda s, d: subset.gene_columns(cust_part(s, d), [1, 2, 3])
)

# F: values
query("f1_normalize_total", f"WITH {NORMAL} SELECT cell_id, gene_id, {r('value')} AS value FROM xn")(
    lambda s, d: normalize.normalize_total(cust_part(s, d)).x.select("cell_id", "gene_id", "value")
)
query("f2_log1p", f"WITH {NORMAL} SELECT cell_id, gene_id, {r('value')} AS value FROM xl")(
    lambda s, d: logged(s, d).x.select("cell_id", "gene_id", "value")
)
query("f3_renormalize", f"WITH {CP}, k AS (SELECT * FROM x WHERE gene_id % 2 = 0), t AS (SELECT cell_id, sum(value) AS total FROM k GROUP BY 1) SELECT cell_id, gene_id, {r('ln(1e0 + CASE WHEN total = 0 THEN 0 ELSE value * 1e3 / total END)')} AS value FROM k JOIN t USING (cell_id)")(
    lambda s, d: normalize.renormalize(subset.keep_genes(normalize.normalize_total(cust_part(s, d)), "gene_id % 2 = 0")).x.select("cell_id", "gene_id", "value")
)
query("f5_standardize", f"WITH {NORMAL}, {MOMENTS.format(x='xl')}, v AS (SELECT gene_id, s / n AS mu, {VAR('s', 'q', 'n')} AS var FROM m, n), w AS (SELECT gene_id, mu, CASE WHEN var > 0 THEN sqrt(var) ELSE 1 END AS sd FROM v) SELECT cell_id, gene_id, {r('greatest(-10, least(10, (value - mu) / sd))')} AS value FROM xl JOIN w USING (gene_id)")(
    lambda s, d: (lambda ds: normalize.standardize(ds.x, qc.gene_moments(ds), 10.0)[0])(logged(s, d))
)
query("f5_standardized_zeros", f"WITH {NORMAL}, {MOMENTS.format(x='xl')}, v AS (SELECT gene_id, s / n AS mu, {VAR('s', 'q', 'n')} AS var FROM m, n) SELECT gene_id, {r('greatest(-10, least(10, -mu / CASE WHEN var > 0 THEN sqrt(var) ELSE 1 END))')} AS zero FROM v")(
    lambda s, d: (lambda ds: normalize.standardize(ds.x, qc.gene_moments(ds), 10.0)[1])(logged(s, d))
)
TAIL = lambda x: f"(CASE WHEN {x} < 2 THEN exp(-{x} * {x} / 2) * 0.3989422804014327::DOUBLE * (1e0 / (1e0 + 0.2316419::DOUBLE * {x})) * (0.319381530::DOUBLE + (1e0 / (1e0 + 0.2316419::DOUBLE * {x})) * (-0.356563782::DOUBLE + (1e0 / (1e0 + 0.2316419::DOUBLE * {x})) * (1.781477937::DOUBLE + (1e0 / (1e0 + 0.2316419::DOUBLE * {x})) * (-1.821255978::DOUBLE + (1e0 / (1e0 + 0.2316419::DOUBLE * {x})) * 1.330274429::DOUBLE)))) ELSE exp(-{x} * {x} / 2) * 0.3989422804014327::DOUBLE / ({x} + list_reduce(list_transform(range(60, 0, -1), lambda k: k::DOUBLE), lambda s, k: k / ({x} + s), 0e0)) END)"
query("f7_normal_tail", f"WITH z AS (SELECT l_quantity / 10 AS z FROM lineitem GROUP BY 1) SELECT {r('z')} AS z, {r('1e6 * ' + TAIL('z'))} AS tail FROM z")(
    lambda s, d: table(s, d, "lineitem").select((F.col("l_quantity") / 10).alias("z")).distinct().select("z", (1e6 * numeric.normal_tail(F.col("z"))).alias("tail"))
)
BINNED = lambda x, lo, hi, n: (
    f"(CASE WHEN {hi} = {lo} THEN 0 ELSE greatest(0, least({n - 1}, CAST(ceil(({x} - {lo}) / (({hi} - {lo}) / {n})) AS BIGINT) - 1)) END)"
)
query("f10_cut_bins", f"WITH p AS (SELECT p_partkey AS gene_id, p_retailprice AS x FROM part), e AS (SELECT min(x) AS lo, max(x) AS hi FROM p), b AS (SELECT gene_id, x, lo, (hi - lo) / 20 AS step, {BINNED('x', 'lo', 'hi', 20)} AS k FROM p, e), c AS (SELECT *, CASE WHEN k > 0 AND x <= lo + step * k THEN k - 1 ELSE k END AS k1 FROM b) SELECT gene_id, CASE WHEN k1 < 19 AND x > lo + step * (k1 + 1) THEN k1 + 1 ELSE k1 END AS bin FROM c")(
    lambda s, d: (lambda p: (lambda e: p.select("gene_id", numeric.cut_bin(F.col("x"), F.lit(e.lo), F.lit(e.hi), 20).alias("bin")))(p.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()))(table(s, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_retailprice").alias("x")))
)

# H: variable genes
HVG = f"""WITH {NORMAL}, {MOMENTS.format(x='xn')}, v AS (SELECT gene_id, s / n AS mean, {VAR('s', 'q', 'n')} AS var, detected FROM m, n),
w AS (SELECT gene_id, CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS mu, var FROM v WHERE detected > {{floor}}),
d AS (SELECT gene_id, CASE WHEN var > 0 THEN ln(var / mu) END AS dispersion, ln(1e0 + mu) AS m FROM w), e AS (SELECT min(m) AS lo, max(m) AS hi FROM d),
b AS (SELECT gene_id, dispersion, m, lo, (hi - lo) / 20 AS step, {BINNED('m', 'lo', 'hi', 20)} AS k FROM d, e), c AS (SELECT *, CASE WHEN k > 0 AND m <= lo + step * k THEN k - 1 ELSE k END AS k1 FROM b),
f AS (SELECT gene_id, dispersion, CASE WHEN k1 < 19 AND m > lo + step * (k1 + 1) THEN k1 + 1 ELSE k1 END AS bin FROM c),
p AS (SELECT bin, avg(dispersion) AS mu, stddev_samp(dispersion) AS sd, count(*) AS k FROM f WHERE dispersion IS NOT NULL GROUP BY 1),
z AS (SELECT gene_id, dispersion, f.bin, CASE WHEN dispersion IS NULL THEN NULL WHEN k = 1 THEN 1e0 WHEN sd < 1e-12 THEN 0e0 ELSE (dispersion - mu) / sd END AS score FROM f LEFT JOIN p ON f.bin = p.bin),
o AS (SELECT gene_id, row_number() OVER (ORDER BY round(score, 9) DESC, gene_id) AS rank FROM z WHERE score IS NOT NULL)
SELECT genes.gene_id, {r('dispersion')} AS dispersion, bin, {r('score')} AS score, rank, coalesce(rank <= 500, false){{include}} AS highly_variable FROM genes LEFT JOIN z USING (gene_id) LEFT JOIN o USING (gene_id)"""
hvg = lambda s, d, **k: select.variable_genes(normalize.normalize_total(cust_part(s, d)), 500, **k).select("gene_id", "dispersion", "bin", "score", "rank", "highly_variable")
query("h1_variable_genes", HVG.format(floor=0, include=""))(lambda s, d: hvg(s, d, min_cells=0))
query("h2_variable_genes_floor", HVG.format(floor="floor(0.01 * (SELECT count(*) FROM cells))", include=""))(lambda s, d: hvg(s, d))
query("p5_include_genes", HVG.format(floor=0, include=" OR genes.gene_id IN (1, 2, 3)"))(lambda s, d: hvg(s, d, min_cells=0, include=[1, 2, 3]))
query("h3_bin_floors", f"""WITH {NORMAL}, {MOMENTS.format(x='xn')}, v AS (SELECT gene_id, s / n AS mean, {VAR('s', 'q', 'n')} AS var, detected FROM m, n), l AS (SELECT gene_id, ln(mean) AS m, ln(var) AS v FROM v WHERE detected > 15 AND mean > 0 AND var > 0),
e AS (SELECT min(m) AS lo, (max(m) + 0.1 - min(m)) / 200 AS step FROM l), b AS (SELECT least(199, CAST(floor((m - lo) / step) AS BIGINT)) AS bin, gene_id, m, v FROM l, e), k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY round(v, 9), gene_id) AS rn FROM b)
SELECT bin, gene_id, {r('m')} AS m, {r('v')} AS v FROM k WHERE rn = 1""")(
    lambda s, d: select.bin_floors(qc.gene_moments(normalize.normalize_total(cust_part(s, d))), 15)
)
query("h3_lowess_genes")(lambda s, d: select.variable_genes(normalize.normalize_total(cust_part(s, d)), 500, flavor="scarf").select("gene_id", "dispersion", "score", "rank", "highly_variable"))
query("h4_shared_variable_genes", f"""WITH {NORMAL}, f AS (SELECT cell_id, cluster FROM cells), common AS (SELECT gene_id FROM (SELECT gene_id, cluster FROM xn JOIN f USING (cell_id) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT cluster) FROM cells)) SELECT gene_id, count(*) AS stored FROM xn SEMI JOIN common USING (gene_id) GROUP BY 1""")(
    lambda s, d: (lambda ds: (lambda c: ds.x.join(c, "gene_id", "left_semi").groupBy("gene_id").agg(F.count("*").alias("stored")))(qc.cluster_stats(ds).groupBy("gene_id").agg(F.count("*").alias("k")).where(F.col("k") == ds.cells.select("cluster").distinct().count())))(normalize.normalize_total(cust_part(s, d)))
)
SHARED = ", shared AS (SELECT * FROM genes SEMI JOIN (SELECT gene_id FROM xn JOIN cells USING (cell_id) WHERE cluster IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cluster) = (SELECT count(DISTINCT cluster) FROM cells)) USING (gene_id)), n AS ("
query("h4_shared_variable_genes_ranked", HVG.format(floor=0, include="").replace(", n AS (", SHARED, 1).replace("FROM genes LEFT JOIN", "FROM shared LEFT JOIN").replace("genes.gene_id", "shared.gene_id"))(
    lambda s, d: select.variable_genes(select.shared_genes(normalize.normalize_total(cust_part(s, d)), "cluster"), 500, min_cells=0).select("gene_id", "dispersion", "bin", "score", "rank", "highly_variable")
)

# D: differential statistics
REST = """,
o AS (SELECT gene_id, cluster, size, s, q, stored, sum(s) OVER g - s AS s0, sum(q) OVER g - q AS q0, sum(size) OVER g - size AS n0 FROM stats WINDOW g AS (PARTITION BY gene_id)),
w AS (SELECT gene_id, cluster, s / size AS m1, s0 / n0 AS m0, sqrt(""" + VAR("s", "q", "size") + " / size + " + VAR("s0", "q0", "n0") + """ / n0) AS se, stored / size AS pts FROM o WHERE size >= 2 AND n0 >= 2),
t AS (SELECT gene_id, cluster, (m1 - m0) / se AS t, CASE WHEN m0 <= 1e-10 THEN 10e0 WHEN m1 <= 1e-10 THEN -10e0 ELSE log2(m1 / m0) END AS lfc, pts FROM w WHERE se >= 1e-12),
p AS (SELECT *, least(1e0, 2 * """ + TAIL("abs(t)") + """) AS p FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY p, gene_id) AS rn, count(*) OVER (PARTITION BY cluster) AS n FROM p),
a AS (SELECT *, least(1e0, min(p * n / rn) OVER (PARTITION BY cluster ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS padj, row_number() OVER (PARTITION BY cluster ORDER BY round(t, 9) DESC, gene_id) AS rank FROM b)"""
MARKERS = f"WITH {NORMAL} {STATS.format(x='xl')} {REST}"
rest = lambda s, d: markers.against_rest(logged(s, d))
query("d1_markers_against_rest", f"{MARKERS} SELECT gene_id, cluster, {r('t')} AS t, {r('lfc')} AS lfc, {r('pts')} AS pts, {r('p')} AS p, {r('padj')} AS padj, rank FROM a")(rest)
query("d3_adjusted_p", f"{MARKERS} SELECT gene_id, cluster, {r('padj')} AS padj FROM a")(lambda s, d: rest(s, d).select("gene_id", "cluster", "padj"))
query("d4_masked_markers", f"WITH {NORMAL}, genes2 AS (SELECT * FROM genes WHERE gene_id % 4 = 0) {STATS.format(x='xl').replace('FROM genes g', 'FROM genes2 g')} {REST} SELECT gene_id, cluster, {r('t')} AS t, {r('padj')} AS padj, rank FROM a")(
    lambda s, d: (lambda ds: markers.against_rest(ds, genes=ds.genes.where("gene_id % 4 = 0")).select("gene_id", "cluster", "t", "padj", "rank"))(logged(s, d))
)
d7_markers_long = query("d7_markers_long", f"{MARKERS} SELECT cluster AS \"group\", rank, gene_id, gene_name AS gene, {r('t')} AS score, {r('lfc')} AS logfoldchange, {r('padj')} AS pval_adj, {r('pts')} AS pct FROM a JOIN genes USING (gene_id) WHERE rank <= 10")(
    lambda s, d: (lambda ds: markers.markers_long(markers.against_rest(ds), ds.genes))(logged(s, d))
)
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
query("d7_markers_wide", f"{MARKERS} SELECT rank, " + ", ".join(f"max(gene_id) FILTER (WHERE cluster = '{c}') AS {c}" for c in SEGMENTS) + " FROM a WHERE rank <= 10 GROUP BY 1")(lambda s, d: markers.markers_wide(rest(s, d), 10, SEGMENTS))
REF = f"""WITH {NORMAL} {STATS.format(x='xl')}, k AS (SELECT gene_id, size AS n0, s AS s0, q AS q0 FROM stats WHERE cluster = 'BUILDING'),
w AS (SELECT gene_id, cluster, s / size AS m1, s0 / n0 AS m0, {VAR('s', 'q', 'size')} / size AS va, {VAR('s0', 'q0', 'n0')} / n0 AS vb, size, n0, stored FROM stats JOIN k USING (gene_id) WHERE cluster <> 'BUILDING' AND size >= 2 AND n0 >= 2)
SELECT gene_id, cluster, {r('CASE WHEN va + vb > 0 THEN (m1 - m0) / sqrt(va + vb) END')} AS t, {r('CASE WHEN va + vb > 0 THEN (va + vb) * (va + vb) / (va * va / (size - 1) + vb * vb / (n0 - 1)) END', 4)} AS df4, {r('log2((exp(m1) - 1 + 1e-9) / (exp(m0) - 1 + 1e-9))', 4)} AS lfc4, {r('stored / size')} AS pts FROM w"""
query("d2_markers_against_group", REF)(
    lambda s, d: markers.against_group(logged(s, d), "BUILDING").select("gene_id", "cluster", "t", F.round("df", 4).alias("df4"), F.round("lfc", 4).alias("lfc4"), "pts")
)
#: Two-sided p of Student's t by Simpson's rule over the angle, and Benjamini-Hochberg's adjustment: of t, df in {w}, by {by}.
TAIL = """, th AS (SELECT *, atan(abs(t) / sqrt(df)) AS lo, least(pi() / 2, atan(abs(t) / sqrt(df)) + 16 / sqrt(df)) AS hi, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) AS front FROM {w}),
pv AS (SELECT * EXCLUDE (lo, hi, front), CASE WHEN t IS NULL THEN 1e0 ELSE least(1e0, 2 * front * (hi - lo) / 4800 * list_sum(list_transform(range(0, 1601), lambda i: (CASE WHEN i = 0 OR i = 1600 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(0e0, cos(lo + (hi - lo) * i / 1600)), df - 1)))) END AS p FROM th),
rk AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY p, gene_id) AS rn, count(*) OVER (PARTITION BY {by}) AS nn FROM pv),
bh AS (SELECT * EXCLUDE (rn, nn), least(1e0, min(p * nn / rn) OVER (PARTITION BY {by} ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS padj FROM rk)"""
T_DF = "CASE WHEN va + vb > 0 THEN (m1 - m0) / sqrt(va + vb) END AS t, CASE WHEN va + vb > 0 THEN (va + vb) * (va + vb) / (va * va / (size - 1) + vb * vb / (n0 - 1)) END AS df"
query("d2_student_p", REF.partition("\nSELECT gene_id, cluster")[0] + f", td AS (SELECT gene_id, cluster, {T_DF} FROM w)" + TAIL.format(w="td", by="cluster") + f" SELECT gene_id, cluster, {r('p', 5)} AS p, {r('padj', 5)} AS padj, row_number() OVER (PARTITION BY cluster ORDER BY round(t, 9) DESC NULLS LAST, gene_id) AS rank FROM bh", 5)(lambda s, d: markers.against_group(logged(s, d), "BUILDING").select("gene_id", "cluster", "p", "padj", "rank"))
OBN = OB + ", tt AS (SELECT cell_id, sum(value) AS total FROM x GROUP BY 1), xl AS (SELECT cell_id, gene_id, ln(1e0 + value * 1e4 / total) AS value FROM x JOIN tt USING (cell_id))"
ob_logged = lambda s, d: normalize.log_transform(normalize.normalize_total(order_brand(s, d)))
CONDITIONS = f"""WITH {OBN}, z AS (SELECT cluster, condition, count(*) AS size FROM cells WHERE cluster IS NOT NULL AND condition IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10), u AS (SELECT gene_id, cluster, condition, sum(value) AS s, sum(value * value) AS q, count(*) AS stored FROM xl JOIN cells USING (cell_id) GROUP BY 1, 2, 3),
st AS (SELECT g.gene_id, z.cluster, z.condition, z.size, coalesce(s, 0) AS s, coalesce(q, 0) AS q, coalesce(stored, 0) AS stored FROM genes g CROSS JOIN z LEFT JOIN u ON u.gene_id = g.gene_id AND u.cluster = z.cluster AND u.condition = z.condition),
k AS (SELECT gene_id, cluster, size AS n0, s AS s0, q AS q0, stored / size AS pct_ref FROM st WHERE condition = 'O'),
w AS (SELECT cluster, condition, gene_id, s / size AS m1, s0 / n0 AS m0, {VAR('s', 'q', 'size')} / size AS va, {VAR('s0', 'q0', 'n0')} / n0 AS vb, size, n0, pct_ref, stored / size AS pct_cond FROM st JOIN k USING (gene_id, cluster) WHERE condition <> 'O' AND size >= 2 AND n0 >= 2)"""
query("d5_conditions_by_cell", CONDITIONS + f"""
SELECT cluster, condition, gene_id, {r('CASE WHEN va + vb > 0 THEN (m1 - m0) / sqrt(va + vb) END')} AS t, {r('pct_ref')} AS pct_ref, {r('pct_cond')} AS pct_cond, {r('log2((exp(m1) - 1 + 1e-9) / (exp(m0) - 1 + 1e-9))')} AS lfc FROM w""")(
    lambda s, d: compare.compare_cells(ob_logged(s, d), "condition", "O", with_p=False).drop("df")
)
query("d5_conditions_by_cell_p", CONDITIONS + f", td AS (SELECT cluster, condition, gene_id, log2((exp(m1) - 1 + 1e-9) / (exp(m0) - 1 + 1e-9)) AS lfc, pct_ref, pct_cond, {T_DF} FROM w)" + TAIL.format(w="td", by="cluster, condition") + f" SELECT cluster, condition, gene_id, {r('t', 5)} AS t, {r('df', 3)} AS df3, {r('lfc', 5)} AS lfc, {r('pct_ref', 5)} AS pct_ref, {r('pct_cond', 5)} AS pct_cond, {r('p', 5)} AS p, {r('padj', 5)} AS padj, padj < 0.05 AND abs(lfc) >= 1 AS significant FROM bh", 5)(
    lambda s, d: compare.volcano(compare.compare_cells(ob_logged(s, d), "condition", "O")).withColumn("df3", F.round("df", 3)).drop("df")
)
query("d6_conditions_pseudobulk")(lambda s, d: compare.compare_pseudobulk(order_brand(s, d), "condition", "O", "cluster", "sample"))
query("d6a_expression_filter", f"""WITH {OB}, {UNITS}, l AS (SELECT cluster, condition, sample, sum(counts) AS lib FROM p GROUP BY 1, 2, 3), md AS (SELECT cluster, quantile_cont(lib, 0.5::DOUBLE) AS med FROM l GROUP BY 1), kk AS (SELECT cluster, min(n) AS k FROM (SELECT cluster, condition, count(*) AS n FROM l GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT cluster, gene_id, count(*) FILTER (WHERE counts / lib * 1e6 >= 10e0 / med * 1e6) AS hits, sum(counts) AS total, max(CASE WHEN k > 10 THEN 10 + (k - 10) * 0.7::DOUBLE ELSE k END) AS need FROM p JOIN l USING (cluster, condition, sample) JOIN md USING (cluster) JOIN kk USING (cluster) GROUP BY 1, 2) SELECT cluster, gene_id FROM h WHERE hits >= need - 1e-14 AND total >= 15 - 1e-14""")(
    lambda s, d: (lambda u, p: compare.expression_filter(p, u, "cluster", "condition"))(*qc.pseudobulk(order_brand(s, d), KEYS, 10))
)
query("d6c_log_cpm", f"WITH {OB}, {UNITS}, l AS (SELECT cluster, condition, sample, sum(counts) AS lib FROM p GROUP BY 1, 2, 3), k AS (SELECT *, lib / (SELECT avg(lib) FROM l) * 3 AS scaled FROM l) SELECT cluster, condition, sample, gene_id, {r('log2((counts + scaled) / (lib + 2 * scaled) * 1e6)')} AS log_cpm FROM p JOIN k USING (cluster, condition, sample)")(
    lambda s, d: (lambda u, p: compare.unit_log_cpm(p, u))(*qc.pseudobulk(order_brand(s, d), KEYS, 10))
)
CHOSEN, CONTROLS = [2, 3, 5, 7, 11], list(range(100, 150))
query("d8_score_genes", f"WITH {NORMAL}, v AS (SELECT cell_id, sum(CASE WHEN gene_id IN (2, 3, 5, 7, 11) THEN value ELSE 0 END) / 5 - sum(CASE WHEN gene_id BETWEEN 100 AND 149 THEN value ELSE 0 END) / 50 AS score FROM xl GROUP BY 1) SELECT cell_id, {r('coalesce(score, 0)')} AS score FROM cells LEFT JOIN v USING (cell_id)")(
    lambda s, d: markers.score_genes(logged(s, d), CHOSEN, CONTROLS)
)
query("d8_control_genes")(lambda s, d: s.createDataFrame([(g,) for g in markers.control_genes(cust_part(s, d).genes, CHOSEN)], "gene_id long"))
query("d9_score_cell_type", f"WITH {NORMAL}, mk AS (SELECT gene_name AS cell_type, gene_id FROM genes WHERE gene_id <= 40), k AS (SELECT cell_type, count(*) AS k FROM mk GROUP BY 1), v AS (SELECT cell_id, cell_type, sum(value) AS s FROM xl JOIN mk USING (gene_id) GROUP BY 1, 2) SELECT cell_id, k.cell_type, {r('coalesce(s, 0) / k')} AS score FROM cells CROSS JOIN k LEFT JOIN v USING (cell_id, cell_type)")(
    lambda s, d: (lambda ds: markers.score_cell_type(ds, ds.genes.where("gene_id <= 40").select(F.col("gene_name").alias("cell_type"), "gene_id")))(logged(s, d))
)

# C: annotation. Markers are made of the part table: brands are types, sizes evidence.
MARK = "mk AS (SELECT DISTINCT p_type AS cell_type, p_brand AS gene, CASE WHEN (length(p_type) + CAST(right(p_brand, 1) AS INTEGER)) % 3 = 0 THEN -1 ELSE 1 END AS sign, 1e0 + CAST(right(p_brand, 1) AS INTEGER) AS evidence, 1e0 * CAST(split_part(p_brand, '#', 2) AS INTEGER) AS strength FROM part)"


def marks(s, d) -> DataFrame:
    last = F.substring("p_brand", -1, 1).cast("int")
    sign = F.when((F.length("p_type") + last) % 3 == 0, -1).otherwise(1)
    part = table(s, d, "part")
    return part.select(F.col("p_type").alias("cell_type"), F.col("p_brand").alias("gene"), sign.alias("sign"), (1.0 + last).alias("evidence"), (1.0 * F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")).alias("strength")).distinct()


WEIGHTS = MARK + """, rr AS (SELECT *, (SELECT count(DISTINCT cell_type) FROM mk) + 1 - count(*) OVER (PARTITION BY gene, sign) AS rare FROM mk),
sc AS (SELECT *, CASE WHEN (SELECT min(rare) = max(rare) FROM rr) THEN (SELECT min(evidence) FROM mk) ELSE (rare - (SELECT min(rare) FROM rr)) / (SELECT (max(rare) - min(rare))::DOUBLE FROM rr) * (SELECT max(evidence) - min(evidence) FROM mk) + (SELECT min(evidence) FROM mk) END AS scaled FROM rr),
wt AS (SELECT cell_type, gene, sign, strength, (log10(evidence) + 1) * (log10(scaled) + 1) AS weight FROM sc), wk AS (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY round(weight, 9) DESC, strength DESC, gene, sign) AS rn FROM wt), ww AS (SELECT cell_type, gene, sign, weight FROM wk WHERE rn <= 12)"""
query("c1_marker_weights", f"WITH {WEIGHTS} SELECT cell_type, gene, sign::BIGINT AS sign, {r('weight')} AS weight FROM ww")(lambda s, d: annotate.weigh(marks(s, d), 12))
MATRIX = WEIGHTS + ", mx AS (SELECT cell_type, gene, sign * weight / sqrt(sum(weight) OVER (PARTITION BY cell_type)) AS w FROM ww)"
query("c2_score_matrix", f"WITH {MATRIX} SELECT cell_type, gene, {r('w')} AS w FROM mx")(lambda s, d: annotate.score_matrix(annotate.weigh(marks(s, d), 12)))
SCORED = OBN + ", " + MATRIX + f""", n AS (SELECT count(*)::DOUBLE AS n FROM cells), mo AS (SELECT gene_id, s / n AS mean, {VAR('s', 'q', 'n')} AS var FROM (SELECT gene_id, coalesce(sum(value), 0) AS s, coalesce(sum(value * value), 0) AS q FROM genes LEFT JOIN xl USING (gene_id) GROUP BY 1), n),
gw AS (SELECT g.gene_id, cell_type, w / sqrt(var) AS w, mean * w / sqrt(var) AS off FROM mx JOIN genes g ON g.gene_name = mx.gene JOIN mo ON mo.gene_id = g.gene_id WHERE var > 1e-18), of AS (SELECT cell_type, sum(off) AS off FROM gw GROUP BY 1),
sm AS (SELECT cell_id, cell_type, sum(value * w) AS s FROM xl JOIN gw USING (gene_id) GROUP BY 1, 2), sco AS (SELECT cell_id, of.cell_type, coalesce(s, 0) - off AS score FROM cells CROSS JOIN of LEFT JOIN sm USING (cell_id, cell_type))"""
scores = lambda s, d: annotate.score_cells(ob_logged(s, d), annotate.score_matrix(annotate.weigh(marks(s, d), 12)))
query("c3_cell_scores", f"WITH {SCORED} SELECT cell_id, cell_type, {r('score')} AS score FROM sco")(scores)
query("c3_best_types", f"WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(score, 9) DESC, cell_type) AS rn FROM sco) SELECT cell_id, max(CASE WHEN rn = 1 THEN cell_type END) AS best, {r('max(CASE WHEN rn = 1 THEN score END)')} AS score, max(CASE WHEN rn = 2 THEN cell_type END) AS second FROM k WHERE rn <= 2 GROUP BY 1")(lambda s, d: annotate.best_types(scores(s, d)))
query("c4_cluster_decisions", f"""WITH {SCORED}, pe AS (SELECT cluster, cell_type, avg(score) AS mean, avg(CASE WHEN score > 0 THEN 1e0 ELSE 0e0 END) AS support FROM sco JOIN cells USING (cell_id) WHERE cluster IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(mean, 9) DESC, cell_type) AS rn FROM pe)
SELECT a.cluster, CASE WHEN a.mean <= 0 OR a.support < 0.25 THEN 'unassigned' ELSE a.cell_type END AS label, a.cell_type AS best, {r('a.mean')} AS mean, {r('a.support')} AS support, CASE WHEN b.mean >= (1 - 0.1::DOUBLE) * a.mean THEN b.cell_type END AS runner_up FROM k a LEFT JOIN k b ON a.cluster = b.cluster AND b.rn = 2 WHERE a.rn = 1""")(
    lambda s, d: annotate.decide(scores(s, d), order_brand(s, d).cells.select("cell_id", "cluster"))
)
query("c4_also_present")(lambda s, d: (lambda sc, c: annotate.also_present(sc, c, annotate.decide(sc, c)))(scores(s, d), order_brand(s, d).cells.select("cell_id", "cluster")))
query("c5_marker_tables", "SELECT * FROM (VALUES ('A', 'x', 1::BIGINT, 1e0, 1e0), ('A', 'y', -1::BIGINT, 1e0, 1e0), ('B', 'z', 1::BIGINT, 1e0, 1e0)) t(cell_type, gene, sign, evidence, strength)")(lambda s, d: annotate.marker_table(s, {"A": ["x+", "y-"], "B": ["z"]}))
labelled = lambda s, d: cust_part(s, d).cells.select("cell_id", F.col("cluster").alias("label"))
query("c7_annotate", f"WITH {CP} SELECT cell_id, CASE cluster WHEN 'BUILDING' THEN 'solid' WHEN 'MACHINERY' THEN 'moving' ELSE 'unassigned' END AS label FROM cells")(lambda s, d: curate.annotate(labelled(s, d), {"BUILDING": "solid", "MACHINERY": "moving"}, keep=False))
query("c8_merge_clusters", f"WITH {CP} SELECT cell_id, CASE WHEN cluster IN ('BUILDING', 'MACHINERY') THEN 'BUILDING+MACHINERY' ELSE cluster END AS label FROM cells")(lambda s, d: curate.merge_clusters(labelled(s, d), [["BUILDING", "MACHINERY"]]))
query("c9_best_matches", f"""WITH {CP}, t AS (SELECT cluster AS la, sample AS lb, count(*) AS n FROM cells GROUP BY 1, 2), a AS (SELECT la, sum(n) AS na FROM t GROUP BY 1), b AS (SELECT lb, sum(n) AS nb FROM t GROUP BY 1), k AS (SELECT la, lb, n / (na + nb - n) AS jaccard, row_number() OVER (PARTITION BY la ORDER BY n / (na + nb - n) DESC, lb) AS rn FROM t JOIN a USING (la) JOIN b USING (lb)) SELECT la, lb, {r('jaccard')} AS jaccard FROM k WHERE rn = 1""")(
    lambda s, d: (lambda c: curate.best_matches(curate.contingency(c.select("cell_id", F.col("cluster").alias("label")), c.select("cell_id", F.col("sample").alias("label")))))(cust_part(s, d).cells)
)

# J: joins that stand behind operators
query("j4_shared_cells", f"WITH {CP}, a AS (SELECT cell_name, cluster FROM cells WHERE cell_id % 2 = 0), b AS (SELECT cell_name, sample FROM cells WHERE cell_id % 3 = 0) SELECT cell_name, cluster, sample FROM a JOIN b USING (cell_name)")(
    lambda s, d: (lambda c: c.where("cell_id % 2 = 0").select("cell_name", "cluster").join(c.where("cell_id % 3 = 0").select("cell_name", "sample"), "cell_name"))(cust_part(s, d).cells)
)
query("j9_orthologs", f"WITH {MARK}, o AS (SELECT DISTINCT p_brand AS gene, 'o' || p_size AS other FROM part) SELECT cell_type, coalesce(other, upper(mk.gene[1]) || lower(mk.gene[2:])) AS gene, sign::BIGINT AS sign FROM mk LEFT JOIN o ON mk.gene = o.gene")(
    lambda s, d: annotate.to_species(marks(s, d), table(s, d, "part").select(F.col("p_brand").alias("gene"), F.concat(F.lit("o"), F.col("p_size").cast("string")).alias("other")).distinct()).select("cell_type", "gene", "sign")
)
TREE = "tr AS (SELECT n_name AS term, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region)"
tree = lambda s, d: table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("term"), F.col("r_name").alias("parent")).union(table(s, d, "region").select("r_name", F.lit("WORLD")))
UP = f"RECURSIVE {TREE}, up AS (SELECT term, term AS ancestor, 0 AS steps FROM (SELECT term FROM tr UNION SELECT parent FROM tr) UNION ALL SELECT up.term, tr.parent, steps + 1 FROM up JOIN tr ON up.ancestor = tr.term), an AS (SELECT term, ancestor, min(steps) AS steps FROM up GROUP BY 1, 2)"
query("j10_ancestors", f"WITH {UP} SELECT term, ancestor, steps::BIGINT AS steps FROM an")(lambda s, d: annotate.ancestors(tree(s, d)))
query("j10_common_ancestors", f"WITH {UP}, k AS (SELECT a.term AS a, b.term AS b, a.ancestor, row_number() OVER (PARTITION BY a.term, b.term ORDER BY a.steps + b.steps, a.ancestor) AS rn FROM an a JOIN an b USING (ancestor)) SELECT a, b, ancestor FROM k WHERE rn = 1")(lambda s, d: annotate.common_ancestors(tree(s, d)))


# X6: the tables behind plots
Q = ", q AS (SELECT cell_id, cluster, sample, coalesce(sum(value), 0) AS n_counts, count(*) FILTER (WHERE value > 0) AS n_genes FROM cells LEFT JOIN x USING (cell_id) GROUP BY 1, 2, 3)"
measured = lambda s, d: qc.qc_metrics(cust_part(s, d), "none ")
query("x6_scatter_qc", f"WITH {CP} {Q} SELECT cell_id, {r('n_counts')} AS n_counts, n_genes FROM q")(lambda s, d: plotframes.scatter_qc(measured(s, d).cells))
query("x6_violin", f"WITH {CP} {Q} SELECT cluster, count(n_counts) AS n, {r('min(n_counts)')} AS low, {r('quantile_cont(n_counts, 0.25::DOUBLE)')} AS q25, {r('quantile_cont(n_counts, 0.5::DOUBLE)')} AS median, {r('quantile_cont(n_counts, 0.75::DOUBLE)')} AS q75, {r('max(n_counts)')} AS high FROM q GROUP BY 1")(
    lambda s, d: plotframes.violin(measured(s, d).cells, "n_counts", "cluster")
)
query("x6_gene_violin", f"WITH {CP}, v AS (SELECT cell_id, cluster, coalesce(max(value) FILTER (WHERE gene_id = 5), 0) AS g FROM cells LEFT JOIN x USING (cell_id) GROUP BY 1, 2) SELECT cluster, count(*) AS n, {r('min(g)')} AS low, {r('quantile_cont(g, 0.25::DOUBLE)')} AS q25, {r('quantile_cont(g, 0.5::DOUBLE)')} AS median, {r('quantile_cont(g, 0.75::DOUBLE)')} AS q75, {r('max(g)')} AS high FROM v GROUP BY 1")(
    lambda s, d: plotframes.gene_violin(cust_part(s, d), 5, "cluster")
)
query("x6_kept_and_removed", f"WITH {CP} {Q}, p AS (SELECT ln(n_counts) AS l, n_genes >= 30 AS kept FROM q WHERE n_counts > 0), e AS (SELECT min(l) AS lo, (max(l) - min(l)) / 64 AS step FROM p) SELECT kept, CAST(least(63, floor((l - lo) / step + 1e-9)) AS BIGINT) AS bin, count(*) AS n FROM p, e GROUP BY 1, 2")(
    lambda s, d: plotframes.kept_and_removed(measured(s, d).cells, F.col("n_genes") >= 30, "n_counts")
)
query("x6_overview", f"WITH {CP} {Q} SELECT count(*) AS n_cells, {r('quantile_cont(n_counts, 0.5::DOUBLE)')} AS median_counts, {r('quantile_cont(n_genes::DOUBLE, 0.5::DOUBLE)')} AS median_genes, (SELECT count(*) FROM genes) AS n_genes FROM q")(lambda s, d: plotframes.overview(measured(s, d)))
query("x6_volcano")(lambda s, d: compare.volcano(compare.compare_pseudobulk(order_brand(s, d), "condition", "O", "cluster", "sample")))
query("x6_fold_changes")(lambda s, d: plotframes.fold_changes(compare.compare_pseudobulk(order_brand(s, d), "condition", "O", "cluster", "sample")))
