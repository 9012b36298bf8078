"""Queries over sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quillon.adapters import cust_part, doc_token, supp_brand, table
from quillon.functions.checks import need_column
from quillon.plans import process
from quillon.plans.steps import Steps
from quillon.queries_matrix import CP, SB, r, tidy
from quillon.sources import h5, mtx, store
from quillon.streaming import metrics

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda s, d: tidy(f(s, d))
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("s3_matrix_folder", f"WITH {SB}, c AS (SELECT cell_id, cell_name, row_number() OVER (ORDER BY cell_id) - 1 AS c FROM cells), g AS (SELECT gene_id, gene_name, row_number() OVER (ORDER BY gene_id) - 1 AS g FROM genes) SELECT c AS cell_id, g AS gene_id, {r('value')} AS value, cell_name, gene_name FROM x JOIN c USING (cell_id) JOIN g USING (gene_id)")
def matrix_folder(s, d):
    """Written as a matrix folder and read again."""
    at = Steps(s, "mtx").root
    mtx.write_mtx(supp_brand(s, d), at)
    ds = mtx.read_mtx(s, at)
    return ds.x.join(ds.cells, "cell_id").join(ds.genes, "gene_id").select("cell_id", "gene_id", "value", "cell_name", "gene_name")


def h5_file(s, d) -> str:
    at = Steps(s, "h5").root.removeprefix("file://")
    os.makedirs(at)
    h5.write_h5ad(supp_brand(s, d), f"{at}/x.h5ad", chunk=1000)
    return f"{at}/x.h5ad"


PLACED = f"WITH {SB}, c AS (SELECT cell_id, cell_name, row_number() OVER (ORDER BY cell_id) - 1 AS c FROM cells), g AS (SELECT gene_id, gene_name, row_number() OVER (ORDER BY gene_id) - 1 AS g FROM genes)"


@query("s1_h5ad", f"{PLACED} SELECT c AS cell_id, g AS gene_id, {r('value')} AS value, cell_name, gene_name FROM x JOIN c USING (cell_id) JOIN g USING (gene_id)")
def h5ad(s, d):
    """Written as an annotated matrix and read again (s12 is the writing)."""
    ds = store.open_any(s, h5_file(s, d))
    return ds.x.join(ds.cells.select("cell_id", "cell_name"), "cell_id").join(ds.genes.select("gene_id", "gene_name"), "gene_id").select("cell_id", "gene_id", "value", "cell_name", "gene_name")


query("s5_scan_h5ad", f"WITH {SB} SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT count(*) FROM genes) AS n_genes, (SELECT count(*) FROM x) AS nnz")(
    lambda s, d: (lambda m: s.createDataFrame([(m["n_cells"], m["n_genes"], m["nnz"])], "n_cells long, n_genes long, nnz long"))(h5.scan_h5ad(h5_file(s, d)))
)
query("s5_scan", f"WITH {CP} SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT count(*) FROM genes) AS n_genes, (SELECT count(*) FROM x) AS nnz, {r('1 - (SELECT count(*) FROM x) / ((SELECT count(*) FROM cells)::DOUBLE * (SELECT count(*) FROM genes))')} AS sparsity")(
    lambda s, d: store.scan(cust_part(s, d))
)


def by_nation(s, d):
    """Three files of one matrix; each knows the genes that its cells use."""
    ds = cust_part(s, d)
    out = {}
    for k in range(3):
        cells = ds.cells.where(F.col("cell_id") % 3 == k)
        x = ds.x.join(cells.select("cell_id"), "cell_id", "left_semi").where(F.col("gene_id") % (k + 2) != 1)
        genes = ds.genes.where(F.col("gene_id") % (k + 2) != 1).select("gene_id", F.concat(F.lit("g"), F.col("gene_id").cast("string")).alias("gene_name"))
        out[f"f{k}"] = ds.with_frames(x=x, cells=cells, genes=genes)
    return out


def total(s, d, how):
    ds = store.merge(by_nation(s, d), how)
    return ds.x.join(ds.genes, "gene_id").groupBy("gene_name", "gene_id").agg(F.sum("value").alias("total"), F.count("*").alias("stored"))


KEPT = f"WITH {CP}, k AS (SELECT cell_id, gene_id, value FROM x WHERE gene_id % (cell_id % 3 + 2) <> 1)"
query("s7_merge_intersection", f"{KEPT}, i AS (SELECT gene_id AS g, row_number() OVER (ORDER BY gene_id) - 1 AS pos FROM genes WHERE gene_id % 2 <> 1 AND gene_id % 3 <> 1 AND gene_id % 4 <> 1) SELECT 'g' || g AS gene_name, pos AS gene_id, {r('sum(value)')} AS total, count(*) AS stored FROM k JOIN i ON k.gene_id = i.g GROUP BY 1, 2")(
    lambda s, d: total(s, d, "intersection")
)
query("s7_merge_union", f"{KEPT}, i AS (SELECT gene_id AS g, row_number() OVER (ORDER BY 'g' || gene_id) - 1 AS pos FROM genes WHERE gene_id % 2 <> 1 OR gene_id % 3 <> 1 OR gene_id % 4 <> 1) SELECT 'g' || g AS gene_name, pos AS gene_id, {r('sum(value)')} AS total, count(*) AS stored FROM k JOIN i ON k.gene_id = i.g GROUP BY 1, 2")(
    lambda s, d: total(s, d, "union")
)
query("s8_concat_frames", "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::VARCHAR AS status FROM customer UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders")(
    lambda s, d: store.concat_frames([table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))])
)
query("s9_validate", f"WITH {CP} SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT count(*) FROM genes) AS n_genes, (SELECT count(*) FROM x) AS nnz, {r('1 - (SELECT count(*) FROM x) / ((SELECT count(*) FROM cells)::DOUBLE * (SELECT count(*) FROM genes))')} AS sparsity, 0::BIGINT AS bad_values, 0::BIGINT AS unknown_cells, 0::BIGINT AS unknown_genes, 0::BIGINT AS repeated_entries, 0::BIGINT AS repeated_cells, 0::BIGINT AS repeated_genes")(
    lambda s, d: store.validate(cust_part(s, d))
)


@query("s10_store", f"WITH {CP} SELECT cell_id, gene_id, {r('value')} AS value FROM x WHERE cell_id BETWEEN 10 AND 40")
def block_store(s, d):
    """Written sorted by cell, read for a range of cells."""
    at = Steps(s, "store").root
    store.write(cust_part(s, d), at, buckets=4)
    return store.read(s, at).x.where("cell_id between 10 and 40").select("cell_id", "gene_id", "value")


@query("s13_save_load", f"WITH {CP} SELECT cell_id, count(*) AS stored FROM x GROUP BY 1")
def save_load(s, d):
    at = Steps(s, "saved").root
    ds = cust_part(s, d)
    store.save(ds.with_uns("sizes", ds.cells.groupBy("cluster").count()), at, {"lines": f"{d}/lineitem.parquet"})
    return store.load(s, at).x.groupBy("cell_id").agg(F.count("*").alias("stored"))


@query("x1_plan")
def plan(s, d):
    found = process.plan(doc_token(s, d))
    return s.createDataFrame([(k, v, found.partitions) for k, v in found.steps.items()], "step string, bytes long, partitions long")


query("x2_max_cells")(lambda s, d: s.createDataFrame([(m, process.max_cells(m, 20_000)) for m in (1_000, 8_000, 64_000)], "memory_mb long, cells long"))


@query("x5_process")
def whole(s, d):
    ds = process.process(cust_part(s, d), Steps(s, "process"), n_top=200, floor=5, components=10)
    need_column(ds.cells, "leiden")
    return ds.cells.select("cell_id", "n_counts", "n_genes", "leiden")


@query("streaming_cell_totals", f"WITH {CP} SELECT cell_id, {r('sum(value)')} AS n_counts, count(*) FILTER (WHERE value > 0) AS n_genes FROM x GROUP BY 1")
def streaming(s, d):
    """An extension: the sums of quality metrics over entries that arrive file by file."""
    at = Steps(s, "stream").root
    cust_part(s, d).x.select("cell_id", "gene_id", "value").repartition(3).write.parquet(at)
    return metrics.run_to_memory(metrics.cell_totals(metrics.stream_entries(s, at)), "cell_totals")


@query("streaming_event_counts", "SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, user_id AS cell_id, event_type AS gene_name, count(*) AS value FROM events GROUP BY 1, 2, 3")
def events(s, d):
    """An extension: tumbling windows over the events table as a batch; the same plan runs on a stream."""
    return metrics.event_counts(table(s, d, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "cell_id", "gene_name", "value")
