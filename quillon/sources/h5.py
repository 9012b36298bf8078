"""Count matrices in HDF5: annotated matrices (``.h5ad``) and genes-by-cells files (10x ``.h5``).

The driver reads shapes and annotations; the matrix is read by tasks, each a range of rows of the compressed matrix.
"""

from __future__ import annotations

from array import array

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.frames import Dataset
from quillon.sources.hdf5 import File, Node, Writer

#: Stored values that one task reads.
PART = 2_000_000


def column(node: Node):
    """A column of an annotation table: plain, categorical, or nullable with a mask."""
    if node.is_dataset:
        return node.read()
    if "categories" in node:
        names, codes = node["categories"].read(), node["codes"].read()
        return np.array([None if c < 0 else names[c] for c in codes], object)
    if "mask" in node:
        values, mask = node["values"].read(), node["mask"].read()
        return np.array([None if m else v for v, m in zip(values.tolist(), mask)], object)
    raise ValueError("this column's encoding isn't known")


def frame(spark: SparkSession, group: Node, key: str, name: str, wanted: list[str] | None = None) -> DataFrame:
    index = str(group.attrs.get("_index", "_index"))
    data = {name: [str(v) for v in group[index].read()]}
    for c in wanted if wanted is not None else sorted(set(group.links) - {index, "__categories"}):
        data[c] = column(group[c])
    pdf = pd.DataFrame({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in data.items()})
    pdf.insert(0, key, np.arange(len(pdf)))
    return spark.createDataFrame(pdf)


def entries(spark: SparkSession, path: str, group: str, indptr: np.ndarray, major: str, minor: str) -> DataFrame:
    """(cell_id, gene_id, value) of a compressed matrix, ranges of whole rows by task."""
    cuts = np.unique(np.searchsorted(indptr, np.arange(0, indptr[-1] + PART, PART)).clip(0, len(indptr) - 1))
    ranges = [(int(a), int(b)) for a, b in zip(cuts, cuts[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist()):
                node = File(path)[group]
                ptr = node["indptr"].read(low, high + 1).astype(np.int64)
                rows = np.repeat(np.arange(low, high), np.diff(ptr))
                columns, values = node["indices"].read(int(ptr[0]), int(ptr[-1])).astype(np.int64), node["data"].read(int(ptr[0]), int(ptr[-1])).astype(np.float64)
                for at in range(0, len(rows), 1 << 18):
                    s = slice(at, at + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[s]), pa.array(columns[s]), pa.array(values[s])], [major, minor, "value"])

    plan = spark.createDataFrame(ranges, "low long, high long").repartition(max(1, len(ranges)))
    return plan.mapInArrow(run, f"{major} long, {minor} long, value double").where("value <> 0").select("cell_id", "gene_id", "value")


def dense_entries(spark: SparkSession, path: str, shape: tuple[int, int]) -> DataFrame:
    step = max(1, PART // max(1, shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in batch.column("id").to_pylist():
                x = File(path)["X"].read(low, low + step)
                row, col = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(row + low), pa.array(col), pa.array(x[row, col].astype(np.float64))], ["cell_id", "gene_id", "value"])

    parts = -(-shape[0] // step)
    return spark.range(0, shape[0], step, max(1, parts)).mapInArrow(run, "cell_id long, gene_id long, value double")


def read_h5ad(spark: SparkSession, path: str, obs_columns: list[str] | None = None) -> Dataset:
    """Matrix, obs and var; what else a file holds isn't read."""
    f = File(path)
    cells, genes = frame(spark, f["obs"], "cell_id", "cell_name", obs_columns), frame(spark, f["var"], "gene_id", "gene_name")
    x = f["X"]
    if x.is_dataset:
        return Dataset(dense_entries(spark, path, x.shape), cells, genes)
    by_column = str(x.attrs.get("encoding-type", "csr_matrix")).startswith("csc")
    return Dataset(entries(spark, path, "X", x["indptr"].read(), *(("gene_id", "cell_id") if by_column else ("cell_id", "gene_id"))), cells, genes)


def read_10x_h5(spark: SparkSession, path: str) -> Dataset:
    f = File(path)
    name = "matrix" if "matrix" in f else sorted(f.root.links)[0]
    m = f[name]
    names = m["features"]["name"] if "features" in m else m["gene_names"]
    keys = m["features"]["id"] if "features" in m else m["genes"]
    cells = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(m["barcodes"].shape[0]), "cell_name": m["barcodes"].read().tolist()}))
    genes = spark.createDataFrame(pd.DataFrame({"gene_id": np.arange(names.shape[0]), "gene_key": keys.read().tolist(), "gene_name": names.read().tolist()}))
    return Dataset(entries(spark, path, name, m["indptr"].read(), "cell_id", "gene_id"), cells, genes)


def scan_h5ad(path: str) -> dict:
    """Shape, stored values and column names, without the matrix."""
    f = File(path)
    x, obs, var = f["X"], f["obs"], f["var"]
    n, m = (g[str(g.attrs.get("_index", "_index"))].shape[0] for g in (obs, var))
    return {"n_cells": n, "n_genes": m, "nnz": n * m if x.is_dataset else x["data"].shape[0], "dtype": str((x if x.is_dataset else x["data"]).kind.dtype), "obs": sorted(obs.links), "var": sorted(var.links)}


def write_h5ad(ds: Dataset, path: str, chunk: int = 65_536) -> None:
    """One file by one writer: rows come to the driver partition by partition in order of cell. For what one machine's disk holds."""
    cells, genes = ds.cells.orderBy("cell_id").toPandas(), ds.genes.orderBy("gene_id").toPandas()
    at_cell, at_gene = ({k: i for i, k in enumerate(t[c])} for t, c in ((cells, "cell_id"), (genes, "gene_id")))
    counts, index, data = np.zeros(len(cells), np.int64), array("i"), array("d")
    for r in ds.x.select("cell_id", "gene_id", "value").orderBy("cell_id", "gene_id").toLocalIterator():
        counts[at_cell[r.cell_id]] += 1
        index.append(at_gene[r.gene_id])
        data.append(r.value)
    w = Writer(path)

    def table(pdf: pd.DataFrame, key: str, name: str) -> int:
        columns = {"_index": w.dataset(np.array([str(v) for v in (pdf[name] if name in pdf else pdf[key])] or [""])[: len(pdf)])}
        for c in pdf.columns:
            if c not in (key, name) and len(pdf) and not pdf[c].isna().any():
                columns[c] = w.dataset(pdf[c].to_numpy() if pdf[c].dtype.kind in "iuf" else pdf[c].astype(str).to_numpy())
        return w.group(columns, {"_index": "_index", "encoding-type": "dataframe"})

    x = w.group({"data": w.dataset(np.frombuffer(data, np.float64), chunk=chunk), "indices": w.dataset(np.frombuffer(index, np.int32), chunk=chunk), "indptr": w.dataset(np.concatenate([[0], np.cumsum(counts)]))}, {"encoding-type": "csr_matrix", "shape": np.array([len(cells), len(genes)])})
    w.close(w.group({"X": x, "obs": table(cells, "cell_id", "cell_name"), "var": table(genes, "gene_id", "gene_name")}))


