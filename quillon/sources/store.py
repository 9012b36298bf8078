"""Datasets as folders of Parquet: writing, reading, saving analyses, scanning and checking files, joining several."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.frames import Dataset
from quillon.functions.checks import need_choice


class SourceMovedError(RuntimeError):
    pass


def write(ds: Dataset, path: str, buckets: int = 0) -> None:
    """One Parquet table a frame. Sorting entries by cell within files lets ranges of cells skip row groups."""
    x = ds.x.repartitionByRange(buckets, "cell_id") if buckets else ds.x
    x.sortWithinPartitions("cell_id", "gene_id").write.parquet(f"{path}/x")
    ds.cells.write.parquet(f"{path}/cells")
    ds.genes.write.parquet(f"{path}/genes")
    if ds.raw is not None:
        ds.raw.write.parquet(f"{path}/counts")
    for kind in ("emb", "edges", "uns"):
        for name, frame in getattr(ds, kind).items():
            frame.write.parquet(f"{path}/{kind}/{name}")


def save(ds: Dataset, path: str, sources: dict[str, str] | None = None) -> None:
    """The frames and a manifest, which remembers what sources held when the analysis was saved."""
    write(ds, path)
    spark = ds.x.sparkSession
    manifest = {"raw": ds.raw is not None, **{k: sorted(getattr(ds, k)) for k in ("emb", "edges", "uns")}, "sources": {n: [p, stamp(spark, p)] for n, p in (sources or {}).items()}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def stamp(spark: SparkSession, path: str) -> list[int]:
    """Size and latest change of everything below a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise SourceMovedError(f"{path} isn't there any more; give its new place with relink")
    files, size, latest = fs.listFiles(p, True), 0, 0
    while files.hasNext():
        f = files.next()
        size, latest = size + f.getLen(), max(latest, f.getModificationTime())
    return [size, latest]


def load(spark: SparkSession, path: str, relink: dict[str, str] | None = None) -> Dataset:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    for name, (place, then) in manifest["sources"].items():
        place = (relink or {}).get(name, place)
        if stamp(spark, place)[0] != then[0]:
            raise SourceMovedError(f"the source {name} at {place} isn't the one that was saved")
    return read(spark, path, manifest)


def read(spark: SparkSession, path: str, manifest: dict | None = None) -> Dataset:
    frames = {k: spark.read.parquet(f"{path}/{k}") for k in ("x", "cells", "genes")}
    more = {k: {n: spark.read.parquet(f"{path}/{k}/{n}") for n in (manifest or {}).get(k, [])} for k in ("emb", "edges", "uns")}
    return Dataset(**frames, raw=spark.read.parquet(f"{path}/counts") if (manifest or {}).get("raw") else None, **more)


def sniff(path: str) -> str:
    """The format by its name."""
    for end, kind in ((".h5ad", "h5ad"), (".h5", "10x h5"), (".mtx", "mtx"), (".mtx.gz", "mtx"), (".parquet", "parquet")):
        if path.rstrip("/").endswith(end):
            return kind
    return "folder"


def sniff_content(spark: SparkSession, path: str) -> str:
    """The format by what a file begins with, whatever its name; of a folder by the files it holds, and by name where neither tells."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        raise FileNotFoundError(path)
    if files.getFileStatus(place).isDirectory():
        names = {f.getPath().getName() for f in files.listStatus(place)}
        return "mtx" if names & {"matrix.mtx", "matrix.mtx.gz"} else "folder" if {"x", "cells", "genes"} <= names else sniff(path)
    stream = files.open(place)
    try:
        head = bytes(b for b in (stream.read() for _ in range(14)) if b >= 0)
    finally:
        stream.close()
    if head.startswith(b"\x89HDF\r\n\x1a\n"):
        from quillon.sources.hdf5 import File

        return "h5ad" if "X" in File(path) else "10x h5"
    if head.startswith(b"PAR1"):
        return "parquet"
    if head.startswith(b"%%MatrixMarket") or head.startswith(b"\x1f\x8b"):
        return "mtx"
    return sniff(path)


def open_any(spark: SparkSession, path: str) -> Dataset:
    """Opens what the content says it is: HDF5 of either kind, a matrix (its folder) or a saved dataset."""
    kind = sniff_content(spark, path)
    if kind in ("h5ad", "10x h5"):
        from quillon.sources import h5

        return h5.read_h5ad(spark, path) if kind == "h5ad" else h5.read_10x_h5(spark, path)
    if kind == "mtx":
        from quillon.sources.mtx import read_mtx

        return read_mtx(spark, path.rsplit("/", 1)[0] if _is_file(spark, path) else path)
    return read(spark, path)


def _is_file(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()


def scan(ds: Dataset) -> DataFrame:
    """One row: n_cells, n_genes, nnz, sparsity."""
    one = ds.cells.agg(F.count("*").alias("n_cells")).crossJoin(ds.genes.agg(F.count("*").alias("n_genes"))).crossJoin(ds.x.agg(F.count("*").alias("nnz")))
    return one.withColumn("sparsity", 1 - F.col("nnz") / F.greatest(F.col("n_cells").cast("double") * F.col("n_genes"), F.lit(1.0)))


def validate(ds: Dataset) -> DataFrame:
    """One row of counts that are all 0 in a sound dataset, and its size."""
    bad = ds.x.agg(F.count_if(F.col("value").isNull() | F.isnan("value") | (F.col("value") == 0)).alias("bad_values"))
    strange = lambda frame, key, name: ds.x.join(frame, key, "left_anti").agg(F.count("*").alias(name))
    twice = lambda df, keys, name: df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias(name))
    out = scan(ds).crossJoin(bad)
    for part in (strange(ds.cells, "cell_id", "unknown_cells"), strange(ds.genes, "gene_id", "unknown_genes"), twice(ds.x, ["cell_id", "gene_id"], "repeated_entries"), twice(ds.cells, ["cell_id"], "repeated_cells"), twice(ds.genes, ["gene_id"], "repeated_genes")):
        out = out.crossJoin(part)  # single rows
    return out


def merged_genes(names: DataFrame, how: str = "intersection") -> DataFrame:
    """(gene_name, gene_id) of several files' genes (file, pos, gene_name), file being a number. An intersection keeps the first file's
    order; a union goes by name unless all files list the same genes. A name that one file lists twice is an error."""
    need_choice(how, ("intersection", "union"), "how")
    if not names.groupBy("file", "gene_name").count().where("count > 1").isEmpty():
        raise ValueError("a file lists a gene name twice")
    n_files = names.select("file").distinct().count()
    per = names.groupBy("gene_name").agg(F.countDistinct("file").alias("k"), F.min(F.struct("file", "pos")).alias("first"))
    if how == "intersection":
        kept = per.where(F.col("k") == n_files)
        if kept.isEmpty():
            raise ValueError("no gene is in all files")
        order = F.col("first.pos")
    else:
        kept, order = per, F.col("first.pos") if per.where(F.col("k") < n_files).isEmpty() else F.col("gene_name")
    from pyspark.sql import Window

    return kept.select("gene_name", (F.row_number().over(Window.orderBy(order, "gene_name")) - 1).cast("long").alias("gene_id"))


def merge(parts: dict[str, Dataset], how: str = "intersection", batch_key: str = "batch") -> Dataset:
    """Cells of all parts one after another (ids are made anew by hash of part and id), genes matched by name; annotations as in
    :func:`concat_frames`."""
    names = None
    for i, ds in enumerate(parts.values()):
        own = ds.genes.select(F.lit(i).alias("file"), F.col("gene_id").alias("pos"), "gene_name")
        names = own if names is None else names.union(own)
    genes = merged_genes(names, how)
    xs, frames = [], []
    for label, ds in parts.items():
        new = F.xxhash64(F.lit(label), "cell_id")
        ids = ds.genes.select("gene_id", "gene_name").join(genes.withColumnRenamed("gene_id", "to"), "gene_name").select("gene_id", "to")
        xs.append(ds.x.join(ids, "gene_id").select(new.alias("cell_id"), F.col("to").alias("gene_id"), "value"))
        frames.append(ds.cells.withColumn("cell_id", new).withColumn(batch_key, F.lit(label)))
    x = xs[0]
    for other in xs[1:]:
        x = x.unionByName(other)
    return Dataset(x, concat_frames(frames), genes)


def concat_frames(frames: list[DataFrame]) -> DataFrame:
    """All columns of all frames; what one lacks is null."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


class Project:
    """A folder for an analysis: runs and results have places of their own."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def run_dir(self, name: str) -> str:
        return f"{self.path}/runs/{name}"

    def results_dir(self, name: str) -> str:
        return f"{self.path}/results/{name}"

    def status(self) -> dict[str, int]:
        jvm = self.spark.sparkContext._jvm
        out = {}
        for part in ("runs", "results"):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
            fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            out[part] = len(fs.listStatus(p)) if fs.exists(p) else 0
        return out

    def clean(self, part: str) -> None:
        need_choice(part, ("runs", "results"), "part")
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
