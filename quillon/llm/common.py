"""Helpers shared by the operators: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is configured: a temporary one on one machine, else a folder in the warehouse."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        one_machine = master.startswith("local") and not master.startswith("local-cluster")
        found = tempfile.mkdtemp(prefix="quillon-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Written intermediate tables in the shared folder.

    ``keep`` cuts the lineage, so that a lost executor costs one step and no step is computed twice.
    Shuffle files are deleted once a step is written.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)  # results read their steps as long as the application lives

    def keep(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(self.CLEANUP, None)
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            (df.coalesce(partitions) if partitions else df).write.parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before) if before is not None else self.spark.conf.unset(self.CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quillon_path = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in kept:
            at = jvm.org.apache.hadoop.fs.Path(df._quillon_path)
            at.getFileSystem(conf).delete(at, True)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``limit`` bytes of text, one row at least, so that memory stays bounded. After the last one, memory that
    the worker doesn't use goes back to the system, as workers wait for more tasks beside those of other stages."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size + 64
        yield batch.slice(start)
    batch = None
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such function
        ctypes.CDLL(None).malloc_trim(0)


def thinned(df: DataFrame, by: list[str], wanted: int, total: int, key: Column | None = None) -> DataFrame:
    """Of ``total`` rows those under a bound of their hash (of ``by``, or ``key`` itself) that leaves about four times as many as wanted, all if they are few.
    Sorting what is left and taking the first then brings the driver a number of rows that doesn't grow with the partitions."""
    if total <= 8 * wanted:
        return df
    return df.where((F.xxhash64(*by) if key is None else key) <= int(-(1 << 63) + 4 * wanted / total * (1 << 64)))
