"""MatrixMarket folders (matrix.mtx[.gz], barcodes.tsv, features.tsv or genes.tsv): genes by cells, counted from one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.frames import Dataset
from quillon.plans.steps import Steps


def hadoop_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def numbered(lines: DataFrame) -> DataFrame:
    """(line, value): line numbers from one in file order. Only the number of lines of each block passes the driver."""
    placed = lines.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("id"))
    parts = placed.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("id").alias("low")).orderBy("f", "b").collect()
    offsets, at = [], 0
    for p in parts:
        offsets.append((p.f, p.b, at - p.low))
        at += p.n
    if not offsets:
        return lines.select(F.lit(0).cast("long").alias("line"), "value").limit(0)
    shift = F.create_map(*[x for f, b, o in offsets for x in (F.lit(f"{f}:{b}"), F.lit(o))])
    return placed.select((F.col("id") + F.element_at(shift, F.concat_ws(":", "f", "b")) + 1).alias("line"), "value")


def first_existing(spark: SparkSession, folder: str, names: list[str]) -> str:
    for name in names:
        if hadoop_exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"{folder} has none of {', '.join(names)}")


def read_mtx(spark: SparkSession, folder: str) -> Dataset:
    matrix = spark.read.text(first_existing(spark, folder, ["matrix.mtx", "matrix.mtx.gz"]))
    parts = F.split(F.trim("value"), r"\s+")
    lines = matrix.where(~F.col("value").startswith("%") & (F.trim("value") != "")).select(parts.alias("p"), F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    size = lines.orderBy("f", "b", "id").select("f", "b", "id").first()  # the line of sizes is the first that isn't a comment
    entries = lines.where(~((F.col("f") == size.f) & (F.col("b") == size.b) & (F.col("id") == size.id)))
    x = entries.select((F.col("p")[1].cast("long") - 1).alias("cell_id"), (F.col("p")[0].cast("long") - 1).alias("gene_id"), F.col("p")[2].cast("double").alias("value")).where("value <> 0")
    barcodes = numbered(spark.read.text(first_existing(spark, folder, ["barcodes.tsv", "barcodes.tsv.gz"])))
    features = numbered(spark.read.text(first_existing(spark, folder, ["features.tsv", "features.tsv.gz", "genes.tsv", "genes.tsv.gz"])))
    cells = barcodes.select((F.col("line") - 1).alias("cell_id"), F.trim("value").alias("cell_name"))
    f = F.split("value", "\t")
    genes = features.select((F.col("line") - 1).alias("gene_id"), F.try_element_at(f, F.lit(1)).alias("gene_key"), F.coalesce(F.try_element_at(f, F.lit(2)), F.try_element_at(f, F.lit(1))).alias("gene_name"))
    return Dataset(x, cells, genes)


def places(rows: DataFrame, key: str, steps: Steps) -> DataFrame:
    """(key, at): places from one by order of the key; ranges of keys are ranked by task, and only the number of keys in each passes the driver."""
    held = steps.keep(rows.select(key).repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    before, at = [], 0
    for r in held.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        before.append((r.part, at))
        at += r.n
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    shift = rows.sparkSession.createDataFrame(before, "part int, before long")
    return ranked.join(F.broadcast(shift), "part").select(key, (F.col("before") + F.col("r")).alias("at"))  # a row a partition


def write_mtx(ds: Dataset, folder: str) -> None:
    """Ids become places by order. The entries are one text table of many parts; its first part holds the header."""
    spark = ds.x.sparkSession
    steps = Steps(spark, "mtx")
    cells, genes = places(ds.cells, "cell_id", steps), places(ds.genes, "gene_id", steps)
    body = ds.x.join(cells.withColumnRenamed("at", "c"), "cell_id").join(genes.withColumnRenamed("at", "g"), "gene_id").select(F.concat_ws(" ", "g", "c", F.format_string("%s", "value")).alias("value"))
    n = [ds.genes.count(), ds.cells.count(), body.count()]
    head = spark.range(1, numPartitions=1).select(F.explode(F.array(F.lit("%%MatrixMarket matrix coordinate real general"), F.lit(" ".join(map(str, n))))).alias("value"))
    head.union(body).write.text(f"{folder}/matrix.mtx")
    name = lambda df, key, column: F.col(column) if column in df.columns else F.col(key).cast("string")
    ds.cells.select("cell_id", name(ds.cells, "cell_id", "cell_name").alias("v")).orderBy("cell_id").coalesce(1).select("v").write.text(f"{folder}/barcodes.tsv")
    ds.genes.select("gene_id", F.concat_ws("\t", F.col("gene_id").cast("string"), name(ds.genes, "gene_id", "gene_name")).alias("v")).orderBy("gene_id").coalesce(1).select("v").write.text(f"{folder}/features.tsv")
