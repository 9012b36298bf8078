"""An extension that finite files don't need: sums over arriving entries as Structured Streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_entries(spark: SparkSession, path: str, schema: str = "cell_id long, gene_id long, value double", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def cell_totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("cell_id").agg(F.sum("value").alias("n_counts"), F.count_if(F.col("value") > 0).alias("n_genes"))


def gene_totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("n_cells"), F.sum("value").alias("total_counts"))


def group_sums(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Sums, squares and stored entries of labelled cells, the labels being a static table."""
    return entries.join(labels, "cell_id").groupBy("gene_id", "label").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count("*").alias("stored"))


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Cells by event types within tumbling windows; what comes later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), F.col("user_id").alias("cell_id"), F.col("event_type").alias("gene_name")).agg(F.count("*").alias("value"))


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drains what there is and returns the result as a table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
