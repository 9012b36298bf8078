"""Views of star-schema, text and vector tables as datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.frames import Dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cust_part(spark: SparkSession, sf_dir: str) -> Dataset:
    """Customers by parts: quantities ordered. Segment is the cluster, nation the sample."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    x = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_name").alias("cell_name"), F.col("c_mktsegment").alias("cluster"), F.col("c_nationkey").cast("string").alias("sample"))
    genes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_name"))
    return Dataset(x, cells, genes)


def order_brand(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders by brands. Status is the condition, nation the replicate, segment the group."""
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gene_name")).agg(F.min("p_partkey").alias("gene_id"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(brands, F.col("p_brand") == F.col("gene_name")).select("p_partkey", "gene_id")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    x = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("cell_id"), "gene_id").agg(F.sum("l_quantity").alias("value"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    cells = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("cell_id"), F.col("c_mktsegment").alias("cluster"), F.col("o_orderstatus").alias("condition"), F.col("c_nationkey").cast("string").alias("sample"))
    return Dataset(x, cells, brands.select("gene_id", "gene_name"))


def supp_brand(spark: SparkSession, sf_dir: str) -> Dataset:
    """Suppliers by brands, nearly dense."""
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gene_name")).agg(F.min("p_partkey").alias("gene_id"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(brands, F.col("p_brand") == F.col("gene_name")).select("p_partkey", "gene_id")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    x = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("cell_id"), "gene_id").agg(F.sum("l_quantity").alias("value"))
    cells = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_name").alias("cell_name"), F.col("s_nationkey").cast("string").alias("sample"))
    return Dataset(x, cells, brands.select("gene_id", "gene_name"))


def doc_token(spark: SparkSession, sf_dir: str) -> Dataset:
    """Documents by tokens: counts. A gene's id is its name's hash."""
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select(F.col("doc_id").alias("cell_id"), F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("gene_name")).where("gene_name <> ''")
    counts = tokens.groupBy("cell_id", "gene_name").agg(F.count("*").cast("double").alias("value"))
    x = counts.select("cell_id", F.xxhash64("gene_name").alias("gene_id"), "value", "gene_name")
    genes = x.select("gene_id", "gene_name").distinct()
    return Dataset(x.drop("gene_name"), docs.select(F.col("doc_id").alias("cell_id"), F.col("lang").alias("cluster"), F.col("source").alias("sample")), genes)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, v, label) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
