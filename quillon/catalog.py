"""Every query of the library proper, and SQL for those that SQL can express. Operators are named by the inventory's ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon import queries_graph, queries_invariants, queries_matrix, queries_models, queries_sources

QUERIES = queries_matrix.QUERIES | queries_sources.QUERIES | queries_graph.QUERIES | queries_models.QUERIES | queries_invariants.QUERIES
ORACLES = queries_matrix.ORACLES | queries_sources.ORACLES | queries_graph.ORACLES | queries_models.ORACLES | queries_invariants.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best markers of every segment."""
    return queries_matrix.d7_markers_long(spark, sf_dir)
