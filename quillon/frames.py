"""The dataset handle: a set of DataFrames that every operator takes and returns.

``x`` holds stored entries only, (cell_id, gene_id, value). ``cells`` and ``genes`` hold every cell and every gene, also those without
entries: zeros are observations, so counts of cells and genes come from these tables and never from ``x``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = {"x": ("cell_id", "gene_id", "value"), "cells": ("cell_id",), "genes": ("gene_id",)}


@dataclass(frozen=True)
class Dataset:
    x: DataFrame
    cells: DataFrame
    genes: DataFrame
    raw: DataFrame | None = None
    emb: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, columns in KEYS.items():
            missing = [c for c in columns if c not in getattr(self, name).columns]
            if missing:
                raise ValueError(f"{name} has no column {missing[0]!r}; it has {getattr(self, name).columns}")

    @property
    def counts(self) -> DataFrame:
        """Raw counts of the cells and genes that are left: what statistics on counts start from."""
        if self.raw is None:
            return self.x
        return self.raw.join(self.cells.select("cell_id"), "cell_id", "left_semi").join(self.genes.select("gene_id"), "gene_id", "left_semi")

    def with_x(self, x: DataFrame) -> Dataset:
        return replace(self, x=x, raw=self.x if self.raw is None else self.raw)

    def with_frames(self, **frames: DataFrame) -> Dataset:
        return replace(self, **frames)

    def with_emb(self, name: str, frame: DataFrame) -> Dataset:
        return replace(self, emb={**self.emb, name: frame})

    def with_edges(self, name: str, frame: DataFrame) -> Dataset:
        return replace(self, edges={**self.edges, name: frame})

    def with_uns(self, name: str, frame: DataFrame) -> Dataset:
        return replace(self, uns={**self.uns, name: frame})


def nested(items: list[tuple], schema: str, spark) -> DataFrame:
    return spark.createDataFrame(items, schema)


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType))


def n_rows(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]
