"""Vector columns: which rows take part, and Arrow lists to numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch


def takes_part() -> Column:
    """Whether ``key`` and ``v`` do: vectors that are null, empty, zero or hold null or non-finite components, and rows without a key, don't."""
    ok = F.expr("key is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return F.coalesce(ok, F.lit(False))


def numbered(rows: DataFrame, key: str, column: str, scratch: Scratch) -> DataFrame:
    """(row: a number of each row's own, key: long, v: array<double>, null where the row takes no part), written once so that numbers stay."""
    named = rows.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v"))
    return scratch.keep(named.select(F.monotonically_increasing_id().alias("row"), "key", F.when(takes_part(), F.col("v")).alias("v")))


def by_length(batch: pa.RecordBatch, column: str = "v", most: int = 1 << 22) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, matrix) for each length of vectors in a batch, at most ``most`` components at a time."""
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for size in np.unique(sizes).tolist():
        where = np.flatnonzero(sizes == size)
        step = max(1, most // max(1, size))
        for at in range(0, len(where), step):
            part = batch.take(pa.array(where[at : at + step])) if len(where) < len(sizes) or len(where) > step else batch
            yield size, part, matrix(part.column(column), size)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is between 1/2 and 1: exact, and norms neither overflow nor vanish."""
    _, power = np.frexp(np.abs(v).max(axis=1))
    return np.ldexp(v, -power[:, None])


def exact_dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same for equal rows wherever they stand."""
    return (x * y).sum(axis=-1)
