"""Errors that name the nearest match."""

from __future__ import annotations

import difflib
from collections.abc import Iterable

from pyspark.sql import DataFrame


def nearest(name: str, known: Iterable[str]) -> str:
    found = difflib.get_close_matches(name, list(known), n=1, cutoff=0.0)
    return f"; did you mean {found[0]!r}?" if found else ""


def need_column(df: DataFrame, name: str, what: str = "column") -> None:
    if name not in df.columns:
        raise KeyError(f"there is no {what} {name!r}{nearest(name, df.columns)}")


def need_choice(value: str, choices: Iterable[str], what: str) -> None:
    if value not in set(choices):
        raise ValueError(f"{what} {value!r} isn't known{nearest(value, choices)}")


def need_positive(value: float, what: str) -> None:
    if not value > 0:
        raise ValueError(f"{what} must be positive, not {value!r}")
