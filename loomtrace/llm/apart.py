"""Columns that an operator carries along without reading them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Apart(NamedTuple):
    """A table whose other columns have numbers for names, and their names."""

    docs: DataFrame
    names: dict[str, str]

    def back(self, rows: DataFrame, *added: str) -> DataFrame:
        """``rows`` under the names and in the order of before, and columns made meanwhile."""
        return rows.select(*(F.col(n).alias(c) for c, n in self.names.items()), *added)


def set_apart(docs: DataFrame, own: Sequence[str]) -> Apart:
    """Rename all columns but ``own``, so that none clashes with a name used inside."""
    names = {c: c if c in own else f"_kept{i}" for i, c in enumerate(docs.columns)}
    return Apart(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names)
