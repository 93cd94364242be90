"""Helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often they are used.

    A projection may be merged into those above it, and a filter or a join condition moved below
    it, which repeats its expressions; nothing is merged with a generator or moved below it.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
