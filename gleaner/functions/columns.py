"""Columns that have to be worked out where they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """The frame with columns worked out once for each row.

    They come from a generator of one row. The optimizer moves filters and projections through plain projections by copying
    their expressions, so long chains of text expressions would be worked out at each use; it moves none through this.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
