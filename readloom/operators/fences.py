"""Compute costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, which the optimizer can't copy into every place that names them.

    Projections and filters are merged through plain projections, so that an expression that
    is named ten times runs ten times; a generator of one row stops that.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
