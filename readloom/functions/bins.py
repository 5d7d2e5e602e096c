"""Binning strategies of numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = {
    "one": lambda n: F.lit(0),
    "by5": lambda n: F.round(n / 5).cast("int"),
    "linear": lambda n: F.when(n < 100, 0).otherwise((n / 1000 + 1).cast("int")),
    "log10": lambda n: (F.log1p(n + 1) / F.log(F.lit(10.0))).cast("int"),
    "log2": lambda n: (F.log1p(n + 1) / F.log(F.lit(2.0))).cast("int"),
    "small_log10": lambda n: F.when(n < 100, 0).otherwise((F.log10(n) - 1).cast("int")),
}


def bin_of(n: Column, strategy: str) -> Column:
    return STRATEGIES[strategy](n.cast("double"))
