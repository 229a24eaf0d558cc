"""Helpers for plans of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row.

    The optimiser may copy a column's expression to where it is used; within a lambda it would then run for every element.
    It never copies through a generator, so the columns come out of one of one row.
    """
    held = df.withColumn("_held", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    kept = [c for c in df.columns if c not in columns]
    return held.select(*kept, *(F.col("_held").getField(n).alias(n) for n in columns))


def fresh(df: DataFrame, name: str) -> str:
    """The name, followed by as many underscores as it takes, so that no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
