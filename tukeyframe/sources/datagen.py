"""Columns with planted outliers, whose number is known beforehand. All are spark.range with an expression: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tukeyframe.sources import parquet

#: Multiplier that scatters a counter (the golden ratio of 32 bits).
SCATTER = 2_654_435_761


def _frame(spark: SparkSession, rows: int, value: Column) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("i"), value.cast("long").alias("v"))


def planted(spark: SparkSession, rows: int, levels: int = 1_000_000, every: int = 1000, height: int = 5_000_000) -> DataFrame:
    """Scattered values below levels, every so many rows lifted by height: rows / every outliers."""
    i = F.col("id")
    return _frame(spark, rows, (i * SCATTER) % levels + F.when(i % every == 0, height).otherwise(0))


def cardinality(spark: SparkSession, rows: int, levels: int, span: int = 10_000_000, every: int = 1000, height: int = 50_000_000) -> DataFrame:
    """About levels distinct values over a span, a thousandth of the rows lifted."""
    i = F.col("id")
    return _frame(spark, rows, (((i * SCATTER) % levels) * SCATTER) % span + F.when(i % every == 0, height).otherwise(0))


def uniform(spark: SparkSession, rows: int, levels: int = 10_000, every: int = 100_000, height: int = 5_000_000) -> DataFrame:
    return planted(spark, rows, levels, every, height)


def drifting(spark: SparkSession, rows: int, per_step: int = 2000, noise: int = 1000, every: int = 100_000, height: int = 5_000_000) -> DataFrame:
    """Values that rise with the row number, so that any sample from the beginning misleads."""
    i = F.col("id")
    return _frame(spark, rows, F.floor(i / per_step) + (i * SCATTER) % noise + F.when(i % every == 0, height).otherwise(0))


def skewed(spark: SparkSession, rows: int, strength: float, levels: int = 1_000_000, every: int = 1000, height: int = 50_000_000) -> DataFrame:
    """Values whose density falls exponentially with the given strength (0: uniform), a thousandth of the rows lifted."""
    i = F.col("id")
    u = ((i * SCATTER) % levels + 0.5) / levels
    x = u if strength == 0 else -F.log(1 - u * (1 - F.exp(F.lit(-float(strength))))) / strength
    return _frame(spark, rows, F.floor(x * levels) + F.when(i % every == 0, height).otherwise(0))


def cycle(spark: SparkSession, rows: int, period: int = 10) -> DataFrame:
    """i modulo period: no outliers."""
    return _frame(spark, rows, F.col("id") % period)


def codecs(spark: SparkSession, folder: str, rows: int, levels: tuple[int, ...] = (10_000, 1_000_000), every: int = 1000) -> dict[str, str]:
    """Files of one planted column for each encoding (plain, dictionary), compression (none, snappy) and number of levels: the
    path of each by name. Every file has rows / every outliers."""
    found = {}
    for n in levels:
        for dictionary in (False, True):
            for compression in ("none", "snappy"):
                name = f"{'dictionary' if dictionary else 'plain'}-{compression}-{n}"
                parquet.write(planted(spark, rows, n, every), f"{folder}/{name}", compression, dictionary=dictionary)
                found[name] = f"{folder}/{name}"
    return found


def check_cardinality(df: DataFrame, levels: int, column: str = "v") -> None:
    """An error unless the column has exactly so many distinct values."""
    found = df.agg(F.count_distinct(column).alias("d")).first()["d"]
    if found != levels:
        raise ArithmeticError(f"{found} distinct values instead of {levels}")
