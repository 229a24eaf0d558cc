"""The algebra of outlier fences: integer fences with floor halves, clamped to the column's type, and the flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = "decimal(38,0)"
#: Least and greatest value of the two column types that outlier functions take.
SIGNED = (-(2**63), 2**63 - 1)
UNSIGNED = (0, 2**64 - 1)


def is_unsigned(dtype: T.DataType) -> bool:
    """Spark reads an unsigned 64-bit Parquet column as decimal(20,0)."""
    return isinstance(dtype, T.DecimalType) and dtype.precision == 20 and dtype.scale == 0


def value_type(df: DataFrame, column: str) -> T.DataType:
    """The type of a column that outlier functions take: a signed or unsigned 64-bit integer."""
    found = {f.name.lower(): f for f in df.schema.fields}
    if column.lower() not in found:
        raise ValueError(f"no column {column!r}; there are {', '.join(df.columns)}")
    dtype = found[column.lower()].dataType
    if not isinstance(dtype, T.LongType) and not is_unsigned(dtype):
        raise TypeError(f"column {column!r} is {dtype.simpleString()}; it must be bigint or unsigned 64-bit (decimal(20,0))")
    return dtype


def fences(quartiles: DataFrame, dtype: T.DataType) -> DataFrame:
    """quartiles (q1, q3) with the columns lo and hi, both null where the quartiles are.

    With d = q3 - q1 and e = d + floor(d / 2) they are q1 - e and q3 + e, computed in 128 bits and clamped to the type.
    """
    low, high = UNSIGNED if is_unsigned(dtype) else SIGNED
    kind = dtype.simpleString()
    d = f"CAST(CAST(q3 AS {WIDE}) - CAST(q1 AS {WIDE}) AS {WIDE})"
    e = f"CAST({d} + CAST({d} div CAST(2 AS {WIDE}) AS {WIDE}) AS {WIDE})"
    lo = f"greatest(CAST(CAST(q1 AS {WIDE}) - {e} AS {WIDE}), CAST('{low}' AS {WIDE}))"
    hi = f"least(CAST(CAST(q3 AS {WIDE}) + {e} AS {WIDE}), CAST('{high}' AS {WIDE}))"
    return quartiles.withColumns({name: F.expr(f"CASE WHEN q1 IS NOT NULL AND q3 IS NOT NULL THEN CAST({x} AS {kind}) END") for name, x in (("lo", lo), ("hi", hi))})


def fence_values(q1: int, q3: int, dtype: T.DataType) -> tuple[int, int]:
    """The fences (lo, hi) of quartiles that are known."""
    low, high = UNSIGNED if is_unsigned(dtype) else SIGNED
    e = (q3 - q1) + (q3 - q1) // 2
    return max(low, q1 - e), min(high, q3 + e)


def outside(value: Column, lo: Column, hi: Column) -> Column:
    """Whether a value is an outlier: strictly outside the fences; null for null."""
    return (value < lo) | (value > hi)
