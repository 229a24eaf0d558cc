"""Exact quartiles of a 64-bit integer column: q1 is the ceil(N/4)-th smallest value, q3 the ceil(3N/4)-th.

All functions take a DataFrame and a column, skip nulls, and give one row (q1, q3), null for an empty column.

* ``cdf`` counts each value and sums the counts in value order: one plan, no action. Its window runs over the distinct
  values in one task, so it is for columns of modest cardinality.
* ``zoom`` narrows down on both ranks by histograms: one small job a level with a map-side aggregate, nothing sorted and
  nothing that grows with the number of distinct values. The first level has bins of equal ratio, so it needs no range
  beforehand, and the second one mostly ends it. It is the way for large columns, and the default (``auto``).
* ``listed``, ``ordered_set``, ``by_row_number`` and ``approximate`` are the other formulations, for comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of a level after the first, and bins a doubling of the first.
BINS, OCTAVE = 8192, 512
#: Integers up to this are exact as doubles.
EXACT_DOUBLE = 2**53


def counts(df: DataFrame, column: str) -> DataFrame:
    """Each value v with its number of rows n."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def cdf(df: DataFrame, column: str) -> DataFrame:
    return cdf_of_counts(counts(df, column))


def cdf_of_counts(counted: DataFrame) -> DataFrame:
    """Quartiles of a table of (v, n)."""
    running = counted.select("v", F.sum("n").over(Window.orderBy("v")).alias("cc"), F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("t"))
    first = lambda k: F.min(F.when(F.col("cc") * 4 >= k * F.col("t"), F.col("v")))
    return running.agg(first(1).alias("q1"), first(3).alias("q3"))


def _as_row(df: DataFrame, q1: int | None, q3: int | None, dtype: T.DataType) -> DataFrame:
    spark = df.sparkSession
    text = lambda x: F.lit(None if x is None else str(x)).cast(dtype)
    return spark.range(1).select(text(q1).alias("q1"), text(q3).alias("q3"))


def _ratio_bin(value: Column) -> Column:
    """A number that never falls as value grows: OCTAVE steps for each doubling, on either side of 0."""
    v = value.cast("double")
    step = F.floor(F.log2(F.abs(v) + 1.0) * OCTAVE).cast("long")
    return F.when(v < 0, -step).otherwise(step)


def ratio_histogram(df: DataFrame, column: str, weight: str | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """((least value, greatest value, rows) of each bin that occurs, in order; rows without a value). 64-bit values have
    some 65,000 bins at most."""
    add = F.sum(weight) if weight else F.count(F.lit(1))
    v = F.col(column)
    rows = df.groupBy(_ratio_bin(v).alias("bin")).agg(F.min(v).alias("low"), F.max(v).alias("high"), add.alias("c")).collect()
    return sorted((int(r["low"]), int(r["high"]), r["c"]) for r in rows if r["low"] is not None), sum(r["c"] for r in rows if r["low"] is None)


def pick(found: list[tuple[int, int, int]], rank: int) -> tuple[int, int, int]:
    """The range that holds a rank, and the rank within it."""
    for low, high, c in found:
        if rank <= c:
            return low, high, rank
        rank -= c
    raise ValueError("the rank is beyond the rows")


def select_ranks(df: DataFrame, column: str, ranks: list[int], bounds: tuple[int, int], weight: str | None = None) -> list[int]:
    """The values of the given 1-based ranks of a column whose values are within bounds."""
    return narrow(df, column, [(*bounds, r) for r in ranks], weight)


def narrow(df: DataFrame, column: str, ranges: list[tuple[int, int, int]], weight: str | None = None) -> list[int]:
    """The values of 1-based ranks within ranges (low, high, rank), which are equal or apart.

    A level is one job and one pass for all ranges: rows within a range go to at most BINS bins of a power of two, whose
    least and greatest values are the next ranges. weight: a column of row counts, 1 if None.
    """
    add = F.sum(weight) if weight else F.count(F.lit(1))
    v = F.col(column)
    state = list(ranges)
    while open_ranges := sorted({(low, high) for low, high, _ in state if low < high}):
        part, inside = None, None
        for low, high in open_ranges:  # one for each rank at most; they are equal or apart
            shift = max(0, (high - low).bit_length() - (BINS.bit_length() - 1))
            if -(2**63) <= low and high < 2**63:
                start, here = F.lit(low), v.between(low, high)
            else:
                start = F.lit(str(low)).cast("decimal(38,0)")
                here = v.between(start, F.lit(str(high)).cast("decimal(38,0)"))
            if high - low < 2**63 and -(2**63) <= low and high < 2**63:
                number = F.call_function("shiftright", v.cast("long") - start, F.lit(shift))
            else:
                offset = (v.cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)")).cast("decimal(38,0)")
                number = F.call_function("div", offset, F.lit(str(1 << shift)).cast("decimal(38,0)"))
            place = F.struct(F.lit(open_ranges.index((low, high))).alias("part"), number.cast("long").alias("bin"))
            part = F.when(here, place) if part is None else part.when(here, place)
            inside = here if inside is None else inside | here
        rows = df.where(inside).groupBy(part.alias("p")).agg(F.min(v).alias("low"), F.max(v).alias("high"), add.alias("c")).collect()
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r in rows:  # at most BINS a range
            found.setdefault(r["p"]["part"], []).append((int(r["low"]), int(r["high"]), r["c"]))
        state = [(low, high, rank) if low == high else pick(sorted(found[open_ranges.index((low, high))]), rank) for low, high, rank in state]
    return [low for low, _, _ in state]


def quartile_ranks(total: int) -> list[int]:
    return [-(-total // 4), -(-3 * total // 4)]


def zoom(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    dtype = df.select(column).schema[0].dataType
    found, _ = ratio_histogram(df, column, weight)
    total = sum(c for *_, c in found)
    if not total:
        return _as_row(df, None, None, dtype)
    q1, q3 = narrow(df, column, [pick(found, r) for r in quartile_ranks(total)], weight)
    return _as_row(df, q1, q3, dtype)


def listed(df: DataFrame, column: str) -> DataFrame:
    """Both quantiles from one aggregate, as an array that is then taken apart."""
    kind = df.select(column).schema[0].dataType
    _check_exact(df, column)
    both = df.agg(F.expr(f"array(percentile_disc(0.25) WITHIN GROUP (ORDER BY `{column}`), percentile_disc(0.75) WITHIN GROUP (ORDER BY `{column}`))").alias("q"))
    return both.select(F.element_at("q", 1).cast(kind).alias("q1"), F.element_at("q", 2).cast(kind).alias("q3"))


def ordered_set(df: DataFrame, column: str) -> DataFrame:
    """The ordered-set aggregate percentile_disc. It works in doubles, so larger values are refused."""
    kind = df.select(column).schema[0].dataType
    _check_exact(df, column)
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)").cast(kind)
    return df.agg(disc(0.25).alias("q1"), disc(0.75).alias("q3"))


def _check_exact(df: DataFrame, column: str) -> None:
    most = df.agg(F.max(F.abs(F.col(column).cast("decimal(38,0)"))).alias("m")).first()["m"]
    if most is not None and most >= EXACT_DOUBLE:
        raise ValueError("percentile_disc works in doubles, which don't hold this column's values: use cdf or zoom")


def by_row_number(df: DataFrame, column: str) -> DataFrame:
    """A full sort with row numbers: the plain definition, in one task."""
    v = F.col(column)
    rows = df.where(v.isNotNull()).select(v.alias("v"), F.row_number().over(Window.orderBy(v)).alias("r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("t"))
    at = lambda k: F.max(F.when(F.col("r") == F.ceil(k * F.col("t") / 4), F.col("v")))
    return rows.agg(at(1).alias("q1"), at(3).alias("q3"))


def approximate(df: DataFrame, column: str, accuracy: int = 10_000) -> DataFrame:
    """Quartiles from a mergeable sketch."""
    at = lambda p: F.percentile_approx(column, p, accuracy)
    return df.agg(at(0.25).alias("q1"), at(0.75).alias("q3"))


def interpolated(df: DataFrame, column: str) -> DataFrame:
    """Interpolated quantiles, as doubles."""
    return df.agg(F.percentile(column, 0.25).alias("q1"), F.percentile(column, 0.75).alias("q3"))


METHODS = {"cdf": cdf, "zoom": zoom, "auto": zoom, "list": listed, "ordered_set": ordered_set, "row_number": by_row_number, "approximate": approximate}
