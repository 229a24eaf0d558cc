"""Histogram quartiles: fixed bins of a power of two over a window, the quartile being a bin's lower edge.

The window is either given (bin_min, bin_shift) or derived from a strided sample of about SAMPLE values: the sample's
quartiles span it (rule "iqr": two interquartile ranges beyond both), or its 1st and 99th percentiles do (rule "p1p99", and
whenever the quartiles coincide). Values outside the window count in the first or last bin; flags compare true values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, SAMPLE = 4096, 8192


@dataclass(frozen=True)
class BinWindow:
    """Bins of 2**shift values from minimum on."""

    minimum: int
    shift: int
    bins: int = BINS


def _sorted_parts(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(df with its dense index i, the persisted table behind it)."""
    placed = df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = placed.persist(StorageLevel.DISK_ONLY)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), F.min("_at").alias("first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.select("_part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn("i", F.col("_at") + F.col("_start")).drop("_part", "_at", "_start"), placed


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """df with the column i: each row's rank (from 0) by a unique key, without a window over all rows.

    Rows are sorted by ranges of the key and kept on the executors' disks until the session ends (or clearCache()); the partitions'
    row counts, a table of one number each, give the offsets.
    """
    return _sorted_parts(df, key)[0]


def strided_sample(df: DataFrame, column: str, key: str | None = None, index: Column | None = None, size: int = SAMPLE) -> list[int]:
    """Every step-th value in the order of key (or by a dense index column), step = max(1, rows div size); nulls left out.

    At most 2 * size values come to the driver.
    """
    step, placed = max(1, df.count() // size), None
    if step > 1 and index is None:
        if key is None:
            raise ValueError("a key or an index must order rows of which only some are sampled")
        df, placed = _sorted_parts(df.select(key, column), key)
        index = F.col("i")
    rows = df if step == 1 else df.where(index % step == 0)
    found = [int(r[0]) for r in rows.where(F.col(column).isNotNull()).select(column).collect()]
    if placed is not None:
        placed.unpersist()
    return found


def window_from_sample(values: list[int], bins: int = BINS, rule: str = "iqr") -> BinWindow:
    """The window that a sample suggests."""
    if rule not in ("iqr", "p1p99"):
        raise ValueError(f"unknown window rule {rule!r}")
    if not values:
        return BinWindow(0, 0, bins)
    s, m = sorted(values), len(values)
    at = lambda percent: s[min(m - 1, m * percent // 100)]
    q1, q3 = at(25), at(75)
    low, high = (q1 - 2 * (q3 - q1), q3 + 2 * (q3 - q1)) if rule == "iqr" and q3 > q1 else (at(1), at(99))
    if high <= low:
        return BinWindow(low, 0, bins)
    width = -(-(high - low) // bins)
    shift = (width - 1).bit_length()
    return BinWindow((low >> shift) << shift, shift, bins)


def auto_window(df: DataFrame, column: str, key: str | None = None, index: Column | None = None, bins: int = BINS, rule: str = "iqr", size: int = SAMPLE) -> BinWindow:
    return window_from_sample(strided_sample(df, column, key, index, size), bins, rule)


def grouped_sample(df: DataFrame, column: str, row: Column, group_rows: int, groups: int = 16, rows: int = 2048, stride: bool = False) -> list[int]:
    """A sample of uniformly spaced row groups, the first and last among them.

    Of each group the first rows values (or, with stride, about as many at equal steps). row is a dense row index.
    """
    n = df.count()
    total = -(-n // group_rows) if n else 0
    if not total:
        return []
    picked = sorted({k * (total - 1) // max(1, min(groups, total) - 1) for k in range(min(groups, total))})
    inside = row % group_rows
    last = n - (total - 1) * group_rows
    length = F.when(F.floor(row / group_rows) == total - 1, last).otherwise(group_rows)
    step = F.greatest(F.lit(1), F.floor(length / rows))
    chosen = (inside % step == 0) & (inside < step * rows) if stride else inside < rows
    sample = df.where(F.floor(row / group_rows).isin(picked) & chosen & F.col(column).isNotNull())
    return [int(r[0]) for r in sample.select(column).collect()]


def whole(n: int) -> Column:
    """A literal of any size."""
    return F.lit(n) if -(2**63) <= n < 2**63 else F.lit(str(n)).cast("decimal(38,0)")


def bin_of(value: Column, window: BinWindow) -> Column:
    """The clamped bin. Values are cut to the window first, so that differences can't overflow."""
    end = window.minimum + (window.bins << window.shift) - 1
    if -(2**63) <= window.minimum and end < 2**63 and end - window.minimum < 2**63:
        inside = F.least(F.greatest(value, F.lit(window.minimum)), F.lit(end)).cast("long")
        return F.call_function("shiftright", inside - F.lit(window.minimum), F.lit(window.shift))
    inside = F.least(F.greatest(value.cast("decimal(38,0)"), whole(window.minimum).cast("decimal(38,0)")), whole(end).cast("decimal(38,0)"))
    return F.call_function("div", (inside - whole(window.minimum).cast("decimal(38,0)")).cast("decimal(38,0)"), whole(1 << window.shift).cast("decimal(38,0)"))


def bins(df: DataFrame, column: str, window: BinWindow) -> DataFrame:
    """Rows (bin, n) of the bins that occur; nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(bin_of(F.col(column), window).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(df: DataFrame, column: str, window: BinWindow) -> DataFrame:
    """(q1, q3): lower edges of the first bins that reach a quarter and three quarters of the rows; the window is small."""
    running = bins(df, column, window).select("bin", F.sum("n").over(Window.orderBy("bin")).alias("cc"), F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("t"))
    first = lambda k: F.min(F.when(F.col("cc") * 4 >= k * F.col("t"), F.col("bin")))
    if -(2**63) <= window.minimum and window.minimum + (window.bins << window.shift) < 2**63:
        edge = lambda b: F.lit(window.minimum) + F.call_function("shiftleft", b.cast("long"), F.lit(window.shift))
    else:
        edge = lambda b: (whole(window.minimum).cast("decimal(38,0)") + (b.cast("decimal(16,0)") * whole(1 << window.shift).cast("decimal(20,0)")).cast("decimal(38,0)")).cast("decimal(38,0)")
    return running.agg(first(1).alias("b1"), first(3).alias("b3")).select(edge(F.col("b1")).alias("q1"), edge(F.col("b3")).alias("q3"))


def half_bin(value: Column, window: BinWindow) -> tuple[Column, Column]:
    """The bin without clamping, and whether the value is exactly at its lower edge."""
    index = F.call_function("shiftright", value.cast("long") - F.lit(window.minimum), F.lit(window.shift))
    return index, value.cast("long") == F.lit(window.minimum) + F.call_function("shiftleft", index, F.lit(window.shift))


def half_bin_outside(value: Column, lo: int, hi: int, window: BinWindow) -> Column:
    """The flag from bin numbers alone, equal to comparing values when both fences are bin edges."""
    index, exact = half_bin(value, window)
    k, m = (lo - window.minimum) >> window.shift, (hi - window.minimum) >> window.shift
    return (index < k) | (index > m) | ((index == m) & ~exact)


def check_total(df: DataFrame, column: str, window: BinWindow) -> int:
    """The rows that the histogram counted; an error if they aren't all non-null rows."""
    counted = bins(df, column, window).agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = df.agg(F.count(column).alias("n")).first()["n"]
    if counted != rows:
        raise ArithmeticError(f"the histogram counted {counted} of {rows} rows")
    return counted


def diagnostics(df: DataFrame, column: str, window: BinWindow) -> DataFrame:
    """(accepted, committed, clamped, bins_used, total): rows with a value, rows that the histogram counted, of these the ones
    outside the window, the bins that occur, and all rows."""
    v = F.col(column)
    end = window.minimum + (window.bins << window.shift) - 1
    facts = df.agg(F.count(column).alias("accepted"), F.count_if((v < whole(window.minimum)) | (v > whole(end))).alias("clamped"), F.count(F.lit(1)).alias("total"))
    used = bins(df, column, window).agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("b")).alias("f")).scalar()
    return facts.select("accepted", used.getField("n").alias("committed"), "clamped", used.getField("b").alias("bins_used"), "total")
