"""The outlier functions: every row of a 64-bit integer column flagged by the 1.5 IQR rule.

``source`` is a DataFrame or a Parquet path. The fences come as a scalar subquery, so that flagging is one plan: Spark runs
the small aggregate first and the scan then compares with constants, within one generated stage and without a join.
Nulls get a null flag; an empty column gives no rows; all rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tukeyframe.functions import fences as algebra
from tukeyframe.operators import histogram, quartiles
from tukeyframe.sources import parquet


def load(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    return source if isinstance(source, DataFrame) else parquet.scan(spark or SparkSession.active(), source)


def flag(df: DataFrame, column: str, found: DataFrame, name: str = "is_outlier") -> DataFrame:
    """df with a flag column from one row of quartiles (q1, q3)."""
    bounds = algebra.fences(found, algebra.value_type(df, column)).select(F.struct("lo", "hi").alias("f")).scalar()
    return df.withColumn(name, algebra.outside(F.col(column), bounds.getField("lo"), bounds.getField("hi")))


def exact_quartiles(df: DataFrame, column: str, method: str = "auto") -> DataFrame:
    if method not in quartiles.METHODS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(quartiles.METHODS)}")
    algebra.value_type(df, column)
    return quartiles.METHODS[method](df, column)


def iqr_flags(source: DataFrame | str, column: str, *, key: str | None = None, index: Column | None = None, window: histogram.BinWindow | None = None, bins: int = histogram.BINS, rule: str = "iqr", sample: int = histogram.SAMPLE, groups: int = 0, group_rows: int = 122_880, group_sample: int = 2048, stride: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, column, is_outlier) with histogram quartiles; a window that isn't given is derived from a sample.

    A path is sampled in the order of its files' names and their rows, a DataFrame in the order of key or by a dense index
    column. groups: sample so many uniformly spaced groups of group_rows rows instead, of each the first ``group_sample`` rows or
    (stride) about as many at equal steps.
    """
    df = load(source)
    algebra.value_type(df, column)
    if window is None:
        if not isinstance(source, DataFrame):
            index = F.col("position")
        sampled = df if isinstance(source, DataFrame) else parquet.with_position(df, column)
        if groups:
            if index is None:
                raise ValueError("a path or an index must order rows of which groups are sampled")
            found = histogram.grouped_sample(sampled, column, index, group_rows, groups, group_sample, stride)
            window = histogram.window_from_sample(found, bins, rule)
        else:
            window = histogram.auto_window(sampled, column, key, index, bins, rule, sample)
    return flag(df, column, histogram.quartiles(df, column, window)).select(*keep, column, "is_outlier")


def iqr_flags_only(source: DataFrame | str, column: str, **options) -> DataFrame:
    keep = options.get("keep", ())
    return iqr_flags(source, column, **options).select(*keep, "is_outlier")


def iqr_cpu_flags(source: DataFrame | str, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, is_outlier) with exact quartiles found by narrowing histograms."""
    df = load(source)
    return flag(df, column, exact_quartiles(df, column, "zoom")).select(*keep, "is_outlier")


def iqr_cpu_flags_groupby(source: DataFrame | str, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, is_outlier) with exact quartiles from cumulative value counts."""
    df = load(source)
    return flag(df, column, exact_quartiles(df, column, "cdf")).select(*keep, "is_outlier")


def iqr_exact(source: DataFrame | str, column: str, method: str = "auto", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, column, is_outlier) with exact quartiles by any method of operators.quartiles."""
    df = load(source)
    return flag(df, column, exact_quartiles(df, column, method)).select(*keep, column, "is_outlier")


def count_outliers(source: DataFrame | str, column: str, method: str = "auto") -> DataFrame:
    """(n, n_outliers): rows and outliers, by exact quartiles of any method (auto: see count_by_zoom)."""
    df = load(source)
    if method in ("auto", "zoom"):
        return count_by_zoom(df, column)
    return flag(df, column, exact_quartiles(df, column, method)).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("n_outliers"))


def count_by_zoom(df: DataFrame, column: str) -> DataFrame:
    """The same two numbers from the histogram that finds the quartiles: its bins are inside or outside the fences but for
    at most two, and only these bins' rows, if there are any, are counted one by one."""
    dtype = algebra.value_type(df, column)
    found, nulls = quartiles.ratio_histogram(df, column)
    total, out = sum(c for *_, c in found), 0
    if total:
        q1, q3 = quartiles.narrow(df, column, [quartiles.pick(found, r) for r in quartiles.quartile_ranks(total)])
        lo, hi = algebra.fence_values(q1, q3, dtype)
        out = sum(c for low, high, c in found if high < lo or low > hi)
        mixed = [(low, high) for low, high, _ in found if low < lo <= high or low <= hi < high]
        v = F.col(column)
        near = [v.between(histogram.whole(low), histogram.whole(high)) for low, high in mixed]
        if near:
            rows = df.where(near[0] if len(near) == 1 else near[0] | near[1])
            out += rows.agg(F.count_if(algebra.outside(v, histogram.whole(lo), histogram.whole(hi))).alias("x")).first()["x"]
    return df.sparkSession.range(1).select(F.lit(total + nulls).cast("long").alias("n"), F.lit(out).cast("long").alias("n_outliers"))


def count_from_counts(source: DataFrame | str, column: str) -> DataFrame:
    """The same from the value counts alone, rows being read once and grouped by value; n counts rows with a value."""
    df = load(source)
    dtype = algebra.value_type(df, column)
    counted = quartiles.counts(df, column)
    bounds = algebra.fences(quartiles.cdf_of_counts(counted), dtype).select(F.struct("lo", "hi").alias("f")).scalar()
    out = algebra.outside(F.col("v"), bounds.getField("lo"), bounds.getField("hi"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(out, F.col("n")).otherwise(0)), F.lit(0)).alias("n_outliers"))


def zscore_flags(source: DataFrame | str, column: str, sigmas: float = 3.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, column, is_outlier): farther than sigmas population standard deviations from the mean."""
    df = load(source)
    facts = df.agg(F.struct(F.avg(column).alias("mu"), F.stddev_pop(column).alias("sigma")).alias("f")).scalar()
    return df.select(*keep, column, (F.abs(F.col(column) - facts.getField("mu")) > sigmas * facts.getField("sigma")).alias("is_outlier"))


def textbook_flags(source: DataFrame | str, column: str, found: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, column, is_outlier) with real-valued fences 1.5 IQR beyond interpolated (or given) quartiles."""
    df = load(source)
    q = (quartiles.interpolated(df, column) if found is None else found).select(F.struct(F.col("q1").cast("double").alias("q1"), F.col("q3").cast("double").alias("q3")).alias("f")).scalar()
    q1, q3 = q.getField("q1"), q.getField("q3")
    return df.select(*keep, column, algebra.outside(F.col(column), q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)).alias("is_outlier"))
