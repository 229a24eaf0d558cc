"""Checks of one way of flagging against another: per row, per value, by fences and in stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tukeyframe.functions import fences as algebra
from tukeyframe.operators import histogram, quartiles
from tukeyframe.sources import parquet


def agreement(left: DataFrame, right: DataFrame, key: str, flag: str = "is_outlier") -> DataFrame:
    """Flags of two runs joined by a row key: rows, agree, disagree, parts per million, and the counts' net difference."""
    pair = left.select(key, F.col(flag).alias("a")).join(right.select(key, F.col(flag).alias("b")), key)
    same = F.col("a").eqNullSafe(F.col("b"))
    sums = pair.agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree"), (F.count_if("a") - F.count_if("b")).alias("net_diff"))
    return sums.withColumn("ppm", F.when(F.col("n") > 0, F.col("disagree") * F.lit(1e6) / F.col("n")))


def inconsistent_values(flagged: DataFrame, column: str, flag: str = "is_outlier") -> DataFrame:
    """Values with more than one flag; there should be none, as a flag is a function of the value."""
    per = flagged.groupBy(F.col(column).alias("value")).agg(F.count_distinct(flag).alias("n_flags"), F.count(F.lit(1)).alias("n_rows"))
    return per.where("n_flags > 1")


def disagreeing_values(flagged: DataFrame, column: str, exact: DataFrame, limit: int = 20, flag: str = "is_outlier") -> DataFrame:
    """The values whose flag differs from the exact one, by rows and then value; exact is one row (lo, hi)."""
    per = flagged.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or(flag).alias("flag"))
    bounds = exact.select(F.struct("lo", "hi").alias("f")).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    rows = per.select("value", "n_rows", "flag", algebra.outside(F.col("value"), lo, hi).alias("exact_flag"), lo.alias("exact_lo"), hi.alias("exact_hi"))
    return rows.where(F.col("flag") != F.col("exact_flag")).orderBy(F.desc("n_rows"), "value").limit(limit)


def effective_fences(flagged: DataFrame, column: str, flag: str = "is_outlier") -> DataFrame:
    """(n, n_out, lo_eff, hi_eff): the least and greatest value that isn't flagged."""
    inside = F.when(~F.col(flag), F.col(column))
    return flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_out"), F.min(inside).alias("lo_eff"), F.max(inside).alias("hi_eff"))


def quartile_crosscheck(df: DataFrame, column: str, methods: tuple[str, ...] = ("cdf", "zoom", "list", "ordered_set", "row_number")) -> DataFrame:
    """(method, q1, q3, matches_first), a row a method."""
    rows = None
    for name in methods:
        one = quartiles.METHODS[name](df, column).select(F.lit(name).alias("method"), "q1", "q3")
        rows = one if rows is None else rows.unionByName(one)
    first = quartiles.METHODS[methods[0]](df, column).select(F.struct("q1", "q3").alias("f")).scalar()
    same = F.col("q1").eqNullSafe(first.getField("q1")) & F.col("q3").eqNullSafe(first.getField("q3"))
    return rows.withColumn("matches_first", same)


def against_builtin(df: DataFrame, column: str) -> DataFrame:
    """Cumulative counts against the built-in percentiles: both quartile pairs, whether they match, and flags that differ."""
    dtype = algebra.value_type(df, column)
    mine = algebra.fences(quartiles.cdf(df, column), dtype).select(F.struct("q1", "q3", "lo", "hi").alias("f")).scalar()
    theirs = algebra.fences(quartiles.ordered_set(df, column), dtype).select(F.struct("q1", "q3", "lo", "hi").alias("f")).scalar()
    out = lambda f: algebra.outside(F.col(column), f.getField("lo"), f.getField("hi"))
    differ = df.agg(F.count_if(out(mine)).alias("n_cdf"), F.count_if(out(theirs)).alias("n_builtin"), F.count_if(out(mine) != out(theirs)).alias("n_differ"))
    same = (mine.getField("q1") == theirs.getField("q1")) & (mine.getField("q3") == theirs.getField("q3"))
    return differ.select(mine.getField("q1").alias("cdf_q1"), mine.getField("q3").alias("cdf_q3"), theirs.getField("q1").alias("builtin_q1"), theirs.getField("q3").alias("builtin_q3"), same.alias("quartiles_match"), "n_cdf", "n_builtin", "n_differ")


def floor_against_true(df: DataFrame, column: str) -> DataFrame:
    """Outliers under integer fences (floor of 1.5 IQR) and under real ones, from the same exact quartiles."""
    dtype = algebra.value_type(df, column)
    f = algebra.fences(quartiles.cdf(df, column), dtype).select(F.struct("q1", "q3", "lo", "hi").alias("f")).scalar()
    lo, hi, q1, q3 = (f.getField(x) for x in ("lo", "hi", "q1", "q3"))
    v, d = F.col(column), (q3 - q1).cast("double")
    counted = df.agg(F.count_if(algebra.outside(v, lo, hi)).alias("n_floor"), F.count_if(algebra.outside(v.cast("double"), q1 - 1.5 * d, q3 + 1.5 * d)).alias("n_true"))
    return counted.select(q1.alias("q1"), q3.alias("q3"), lo.alias("lo_floor"), hi.alias("hi_floor"), "n_floor", "n_true")


def exact_against_histogram(df: DataFrame, column: str, window: histogram.BinWindow) -> DataFrame:
    """Both pairs of fences, both outlier counts, and the rows on which they disagree."""
    dtype = algebra.value_type(df, column)
    exact = algebra.fences(quartiles.cdf(df, column), dtype).select(F.struct("lo", "hi").alias("f")).scalar()
    binned = algebra.fences(histogram.quartiles(df, column, window), dtype).select(F.struct("lo", "hi").alias("f")).scalar()
    out = lambda f: algebra.outside(F.col(column), f.getField("lo"), f.getField("hi"))
    counted = df.agg(F.count_if(out(exact)).alias("n_exact"), F.count_if(out(binned)).alias("n_hist"), F.count_if(out(exact) != out(binned)).alias("n_disagree"))
    return counted.select(*(f.getField(x).alias(f"{k}_{x}") for k, f in (("exact", exact), ("hist", binned)) for x in ("lo", "hi")), "n_exact", "n_hist", "n_disagree")


def digest(df: DataFrame, column: str) -> DataFrame:
    """(n, total, hash_sum): equal for equal multisets of values, whatever their order. The hash is of the value as text."""
    v = F.col(column)
    hashed = F.conv(F.substring(F.md5(v.cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(column).alias("n"), F.sum(v.cast("decimal(38,0)")).alias("total"), F.sum(hashed).alias("hash_sum"))


def rank_error(df: DataFrame, column: str, found: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """(n, q1_within, q3_within): whether approximate quartiles (q1, q3) are within the ranks that their accuracy allows."""
    q = found.select(F.struct("q1", "q3").alias("f")).scalar()
    v, n = F.col(column), F.count(column)
    facts = df.agg(n.alias("n"), *(f(c).alias(f"{k}_{name}") for k in ("q1", "q3") for name, f, c in (("below", F.count_if, v < q.getField(k)), ("upto", F.count_if, v <= q.getField(k)))))
    slack = F.ceil(F.col("n") / accuracy) + 1
    within = lambda k, share: ((F.col(f"{k}_below") <= share * F.col("n") + slack) & (F.col(f"{k}_upto") >= share * F.col("n") - slack)).alias(f"{k}_within")
    return facts.select("n", within("q1", 0.25), within("q3", 0.75))


def skew_measure(df: DataFrame, column: str, planted: int) -> DataFrame:
    """How skewed a generated column is: skewness, kurtosis and mean-to-median ratio of the rows below the planted values, the
    exact upper fence, and the outliers that are natural (not planted); planted values are from there on."""
    dtype = algebra.value_type(df, column)
    f = algebra.fences(quartiles.zoom(df, column), dtype).select(F.struct("lo", "hi").alias("f")).scalar()
    v, own = F.col(column), F.col(column) < planted
    only = F.when(own, F.col(column))
    median = F.median(only)
    found = df.agg(
        F.count(column).alias("n"),
        F.round(F.skewness(only), 9).alias("skew"),
        F.round(F.kurtosis(only), 9).alias("kurt"),
        F.round(F.avg(only) / F.nullif(median, F.lit(0.0)), 9).alias("mean_to_median"),
        F.count_if(algebra.outside(v, f.getField("lo"), f.getField("hi"))).alias("n_outliers"),
        F.count_if(own & algebra.outside(v, f.getField("lo"), f.getField("hi"))).alias("n_natural"),
    )
    return found.withColumn("hi", f.getField("hi"))


def shape(df: DataFrame, column: str) -> DataFrame:
    """Population skewness and kurtosis, median, mean-to-median ratio and the number of distinct values."""
    v = F.col(column)
    return df.agg(
        F.count(column).alias("n"),
        F.round(F.skewness(v), 9).alias("skew"),
        F.round(F.kurtosis(v), 9).alias("kurt"),
        F.median(v).alias("median"),
        (F.avg(v) / F.nullif(F.median(v), F.lit(0.0))).alias("mean_to_median"),
        F.count_distinct(v).alias("n_distinct"),
    )


def textbook_histogram(df: DataFrame, column: str, bins: int = 256) -> DataFrame:
    """(q1, q3, n_outliers): quartiles from real-valued bins between the interpolated 1st and 99th percentiles."""
    w = df.agg(F.struct(F.percentile(column, 0.01).alias("lo"), F.percentile(column, 0.99).alias("hi")).alias("w")).scalar()
    lo, width = w.getField("lo"), F.greatest(F.lit(1.0), (w.getField("hi") - w.getField("lo")) / bins)
    number = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(column) - lo) / width).cast("long")))
    counted = df.where(F.col(column).isNotNull()).groupBy(number.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    edges = quartiles.cdf_of_counts(counted).select((lo + F.col("q1") * width).alias("q1"), (lo + F.col("q3") * width).alias("q3"))
    q = edges.select(F.struct("q1", "q3").alias("f")).scalar()
    q1, q3 = q.getField("q1"), q.getField("q3")
    out = algebra.outside(F.col(column), q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return df.agg(F.count_if(out).alias("n_outliers")).select(q1.alias("q1"), q3.alias("q3"), "n_outliers")


def as_table(flagged: DataFrame, flag: str = "is_outlier") -> tuple[int, int]:
    """Creates a table of the whole mask, counts its rows and outliers, and drops it."""
    spark, name = flagged.sparkSession, f"mask_{uuid.uuid4().hex}"
    parquet.create_table(flagged, name)
    found = spark.table(name).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("o")).first()
    spark.sql(f"DROP TABLE {name}")
    return found["n"], found["o"]
