import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tukeyframe.functions import fences as algebra
from tukeyframe.operators import flags, histogram, quartiles, validate

LONG = "k long, v long"
UNSIGNED = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DecimalType(20, 0))])


def frame(spark, values, schema=LONG):
    return spark.createDataFrame(list(enumerate(values)), schema)


def plain(values, low=-(2**63), high=2**63 - 1):
    """(q1, q3, lo, hi) by the definition, in unbounded integers."""
    s = sorted(v for v in values if v is not None)
    if not s:
        return None
    q1, q3 = s[(len(s) + 3) // 4 - 1], s[(3 * len(s) + 3) // 4 - 1]
    e = (q3 - q1) + (q3 - q1) // 2
    return q1, q3, max(low, q1 - e), min(high, q3 + e)


def expected_flags(values, **limits):
    found = plain(values, **limits)
    return [None if v is None else v < found[2] or v > found[3] for v in values]


CASES = {
    **{f"n{n}": [7 * i % 11 for i in range(n)] for n in range(1, 10)},
    "constant": [8] * 32,
    "two outliers": [0, 7, 8, 8, 9, 7, 8, 9, 8, 7, 9, 8, 7, 8, 9, 15],
    "negatives": [-5, -4, -3, -1000, 0, 1, 2, 900],
    "beyond doubles": [2**53 + 1, 2**53 + 2, 2**53 + 3, 2**53 + 5, 2**60],
    "whole range": [-(2**63), 2**63 - 1, 0, 1, 2, -(2**63), 2**63 - 1, 5],
    "clamped": [2**63 - 1 - i * i * i for i in range(30)] + [-(2**63)],
    "nulls": [None, 1, 2, None, 3, 100, 2, 2, 3, None],
    "only nulls": [None, None],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("method", ["cdf", "zoom"])
def test_exact_flags(spark, name, method):
    values = CASES[name]
    df = frame(spark, values)
    q = quartiles.METHODS[method](df, "v")
    found = tuple(algebra.fences(q, T.LongType()).first())
    assert found == (plain(values) or (None,) * 4)
    rows = flags.iqr_exact(df, "v", method, keep=("k",)).orderBy("k").collect()
    assert [r.is_outlier for r in rows] == (expected_flags(values) if plain(values) else [None] * len(values))


@pytest.mark.parametrize("method", ["cdf", "zoom"])
def test_unsigned(spark, method):
    from decimal import Decimal

    values = [2**64 - 1, 2**63, 2**63 + 5, 3, 0, 2**64 - 2, 2**63 + 6, 2**63 + 1]
    df = frame(spark, [Decimal(v) for v in values], UNSIGNED)
    rows = flags.iqr_exact(df, "v", method, keep=("k",)).orderBy("k").collect()
    assert [r.is_outlier for r in rows] == expected_flags(values, low=0, high=2**64 - 1)
    window = histogram.BinWindow(2**63, 1, 16)
    assert [int(r.q1) for r in histogram.quartiles(df, "v", window).collect()] == [2**63]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-(2**63), 2**63 - 1), st.integers(-5, 5)), min_size=1, max_size=60))
def test_zoom_finds_every_rank(spark, values):
    df = frame(spark, values)
    ranks = sorted({1, len(values), (len(values) + 1) // 2})
    assert quartiles.select_ranks(df, "v", ranks, (min(values), max(values))) == [sorted(values)[r - 1] for r in ranks]


def test_all_methods_agree(spark):
    rng = random.Random(4)
    df = frame(spark, [rng.randint(-10_000, 10_000) for _ in range(997)])
    rows = validate.quartile_crosscheck(df, "v", ("cdf", "zoom", "auto", "list", "ordered_set", "row_number")).collect()
    assert len(rows) == 6 and all(r.matches_first for r in rows)


def test_refusals(spark):
    df = spark.createDataFrame([(1, "a", 2.5)], "v long, s string, d double")
    with pytest.raises(ValueError, match="no column"):
        flags.iqr_exact(df, "missing")
    for column in ("s", "d"):
        with pytest.raises(TypeError):
            flags.iqr_exact(df, column)
    with pytest.raises(ValueError, match="doubles"):
        quartiles.ordered_set(frame(spark, [2**60]), "v")
    with pytest.raises(ValueError, match="unknown method"):
        flags.iqr_exact(df, "v", "median")


def model_flags(values, window):
    """The histogram run in plain Python."""
    count = np.zeros(window.bins, int)
    for v in values:
        count[min(window.bins - 1, max(0, (v - window.minimum) >> window.shift))] += 1
    total, running = len(values), np.cumsum(count)
    q1 = window.minimum + (int(np.argmax(4 * running >= total)) << window.shift)
    q3 = window.minimum + (int(np.argmax(4 * running >= 3 * total)) << window.shift)
    e = (q3 - q1) + (q3 - q1) // 2
    return [v < q1 - e or v > q3 + e for v in values]


VECTORS = {
    "two outliers": ([0, 7, 8, 8, 9, 7, 8, 9, 8, 7, 9, 8, 7, 8, 9, 15], histogram.BinWindow(0, 0, 16), 2),
    "none": ([8, 9] * 8, histogram.BinWindow(0, 0, 16), 0),
    "single": ([7], histogram.BinWindow(0, 0, 16), 0),
    "clamped high": ([*range(16), 20, 40, 100], histogram.BinWindow(0, 0, 16), None),
    "fence cluster, fine": ([2000] * 250 + list(range(2000, 8000, 12)) + [8000] * 250 + [15670] * 300, histogram.BinWindow(0, 2, 4096), 300),
    "fence cluster, coarse": ([2000] * 250 + list(range(2000, 8000, 12)) + [8000] * 250 + [15670] * 300, histogram.BinWindow(0, 4, 1024), 0),
    "below the window": ([-50, -3, 0, 1, 2, 3, 4, 5], histogram.BinWindow(0, 0, 8), None),
}


@pytest.mark.parametrize("name", VECTORS)
def test_histogram_flags(spark, name):
    values, window, outliers = VECTORS[name]
    rows = flags.iqr_flags(frame(spark, values), "v", window=window, keep=("k",)).orderBy("k").collect()
    assert [r.is_outlier for r in rows] == model_flags(values, window)
    assert outliers is None or sum(r.is_outlier for r in rows) == outliers
    assert histogram.check_total(frame(spark, values), "v", window) == len(values)


def test_windows():
    assert histogram.window_from_sample([]) == histogram.BinWindow(0, 0)
    assert histogram.window_from_sample([5] * 40).shift == 0
    w = histogram.window_from_sample(list(range(-1000, 1000)), 256)
    assert w.minimum % (1 << w.shift) == 0 and w.minimum <= -2500 and (w.bins << w.shift) >= 4000
    assert histogram.window_from_sample(list(range(1000)), 16, "p1p99").minimum <= 10
    with pytest.raises(ValueError):
        histogram.window_from_sample([1], 16, "other")


def test_strided_sample_and_index(spark):
    df = frame(spark, list(range(1000))).orderBy(F.rand(3)).repartition(5)
    indexed = histogram.dense_index(df, "k").collect()
    assert sorted((r.i, r.k) for r in indexed) == [(i, i) for i in range(1000)]
    assert sorted(histogram.strided_sample(df, "v", "k", size=100)) == list(range(0, 1000, 10))
    with pytest.raises(ValueError):
        histogram.strided_sample(df, "v", size=100)
    first = histogram.grouped_sample(df, "v", F.col("k"), 100, groups=4, rows=5)
    assert sorted(first) == [g * 100 + i for g in (0, 3, 6, 9) for i in range(5)]
    assert len(histogram.grouped_sample(df, "v", F.col("k"), 100, groups=4, rows=5, stride=True)) == 20


def test_half_bins_equal_values(spark):
    window, (lo, hi) = histogram.BinWindow(-64, 3, 64), (-24, 40)
    rows = frame(spark, list(range(-100, 200))).select("v", histogram.half_bin_outside(F.col("v"), lo, hi, window).alias("o")).collect()
    assert all(r.o == (r.v < lo or r.v > hi) for r in rows)


def test_counts_agree(spark):
    rng = random.Random(7)
    df = frame(spark, [int(rng.gauss(0, 1000)) ** 3 for _ in range(500)] + [None])
    a, b = flags.count_outliers(df, "v").first(), flags.count_from_counts(df, "v").first()
    assert a.n_outliers == b.n_outliers and (a.n, b.n) == (501, 500)


def test_validators(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 8, 100, 100]
    df = frame(spark, values)
    exact = flags.iqr_exact(df, "v", "cdf", keep=("k",))
    none = df.withColumn("is_outlier", F.lit(False))
    row = validate.agreement(exact, none, "k").first()
    assert (row.n, row.disagree, row.net_diff, row.ppm) == (10, 2, 2, 200_000.0)
    assert validate.inconsistent_values(exact.unionByName(none), "v").first().value == 100
    detail = validate.disagreeing_values(none, "v", algebra.fences(quartiles.cdf(df, "v"), T.LongType())).collect()
    assert [(r.value, r.n_rows, r.exact_flag) for r in detail] == [(100, 2, True)]
    eff = validate.effective_fences(exact, "v").first()
    assert (eff.n_out, eff.lo_eff, eff.hi_eff) == (2, 1, 8)
    assert validate.digest(df, "v").first() == validate.digest(df.orderBy(F.desc("k")), "v").first()
