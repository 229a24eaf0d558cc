"""The queries by name, each over whole tables of a scale's folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tukeyframe.functions import fences as algebra
from tukeyframe.functions import profile
from tukeyframe.operators import flags, histogram, mask, quartiles, validate
from tukeyframe.plans import sql as surface
from tukeyframe.sources import datagen, parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(name: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet.scan(spark, f"{sf_dir}/{name}.parquet")


def hundredths(name: str) -> str:
    return f"CAST(round({name} * 100) AS BIGINT)"


#: Integer columns (v) by name: table, unique key (k) or None, value.
COLUMNS = {
    "events": ("events", "event_id", hundredths("value")),
    "documents": ("documents", "doc_id", "n_chars"),
    "orders": ("orders", "o_orderkey", hundredths("o_totalprice")),
    "customer": ("customer", "c_custkey", hundredths("c_acctbal")),
    "part": ("part", "p_partkey", hundredths("p_retailprice")),
    "quantity": ("lineitem", None, "CAST(l_quantity AS BIGINT)"),
    "extprice": ("lineitem", None, hundredths("l_extendedprice")),
}


def values(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, key, value = COLUMNS[name]
    return table(spark, sf_dir, source).select(*([F.col(key).alias("k")] if key else []), F.expr(value).alias("v"))


def on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(values(spark, sf_dir, name))


def window_row(df: DataFrame, window: histogram.BinWindow) -> DataFrame:
    """Window, quartiles, fences and outliers of a histogram run as one row."""
    found = algebra.fences(histogram.quartiles(df, "v", window), df.schema["v"].dataType)
    f = found.select(F.struct("q1", "q3", "lo", "hi").alias("f")).scalar()
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(algebra.outside(F.col("v"), f.getField("lo"), f.getField("hi"))).alias("n_out"))
    return out.select(F.lit(window.shift).cast("long").alias("sh"), F.lit(window.minimum).cast("long").alias("bmin"), *(f.getField(x).alias(x) for x in ("q1", "q3", "lo", "hi")), "n", "n_out")


EXPLICIT = histogram.BinWindow(0, 4, 1024)


# exact and histogram flags of every row, by key
for _name in ("events", "documents", "orders", "customer", "part"):
    QUERIES[f"iqr_flags_{_name}"] = on(_name, lambda df: flags.iqr_flags(df, "v", key="k", keep=("k",)))
    QUERIES[f"iqr_exact_count_{_name}"] = on(_name, lambda df: flags.count_outliers(df, "v"))
for _name in ("events", "documents", "customer"):
    QUERIES[f"iqr_flags_only_{_name}"] = on(_name, lambda df: flags.iqr_flags_only(df, "v", key="k", keep=("k",)))
    QUERIES[f"iqr_cpu_zoom_{_name}"] = on(_name, lambda df: flags.iqr_cpu_flags(df, "v", keep=("k",)))
    QUERIES[f"iqr_cpu_groupby_{_name}"] = on(_name, lambda df: flags.iqr_cpu_flags_groupby(df, "v", keep=("k",)))
    for _bins in (256, 1024, 4096):
        QUERIES[f"hist_window_auto_{_bins}_{_name}"] = on(_name, lambda df, b=_bins: window_row(df, histogram.auto_window(df, "v", "k", bins=b)))
for _name in ("quantity", "extprice"):
    QUERIES[f"iqr_exact_count_{_name}"] = on(_name, lambda df: flags.count_outliers(df, "v"))
    QUERIES[f"count_zoom_{_name}"] = on(_name, lambda df: flags.count_outliers(df, "v", "zoom"))
for _name in ("events", "documents", "extprice"):
    QUERIES[f"count_histsum_{_name}"] = on(_name, lambda df: flags.count_from_counts(df, "v"))
for _method in ("cdf", "zoom", "list", "ordered_set", "row_number", "auto"):
    QUERIES[f"quartiles_{_method}"] = on("events", lambda df, m=_method: quartiles.METHODS[m](df, "v"))
    QUERIES[f"mask_{_method}"] = on("events", lambda df, m=_method: flags.iqr_exact(df, "v", m, keep=("k",)))
QUERIES |= {
    "quartiles_approx": on("events", lambda df: validate.rank_error(df, "v", quartiles.approximate(df, "v"))),
    "count_list_events": on("events", lambda df: flags.count_outliers(df, "v", "list")),
    "quartiles_interpolated": on("events", lambda df: quartiles.interpolated(df, "v")),
    "quartile_crosscheck": on("events", lambda df: validate.quartile_crosscheck(df, "v")),
    "fences_floor_vs_true": on("events", lambda df: validate.floor_against_true(df, "v")),
    "hist_window_p1p99": on("events", lambda df: window_row(df, histogram.auto_window(df, "v", "k", bins=1024, rule="p1p99"))),
    "hist_window_explicit": on("events", lambda df: window_row(df, EXPLICIT)),
    "hist_window_explicit_extprice": on("extprice", lambda df: window_row(df, histogram.BinWindow(0, 12, 4096))),
    "hist_bins": on("events", lambda df: histogram.bins(df, "v", EXPLICIT).withColumn("bin", F.col("bin").cast("long"))),
    "hist_flags": on("events", lambda df: flags.iqr_flags(df, "v", window=EXPLICIT, keep=("k",))),
    "hist_vs_exact": on("events", lambda df: validate.exact_against_histogram(df, "v", EXPLICIT)),
    "cpu_vs_builtin": on("events", lambda df: validate.against_builtin(df, "v")),
    "zscore_flags": on("events", lambda df: flags.zscore_flags(df, "v", keep=("k",))),
    "textbook_iqr_cont": on("events", lambda df: flags.textbook_flags(df, "v", keep=("k",))),
    "textbook_hist256": on("events", lambda df: validate.textbook_histogram(df, "v")),
    "multiset_digest": on("events", lambda df: validate.digest(df, "v").select("n", F.col("total").cast("long").alias("total"))),
    "multiset_hash": on("events", lambda df: validate.digest(df, "v").select("n", *(F.col(c).cast("string").alias(c) for c in ("total", "hash_sum")))),
    "shape_stats": on("events", lambda df: validate.shape(df, "v")),
}


@query("rowwise_agreement")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = values(spark, sf_dir, "events")
    return validate.agreement(flags.iqr_flags(df, "v", window=EXPLICIT, keep=("k",)), flags.iqr_exact(df, "v", "cdf", keep=("k",)), "k")


@query("flag_consistency")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with more than one flag (none), and how many values were looked at."""
    flagged = flags.iqr_flags(values(spark, sf_dir, "events"), "v", window=EXPLICIT)
    bad = validate.inconsistent_values(flagged, "v").agg(F.count(F.lit(1)).alias("n")).scalar()
    return flagged.agg(F.count_distinct("v").alias("n_values")).withColumn("n_inconsistent", bad)


@query("disagree_detail_top20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = values(spark, sf_dir, "events")
    coarse = histogram.BinWindow(0, 9, 64)
    exact = algebra.fences(quartiles.cdf(df, "v"), df.schema["v"].dataType)
    return validate.disagreeing_values(flags.iqr_flags(df, "v", window=coarse), "v", exact)


@query("effective_fences")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.effective_fences(flags.iqr_flags(values(spark, sf_dir, "events"), "v", window=EXPLICIT), "v")


@query("three_way")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers by the histogram, by cumulative counts and by the built-in percentiles, and rows on which pairs differ."""
    df = values(spark, sf_dir, "events")
    hist, mine = flags.iqr_flags(df, "v", window=EXPLICIT, keep=("k",)), flags.iqr_exact(df, "v", "cdf", keep=("k",))
    builtin = flags.iqr_exact(df, "v", "ordered_set", keep=("k",))
    rows = hist.select("k", F.col("is_outlier").alias("h")).join(mine.select("k", F.col("is_outlier").alias("c")), "k").join(builtin.select("k", F.col("is_outlier").alias("b")), "k")
    return rows.agg(F.count_if("h").alias("n_hist"), F.count_if("c").alias("n_cdf"), F.count_if("b").alias("n_builtin"), F.count_if(F.col("h") != F.col("c")).alias("hist_vs_cdf"), F.count_if(F.col("c") != F.col("b")).alias("cdf_vs_builtin"))


@query("methods_compare")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = values(spark, sf_dir, "events")
    ways = {"zscore": flags.zscore_flags(df, "v"), "iqr_cont": flags.textbook_flags(df, "v"), "iqr_cdf": flags.iqr_exact(df, "v", "cdf"), "iqr_zoom": flags.iqr_exact(df, "v", "zoom")}
    rows = None
    for name, made in ways.items():
        one = made.agg(F.count_if("is_outlier").alias("n_outliers")).select(F.lit(name).alias("method"), "n_outliers")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("positional_zip")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two projections of one file side by side by row position."""
    rows = parquet.with_position(table(spark, sf_dir, "events"), "event_id", "user_id")
    zipped = parquet.positional_zip(rows.select("position", "event_id"), rows.select("position", "user_id"))
    return zipped.groupBy("event_id").agg(F.max("user_id").alias("user_id"))


@query("rowid_join_check")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags joined back to values by row position: net difference and per-row mismatches."""
    rows = parquet.with_position(table(spark, sf_dir, "events"), "value").select("position", F.expr(COLUMNS["events"][2]).alias("v"))
    flagged = flags.iqr_exact(rows, "v", "cdf", keep=("position",)).drop("v")
    return validate.agreement(flagged, flags.iqr_exact(rows, "v", "zoom", keep=("position",)), "position")


@query("mask_approximate")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by approximate quartiles against exact ones: rows, and whether at most two in a thousand differ."""
    df = values(spark, sf_dir, "events")
    both = validate.agreement(flags.iqr_exact(df, "v", "approximate", keep=("k",)), flags.iqr_exact(df, "v", "zoom", keep=("k",)), "k")
    return both.select("n", (F.col("ppm") <= 2000).alias("within"))


@query("run_diagnostics")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = values(spark, sf_dir, "events").withColumn("v", F.when(F.col("k") % 3 != 0, F.col("v")))
    return histogram.diagnostics(df, "v", EXPLICIT)


def _spanning(stride: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flags.iqr_flags(f"{sf_dir}/documents.parquet", "n_chars", groups=16, group_rows=20, group_sample=5, stride=stride)

    return run


QUERIES |= {"iqr_flags_spanning_first": _spanning(False), "iqr_flags_spanning_strided": _spanning(True)}


@query("ctas_three_way")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with the whole mask by each of three arms, and what is in it."""
    df = values(spark, sf_dir, "events")
    arms = {"histogram": lambda: flags.iqr_flags(df, "v", window=EXPLICIT, keep=("k",)), "zoom": lambda: flags.iqr_cpu_flags(df, "v", keep=("k",)), "groupby": lambda: flags.iqr_cpu_flags_groupby(df, "v", keep=("k",))}
    return spark.createDataFrame([(arm, *validate.as_table(make())) for arm, make in arms.items()], "arm string, n long, n_outliers long")


@query("half_bin_index_equiv")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags from bin numbers alone against flags from values, for fences at bin edges."""
    lo, hi = 16 * 5, 16 * 700
    v = F.col("v")
    out = algebra.outside(v, F.lit(lo), F.lit(hi))
    by_bin = histogram.half_bin_outside(v, lo, hi, EXPLICIT)
    return values(spark, sf_dir, "events").agg(F.count_if(out).alias("n_value"), F.count_if(by_bin).alias("n_index"), F.count_if(out != by_bin).alias("n_differ"))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = flags.iqr_exact(values(spark, sf_dir, "events"), "v", "cdf", keep=("k",))
    return histogram.dense_index(df, "k")


@query("mask_pack")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.pack(_indexed(spark, sf_dir), "i", "is_outlier")


@query("mask_unpack")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _indexed(spark, sf_dir)
    return mask.unpack(mask.pack(rows, "i", "is_outlier"), rows.count())


@query("mask_ragged_repack")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of 1001 rows, each padded to whole bytes, made one mask."""
    rows = _indexed(spark, sf_dir).withColumn("part", F.floor(F.col("i") / 1001))
    sized = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    bits = rows.select("part", (F.col("i") % 1001).alias("own"), "is_outlier")
    value = F.sum(F.when(F.col("is_outlier"), F.call_function("shiftleft", F.lit(1), (F.col("own") % 8).cast("int"))).otherwise(0)).cast("int")
    padded = bits.groupBy("part", F.call_function("shiftright", "own", F.lit(3)).alias("byte_no")).agg(value.alias("byte")).join(sized, "part")
    return mask.repack(padded)


@query("mask_export")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.blocks(_indexed(spark, sf_dir), "i", "is_outlier").select("block", F.lower(F.hex("data")).alias("data"))


# the scan
@query("scan_project")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("scan_filter")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice"], "l_quantity > 45 AND l_discount <= 0.02")


@query("scan_count_only")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("scan_min_max")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.column_statistics(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("scan_ordered")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the file, in its order."""
    return parquet.ordered(table(spark, sf_dir, "events")).select("row_index", "event_id")


@query("scan_strings")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.scan(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_name", "c_mktsegment"], "c_mktsegment = 'BUILDING'")


@query("scan_multi_file")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.scan(spark, [f"{sf_dir}/nation.parquet", f"{sf_dir}/nation.parquet"]).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("scan_pruned")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a file of many row groups in the order of the filtered column: the reader skips all but a few of them."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pruned-{uuid.uuid4().hex}"
    parquet.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").coalesce(1).sortWithinPartitions("o_orderkey"), folder, row_group_bytes=1 << 14)
    return parquet.scan(spark, folder, where="o_orderkey BETWEEN 1000 AND 1200")


@query("scan_row_groups")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet.row_groups(spark, f"{sf_dir}/orders.parquet").groupBy("path_in_schema").agg(F.sum("num_values").cast("long").alias("n_values"), F.max("type").alias("type"))


# counters
LANES = "(0, 1000, 10, 200, 90, 900, 50, 30, 20), (1, 2000, 0, 0, 0, 1900, 100, 0, 0), (2, 0, 0, 0, 0, 0, 0, 0, 0), (3, 500, 500, 250, 750, 450, 0, 450, 100)"


def _lanes(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {LANES} t(lane, {', '.join(profile.COUNTERS)})").select("lane", *(F.col(c).cast("long") for c in profile.COUNTERS))


QUERIES |= {
    "profile_throughput": lambda spark, sf_dir: profile.throughput(_lanes(spark)),
    "lane_shares": lambda spark, sf_dir: profile.shares(_lanes(spark)),
    "lane_balance": lambda spark, sf_dir: profile.balance(_lanes(spark)),
    "profile_total": lambda spark, sf_dir: profile.total_counters(_lanes(spark)),
}


@query("stage_profile")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.throughput(profile.stage_counters(spark))


# generators
QUERIES |= {
    "gen_planted": lambda spark, sf_dir: flags.count_outliers(datagen.planted(spark, 100_000), "v"),
    "gen_uniform": lambda spark, sf_dir: flags.count_outliers(datagen.uniform(spark, 200_000, every=1000), "v"),
    "gen_drift": lambda spark, sf_dir: flags.count_outliers(datagen.drifting(spark, 200_000, every=1000), "v"),
    "gen_cardinality": lambda spark, sf_dir: flags.count_outliers(datagen.cardinality(spark, 100_000, 1000), "v"),
    "gen_cycle": lambda spark, sf_dir: flags.iqr_exact(datagen.cycle(spark, 8192), "v", "cdf", keep=("i",)),
    "gen_skew_measure": lambda spark, sf_dir: validate.skew_measure(datagen.skewed(spark, 50_000, 3.0), "v", 50_000_000),
    "gen_skew": lambda spark, sf_dir: validate.shape(datagen.skewed(spark, 50_000, 3.0), "v").select("n", "n_distinct", "median"),
}


# edge cases, each beside its non-empty twin above
QUERIES |= {
    "iqr_signed_negatives": on("customer", lambda df: flags.iqr_exact(df, "v", "zoom", keep=("k",))),
    "iqr_empty": on("events", lambda df: flags.iqr_exact(df.where("v < -1000000"), "v", "cdf", keep=("k",))),
    "iqr_constant": on("events", lambda df: flags.iqr_exact(df.withColumn("v", F.lit(7).cast("long")), "v", "cdf", keep=("k",))),
    "iqr_with_nulls": on("events", lambda df: flags.iqr_exact(df.withColumn("v", F.when(F.col("k") % 3 != 0, F.col("v"))), "v", "cdf", keep=("k",))),
    "iqr_unsigned": on("events", lambda df: flags.iqr_exact(df.withColumn("v", (F.col("v").cast("decimal(38,0)") * 376_000_000_000_000).cast("decimal(20,0)")), "v", "zoom", keep=("k",))),
    "iqr_extremes": on("events", lambda df: flags.iqr_exact(df.withColumn("v", F.when(F.col("k") % 2 == 0, F.lit(2**63 - 1) - F.col("v")).otherwise(F.lit(-(2**63)) + F.col("v"))), "v", "zoom", keep=("k",))),
}


# the outlier functions within SQL, and relational operators over a scan
@query("sql_table_function")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    return surface.sql(spark, f"SELECT count(*) AS n, count(*) FILTER (WHERE f) AS n_out, min(v) FILTER (WHERE NOT f) AS lo_eff, max(v) FILTER (WHERE NOT f) AS hi_eff FROM iqr_flags('{path}', 'n_chars') t(v, f)")


@query("sql_flags_groupby")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.sql(spark, f"SELECT is_outlier, count(*) AS n FROM iqr_cpu_flags_groupby('{sf_dir}/documents.parquet', 'n_chars') GROUP BY is_outlier")


@query("compose_join_agg")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flags.iqr_exact(values(spark, sf_dir, "orders").withColumn("v", F.col("v")), "v", "cdf", keep=("k",))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    return flagged.join(orders, "k").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_outlier").alias("n_out"), F.sum("v").alias("total"))


@query("compose_window")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(hundredths("value")).alias("v"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return rows.select("event_id", F.sum("v").over(w).alias("running"), F.row_number().over(w).cast("long").alias("rn"))


@query("compose_topk")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, sf_dir, "events").orderBy(F.desc("v"), "k").limit(20)


@query("compose_union_all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = values(spark, sf_dir, "events").select("v").union(values(spark, sf_dir, "documents").select("v"))
    return flags.count_outliers(both, "v")


@query("compose_select_distinct")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("compose_distinct")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.agg(F.count_distinct("l_suppkey").alias("n_suppliers"), F.bool_or(F.col("l_quantity") > 49).alias("any_large"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("return_flags"))


# scalar functions that the analysis queries use
@query("scalar_math")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return values(spark, sf_dir, "customer").select(
        "k",
        F.call_function("div", v, F.lit(1000)).alias("quotient"),
        (v % 1000).alias("remainder"),
        F.call_function("shiftright", v, F.lit(4)).alias("right_shift"),
        F.call_function("shiftleft", v, F.lit(3)).alias("left_shift"),
        F.greatest(v, F.lit(0)).alias("at_least_0"),
        F.least(v, F.lit(500_000)).alias("at_most"),
        F.ceil(v / 7).cast("long").alias("up"),
        F.floor(v / 7).cast("long").alias("down"),
        F.nullif(v % 5, F.lit(0)).alias("not_0"),
        F.round(F.log2(F.abs(v) + 1.0), 6).alias("bits"),
    )


@query("case_and_text")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_totalprice") > 400_000, "large").when(F.col("o_totalprice") > 100_000, "middle").otherwise("small")
    return rows.select("o_orderkey", kind.alias("kind"), F.format_string("%08d-%s", "o_orderkey", "o_orderstatus").alias("label"), F.concat("o_orderpriority", F.lit("/"), "o_orderstatus").alias("both"))


@query("list_index")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = quartiles.listed(values(spark, sf_dir, "orders"), "v").select(F.array("q1", "q3").alias("q"))
    return both.select(F.element_at("q", 1).alias("first"), F.element_at("q", 2).alias("second"), F.size("q").cast("long").alias("n"))


@query("having_distinct_flags")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events have both flags."""
    rows = table(spark, sf_dir, "events").select("user_id", F.expr(hundredths("value")).alias("v"))
    flagged = flags.iqr_exact(rows, "v", "cdf", keep=("user_id",))
    return flagged.groupBy("user_id").agg(F.count_distinct("is_outlier").alias("n_flags"), F.bool_or("is_outlier").alias("any_outlier")).where("n_flags > 1")


@query("approx_distinct")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number, and whether the approximate one is within 15 percent (three times its stated deviation)."""
    found = values(spark, sf_dir, "extprice").agg(F.count_distinct("v").alias("n_distinct"), F.approx_count_distinct("v").alias("a"))
    return found.select("n_distinct", (F.abs(F.col("a") - F.col("n_distinct")) <= 0.15 * F.col("n_distinct")).alias("within"))


@query("session_variable")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold kept in a session variable and used by a later statement."""
    table(spark, sf_dir, "events").createOrReplaceTempView("session_events")
    spark.sql("DECLARE OR REPLACE VARIABLE threshold BIGINT")
    spark.sql(f"SET VARIABLE threshold = (SELECT max({hundredths('value')}) div 2 FROM session_events)")
    return spark.sql(f"SELECT count(*) AS n FROM session_events WHERE {hundredths('value')} > threshold")
