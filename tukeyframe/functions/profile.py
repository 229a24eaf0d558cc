"""Counter tables: throughput and busy shares by lane, and counters of Spark's own stages in the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDES = ("in", "out")
STATES = ("handshakes", "starved", "stalled", "idle")
COUNTERS = tuple(f"{side}_{state}" for side in SIDES for state in STATES)
#: Bytes moved by one handshake, and nanoseconds of a cycle: fixed values of the throughput formula.
BYTES, CYCLE_NS = 64, 4


def _cycles(side: str, idle: bool = True) -> Column:
    total = F.col(f"{side}_handshakes") + F.col(f"{side}_starved") + F.col(f"{side}_stalled")
    return total + F.col(f"{side}_idle") if idle else total


def _rate(side: str, idle: bool) -> Column:
    """GB/s; 0 without cycles. Bytes a nanosecond are GB/s."""
    cycles = _cycles(side, idle)
    return F.when(cycles > 0, F.col(f"{side}_handshakes") * F.lit(float(BYTES)) / (cycles * F.lit(float(CYCLE_NS)))).otherwise(F.lit(0.0))


def throughput(counters: DataFrame) -> DataFrame:
    """counters (lane and COUNTERS) with GB/s on both sides, over all cycles and over those that weren't idle."""
    return counters.withColumns({f"{side}_gbps{suffix}": _rate(side, idle) for side in SIDES for suffix, idle in (("", True), ("_excl_idle", False))})


def shares(counters: DataFrame) -> DataFrame:
    """Per lane: milliseconds, and percentages of the input cycles that were busy, starved, stalled and idle; and of stalled output."""
    total = F.nullif(_cycles("in"), F.lit(0))
    percent = lambda c, t: F.round(F.lit(100.0) * c / t, 1)
    out = F.nullif(_cycles("out", False), F.lit(0))
    return counters.select(
        "lane",
        F.round(_cycles("in") / F.lit(1e6 / CYCLE_NS), 2).alias("lane_ms"),
        *(percent(F.col(f"in_{s}"), total).alias(n) for s, n in (("handshakes", "busy_pct"), ("starved", "starved_pct"), ("stalled", "stalled_pct"), ("idle", "idle_pct"))),
        percent(F.col("out_stalled"), out).alias("out_stalled_pct"),
    )


def balance(counters: DataFrame) -> DataFrame:
    """The shortest and longest lane in milliseconds, their ratio, and the busy time of all."""
    per_ms = F.lit(1e6 / CYCLE_NS)
    sums = counters.agg(F.min(_cycles("in")).alias("least"), F.max(_cycles("in")).alias("most"), F.sum("in_handshakes").alias("busy"))
    return sums.select(
        F.round(F.col("least") / per_ms, 2).alias("min_lane_ms"),
        F.round(F.col("most") / per_ms, 2).alias("max_lane_ms"),
        F.round(F.col("most") / F.nullif(F.col("least"), F.lit(0)), 2).alias("imbalance_x"),
        F.round(F.col("busy") / per_ms, 2).alias("total_busy_ms"),
    )


def stage_counters(spark: SparkSession) -> DataFrame:
    """One lane a finished Spark stage that is still in the status store, in the profilers' columns.

    Units are records for handshakes, and milliseconds for waits: fetching input starves, writing shuffles or collecting
    garbage stalls, and idle is the task time that ran no code.
    """
    context = spark.sparkContext
    no_quantiles = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, no_quantiles, context._jvm.java.util.ArrayList())
    rows = []
    for i in range(stages.size()):
        s = stages.apply(i)
        run, cpu = s.executorRunTime(), s.executorCpuTime() // 1_000_000
        rows.append((s.stageId(), s.inputRecords() + s.shuffleReadRecords(), s.shuffleFetchWaitTime(), s.jvmGcTime(), max(0, run - cpu), s.outputRecords() + s.shuffleWriteRecords(), 0, s.shuffleWriteTime() // 1_000_000, max(0, run - cpu)))
    return spark.createDataFrame(rows, "lane int, " + ", ".join(f"{c} long" for c in COUNTERS))


def total_counters(counters: DataFrame) -> DataFrame:
    """All lanes as one row of the eight counters."""
    return counters.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))
