"""Measuring: medians of repeated runs, their spread, phases, and sweeps over generated columns."""

from __future__ import annotations

import csv
import statistics
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tukeyframe.operators import flags


def consume(df: DataFrame) -> None:
    """Computes every column of every row and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def medians(arms: dict[str, Callable[[], DataFrame]], repeats: int = 5, warm: int = 1) -> dict[str, dict[str, float]]:
    """Median seconds of each arm, their spread (greatest less least over median), and the ratio to the first arm."""
    out: dict[str, dict[str, float]] = {}
    for name, make in arms.items():
        took = []
        for k in range(warm + repeats):
            began = time.perf_counter()
            consume(make())
            took += [time.perf_counter() - began] if k >= warm else []
        mid = statistics.median(took)
        out[name] = {"median_s": mid, "min_s": min(took), "spread": (max(took) - min(took)) / mid}
    first = next(iter(out.values()))["median_s"] if out else 1.0
    return {name: row | {"ratio": row["median_s"] / first} for name, row in out.items()}


def geometric_mean(values: list[float]) -> float:
    return statistics.geometric_mean(values)


def phases(steps: dict[str, Callable[[], object]]) -> dict[str, float]:
    """Seconds of each named step, run in order."""
    out = {}
    for name, step in steps.items():
        began = time.perf_counter()
        step()
        out[name] = time.perf_counter() - began
    return out


def sweep(points: dict[str, DataFrame], arms: dict[str, Callable[[DataFrame], DataFrame]], expected: dict[str, int] | None = None, repeats: int = 3) -> list[dict]:
    """A row for each point and arm with its median; arms that give a flag are first checked against the planted count."""
    rows = []
    for point, df in points.items():
        for arm, run in arms.items():
            if expected is not None:
                found = run(df).where("is_outlier").count()
                if found != expected[point]:
                    raise ArithmeticError(f"{arm} found {found} of {expected[point]} outliers at {point}")
            rows.append({"point": point, "arm": arm, **medians({arm: lambda df=df, run=run: run(df)}, repeats)[arm]})
    return rows


def line(points: list[tuple[float, float]]) -> tuple[float, float]:
    """Least-squares slope and intercept."""
    return tuple(statistics.linear_regression([x for x, _ in points], [y for _, y in points]))


def in_parts(df: DataFrame, counts: tuple[int, ...]) -> dict[str, DataFrame]:
    """The points of a sweep over parallelism: the same rows in so many partitions, each of which one thread works on."""
    return {str(n): df.repartition(n).persist() for n in counts}


def window_groups(path: str, column: str, counts: tuple[int, ...] = (4, 16, 64), **options) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The arms of a sweep over how many row groups the histogram's window is sampled from; they read path, not the point."""
    return {str(n): lambda _, n=n: flags.iqr_flags(path, column, groups=n, **options) for n in counts}


def to_csv(rows: list[dict], path: str) -> None:
    """The rows of sweeps as a CSV file."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    with open(path, "w", newline="") as out:
        writer = csv.DictWriter(out, names)
        writer.writeheader()
        writer.writerows(rows)


def campaign(steps: dict[str, Callable[[], object]], seconds: float) -> dict[str, dict]:
    """Each named step with its seconds, its result's error if it failed, and whether it ran over its time; a step over its time
    has its Spark jobs cancelled, and the next one follows."""
    spark, out = SparkSession.active(), {}
    for name, step in steps.items():
        group = f"campaign-{name}"
        timer = threading.Timer(seconds, spark.sparkContext.cancelJobGroup, [group])
        spark.sparkContext.setJobGroup(group, name, interruptOnCancel=True)
        began, error = time.perf_counter(), None
        timer.start()
        try:
            step()
        except Exception as e:  # the others still run; the row says what went wrong
            error = f"{type(e).__name__}: {e}".split("\n")[0]
        finally:
            timer.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        took = time.perf_counter() - began
        out[name] = {"seconds": took, "error": error, "over": took >= seconds}
    return out


def progress(spark: SparkSession) -> float:
    """Percent of the running jobs' tasks that are done; 100 if nothing runs."""
    tracker = spark.sparkContext.statusTracker()
    stages = [info for i in tracker.getActiveStageIds() if (info := tracker.getStageInfo(i)) is not None]
    total = sum(s.numTasks for s in stages)
    return 100.0 * sum(s.numCompletedTasks for s in stages) / total if total else 100.0
