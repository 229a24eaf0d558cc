"""SQL with the outlier functions as table functions: FROM iqr_flags('file.parquet', 'column') t(v, f).

Spark's own table functions can't take a path and give that file's schema, so calls are resolved before Spark parses the
text: each becomes a temporary view. A view is a plan, but finding a window or exact quartiles for it runs small jobs. Text
within quotes and comments is left alone. release() drops the views that calls have made.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tukeyframe.functions import profile
from tukeyframe.operators import flags
from tukeyframe.sources import parquet

FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    "read_columns": lambda spark, path: parquet.scan(spark, path),
    "iqr_flags": lambda spark, path, column: flags.iqr_flags(path, column),
    "iqr_flags_only": lambda spark, path, column: flags.iqr_flags_only(path, column),
    "iqr_cpu_flags": lambda spark, path, column: flags.iqr_cpu_flags(path, column),
    "iqr_cpu_flags_groupby": lambda spark, path, column: flags.iqr_cpu_flags_groupby(path, column),
    "iqr_profiler": lambda spark: profile.total_counters(profile.stage_counters(spark)),
    "decoder_profiler": lambda spark: profile.stage_counters(spark),
    "stream_profile": lambda spark: profile.throughput(profile.stage_counters(spark)),
    "parquet_metadata": lambda spark, path: parquet.row_groups(spark, path),
}
_STRING = r"'(?:[^']|'')*'"
_TOKEN = re.compile(rf"{_STRING}|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\b(?P<name>{'|'.join(FUNCTIONS)})\s*\((?P<args>\s*(?:{_STRING}\s*(?:,\s*{_STRING}\s*)*)?)\)", re.S | re.I)


def resolve(spark: SparkSession, text: str) -> str:
    """The text with every call of a table function replaced by the name of a view."""

    def view(match: re.Match) -> str:
        if match["name"] is None:
            return match[0]
        name = match["name"].lower()
        args = [a[1:-1].replace("''", "'") for a in re.findall(_STRING, match["args"])]
        try:
            made = FUNCTIONS[name](spark, *args)
        except TypeError as e:
            if "positional argument" in str(e):
                raise ValueError(f"{name} doesn't take {len(args)} arguments") from None
            raise
        found = f"{name}_{uuid.uuid4().hex}"
        made.createOrReplaceTempView(found)
        return found

    return _TOKEN.sub(view, text)


def release(spark: SparkSession) -> int:
    """Drops the session's views of earlier calls; queries that were made from them stay as they are."""
    made = re.compile(rf"(?:{'|'.join(FUNCTIONS)})_[0-9a-f]{{32}}")
    names = [t.name for t in spark.catalog.listTables() if t.isTemporary and made.fullmatch(t.name)]
    return sum(spark.catalog.dropTempView(n) for n in names)


def sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(resolve(spark, text))
