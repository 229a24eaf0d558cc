"""Fences over a stream: value counts are merged batch by batch, so the fences are exact for all rows so far.

The state is a table of (v, n), written anew under the batch's number with each micro-batch; a batch that runs again after a
failure starts from the same earlier table and so counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tukeyframe.functions import fences as algebra
from tukeyframe.operators import quartiles


class RunningFences:
    """Keeps the counts of a column below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, column: str):
        self.spark, self.folder, self.column, self.last = spark, folder.rstrip("/"), column, -1

    def update(self, batch: DataFrame, number: int) -> None:
        new = quartiles.counts(batch, self.column)
        if number:
            new = self.spark.read.parquet(f"{self.folder}/{number - 1}").unionByName(new).groupBy("v").agg(F.sum("n").alias("n"))
        new.write.mode("overwrite").parquet(f"{self.folder}/{number}")
        self.last = number

    def fences(self) -> DataFrame:
        """(q1, q3, lo, hi) of all rows so far."""
        counted = self.spark.read.parquet(f"{self.folder}/{self.last}")
        return algebra.fences(quartiles.zoom(counted, "v", "n"), counted.schema["v"].dataType)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, time: str, column: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of event time with rows, sum, least and greatest value; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length)).agg(F.count(F.lit(1)).alias("n"), F.sum(column).alias("total"), F.min(column).alias("low"), F.max(column).alias("high"))
