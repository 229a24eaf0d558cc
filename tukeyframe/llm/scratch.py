"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts the lineage and survives the loss of any executor. The folder is the one that the cluster
names in ``spark.checkpoint.dir``; only where that is unset (a local session) is one made on this machine.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two numbers that may be broadcast: some 30 MB in an executor.
BROADCAST_ROWS = 1_000_000
#: Rows with texts that go to a Python worker at once.
ARROW_ROWS = 1024


#: Folders made for local sessions that name none, by application.
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, with its scheme and without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _made:
            _made[app] = f"file://{tempfile.mkdtemp(prefix='tukeyframe-')}"
        found = _made[app]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", whole).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/tukeyframe/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most that many rows (of a few numbers each); else joined by a shuffle.

    df should be a written table: its rows are counted, which for Parquet takes only the footers.
    """
    return F.broadcast(df) if df.count() <= rows else df


def text_batches(df: DataFrame) -> DataFrame:
    """df, after setting for its session that Python workers get ARROW_ROWS rows at a time at most: batches of whole texts
    are held by the JVM and the worker at once, and 10,000 of them take hundreds of megabytes of an executor."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


def remove(df: DataFrame) -> None:
    """Deletes the files behind a table that materialise() returned."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(spark, file)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables below the shared folder, also those of other sessions that share it: for when no result
    that reads them is needed any more."""
    delete(spark, f"{shared_dir(spark)}/tukeyframe")


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
