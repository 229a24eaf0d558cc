"""Parquet in and out: the scan, row positions, footers as a table, packed directories, and the writers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, where: Column | str | None = None) -> DataFrame:
    """One or more Parquet files, folders or globs. Columns and filters reach the reader, which skips row groups by them."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def with_row_index(df: DataFrame) -> DataFrame:
    """A scan with file_path and row_index: the position of each row in its file. Apply it before other operations."""
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def ordered(df: DataFrame) -> DataFrame:
    """A scan's rows in the order of the files' names and their rows."""
    return with_row_index(df).orderBy("file_path", "row_index")


def _starts(df: DataFrame) -> DataFrame:
    """(file_path, start): the rows in the files before, by name, for a scan with file_path and row_index."""
    sizes = df.groupBy("file_path").agg((F.max("row_index") + 1).alias("size"))
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return sizes.select("file_path", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("start"))


def with_position(df: DataFrame, *columns: str) -> DataFrame:
    """The columns of a scan (all if none are named) with position: each row's place (from 0) over all files in the order of
    their names. Files may be split between tasks; what is gathered is a number a file."""
    rows = with_row_index(df if not columns else df.select(*columns))
    placed = rows.join(F.broadcast(_starts(rows)), "file_path")
    return placed.withColumn("position", F.col("start") + F.col("row_index")).drop("file_path", "row_index", "start")


def positional_zip(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows at equal positions side by side: an equi-join on position (see with_position), of which each side has one row."""
    return left.join(right, "position", "full")


def column_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, rows, nulls, min, max) by one aggregate; Spark answers it from footers where it can."""
    names = columns or df.columns
    facts = df.agg(F.count(F.lit(1)).alias("n"), *(f(F.col(c)).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("c", F.count), ("l", F.min), ("h", F.max))))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), (F.col("n") - F.col(f"c_{i}")).alias("nulls"), F.col(f"l_{i}").cast("string").alias("min"), F.col(f"h_{i}").cast("string").alias("max")) for i, c in enumerate(names)))
    return facts.select(F.inline(each))


FOOTER = (
    "file_name string, row_group_id int, row_group_num_rows long, column_id int, path_in_schema string, type string, "
    "compression string, encodings string, num_values long, total_compressed_size long, total_uncompressed_size long, has_dictionary boolean, stats_min string, stats_max string"
)


def _chunks(name: str, meta) -> Iterator[tuple]:
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            s = chunk.statistics
            ends = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
            yield name, g, group.num_rows, c, chunk.path_in_schema, chunk.physical_type, chunk.compression, ",".join(chunk.encodings), chunk.num_values, chunk.total_compressed_size, chunk.total_uncompressed_size, chunk.has_dictionary_page, *ends


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """The footers of Parquet files as rows, a row a column chunk.

    Files are listed by Spark and opened in tasks through pyarrow's file systems, which read the end of a file only. Files
    in a store that pyarrow doesn't know come whole through Spark.
    """
    import pyarrow as pa
    from pyarrow import fs

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    some = files.select("path").first()
    try:
        known = some is None or fs.FileSystem.from_uri(some["path"]) is not None
    except pa.ArrowInvalid:
        known = False

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            for row in batch.itertuples():
                if known:
                    store, name = fs.FileSystem.from_uri(row.path)
                    with store.open_input_file(name) as data:
                        meta = pq.read_metadata(data)
                else:
                    meta = pq.read_metadata(pa.BufferReader(row.content))
                yield pd.DataFrame(list(_chunks(row.path, meta)), columns=[x.split()[0] for x in FOOTER.split(", ")])

    return files.select(*(["path"] if known else ["path", "content"])).mapInPandas(footers, FOOTER)


def check_types(spark: SparkSession, path: str) -> None:
    """Strict mode: an error for files without row groups or with column types that the fixed-width scan doesn't take."""
    found = row_groups(spark, path).select("path_in_schema", "type").distinct().collect()
    if not found:
        raise ValueError(f"{path} has no row groups")
    bad = sorted(r.path_in_schema for r in found if r.type in ("INT96", "FIXED_LEN_BYTE_ARRAY"))
    if bad:
        raise ValueError(f"columns {', '.join(bad)} have types that can't be scanned")


def write(df: DataFrame, path: str, compression: str = "snappy", row_group_bytes: int | None = None, dictionary: bool = True, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", compression).option("parquet.enable.dictionary", str(dictionary).lower())
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.parquet(path)


def create_table(df: DataFrame, name: str) -> None:
    """Creates or replaces a managed table from a query."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def pack_directory(entries: list[tuple[str, int, int]]) -> bytes:
    """A directory blob: the number of entries, then for each its name's length, the name, an offset and a size."""
    parts = [struct.pack("<Q", len(entries))]
    for name, offset, size in entries:
        raw = name.encode()
        parts.append(struct.pack("<Q", len(raw)) + raw + struct.pack("<QQ", offset, size))
    return b"".join(parts)


def read_directory(blob: bytes) -> list[tuple[str, int, int]]:
    """The entries of a directory blob, sorted by name; an error if it is cut short."""
    at, out = 0, []

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(blob):
            raise ValueError("the directory is cut short")
        at += n
        return blob[at - n : at]

    (count,) = struct.unpack("<Q", take(8))
    for _ in range(count):
        (length,) = struct.unpack("<Q", take(8))
        name = take(length).decode()
        out.append((name, *struct.unpack("<QQ", take(16))))
    return sorted(out)
