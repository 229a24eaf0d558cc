"""Outlier masks as bits: element i is bit i % 8 of byte i / 8, the lowest bit first."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pack(df: DataFrame, index: str, flag: str, group: int = 8) -> DataFrame:
    """(byte_no, byte): the mask's bytes from a dense index (from 0) and a flag; a null flag is 0."""
    position = F.col(index)
    value = F.sum(F.when(F.col(flag), F.call_function("shiftleft", F.lit(1), (position % 8).cast("int"))).otherwise(0))
    return df.groupBy(F.call_function("shiftright", position, F.lit(3)).alias("byte_no")).agg(value.cast("int").alias("byte"))


def unpack(packed: DataFrame, rows: int) -> DataFrame:
    """(i, flag) of the first rows elements of pack()'s bytes."""
    bit = packed.select("byte_no", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    i = F.col("byte_no") * 8 + F.col("bit")
    return bit.select(i.alias("i"), (F.call_function("shiftright", F.col("byte"), F.col("bit")) % 2 == 1).alias("flag")).where(F.col("i") < rows)


#: Parts that one task sums up.
PARTS = 1 << 16


def part_starts(sizes: DataFrame) -> DataFrame:
    """(part, start) from (part, rows): the rows in the parts before. Parts are summed in ranges of PARTS numbers, and then
    the ranges, so that no task has all parts."""
    ranged = sizes.withColumn("range", F.floor(F.col("part") / PARTS))
    totals = ranged.groupBy("range").agg(F.sum("rows").alias("rows"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("range", F.coalesce(F.sum("rows").over(before().orderBy("range")), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("rows").over(before("range").orderBy("part")), F.lit(0))
    return ranged.withColumn("within", within).join(first, "range").select("part", (F.col("base") + F.col("within")).cast("long").alias("start"))


def repack(parts: DataFrame) -> DataFrame:
    """One mask from parts that are each padded to whole bytes: (part, rows, byte_no, byte), part numbered in order."""
    starts = part_starts(parts.groupBy("part").agg(F.max("rows").alias("rows")))
    bit = parts.select("part", "rows", "byte_no", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    own = F.col("byte_no") * 8 + F.col("bit")
    flat = bit.where(own < F.col("rows")).join(starts, "part")
    return pack(flat.select((own + F.col("start")).alias("i"), (F.call_function("shiftright", F.col("byte"), F.col("bit")) % 2 == 1).alias("flag")), "i", "flag")


def blocks(df: DataFrame, index: str, flag: str, bytes_per_block: int = 1 << 20) -> DataFrame:
    """(block, data): the mask as binary blocks in order, each of at most bytes_per_block bytes."""
    packed = pack(df, index, flag).withColumn("block", F.floor(F.col("byte_no") / bytes_per_block))
    ordered = F.array_sort(F.collect_list(F.struct("byte_no", "byte")))
    hexed = F.array_join(F.transform(ordered, lambda x: F.lpad(F.hex(x["byte"]), 2, "0")), "")
    return packed.groupBy("block").agg(F.unhex(hexed).alias("data"))


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path behind a URI or a local path."""
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def dump(df: DataFrame, path: str, index: str, flag: str, bytes_per_block: int = 1 << 20) -> int:
    """Writes the number of rows (64 bits, little endian) and the mask's bytes to one file, a block at a time."""
    rows = df.count()
    store, name = _place(path)
    with store.open_output_stream(name, compression=None) as out:
        out.write(struct.pack("<Q", rows))
        for r in blocks(df, index, flag, bytes_per_block).orderBy("block").toLocalIterator():
            out.write(r["data"])
    return rows


def read_dump(spark: SparkSession, path: str, bytes_per_task: int = 1 << 22) -> DataFrame:
    """(i, flag) of a dumped mask, in a store that driver and executors share: each task reads its own range of the file."""
    store, name = _place(path)
    with store.open_input_file(name) as data:
        (rows,) = struct.unpack("<Q", data.read(8))
        size = data.size() - 8
    if size != -(-rows // 8):
        raise ValueError(f"{path} has {size} bytes of flags for {rows} rows")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = _place(path)
        with store.open_input_file(name) as data:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    start = part * bytes_per_task
                    data.seek(8 + start)
                    body = np.frombuffer(data.read(min(bytes_per_task, size - start)), np.uint8)
                    for at in range(0, len(body), 1 << 16):
                        some = body[at : at + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(some), dtype=np.int64) + start + at), pa.array(some.astype(np.int32))], names=["byte_no", "byte"])

    parts = -(-size // bytes_per_task)
    return unpack(spark.range(0, parts, 1, max(1, parts)).mapInArrow(read, "byte_no long, byte int"), rows)


def to_bytes(flags: Iterable[bool | None]) -> bytes:
    """The mask of a short list."""
    out = bytearray()
    for i, flag in enumerate(flags):
        if i % 8 == 0:
            out.append(0)
        out[-1] |= bool(flag) << i % 8
    return bytes(out)


def bit(index: Column, byte: Column) -> Column:
    """The flag of an element from its byte."""
    return F.call_function("shiftright", byte, (index % 8).cast("int")) % 2 == 1
