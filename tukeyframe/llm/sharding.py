"""Extendible hashing: a directory indexed by hash-prefix bits, of shards within a byte limit.

The directory has an entry for each prefix of its global depth; entries whose further bits don't matter point to the same shard,
whose local depth says how many bits do. Only a bucket over the limit splits on another bit, until each fits or holds one hash
alone. Bytes are first summed by a fine prefix (cells), so that the directory is grown from a table of cells, and a row finds
its shard by one lookup of its prefix. Where a few cells are still too large at that prefix, their entries point to a
directory of the next STEP bits, and only their rows are looked up again.

Rows whose keys hash alike can't be parted by bits. Where these are over the limit together, they are dealt to overflow
pages within the limit, each input partition filling its own, so a key that a third of all rows have is split like any other.

Defined results: a null key hashes as the empty text; a null payload has 0 bytes; a row of more bytes than the limit gets
a shard or overflow page of its own; repeated rows are dealt one by one; payloads are of any length, only their size is
read for the directory; an empty table gives an empty result, and no shards; columns may have any names: assign() returns
its own four, and write() keeps those of the rows (its folders are named by a column that none of them has).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tukeyframe.llm import scratch
from tukeyframe.llm.native import fresh

#: Bits of the key's hash that make the finest prefix.
BITS = 60
#: Bits of the first cells beyond those that even shards would need, and bits more whenever cells are too large.
SLACK, STEP = 4, 6


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(hashed: Column, depth: int) -> Column:
    """The first depth bits of a 60-bit hash, as a long."""
    return F.call_function("shiftright", hashed, F.lit(BITS - depth))


def directory(sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """The directory for sizes (columns h, bytes), as (global depth, entries) of each level; most tables need one.

    Entries: slot (a prefix of that depth), depth and prefix of the shard, its bytes and rows, and deeper where the next
    level says more instead.
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    fine = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK)
    whole = [F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    cell = lambda rows, bits: rows.groupBy(prefix(F.col("h"), bits).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    fits = (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))
    levels, start, rows = [], 0, sizes
    while True:
        cells = scratch.materialise(cell(rows, fine), "cells")
        # every prefix of a cell with what is below it; a shard is one that fits within a parent that doesn't
        up = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(fine))))
        shift = (F.lit(fine) - F.col("depth")).cast("int")
        nodes = up.groupBy("depth", F.call_function("shiftright", F.col("p"), shift).alias("prefix")).agg(*whole)
        parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), (~fits).alias("over"))
        joined = nodes.withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1))).join(parent, ["depth", "up"], "left")
        reached = F.coalesce("over", F.col("depth") == start)
        found = scratch.materialise(joined.where(reached & (fits | (F.col("depth") == fine))).select("depth", "prefix", "bytes", "n", (~fits).alias("deeper")), "buckets")
        depth = found.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()["d"]
        spare = (F.lit(depth) - F.col("depth")).cast("int")
        first = F.call_function("shiftleft", F.col("prefix"), spare)
        entries = found.withColumn("slot", F.explode(F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), spare) - 1)))
        levels.append((depth, entries))
        large = found.where("deeper").select(F.col("prefix").alias("p"))  # these have the depth fine
        if large.isEmpty():
            return levels
        rows = sizes.withColumn("p", prefix(F.col("h"), fine)).join(large, "p", "left_semi")
        start, fine = fine + 1, min(BITS, fine + STEP)


def placed(rows: DataFrame, limit: int, key: str = "doc_id", payload: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """rows with the columns bytes, depth and shard, under the names that the dictionary gives (none that rows have)."""
    name = {c: fresh(rows, c) for c in ("bytes", "depth", "shard")}
    h, slot, deeper, used, n, page = (fresh(rows, c) for c in ("h", "slot", "deeper", "shard_bytes", "n", "page"))
    size = F.coalesce(F.octet_length(F.col(payload).cast("string")), F.lit(0)).cast("long")
    hashed = rows.withColumn(name["bytes"], size).withColumn(h, key_hash(F.col(key)))
    sizes = scratch.materialise(hashed.select(F.col(h).alias("h"), F.col(name["bytes"]).alias("bytes")), "sizes")
    found, rest = None, hashed
    for depth, entries in directory(sizes, limit):
        bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
        table = entries.select(F.col("slot").alias(slot), F.col("depth").alias(name["depth"]), bits.alias(name["shard"]), F.col("bytes").alias(used), F.col("n").alias(n), F.col("deeper").alias(deeper))
        looked = rest.withColumn(slot, prefix(F.col(h), depth)).join(table, slot).drop(slot)
        here = looked.where(~F.col(deeper)).drop(deeper)
        found = here if found is None else found.unionByName(here)
        rest = looked.where(F.col(deeper)).select(*hashed.columns)
    over = (F.col(used) > limit) & (F.col(n) > 1)
    out = found.where(~over).drop(h, used, n)
    alike = scratch.materialise(sizes.groupBy("h").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("c")).where(f"b > {limit} AND c > 1"), "alike")
    if alike.isEmpty():
        return out, name
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col(name["bytes"]), F.lit(1)))).cast("long")
    part = found.where(over).withColumn(page, F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy(page, h, name["bytes"]).orderBy(F.lit(1))) - 1
    paged = F.concat_ws("/", name["shard"], F.col(name["bytes"]).cast("string"), F.col(page).cast("string"), F.floor(number / each).cast("string"))
    return out.unionByName(part.withColumn(name["shard"], paged).drop(h, used, n, page)), name


def assign(rows: DataFrame, limit: int, key: str = "doc_id", payload: str = "text") -> DataFrame:
    """Each row's key and bytes with the local depth of its shard and the shard's name.

    The name is the prefix in binary digits; overflow pages add the row size, the input partition and a number.
    """
    found, name = placed(rows, limit, key, payload)
    return found.select(F.col(key).alias(key), *(F.col(name[c]).alias(c) for c in ("bytes", "depth", "shard")))


def write(rows: DataFrame, path: str, limit: int, key: str = "doc_id", payload: str = "text") -> tuple[str, str]:
    """Writes rows as one folder of Parquet a shard; a task holds whole shards. The names of the folders' column (the
    shard) and of the column with its local depth."""
    found, name = placed(rows, limit, key, payload)
    shard = F.concat(F.lit("b"), name["shard"])
    found.withColumn(name["shard"], shard).drop(name["bytes"]).repartition(name["shard"]).write.partitionBy(name["shard"]).parquet(path)
    return name["shard"], name["depth"]


def round_trip(rows: DataFrame, limit: int, key: str = "doc_id", payload: str = "text", path: str | None = None) -> DataFrame:
    """Writes the shards, reads them again, and returns what assign() does, from what was read."""
    spark = rows.sparkSession
    path = path or scratch.new_path(spark, "shards")
    shard, depth = write(rows, path, limit, key, payload)
    schema = T.StructType([*rows.schema.fields, T.StructField(depth, T.IntegerType()), T.StructField(shard, T.StringType())])
    back = spark.read.schema(schema).parquet(path)
    size = F.coalesce(F.octet_length(F.col(payload).cast("string")), F.lit(0)).cast("long")
    return back.select(F.col(key).alias(key), size.alias("bytes"), F.col(depth).alias("depth"), F.substring(shard, 2, 1 << 20).alias("shard"))
