import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tukeyframe.llm import sharding


def plain(rows, limit):
    """Splits buckets one bit at a time."""
    todo, done = [(0, "", rows)], {}
    while todo:
        depth, name, own = todo.pop()
        if sum(len((t or "").encode()) for _, t in own) <= limit or len({k for k, _ in own}) == 1:
            done[name] = own
            continue
        for bit in "01":
            part = [r for r in own if f"{int(hashlib.md5(str('' if r[0] is None else r[0]).encode()).hexdigest()[:15], 16):060b}"[depth] == bit]
            if part:
                todo.append((depth + 1, name + bit, part))
    return done


@pytest.mark.parametrize("limit", [50, 1000, 10**6])
def test_splits_like_extendible_hashing(spark, limit):
    rows = [(i, "x" * (i % 37)) for i in range(500)] + [(None, "null key"), (501, None), (502, "é" * 20)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, shard string, bytes int")
    got = sharding.assign(docs, limit).collect()
    want = {(k, len((t or "").encode()), name) for name, own in plain(rows, limit).items() for k, t in own}
    assert {(r.doc_id, r.bytes, r.shard) for r in got} == want and len(got) == len(rows)


def test_overflow_pages(spark):
    rows = [(7, "a" * 30)] * 25 + [(7, "b" * 200), (7, "c" * 10), (8, "d" * 10), (9, "e" * 500)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()
    assert Counter((r.doc_id, r.bytes) for r in got) == Counter((k, len(t)) for k, t in rows)
    load = Counter()
    for r in got:
        load[r.shard] += r.bytes
    single = Counter(r.shard for r in got)
    assert all(n <= 100 or single[s] == 1 for s, n in load.items())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(empty, 100).collect() == sharding.round_trip(empty, 100).collect() == []


def loads(rows):
    load, single = Counter(), Counter()
    for r in rows:
        load[r.shard] += r.bytes
        single[r.shard] += 1
    return {k: n for k, n in load.items() if single[k] > 1}


def test_round_trip_keeps_rows_and_limits(spark, tmp_path):
    rows = [(i, "x" * (50 + i % 3), "clash", 1) for i in range(400)] + [(None, None, "s", 2), (None, "é" * 100, "s", 2), (7, "again", "s", 3), (8, "y" * 5000, None, None)]
    rows += [(9, "z" * 60, "hot", 4)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, depth int").repartition(3)
    got = sharding.round_trip(docs, 200, path=str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.bytes) for r in got) == Counter((k, len((t or "").encode())) for k, t, *_ in rows)
    assert max(loads(got).values()) <= 200
    back = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out"))
    assert Counter(tuple(r) for r in back.select("doc_id", "text", "shard", "depth").collect()) == Counter(rows)
    assert sum("=" in p.name for p in (tmp_path / "out").iterdir()) == len({r.shard for r in got})


def test_directory_has_an_entry_for_every_prefix(spark):
    sizes = spark.range(3000).select(sharding.key_hash(F.col("id")).alias("h"), F.lit(10).cast("long").alias("bytes"))
    ((depth, entries),) = sharding.directory(sizes, 200)
    rows = entries.collect()
    assert len({r.slot for r in rows}) == len(rows) > 0.9 * 2**depth and max(r.depth for r in rows) == depth
    for r in rows:
        assert r.slot >> (depth - r.depth) == r.prefix and r.bytes <= 200 and not r.deeper


def test_deep_splits_need_further_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLACK", 0)
    rows = [(i, "x" * 100) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(k, len(t), name) for name, own in plain(rows, 100).items() for k, t in own}
    assert {(r.doc_id, r.bytes, r.shard) for r in sharding.assign(docs, 100).collect()} == want


def test_long_payloads(spark):
    rows = [(1, "x" * 3_000_000), (2, "y"), (3, "z")]
    got = sharding.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    assert {(r.doc_id, r.bytes) for r in got} == {(1, 3_000_000), (2, 1), (3, 1)}
    assert not {r.shard for r in got if r.doc_id == 1} & {r.shard for r in got if r.doc_id != 1}
