import math
import random

import pytest
from pyspark.sql import functions as F

from tukeyframe.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank int"


def plain(rows, k, step):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % step == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def vectors(n, width, seed, spread):
    import struct

    rng = random.Random(seed)
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    return [(i, [single(rng.gauss(0, 1) * spread**-d) for d in range(width)], 0) for i in range(n)]


@pytest.mark.parametrize(("width", "spread"), [(1, 1.0), (8, 1.0), (16, 1.5)])
def test_against_brute_force(spark, monkeypatch, width, spread):
    monkeypatch.setattr(topk, "SEEDS", 20)
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    rows = vectors(600, width, 3, spread) + [(600 + i, [0.25] * width, 0) for i in range(50)]
    rows += [(700, None, 0), (701, [None] * width, 0), (702, [float("nan")] * width, 0), (703, [float("inf")] * width, 0), (None, [1.0] * width, 0), (704, [], 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = topk.search(docs, F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in got} == plain(rows, 10, 50)
    assert len(got) == len({(r.query_id, r["rank"]) for r in got})


def test_few_rows_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_CHUNK", 3)
    rows = vectors(9, 4, 5, 1.0)
    got = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 1 == 0).collect()
    assert {tuple(r) for r in got} == plain(rows, 10, 1)


def test_large_components_and_empty(spark):
    rows = [(i, [float(10**5 * (i + 1)), 1.0], 0) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in topk.search(docs, F.col("vec_id") % 5 == 0).collect()} == plain(rows, 10, 5)
    assert topk.search(docs.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert topk.search(docs, F.col("vec_id") < 0).collect() == []


def test_repeated_rows(spark):
    rows = [(0, [1.0], 0), (0, [1.0], 0), (1, [0.5], 0), (1, [0.5], 0), (2, [2.0], 0)]
    got = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2 * 1024**2), (1, 1024**2 // 2), (1, 1024**2 // 2)]


def test_short_vectors_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEEDS", 40)
    rows = [(i, [x * (30.0 if i < 40 else 0.5) for x in v], 0) for i, v, _ in vectors(800, 6, 8, 1.0)]
    seen = []
    least = topk.Search.least_length

    def noted(self):
        seen.append(least(self))
        return seen[-1]

    monkeypatch.setattr(topk.Search, "least_length", noted)
    got = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 40 == 0, k=3).collect()
    assert {tuple(r) for r in got} == plain(rows, 3, 40)
    assert seen and seen[0] > 0


def test_long_vectors_and_one_vector_many_times(spark):
    rows = vectors(12, 5000, 2, 1.0) + [(100 + i, [0.5] * 5000, 0) for i in range(60)]
    docs = spark.createDataFrame([(*r, "x", True) for r in rows], SCHEMA + ", norm string, asked boolean")
    assert {tuple(r) for r in topk.search(docs, F.col("vec_id") % 10 == 0, k=4).collect()} == plain(rows, 4, 10)
