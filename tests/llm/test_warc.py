import functools
import gzip
import pathlib
import zlib

import pytest

from pyspark.sql import functions as F

from tukeyframe.llm import warc

PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/2", "<p>two\r\n\r\nWARC/1.1\r\nContent-Length: 3</p>"),
    (3, "http://a/3", "<p>one</p>"),
    (4, None, None),
    (5, "http://a/5 x", ""),
    (6, "http://a/6", "é" * 700_000),
    (3, "http://a/3", "<p>one</p>"),
    (None, "http://a/n", "<p>one</p>"),
    (None, "http://a/n", "alone"),
]
SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("broadcast", [True, False])
def test_round_trip(spark, monkeypatch, broadcast):
    extra = [(*r, "clash") for r in PAGES]
    pages = spark.createDataFrame(extra, SCHEMA + ", digest string").repartition(3)
    if not broadcast:
        monkeypatch.setattr(warc, "SALT_ROWS", 2)
        monkeypatch.setattr(warc, "verdicts", functools.partial(warc.verdicts, groups=0))
    rows = warc.round_trip(pages).collect()
    assert len(rows) == len(PAGES)
    payloads = [(p, (h or "").encode()) for p, _, h in PAGES]
    expected = []
    for key, payload in payloads:
        winner = max((k for k, x in payloads if x == payload and k is not None), default=None)
        revisit = winner is not None and key != winner
        expected.append((key, len(payload), warc.payload_digest(payload), "revisit" if revisit else "response", winner if revisit else None))
    found = [tuple(r)[:5] for r in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_short_payloads_stay_responses(spark):
    rows = warc.round_trip(spark.createDataFrame(PAGES, SCHEMA), min_bytes=11).collect()
    assert {r.record_type for r in rows} == {"response"}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_normaliser_takes_any_layout(spark, tmp_path):
    whole = [warc.record(i, f"http://x/{i}", b"z" * (i * 50_000), None, False) for i in range(40)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.warc.gz").write_bytes(gzip.compress(b"".join(whole)))
    (tmp_path / "in/many.warc.gz").write_bytes(b"".join(map(gzip.compress, whole)))
    paths = spark.createDataFrame([(f"file://{tmp_path}/in/{n}.warc.gz",) for n in ("one", "many")], "path string")
    made = warc.normalise(paths, f"file://{tmp_path}/out").collect()
    assert [r.records for r in made] == [40, 40]
    for r in made:
        data, members = pathlib.Path(r.path.removeprefix("file://")).read_bytes(), []
        while data:
            member = zlib.decompressobj(31)
            members.append(member.decompress(data))
            data = member.unused_data
        assert members == whole


def test_one_page_many_times(spark):
    copies = spark.range(20_000).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), F.when(F.col("id") % 10 > 0, "<p>same</p>").otherwise(F.col("id").cast("string")).alias("html"))
    made = warc.verdicts(copies.repartition(8), groups=0)
    assert max(r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()) < 10_000
    rows = warc.round_trip(copies.repartition(4)).groupBy("record_type", "refers_to").count().collect()
    assert {(r.record_type, r.refers_to, r["count"]) for r in rows} == {("response", None, 2001), ("revisit", 19_999, 17_999)}


def test_archives_are_cut_by_bytes(spark, tmp_path):
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.repeat(F.lit("x"), 100).alias("html")).coalesce(1)
    paths = [r.path for r in warc.write_monolithic(warc.verdicts(pages), f"file://{tmp_path}/cut", archive_bytes=1000).collect()]
    assert len(paths) == len(set(paths)) == 10
