import struct

import pytest
from pyspark.sql import functions as F

from tukeyframe.functions import profile
from tukeyframe.operators import flags, mask
from tukeyframe.plans import settings, sql, timing
from tukeyframe.sources import datagen, parquet
from tukeyframe.streaming.fences import RunningFences, windowed_counts


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "o'brien.parquet")
    datagen.planted(spark, 30_000).coalesce(1).write.parquet(path)
    return path


def test_mask_round_trip(spark, tmp_path):
    values = [i % 3 == 0 or i == 17 for i in range(101)]
    df = spark.createDataFrame([(i, v if i != 5 else None) for i, v in enumerate(values)], "i long, flag boolean")
    values[5] = False
    packed = bytes(r.byte for r in mask.pack(df, "i", "flag").orderBy("byte_no").collect())
    assert packed == mask.to_bytes(values)
    assert mask.dump(df, str(tmp_path / "m"), "i", "flag", bytes_per_block=4) == 101
    assert (tmp_path / "m").read_bytes() == struct.pack("<Q", 101) + packed
    assert [r.flag for r in mask.read_dump(spark, str(tmp_path / "m")).orderBy("i").collect()] == values
    (tmp_path / "m").write_bytes((tmp_path / "m").read_bytes()[:-1])
    with pytest.raises(ValueError):
        mask.read_dump(spark, str(tmp_path / "m"))


def test_repack_parts(spark):
    parts, flat = [[True] * 3, [False, True] * 6, [True], []], []
    rows = []
    for p, part in enumerate(parts):
        flat += part
        rows += [(p, len(part), b, byte) for b, byte in enumerate(mask.to_bytes(part))]
    got = mask.repack(spark.createDataFrame(rows, "part int, rows long, byte_no long, byte int")).orderBy("byte_no").collect()
    assert bytes(r.byte for r in got) == mask.to_bytes(flat)


def test_scan_plan_reads_what_it_needs(spark, file):
    plan = parquet.scan(spark, file, ["i"], "v > 5000000")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,5000000)]" in plan and "ReadSchema: struct<i:bigint,v:bigint>" in plan
    count = parquet.scan(spark, file).agg(F.count(F.lit(1)))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<>" in count


def test_row_groups_and_types(spark, file, tmp_path):
    rows = parquet.row_groups(spark, file).collect()
    assert {r.path_in_schema for r in rows} == {"i", "v"} and sum(r.num_values for r in rows) == 60_000
    parquet.check_types(spark, file)
    spark.sql("SELECT CAST(1 AS decimal(30,2)) AS d").write.parquet(str(tmp_path / "d"))
    with pytest.raises(ValueError):
        parquet.check_types(spark, str(tmp_path / "d"))


def test_directory_blob():
    entries = [("b.parquet", 100, 7), ("a é.parquet", 0, 100)]
    blob = parquet.pack_directory(entries)
    assert parquet.read_directory(blob) == sorted(entries)
    for cut in (3, 12, len(blob) - 1):
        with pytest.raises(ValueError):
            parquet.read_directory(blob[:cut])


def test_writers(spark, tmp_path):
    parquet.write(datagen.cycle(spark, 5000), str(tmp_path / "w"), "zstd", row_group_bytes=4096, dictionary=False)
    rows = parquet.row_groups(spark, str(tmp_path / "w")).collect()
    assert {r.compression for r in rows} == {"ZSTD"} and not any(r.has_dictionary for r in rows)
    parquet.create_table(datagen.cycle(spark, 10), "cycle_table")
    assert spark.table("cycle_table").count() == 10
    spark.sql("DROP TABLE cycle_table")


def test_planted_counts_by_every_function(spark, file):
    quoted = file.replace("'", "''")
    for name in ("iqr_flags", "iqr_flags_only", "iqr_cpu_flags", "iqr_cpu_flags_groupby"):
        row = sql.sql(spark, f"SELECT count(*) AS n, count(*) FILTER (WHERE is_outlier) AS o FROM {name}('{quoted}', 'v') -- {name}('x', 'y')").first()
        assert (row.n, row.o) == (30_000, 30)
    assert sql.sql(spark, f"SELECT 'iqr_flags(''a'', ''b'')' AS s, count(*) AS n FROM read_columns('{quoted}') WHERE v >= 5000000").first().asDict() == {"s": "iqr_flags('a', 'b')", "n": 30}
    assert sql.sql(spark, "SELECT * FROM decoder_profiler()").columns[0] == "lane"
    assert sql.sql(spark, "SELECT * FROM iqr_profiler()").count() == 1
    with pytest.raises(ValueError):
        sql.sql(spark, f"SELECT * FROM iqr_flags('{quoted}')")


@pytest.mark.parametrize("make", [datagen.uniform, datagen.drifting])
def test_order_does_not_mislead(spark, make):
    df = make(spark, 100_000, every=1000)
    assert flags.iqr_flags(df, "v", index=F.col("i")).where("is_outlier").count() == 100
    assert flags.iqr_exact(df, "v", "zoom").where("is_outlier").count() == 100


def test_profile_of_idle_lane(spark):
    df = spark.createDataFrame([(0, *[0] * 8), (1, 8, 1, 1, 2, 4, 0, 4, 8)], "lane int, " + ", ".join(f"{c} long" for c in profile.COUNTERS))
    rows = {r.lane: r for r in profile.throughput(df).collect()}
    assert rows[0].in_gbps == 0 and rows[1].in_gbps == pytest.approx(8 * 64 / (12 * 4)) and rows[1].in_gbps_excl_idle == pytest.approx(8 * 64 / (10 * 4))
    assert profile.shares(df).where("lane = 0").first().busy_pct is None


def test_settings(spark):
    s = settings.Settings()
    s.set(spark, "logging_level", "error")
    assert s.get("logging_level") == "ERROR"
    for name, bad in (("logging_level", "loud"), ("scheduler_num_streams", 0), ("scheduler_queue_depth", 0), ("remote_port", 70_000)):
        with pytest.raises(ValueError):
            s.set(spark, name, bad)
    with pytest.raises(KeyError):
        s.set(spark, "other", 1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    s.set(spark, "scan_groups_in_flight", 1)
    assert s.get("scan_groups_in_flight") == 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_running_fences(spark, tmp_path):
    df = datagen.planted(spark, 4000, levels=1000)
    for part in range(4):
        df.where(F.col("i") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = RunningFences(spark, str(tmp_path / "state"), "v")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state.start(stream, str(tmp_path / "check")).awaitTermination(120)
    from tukeyframe.functions import fences
    from tukeyframe.operators import quartiles

    assert state.last == 3 and state.fences().first() == fences.fences(quartiles.cdf(df, "v"), df.schema["v"].dataType).first()


def test_windowed_counts(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' + make_interval(0,0,0,0,0,i) AS ts, i AS v FROM (SELECT explode(sequence(0, 9)) AS i)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v int").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "v").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.total) for r in spark.table("windows").orderBy("window").collect()] == [(4, 6), (5, 30), (1, 9)]


def test_timing(spark):
    out = timing.medians({"a": lambda: spark.range(10), "b": lambda: spark.range(10)}, repeats=2)
    assert out["a"]["ratio"] == 1 and out["b"]["median_s"] > 0
    rows = timing.sweep({"1k": datagen.planted(spark, 1000, levels=100)}, {"cdf": lambda d: flags.iqr_exact(d, "v", "cdf")}, {"1k": 1}, repeats=1)
    assert rows[0]["point"] == "1k"
    with pytest.raises(ArithmeticError):
        timing.sweep({"1k": datagen.planted(spark, 1000, levels=100)}, {"none": lambda d: d.selectExpr("false AS is_outlier")}, {"1k": 1})
    assert timing.line([(0, 1), (1, 3)]) == (2, 1) and set(timing.phases({"x": lambda: None})) == {"x"}


def test_positions_over_several_files(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("i"), (F.col("id") * 7919 % 997).alias("v"))
    for name, n in (("one", 1), ("many", 9)):
        df.repartitionByRange(n, "i").sortWithinPartitions("i").write.parquet(str(tmp_path / name))
    scans = [parquet.with_position(parquet.scan(spark, str(tmp_path / n))) for n in ("one", "many")]
    assert all(x.where("position <> i").isEmpty() and x.count() == 5000 for x in scans)
    assert parquet.positional_zip(scans[0].select("position", "i"), scans[1].select("position", "v")).count() == 5000
    windows = [flags.iqr_flags(str(tmp_path / n), "v", sample=100).groupBy("is_outlier").count().collect() for n in ("one", "many")]
    assert windows[0] == windows[1]


def test_row_groups_are_pruned(spark, tmp_path):
    parquet.write(spark.range(200_000).coalesce(1), str(tmp_path / "groups"), row_group_bytes=1 << 16, dictionary=False)
    assert len({r.row_group_id for r in parquet.row_groups(spark, str(tmp_path / "groups")).collect()}) > 5
    found = parquet.scan(spark, str(tmp_path / "groups"), where="id BETWEEN 1000 AND 1010")
    assert found.count() == 11
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.queryExecution().executedPlan().execute().count()
    read = [s for s in str(plan).split("\n") if "PushedFilters" in s]
    assert "GreaterThanOrEqual(id,1000)" in read[0] and "LessThanOrEqual(id,1010)" in read[0]
    scan = plan.collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 200_000 / 3


def test_parts_are_summed_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(mask, "PARTS", 3)
    rows = [(p, (p * 5) % 7) for p in range(20)]
    found = {r.part: r.start for r in mask.part_starts(spark.createDataFrame(rows, "part long, rows long")).collect()}
    assert found == {p: sum(n for q, n in rows if q < p) for p, _ in rows}


def test_count_by_zoom_against_every_method(spark):
    wide = spark.range(3000).select(F.expr("CAST(pow(-1, id % 2) * pow(1.02, id % 2100) AS BIGINT) + id AS v"))
    odd = [wide, wide.selectExpr("CASE WHEN v % 5 <> 0 THEN v END AS v"), wide.where("v > 1e30"), wide.selectExpr("-abs(v) AS v"), spark.sql("SELECT explode(array(-9223372036854775808, -5, 0, 0, 3, 9223372036854775807)) AS v")]
    for df in odd:
        want = flags.count_outliers(df, "v", "cdf").first()
        assert flags.count_outliers(df, "v").first() == want
        assert flags.count_from_counts(df, "v").first() == (df.where("v IS NOT NULL").count(), want.n_outliers)


def test_codec_files(spark, tmp_path):
    files = datagen.codecs(spark, str(tmp_path), 20_000, (1000, 10_000))
    assert len(files) == 8
    for name, path in files.items():
        assert flags.count_outliers(path, "v").first()["n_outliers"] == 20
        kinds = {r.compression for r in parquet.row_groups(spark, path).collect()}
        assert kinds == {"SNAPPY" if "snappy" in name else "UNCOMPRESSED"}
    datagen.check_cardinality(spark.range(50).selectExpr("id % 7 AS v"), 7)
    with pytest.raises(ArithmeticError):
        datagen.check_cardinality(spark.range(50).selectExpr("id % 7 AS v"), 8)


def test_campaign_and_sweeps(spark, tmp_path, file):
    out = timing.campaign({"good": lambda: spark.range(10).count(), "bad": lambda: 1 / 0, "slow": lambda: spark.range(10**13).selectExpr("sum(id % 7)").collect()}, 3)
    assert out["good"]["error"] is None and "ZeroDivisionError" in out["bad"]["error"] and out["slow"]["over"]
    assert timing.progress(spark) == 100.0
    rows = timing.sweep(timing.in_parts(datagen.planted(spark, 3000, levels=100), (1, 3)), {"zoom": lambda d: flags.iqr_exact(d, "v")}, {"1": 3, "3": 3}, repeats=1)
    rows += timing.sweep({"file": spark.range(1)}, timing.window_groups(file, "v", (2, 4), group_rows=1000), {"file": 30}, repeats=1)
    timing.to_csv(rows, str(tmp_path / "sweep.csv"))
    assert len((tmp_path / "sweep.csv").read_text().splitlines()) == 5


def test_views_of_sql_are_released(spark, file):
    quoted = file.replace("'", "''")
    rows = sql.sql(spark, f"SELECT count(*) AS n FROM iqr_flags('{quoted}', 'v')")
    assert sql.release(spark) >= 1 and sql.release(spark) == 0 and rows.first().n == 30_000
