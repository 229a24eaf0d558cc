import pytest

from tukeyframe.llm import native, scratch


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Key long, key_ long, other long")
    assert native.fresh(df, "key") == "key__" and native.fresh(df, "new") == "new"


def test_batches_are_only_made_smaller(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for now, then in (("10000", str(scratch.ARROW_ROWS)), ("0", str(scratch.ARROW_ROWS)), ("7", "7")):
            spark.conf.set(name, now)
            scratch.text_batches(spark.range(1))
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)


def test_tables_are_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    table = scratch.materialise(spark.range(5), "numbers")
    files = table.inputFiles()
    assert table.count() == 5 and files
    scratch.clear(spark)
    assert not [p for p in tmp_path.iterdir() if p.is_dir()]
    with pytest.raises(Exception, match="(?i)not.*exist"):
        spark.read.parquet(files[0])


def test_the_shared_folder_has_a_scheme(spark):
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default=None):
            return self.value

    class Session:
        sparkContext = spark.sparkContext

        def __init__(self, value):
            self.conf = Conf(value)

    assert scratch.shared_dir(Session("/tmp/some/")) == scratch.shared_dir(Session("file:///tmp/some")) == "file:///tmp/some"
    made = scratch.shared_dir(Session(None))
    assert made.startswith("file:///") and made == scratch.shared_dir(Session(None))
