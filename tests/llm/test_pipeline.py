import importlib.util

import pytest

from tests.llm.test_neardup import plain

pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else pytest.skip("the pipeline isn't there", allow_module_level=True)

from tukeyframe.llm import packing, secrets  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    odd = spark.createDataFrame([(100_000, "12 !!", "en", "s", 5), (100_001, None, "en", "s", 0), (100_002, items[0] + " and more", "en", "s", 9), (3, docs.where("doc_id = 3").first().text, "en", "s", 1)], docs.schema)
    before = docs.unionByName(odd)
    names, steps = [n for n, _ in pipeline.STAGES], {}
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    for name, stage in pipeline.STAGES:
        after = stage(spark, before, DATA).cache()
        steps[name] = before.collect(), after.collect()
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    was, now = steps["language_id"]
    assert {r.doc_id for r in was} - {r.doc_id for r in now} == {100_000, 100_001}
    was, now = steps["near_dedup"]
    kept = {k for k, _, _, kept in plain([(r.doc_id, r.text) for r in was]) if kept}
    assert sorted(r.doc_id for r in now) == sorted(kept)
    was, now = steps["decontamination"]
    flat = lambda t: " ".join(t.split())
    assert {r.doc_id for r in was} - {r.doc_id for r in now} == {r.doc_id for r in was if any(flat(x) in flat(r.text) for x in items)}
    was, now = steps["secret_scan"]
    assert [r.doc_id for r in was] == [r.doc_id for r in now]
    assert all(not secrets.spans(r.text) and r.n_chars == len(r.text) for r in now)
    assert all(a.text == b.text for a, b in zip(was, now, strict=True) if not secrets.spans(a.text))
    was, now = steps["packing"]
    pieces = {}
    for r in sorted(now, key=lambda r: r.piece):
        pieces[r.doc_id] = pieces.get(r.doc_id, "") + r.text
    assert pieces == {r.doc_id: r.text for r in was}
    bins = {}
    for r in now:
        bins.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.n_tokens))
    for (_, capacity), own in bins.items():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and capacity == min(c for c in packing.CAPACITIES if c >= ends[-1])


def test_clashing_columns_and_odd_rows(spark, tmp_path):
    spark.read.parquet(f"{DATA}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    long = "the quiet river runs past the old mill and " * 20_000
    rows = [(i, f"document number {i} of this set says that {w} is {w} and nothing else today", "en") for i, w in enumerate("one two three four five six seven eight nine ten eleven".split())]
    rows += [(20, long, "en"), (None, "a document without an id that is kept as it is", "en"), (21, None, "en"), (22, "", None), (23, rows[3][1], "en"), (3, rows[3][1], "en")]
    names = "score double, lang_pred string, _key long, _found string, shard string, contaminated long, spans string"
    extra = (0.25, "mine", 7, "found", "s", 8, "t")
    docs = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, " + names)
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        before = stage(spark, before, str(tmp_path))
        assert before.columns == docs.columns
    kept = before.collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([*range(11), 20, None], key=str)
    assert all(tuple(r)[3:] == extra for r in kept) and max(len(r.text) for r in kept) == len(long)
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.collect() == []


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert found["pipeline"] is pipeline.run and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in found}
