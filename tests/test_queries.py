"""Every query of the registry against its SQL at the smallest scale."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tukeyframe.plans import oracle, registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 8) if isinstance(value, float) else value


@pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't there")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in oracle.SQL:
        assert rows
        return
    found = con.execute(oracle.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(plain(r[columns.index(c)]) for c in df.columns) for r in found.fetchall())
    assert Counter(tuple(map(plain, r)) for r in rows) == want


def test_golden_counts(spark):
    if Path("/root/testdata/sf0.01").exists():
        got = {name: tuple(registry.QUERIES[f"iqr_exact_count_{name}"](spark, "/root/testdata/sf0.01").first()) for name in ("events", "documents", "customer", "extprice")}
        assert got == {"events": (10_000, 463), "documents": (1000, 95), "customer": (1500, 0), "extprice": (60_000, 0)}
