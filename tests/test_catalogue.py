import math

import duckdb
import pytest

from phenoweave.catalogue_models import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, con, name):
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    key = lambda row: [(v is None, str(v)) for v in row]
    got = sorted(([plain(v) for v in r] for r in df.select(names).collect()), key=key)
    ref = sorted(([plain(v) for v in r] for r in want.fetchall()), key=key)
    assert len(ref) > 0
    assert got == ref
