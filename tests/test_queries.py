"""Every registered query of this part against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import flow_oracles, flows, oracles, queries

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES | flows.QUERIES, oracles.ORACLES | flow_oracles.ORACLES


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = tables.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert got == want
