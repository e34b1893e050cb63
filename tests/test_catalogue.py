"""Every registered query with a twin gives what the twin gives, over whole tables."""

import math
from pathlib import Path

import pytest

from trellis.plans import catalogue

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the given tables are not here")
duckdb = pytest.importorskip("duckdb")


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted((tuple(_cell(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in catalogue.SQL:
        rel = con.sql(catalogue.SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted((tuple(_cell(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_nothing_outside_imports_the_training_data_subpackage():
    root = Path(__file__).resolve().parent.parent / "trellis"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "trellis.llm" not in p.read_text(), p
