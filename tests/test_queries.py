"""Every registered query of the library's own runs on the smallest tables and agrees with its SQL."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from faultline.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(value.item() if hasattr(value, "item") else value)


def table_of(pdf):
    return sorted(tuple(map(plain, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the standard tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert table_of(got) == table_of(want)


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
    if Path(SF).exists():
        assert entry.entry(spark).limit(1).count() == 1


def test_queries_stay_without_the_extras():
    """A module that the extras need and that is missing costs the extras only."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
