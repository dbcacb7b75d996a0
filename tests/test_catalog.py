"""Every registered query against its SQL, at the smallest scale; and the driver's contract."""

import glob
import importlib
import os
import subprocess
import sys

import duckdb
import pytest

from cellweave.plans import catalog, exchange, stored, wide

assert exchange and stored and wide  # their queries register in the catalog
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert got == sorted(tuple(repr(r[i]) for i in place) for r in found.fetchall())


def test_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0


def test_entry_imports_without_the_corpus_operators():
    code = "import sys; sys.modules['cellweave.llm'] = None; import __spark_entry__ as e; assert 'adapt_full' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))
