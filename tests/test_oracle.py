"""Every query that has a DuckDB twin gives the same rows, at the smallest scale."""

import glob
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None:
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = oracle.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted(tuple(map(norm, r)) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n in QUERIES.keys() - SQL.keys() if not n.startswith("op") and n != "pipeline"))
def test_others_give_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_only_the_entry_knows_the_optional_part():
    """Nothing in the library imports the subpackage of training-data operators."""
    import re
    from pathlib import Path

    root = Path(entry.__file__).parent / "citelab"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"citelab\.llm|from citelab import llm|corpus_pipeline", f.read_text()), f
