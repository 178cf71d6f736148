"""Every query with SQL against DuckDB on the smallest tables, and every other one for its rows."""

import importlib.util
import re
import sys
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("compare", Path(__file__).parent.parent / "tools" / "compare.py")
compare = importlib.util.module_from_spec(spec)
sys.modules["compare"] = compare
spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equal(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([compare.cell(v) for v in r] for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    assert got == sorted(([compare.cell(r[have.index(c)]) for c in cols] for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not re.match(r"p\d+_", n)))
def test_rows(spark, name):
    """Queries SQL cannot say (those of the training-data problems have tests of their own): they run whole, have rows, and no column of the result is null throughout."""
    df = entry.queries()[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    assert rows or name in ("logit_p_values",)
    assert all(any(r[c] is not None for r in rows) for c in df.columns)
