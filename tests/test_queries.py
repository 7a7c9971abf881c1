"""Every registered query of the core against its SQL on the smallest tables."""

import os
import sys
from collections import Counter

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

import __spark_entry__ as entry  # noqa: E402

CORE = [n for m in entry._modules() if not m.__name__.startswith("lodestrand.llm") for n in m.QUERIES]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        con.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    from compare import plain

    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name in entry.oracle_sql():
        cur = duck.execute(entry.oracle_sql()[name])
        have = [d[0] for d in cur.description]
        assert sorted(have) == cols
        assert mine == Counter(tuple(plain(r[have.index(c)]) for c in cols) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "title", "namespace", "score", "snippet"]
