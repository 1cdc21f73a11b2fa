"""Every catalogue query against its DuckDB oracle on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from flowlattice.plans import catalog

DATA = Path("/root/testdata/sf0.001")
SLOW = {"tree_importance", "walk_forward_trees"}  # dozens of fits; test_models covers them
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6f}" if isinstance(v, int | float) else str(v)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, str(DATA))
    rows = [tuple(r) for r in frame.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert canonical(rows, frame.columns) == canonical(found.fetchall(), names)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
