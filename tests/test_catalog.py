"""Every query with SQL against DuckDB on the same tables; the others run and give rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog, catalog_options  # noqa: F401


@pytest.fixture(scope="module")
def con(sf_dir):
    found = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def key(row):
    return tuple("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(name, spark, sf_dir, con):
    df = catalog.QUERIES[name](spark, sf_dir)
    expected = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in expected.description]
    rows = expected.fetchall()
    assert sorted(df.columns) == sorted(names)
    found = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    assert len(found) == len(rows) > 0
    for one, two in zip(sorted(found, key=key), sorted(rows, key=key), strict=True):
        for a, b in zip(one, two, strict=True):
            if isinstance(a, float) or isinstance(b, float):
                assert a == b or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6), (one, two)
            else:
                assert a == b, (one, two)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
