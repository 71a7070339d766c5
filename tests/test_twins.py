"""Every registered query against its SQL twin."""

import math

import duckdb
import pytest

from marketlens.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
# Row-wise Python, all-pairs joins and single-task steps have no place in a SQL-expressible
# query.
UNSCALABLE = ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct",
              "BroadcastNestedLoopJoin", "Exchange SinglePartition, REPARTITION")
QUERIES, TWINS = catalog.queries(), catalog.twins()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


@pytest.mark.parametrize("key", sorted(TWINS))
def test_twin(spark, duck, sf_dir, key):
    df = QUERIES[key](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [operator for operator in UNSCALABLE if operator in plan]
    result = duck.execute(TWINS[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    expected = sorted(tuple(cell(row[i]) for i in order) for row in result.fetchall())
    actual = sorted(tuple(cell(v) for v in row) for row in df.collect())
    assert len(actual) > 0
    assert actual == expected


def test_every_key_has_rows_or_twin():
    assert set(TWINS) <= set(QUERIES)
    assert len(QUERIES) >= 125


ROW_ONLY = sorted(set(QUERIES) - set(TWINS))


@pytest.mark.parametrize("key", ROW_ONLY)
def test_rows_only(spark, sf_dir, key):
    rows = QUERIES[key](spark, sf_dir).collect()
    assert rows
    if "p_down" in rows[0]:
        for r in rows:
            assert abs(r["p_down"] + r["p_neutral"] + r["p_up"] - 1) < 1e-6
            assert r["prediction"] in (0, 1, 2)
