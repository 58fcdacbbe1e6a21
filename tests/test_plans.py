"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import datetime as dt
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

from casemill import plans  # noqa: E402


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, dt.datetime):
        return x.date().isoformat()
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, db, name):
    df = plans.queries()[name](spark, DATA)
    rel = db.sql(plans.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.queries()) <= set(__spark_entry__.queries())


#: Queries of the citation graph over orders of 60 times sf0.1 (volumes of five digits; some numbers between the orders are missing).
GRAPH = ["citation_edges", "most_cited", "citation_dates", "citations_between_topics", "citation_path", "citation_rank"]


@pytest.fixture(scope="module")
def late_orders(tmp_path_factory):
    wanted, todo = set(), [8_999_999, 8_999_990, 6_000_000, 4_950_000, 1_448_365, 965_576, 33_000, 1, 0]
    while todo:
        key = todo.pop()
        if key not in wanted:
            wanted.add(key)
            todo += [key * 2 // 3, key // 5] if key % 7 else [key * 2 // 3]
    at = tmp_path_factory.mktemp("late")
    c = duckdb.connect()
    c.execute("CREATE TABLE k AS SELECT unnest(?) AS o_orderkey", [sorted(wanted)])
    c.execute(
        f"""COPY (SELECT o_orderkey, o_orderkey % 1000 AS o_custkey, TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (o_orderkey % 900) AS o_orderdate,
        CAST(o_orderkey % 5 AS VARCHAR) AS o_orderpriority FROM k) TO '{at}/orders.parquet'"""
    )
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{at}/orders.parquet'")
    return str(at), c


@pytest.mark.parametrize("name", GRAPH)
def test_citation_graph_of_late_orders_equals_sql(spark, late_orders, name):
    at, c = late_orders
    df, rel = plans.queries()[name](spark, at), c.sql(plans.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall()) != []
