"""Graph queries over every row of lineitem, against brute force and their SQL."""

import duckdb
import pytest

import __spark_entry__
from tessera.operators import graph


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    # Few lines have a quantity of 50; two of the four components have none of them.
    lines = [(k, p, s, float(q), 0.1 if q == 50 else 0.0) for k, (p, s, q) in enumerate([(1, 1, 50), (1, 2, 3), (2, 2, 4), (3, 3, 50), (4, 3, 9), (5, 4, 1), (6, 4, 2), (6, 4, 2), (7, 5, 8)])]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double"),
        "orders": ([(k, (k * 2) % 5) for k in range(9)], "o_orderkey long, o_custkey long"),
        "supplier": ([(s, s % 4) for s in range(1, 6)], "s_suppkey long, s_nationkey long"),
        "nation": ([(n, n) for n in range(4)], "n_nationkey long, n_regionkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("most", [0, 3, 1_000_000])
def test_components_of_every_edge(spark, folder, monkeypatch, most):
    monkeypatch.setattr(graph, "TASK_EDGES", most)
    found = {r.v: r.component for r in __spark_entry__.queries()["components"](spark, folder).collect()}
    groups = [["p1", "p2", "s1", "s2"], ["p3", "p4", "s3"], ["p5", "p6", "s4"], ["p7", "s5"]]
    assert found == {v: g[0] for g in groups for v in g}


@pytest.mark.parametrize("name", ["degree_rank", "hops2", "visible_nodes_edges", "symmetric_dedupe"])
def test_every_line_counts(spark, folder, name):
    db = duckdb.connect()
    for table in ("lineitem", "orders", "supplier", "nation"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found = sorted(map(tuple, __spark_entry__.queries()[name](spark, folder).collect()))
    assert found and found == sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())
