"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from waymark.plans import catalogue, operator_queries  # noqa: F401 (registers its queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def printed(v) -> str:
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows_of(names: list[str], rows) -> list:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(printed(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1000
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_whole_graph_of_orders_and_parts(spark, con):
    """Components, degrees and dangles over all lineitem rows, by brute force."""
    edges = set(con.execute("SELECT l_orderkey, -l_partkey FROM lineitem").fetchall())
    parent, degree = {}, {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
        for x in (u, v):
            degree[x] = degree.get(x, 0) + 1
    q = catalogue.QUERIES
    assert {r.node: r.component for r in q["components_whole"](spark, SF).collect()} == {x: root(x) for x in degree}
    assert {r.node: r.degree for r in q["node_degree_whole"](spark, SF).collect()} == degree
    assert {r.node for r in q["dangles_whole"](spark, SF).collect()} == {x for x, n in degree.items() if n == 1}


def test_ways_over_all_arcs_by_dijkstra(spark, con):
    import heapq

    flow = con.execute("SELECT c_nationkey, s_nationkey, count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL").fetchall()
    out, want = {}, {}
    for u, v, n in flow:
        out.setdefault(u, []).append((v, float(n)))
    for src in {x for u, v, _ in flow for x in (u, v)}:
        heap = [(0.0, src)]
        while heap:
            d, x = heapq.heappop(heap)
            if (src, x) not in want:
                want[src, x] = d
                for v, n in out.get(x, ()):
                    heapq.heappush(heap, (d + n, v))
    assert {(r.src, r.dst): r.time_s for r in catalogue.QUERIES["apsp_nations_whole"](spark, SF).collect()} == want
