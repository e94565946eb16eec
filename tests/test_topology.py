"""Noding and geometry on small fixtures."""

import math
import random

import numpy as np
import pytest

from waymark.operators import graph, planar, topology
from waymark.params import Topology

COORDS = topology.COORDS


def lines(spark, *pts, start=0):
    return spark.createDataFrame([(start + k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, p in enumerate(pts)], f"id long, coords {COORDS}")


def trails(spark, *pts):
    return lines(spark, *pts).selectExpr("id AS trail_id", "concat('T', id) AS name", "coords")


def cut_ends(df) -> dict:
    out: dict = {}
    for r in df.orderBy("id", "seq").collect():
        out.setdefault(r.id, []).append(round(r.length_m, 6))
    return out


def test_crossing_lines_are_cut_at_the_crossing(spark):
    got = cut_ends(topology.split(lines(spark, [(0, 0), (200, 0)], [(50, -80), (50, 120)])))
    assert got == {0: [50, 150], 1: [80, 120]}


def test_a_line_that_ends_near_another_cuts_it(spark):
    assert cut_ends(topology.split(lines(spark, [(0, 0), (200, 0)], [(120, 10), (120, 90)]))) == {0: [120, 80], 1: [80]}
    assert cut_ends(topology.split(lines(spark, [(0, 0), (200, 0)], [(120, 30), (120, 90)]))) == {0: [200], 1: [60]}


def test_a_shared_stretch_is_cut_at_both_ends(spark):
    got = cut_ends(topology.split(lines(spark, [(0, 0), (300, 0)], [(100, 80), (100, 0), (200, 0), (200, 80)])))
    assert got == {0: [100, 100, 100], 1: [80, 100, 80]}


def test_thinning_is_greedy_from_the_last_kept():
    assert planar.thin(np.array([5.0, 12.0, 20.0, 28.0, 95.0]), 100.0, 10.0).tolist() == [0, 12, 28, 100]
    assert planar.thin(np.array([]), 5.0, 10.0).tolist() == [0, 5]


def test_network_of_a_cross(spark):
    edges, nodes = topology.build(trails(spark, [(0, 0), (200, 0)], [(100, -100), (100, 100)]))
    assert edges.count() == 4 and nodes.count() == 5
    assert sorted(r.degree for r in graph.degrees(edges).collect()) == [1, 1, 1, 1, 4]
    for r in edges.collect():
        n = {x.node_id: (x.x, x.y) for x in nodes.collect()}
        assert (r.coords[0].x, r.coords[0].y) == n[r.u] and (r.coords[-1].x, r.coords[-1].y) == n[r.v]


def test_loops_stay_and_slivers_go(spark):
    rows = [(0, 1, 1, 200.0), (1, 1, 1, 5.0), (2, 1, 2, 5.0), (3, 1, 2, 1e-9)]
    df = spark.createDataFrame(rows, "edge_id long, u long, v long, length_m double")
    assert [r.edge_id for r in topology.without_degenerate(df).orderBy("edge_id").collect()] == [0, 2]


def test_orphan_roads_are_pruned_and_islands_joined(spark):
    t = trails(spark, [(0, 0), (100, 0)], [(500, 0), (600, 0)])
    roads = spark.createDataFrame([("link", [{"x": 100.0, "y": 0.0}, {"x": 500.0, "y": 0.0}]), ("far", [{"x": 5000.0, "y": 0.0}, {"x": 5100.0, "y": 0.0}])], f"name string, coords {COORDS}")
    edges, nodes = topology.build(t, roads)
    assert sorted(r.name for r in edges.collect()) == ["T0", "T1", "link"] and sorted(r.node_id for r in nodes.collect()) == [0, 1, 2, 3]
    assert graph.components(edges).select("component").distinct().count() == 1
    alone, _ = topology.build(t)
    assert graph.components(alone).select("component").distinct().count() == 2


@pytest.mark.parametrize("x,more_edges,more_nodes", [(100.0, 2, 2), (5.0, 1, 1)])
def test_depot(spark, x, more_edges, more_nodes):
    t = trails(spark, [(0, 0), (200, 0)])
    plain, nodes = topology.build(t)
    edges, with_depot = topology.build(t, depot=(x, 40.0))
    assert edges.count() == plain.count() + more_edges and with_depot.count() == nodes.count() + more_nodes
    assert with_depot.where("is_depot").count() == 1 and edges.where("trail_id is null").count() == 1
    scored = edges.where("trail_id is not null").agg({"length_m": "sum"}).first()[0]
    assert math.isclose(scored, 200.0)


def test_road_gaps_are_filled_up_to_a_limit(spark):
    road = lines(spark, [(0, 0), (3000, 0)])
    near = lines(spark, [(0, 100), (400, 100)], [(1400, 100), (1700, 100)], [(2980, 100), (3000, 100)])
    got = topology.clip_roads(road, near).orderBy("part").collect()
    reach = math.sqrt(250**2 - 100**2)
    ends = [(r.coords[0].x, r.coords[-1].x) for r in got]
    want = [(0.0, 1700 + reach)] if 1400 - reach - (400 + reach) <= 800 else None
    assert want and len(ends) == 2 and np.allclose(ends[0], want[0], atol=0.01) and np.allclose(ends[1], (2980 - reach, 3000.0), atol=0.01)


def test_close_pairs_equal_brute_force(spark):
    rnd = random.Random(1)
    p = [(k, rnd.uniform(0, 300), rnd.uniform(0, 300)) for k in range(400)]
    df = spark.createDataFrame(p, "id long, x double, y double")
    got = {(r.a_id, r.b_id) for r in topology.close_pairs(df, df, 12.0).collect()}
    assert got == {(a, b) for a, ax, ay in p for b, bx, by in p if math.hypot(ax - bx, ay - by) <= 12.0}


def test_interval_merge_uses_the_farthest_end(spark):
    df = spark.createDataFrame([(1, 0.0, 100.0), (1, 10.0, 20.0), (1, 105.0, 110.0), (1, 200.0, 210.0)], "k long, lo double, hi double")
    got = sorted(tuple(r) for r in topology.merge_intervals(df, ["k"], "lo", "hi", 5.0).collect())
    assert got == [(1, 0.0, 110.0, 3), (1, 200.0, 210.0, 1)]
    assert planar.merge_gaps([(0, 100), (10, 20), (105, 110), (200, 210)], 5) == [(0, 110), (200, 210)]


def test_junction_band(spark):
    df = lines(spark, [(0, 0), (200, 0)], [(100, 25), (100, 90)], [(50, 10), (50, 90)])
    assert [(r.id, r.which, r.other, r.gap) for r in topology.junction_band(df, 18.0, 40.0).collect()] == [(1, "start", 0, 25.0)]


def test_geometry():
    rnd = np.random.default_rng(2)
    a = rnd.uniform(0, 100, (30, 2))
    d, gap = planar.project(a, a)
    assert np.allclose(gap, 0) and np.allclose(planar.at(a, planar.measure(a)), a)
    part = planar.substring(a, 50.0, 120.0)
    assert math.isclose(planar.length(part), 70.0)
    flat = np.array([[0, 0], [1, 0.1], [2, -0.1], [3, 0], [3, 5.0]])
    assert planar.simplify(flat, 0.5).tolist() == [[0, 0], [3, 0], [3, 5]]
    stations = planar.densify(a, 10.0)
    assert (np.diff(stations) <= 10 + 1e-9).all() and set(planar.measure(a)) <= set(stations)
    x, y = planar.transverse_mercator(np.array([-87.0]), np.array([0.0]), -87.0)
    assert math.isclose(x[0], 500_000.0) and abs(y[0]) < 1e-6
    _, y = planar.transverse_mercator(np.array([-87.0]), np.array([45.0]), -87.0)
    assert abs(y[0] - 4_982_950.4) < 1.0  # metres along the central meridian, times the scale


def test_tolerance_sweep_only_ever_joins(spark):
    t = trails(spark, [(0, 0), (100, 0)], [(110, 0), (200, 0)], [(230, 0), (300, 0)])
    got = topology.tolerance_sweep(t, [1.0, 12.0, 40.0]).orderBy("tolerance").collect()
    assert [r.components for r in got] == [3, 2, 1]
