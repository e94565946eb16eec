"""The whole way from tracks to a plan, and the integer program of a small network."""

import json
import math

import numpy as np
import pytest

from tests.test_planning import RACE, network, steps_of
from waymark.operators import graph, model, planar, scoring, search, topology
from waymark.operators.rules import Rule
from waymark.params import Params
from waymark.plans import network as plan


def tracks(spark):
    ring = [(300 * math.cos(k / 3), 300 * math.sin(k / 3)) for k in range(19)]
    rows = [(1, "Ring", ring + [ring[0]]), (2, "North", [(0, 0), (0, 500)]), (3, "East", [(0, 0), (500, 0)]), (4, "West", [(0, 0), (-500, 20)])]
    return spark.createDataFrame([(i, n, [{"x": float(x), "y": float(y)} for x, y in p]) for i, n, p in rows], f"trail_id long, name string, coords {topology.COORDS}")


def test_tracks_to_plan(spark, tmp_path):
    p = Params().with_(race={"budget_s": 3000.0})
    pixels = spark.range(0, 130).withColumnRenamed("id", "row").join(spark.range(0, 130).withColumnRenamed("id", "col"), how="cross").selectExpr("row", "col", "row * 0.5 AS z")
    raster = {"x0": -650.0, "y0": 650.0, "resolution": 10.0, "rows": 130, "cols": 130}
    out = str(tmp_path / "o")
    report = plan.run(spark, tracks(spark), out, (0.0, -30.0), pixels=pixels, raster=raster, params=p, seeds=2, iterations=40)
    assert report["failed"] == {} and report["score"] >= max(report["baselines"].values()) - 1e-9 and report["bound"] >= report["score"] - 1e-6 and report["time_s"] <= 3000
    assert json.loads(spark.read.text(f"{out}/report").first().value)["score"] == report["score"]
    cues = spark.read.csv(f"{out}/cues", header=True).collect()
    assert cues[0].turn == "start" and float(cues[-1].running_score) == pytest.approx(report["score"], abs=0.01)
    doc = json.loads(spark.read.text(f"{out}/document").first().value)
    assert doc["totals"]["score"] == pytest.approx(report["score"]) and len(doc["trails"]) == 4
    assert spark.read.parquet(f"{out}/nodes").where("is_depot").count() == 1
    again = plan.run(spark, tracks(spark).limit(0), out, (0.0, -30.0), params=p, seeds=1, iterations=10)
    assert again["arcs"] > 0  # stages that are there are read


def test_program_holds_for_real_walks(spark):
    edges = network(spark, 5).cache()
    arcs = graph.arcs(edges).cache()
    p = search.problem(arcs, graph.shortest(arcs), graph.chains(edges), 0)
    trails = edges.where("trail_id is not null").select("trail_id", "edge_id")
    walk = search.large_neighbourhood(p, 1, 60, RACE)["walk"]
    kinds = model.variables(arcs, trails, RACE)
    have = p.edges(walk)
    done = [t for t, n in p.needs.items() if n <= have]
    values = {f"z_{e}": 1.0 for e in have} | {f"y_{t}": 1.0 for t in done}
    nodes = {p.arcs[a][2] for a in walk}
    values |= {f"p_{n}": 1.0 for n in nodes}
    for a in walk:
        values[f"x_{a}"] = values.get(f"x_{a}", 0.0) + 1
    left, carried = set(nodes) - {0}, {}
    for a in walk:  # flow: carry a unit for every node not reached yet
        carried[a] = carried.get(a, 0.0) + len(left)
        left.discard(p.arcs[a][2])
    values |= {f"g_{a}": g for a, g in carried.items()}
    df = spark.createDataFrame(list(values.items()), "variable string, value double")
    score = p.score(have, RACE)
    heads, terms = model.constraints(arcs, trails, 0, RACE, Rule("r", require=(done[0],)), incumbent=score)
    assert model.violated(heads, terms, df).count() == 0
    goal = df.join(kinds, "variable").selectExpr("sum(value * objective) AS s").first().s
    assert goal == pytest.approx(score)
    broken = df.where(f"variable <> 'x_{walk[0]}'")
    assert {r.row.split("_")[0] for r in model.violated(heads, terms, broken).collect()} & {"balance", "used", "carried"}
    shut = model.constraints(arcs, trails, 0, RACE, Rule("f", forbid=(done[0],)))
    assert {r.row.split("_")[0] for r in model.violated(*shut, df).collect()} == {"forbid"}
    back = [r.arc_id for r in model.walk_of(df, arcs, 0).orderBy("pos").collect()]
    assert sorted(back) == sorted(walk)
    text = model.lp_text(kinds, heads, terms).first().document
    assert text.startswith("Maximize\n obj: ") and "budget_all:" in text and text.rstrip().endswith("End")
    assert model.gap_percent(10.0, 11.0) == pytest.approx(10.0) and model.gap_percent(10.0, 9.0) == 0.0


def test_flexible_plans_hold_the_floor(spark):
    edges = network(spark, 6)
    arcs = graph.arcs(edges)
    p = search.problem(arcs, graph.shortest(arcs), graph.chains(edges), 0)
    plain = search.large_neighbourhood(p, 1, 60, RACE)
    flexible = search.adaptive(p, 1, 120, plain["score"] - 3.0, RACE)
    assert flexible["score"] >= plain["score"] - 3.0 - 1e-9
    steps = steps_of(spark, p, flexible["walk"])
    assert scoring.score(steps, ["route_id"], "edge_id", edges, edges.where("trail_id is not null").select("trail_id", "edge_id"), RACE).first().score == pytest.approx(flexible["score"])


def test_projection_round_trip(spark):
    lon, lat = np.array([-86.7, -86.9, -87.3]), np.array([33.3, 33.4, 33.9])
    x, y = planar.transverse_mercator(lon, lat, -87.0)
    back = planar.inverse_mercator(x, y, -87.0)
    assert np.allclose(back[0], lon, atol=1e-9) and np.allclose(back[1], lat, atol=1e-9)
    df = spark.createDataFrame([(1, [{"x": float(a), "y": float(b)} for a, b in zip(lon, lat)])], f"id long, coords {topology.COORDS}")
    metres = topology.projected(df, -87.0)
    again = topology.projected(metres, -87.0, back=True).first().coords
    assert np.allclose([p.x for p in again], lon, atol=1e-9)
    assert topology.published_lines(metres, -87.0).first().coords == [[33.3, -86.7], [33.4, -86.9], [33.9, -87.3]]


def test_junctions(spark):
    edges, nodes = topology.build(tracks(spark))
    assert topology.junctions(edges, nodes).count() == 4


def test_presets(spark, tmp_path):
    from waymark.operators import pricing
    from waymark.plans import presets

    edges, nodes = topology.build(tracks(spark), depot=(0.0, -30.0))
    edges = edges.cache()
    profiles = pricing.stations(edges, 10.0).selectExpr("*", "y * 0.05 AS z")
    depot = nodes.where("is_depot").first().node_id
    p = Params().with_(race={"budget_s": 1500.0})
    rows = presets.build(spark, edges, profiles, depot, (2,), str(tmp_path / "o"), [4.0, 6.0], "abcd", 1, 25, p)
    by = {(r["mph"], r["option"]): r for r in rows}
    for v in (4.0, 6.0):
        assert by[v, "a"]["score"] >= by[v, "c"]["score"] - 1e-9 and by[v, "d"]["score"] >= by[v, "a"]["score"] - 3.0 - 1e-9
    assert by[6.0, "a"]["score"] > by[4.0, "a"]["score"]
    doc = json.loads(spark.read.text(f"{tmp_path}/o/preset_s60a.json").first().value)
    assert doc["totals"]["mph"] == 6.0 and doc["totals"]["delta_vs_free"] == 0.0
    listed = json.loads(spark.read.text(f"{tmp_path}/o/manifest").first().value)
    assert [x["mph"] for x in listed] == [4.0, 6.0] and {x["file"] for x in listed[1]["presets"]} == {r["file"] for r in rows if r["mph"] == 6.0}
