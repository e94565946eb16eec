"""Scores, rules, detours, search and publication on small networks, against plain Python."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import adapt, graph, pricing, publish, rules, scoring, search, walk
from waymark.params import Race

RACE = Race(budget_s=1000.0)
EDGES = "edge_id long, u long, v long, time_fwd_s double, time_rev_s double, gain_fwd_m double, gain_rev_m double, length_m double, score_mi double, trail_id long, off_trail boolean, name string"


def network(spark, n: int = 9, seed: int = 3):
    """A wheel: a depot in the middle, spokes and rim, one trail per two edges."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        rows.append((2 * k, 0, k + 1, *(float(rnd.randint(40, 90)) for _ in range(2)), 5.0, 1.0, 1000.0, 0.6, k, False, f"S{k}"))
        rows.append((2 * k + 1, k + 1, (k + 1) % n + 1, *(float(rnd.randint(40, 90)) for _ in range(2)), 2.0, 2.0, 900.0, 0.5, k, False, f"S{k}"))
    rows.append((2 * n, 0, n + 1, 30.0, 30.0, 0.0, 0.0, 300.0, 0.0, None, False, "road"))
    return spark.createDataFrame(rows, EDGES)


@pytest.fixture(scope="module")
def solved(spark):
    edges = network(spark).cache()
    arcs = graph.arcs(edges).cache()
    known = graph.shortest(arcs).cache()
    p = search.problem(arcs, known, graph.chains(edges), 0)
    return edges, arcs, known, p


def test_shortest_ways_equal_floyd_warshall(solved):
    _, arcs, known, _ = solved
    nodes = range(11)
    d = {(i, j): 0.0 if i == j else math.inf for i in nodes for j in nodes}
    for r in arcs.collect():
        d[r.u, r.v] = min(d[r.u, r.v], r.time_s)
    for k in nodes:
        for i in nodes:
            for j in nodes:
                d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    got = {(r.src, r.dst): r.time_s for r in known.collect()}
    assert got == {k: t for k, t in d.items() if t < math.inf}
    by = {r.arc_id: r for r in arcs.collect()}
    path = graph.path(known, arcs, 1, 5)
    assert by[path[0]].u == 1 and by[path[-1]].v == 5 and math.isclose(sum(by[a].time_s for a in path), got[1, 5])
    assert graph.path(known, arcs, 3, 3) == [] and graph.path(known, arcs, 3, 99) is None


def test_components_of_long_chains(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 200) if i != 77] + [(500, 500)], "u long, v long")
    got = {(r.node, r.component) for r in graph.components(df).collect()}
    assert got == {(i, 1) for i in range(1, 78)} | {(i, 78) for i in range(78, 201)} | {(500, 500)}


def test_chains_walk_every_edge_once(spark):
    df = spark.createDataFrame([(1, 5, 1, 2), (1, 6, 3, 2), (1, 7, 3, 4), (2, 8, 1, 1), (3, 9, 1, 2), (3, 10, 5, 6)], "trail_id long, edge_id long, u long, v long")
    got = [(r.trail_id, r.edge_id, r.forward, r.complete) for r in graph.chains(df).orderBy("trail_id", "place").collect()]
    assert got == [(1, 5, True, True), (1, 6, False, True), (1, 7, True, True), (2, 8, True, True), (3, 9, True, False)]


def test_euler_walk_uses_every_arc(spark):
    bag = spark.createDataFrame([(1, 0, 0, 1, 1), (1, 1, 1, 0, 2), (1, 2, 0, 1, 1), (1, 3, 1, 2, 1), (1, 4, 2, 1, 1)], "route_id long, arc_id long, u long, v long, times int")
    got = [r.arc_id for r in graph.euler(bag, 0).orderBy("pos").collect()]
    ends = {0: (0, 1), 1: (1, 0), 2: (0, 1), 3: (1, 2), 4: (2, 1)}
    assert sorted(got) == [0, 1, 1, 2, 3, 4] and ends[got[0]][0] == 0 == ends[got[-1]][1]
    assert all(ends[a][1] == ends[b][0] for a, b in zip(got, got[1:]))


def test_scores_count_edges_once_and_caps_hold(spark, solved):
    edges, *_ = solved
    trails = edges.where("trail_id is not null").select("trail_id", "edge_id")
    walked = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 4), (2, 999), (3, 0)], "route_id long, edge_id long")
    got = {r.route_id: (round(r.miles, 6), r.trails, round(r.score, 6)) for r in scoring.score(walked, ["route_id"], "edge_id", edges, trails, RACE).collect()}
    assert got == {1: (1.7, 1, 2.7), 2: (0.0, 0, 0.0), 3: (0.6, 0, 0.6)}
    capped = scoring.score(walked, ["route_id"], "edge_id", edges, trails, Race(mile_cap=1.0, trail_cap=0.5)).where("route_id = 1").first()
    assert capped.score == 1.5
    assert spark.range(1).select(scoring.caps(F.lit(40.0), F.lit(3)).alias("c")).first().c == ["miles"]


def test_rules(spark, solved):
    edges, *_ = solved
    trails = edges.where("trail_id is not null").select("trail_id", "edge_id")
    walked = spark.createDataFrame([(1, 0), (1, 1), (2, 4)], "route_id long, edge_id long")
    walks = spark.createDataFrame([(1,), (2,), (3,)], "route_id long")
    found = rules.offenders(walks, walked, ["route_id"], "edge_id", trails, rules.Rule("x", (0,), (2,)))
    assert sorted((r.route_id, r.kind, r.trail_id) for r in found.collect()) == [(2, "entered", 2), (2, "missing", 0), (3, "missing", 0)]
    assert rules.offenders(walks, walked, ["route_id"], "edge_id", trails, rules.Rule()).count() == 0
    assert rules.for_option("b", (1,)).require == (1,) and rules.for_option("d", (1,)).describe()["free"]
    with pytest.raises(ValueError):
        rules.for_option("e", ())


def steps_of(spark, p, walk_):
    rows = [(1, k, a, p.arcs[a][0], p.arcs[a][1], p.arcs[a][2], p.arcs[a][3], p.miles[p.arcs[a][0]]) for k, a in enumerate(walk_)]
    return spark.createDataFrame(rows, "route_id long, pos int, arc_id long, edge_id long, u long, v long, time_s double, score_mi double")


def test_search_beats_greedy_and_reaches_the_optimum(spark, solved):
    edges, arcs, _, p = solved
    greedy = search.decode(p, search.greedy(p, RACE), RACE)
    ratio = search.decode(p, search.best_ratio(p, RACE), RACE)
    found = search.large_neighbourhood(p, 1, 150, RACE)
    best = max(p.score(p.edges(w), RACE) for w in (greedy, ratio))
    assert found["score"] >= best - 1e-9 and found["time_s"] <= RACE.budget_s + 1e-6
    steps = steps_of(spark, p, found["walk"])
    check = walk.continuity(steps, ["route_id"], F.lit(0), RACE.budget_s).first()
    assert check.ok, check.problem
    bound = scoring.knapsack_bound(edges, edges.where("trail_id is not null").select("trail_id", "edge_id"), RACE).first().bound
    assert bound >= found["score"] - 1e-6
    small = Race(budget_s=330.0)
    assert search.large_neighbourhood(p, 2, 200, small)["score"] <= search.exact(p, small)["score"] + 1e-9
    trails = edges.where("trail_id is not null").select("trail_id", "edge_id")
    e = scoring.evaluate(steps, ["route_id"], edges, trails, RACE).first()
    assert math.isclose(e.score, found["score"]) and e.feasible and math.isclose(e.walked_miles, e.unique_miles + e.offtrail_miles + e.repeat_miles)


def test_grid(spark, solved):
    *_, p = solved
    grid = spark.createDataFrame([("a", s, [], [], None) for s in (1, 2)] + [("b", 1, [3], [], None), ("c", 1, [], [3], None), ("d", 1, [], [], 2.0)], "option string, seed long, require array<long>, forbid array<long>, floor double")
    got = search.solve_grid(spark, p, grid, 40, RACE).cache()
    rows = {(r.option, r.seed): r for r in got.collect()}
    assert len(rows) == 5 and all(r.time_s <= RACE.budget_s + 1e-6 for r in rows.values())
    assert p.needs[3] <= p.edges(rows["b", 1].walk) and not p.needs[3] & p.edges(rows["c", 1].walk)
    again = search.solve_grid(spark, p, grid.where("option = 'a'"), 40, RACE).collect()
    assert sorted(tuple(r) for r in again) == sorted(tuple(r) for k, r in rows.items() if k[0] == "a")
    shipped = search.ship(got).collect()
    assert {r.option for r in shipped} == {"a", "b", "c", "d"} and max(rows["a", 1].score, rows["a", 2].score) == next(r.score for r in shipped if r.option == "a")


def test_detours_partition_a_walk(spark):
    rnd = random.Random(5)
    rows = []
    for route in range(30):
        at = 0
        for k in range(rnd.randint(1, 40)):
            to = rnd.randint(0, 8)
            rows.append((route, k, at, to))
            at = to
    steps = spark.createDataFrame(rows, "route_id long, pos int, u long, v long")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    spans = adapt.nesting(adapt.detours(steps)).collect()
    assert spans
    for s in spans:
        assert by[s.route_id][s.arc_start][2] == s.hinge == by[s.route_id][s.arc_end - 1][3]
    for a in spans:
        for b in spans:
            if a.route_id == b.route_id and a.span_id < b.span_id:
                apart = a.arc_end <= b.arc_start or b.arc_end <= a.arc_start
                assert apart or (a.arc_start <= b.arc_start and b.arc_end <= a.arc_end)


def test_cuts_salvage_and_bail_out(spark, solved):
    edges, arcs, known, p = solved
    trails = edges.where("trail_id is not null").select("trail_id", "edge_id").cache()
    walk_ = search.large_neighbourhood(p, 1, 60, RACE)["walk"]
    steps = steps_of(spark, p, walk_).cache()
    spans = adapt.nesting(adapt.detours(steps)).cache()
    cuts = adapt.thresholds(adapt.priced_cuts(steps, spans, edges, trails, RACE), RACE).cache()
    total = p.score(p.edges(walk_), RACE)
    for c in cuts.collect():
        left = [a for k, a in enumerate(walk_) if not c.arc_start <= k < c.arc_end]
        assert math.isclose(c.points_lost, total - p.score(p.edges(left), RACE), abs_tol=1e-6)
        assert 120 <= c.time_s <= 0.35 * c.total_s and math.isclose(c.time_s, sum(p.arcs[a][3] for a in walk_[c.arc_start : c.arc_end]))
        assert c.lost_trails == sorted(t for t, n in p.needs.items() if n <= p.edges(walk_) and not n <= p.edges(left))
    plans = adapt.salvage(cuts, steps, edges, trails, RACE).cache()
    assert publish.cut_problems(cuts, plans).count() == 0
    for r in plans.collect():
        assert r.time_s <= r.budget_s + 1e-6 and r.score <= total + 1e-9
    home = known.where("dst = 0").select(F.col("src").alias("node"), F.col("time_s").alias("home_s"))
    rows = [(n, p.arcs[a][0]) for n in range(1, 11) for a in graph.path(known, arcs, n, 0)]
    bail = adapt.bail_out(steps, home, spark.createDataFrame(rows, "node long, edge_id long"), edges, trails, RACE).orderBy("pos").collect()
    for k, r in enumerate(bail):
        back = graph.path(known, arcs, p.arcs[walk_[k]][2], 0)
        assert math.isclose(r.score, p.score(p.edges(walk_[: k + 1] + back), RACE)) and math.isclose(r.finish_s + r.slack_s, RACE.budget_s)
    early = adapt.front_load(steps, ["route_id"], 500.0, edges, trails, RACE).first()
    t, part = 0.0, []
    for a in walk_:
        t += p.arcs[a][3]
        if t > 500:
            break
        part.append(a)
    assert math.isclose(early.score, p.score(p.edges(part), RACE))


def test_droppable_counts_outermost_only(spark):
    df = spark.createDataFrame([(1, 0, 10, 100.0, 0), (1, 2, 5, 30.0, 0), (1, 20, 30, 50.0, 0), (1, 2, 5, 30.0, 1), (1, 20, 30, 50.0, 1), (1, 0, 10, 100.0, 1)], "route_id long, arc_start int, arc_end int, time_s double, from_pos int")
    assert sorted((r.from_pos, r.droppable_s) for r in adapt.droppable_after(df).collect()) == [(0, 150.0), (1, 80.0)]


def test_documents_and_their_checks(spark, solved):
    edges, _, _, p = solved
    walk_ = search.decode(p, search.greedy(p, RACE), RACE)
    trails = edges.where("trail_id is not null").select("trail_id", "edge_id")
    steps = steps_of(spark, p, walk_).join(edges.select("edge_id", "trail_id", "name", "length_m", "off_trail"), "edge_id")
    run = adapt.running(steps, trails, RACE)
    last = run.orderBy(F.desc("pos")).first()
    assert math.isclose(last.running_score, p.score(p.edges(walk_), RACE)) and math.isclose(last.elapsed_s, p.seconds(walk_))
    legs = walk.collapse(walk.legs(run, ["route_id"], ["pos"], ["name", "cat"]), ["route_id"], "pos", ["time_s", "length_m"], ["elapsed_s", "running_unique", "running_trails", "running_score"], ["name", "cat", "off_trail"])
    cued = publish.turn_cues(legs.withColumns({"bearing_in": F.lit(10.0), "bearing_out": F.lit(100.0)}), ["route_id"])
    sheet = publish.cue_sheet(cued).orderBy("leg").collect()
    assert (sheet[0].turn, sheet[0].glyph, sheet[0].leg) == ("start", turns_start(), 1) and (len(sheet) == 1 or sheet[1].turn == "left")
    cat = walk.cumulative_by_category(run.withColumn("mi", F.col("score_mi")), ["route_id"], ["pos"], "mi", ["unique", "repeat", "offtrail"])
    good = cat.select("route_id", F.col("pos").alias("leg"), F.col("running_score").alias("cum_score"), F.col("elapsed_s").alias("cum_s"), F.col("cum_all").alias("cum_miles"), F.col("running_trails").alias("cum_trails"), "cum_unique", "cum_repeat", "cum_offtrail", F.lit("straight").alias("turn"), F.lit("↑").alias("glyph"))
    totals = spark.createDataFrame([(1, last.running_score, last.elapsed_s, good.orderBy(F.desc("leg")).first().cum_miles, int(last.running_trails))], "route_id long, score double, time_s double, miles double, trails long")
    publish.require_none(publish.problems(good, totals, RACE.budget_s))
    wrong = publish.problems(good.withColumn("glyph", F.when(F.col("leg") == 1, "x").otherwise(F.col("glyph"))), totals.withColumn("score", F.col("score") + 1), RACE.budget_s)
    assert {r.problem for r in wrong.collect()} == {"score differs from the last step", "step 1: glyph does not fit its turn"}
    with pytest.raises(ValueError):
        publish.require_none(wrong)
    done = publish.completion_order(run, ["route_id"], trails, edges.where("trail_id is not null").select("trail_id", "name").distinct())
    doc = json.loads(publish.document(legs, totals, done, spark.createDataFrame([(1, "west", 0.0)], "route_id long, corridor string, miles double")).first().document)
    assert doc["totals"]["trails"] == last.running_trails and len(doc["steps"]) == len(sheet) and doc["corridors"][0]["corridor"] == "west"


def turns_start():
    from waymark.functions.turns import GLYPHS

    return GLYPHS["start"]


def test_lines_are_stitched_and_measured(spark):
    rows = [(1, 0, 7, 7, [(0.0, 0.0), (0.0, 50.0)]), (1, 1, 8, 9, [(40.0, 50.0), (0.0, 50.0)])]
    df = spark.createDataFrame([(a, b, c, d, [{"x": x, "y": y} for x, y in p]) for a, b, c, d, p in rows], "route_id long, pos int, u long, edge_u long, coords array<struct<x:double,y:double>>")
    line = publish.stitched(df, ["route_id"])
    r = line.select("coords", publish.leg_bearings(F.col("coords")).alias("b")).first()
    assert [tuple(p) for p in r.coords] == [(0, 0), (0, 50), (40, 50)] and (r.b.bearing_in, r.b.bearing_out) == (0.0, 90.0)
    points = publish.track_points(line, ["route_id"], 100.0).orderBy("pos").collect()
    assert [p.time for p in points] == ["2000-01-01T07:00:00Z", "2000-01-01T07:00:50Z", "2000-01-01T07:01:40Z"]


def test_priced_edges(spark):
    coords = [{"x": 0.0, "y": 0.0}, {"x": 95.0, "y": 0.0}]
    edges = spark.createDataFrame([(1, 7, False, coords, 95.0), (2, None, True, coords, 95.0)], "edge_id long, trail_id long, off_trail boolean, coords array<struct<x:double,y:double>>, length_m double")
    pixels = spark.range(0, 40).crossJoin(spark.range(0, 130).withColumnRenamed("id", "col")).select(F.col("id").alias("row"), "col", (F.col("col") * 0.1).alias("z"))
    points = pricing.stations(edges, 10.0)
    heights = pricing.sample(points, pixels, -10.0, 20.0, 1.0, 40, 130)
    first = {r.pos: r.z for r in heights.where("edge_id = 1").collect()}
    assert len(first) == 11 and math.isclose(first[10] - first[0], 9.5)
    out = {r.edge_id: r for r in pricing.price(edges, heights).collect()}
    assert out[1].time_fwd_s > out[1].time_rev_s and math.isclose(out[1].gain_fwd_m, 9.5) and abs(out[1].gain_rev_m) < 1e-9
    assert math.isclose(out[2].time_fwd_s, out[1].time_fwd_s / 0.6) and out[2].score_mi == 0.0 and out[1].score_mi == out[1].length_mi
    paces = {(r.pace, r.edge_id): r.time_fwd_s for r in pricing.price_paces(edges, heights, [1.0, 2.0]).collect()}
    assert math.isclose(paces[1.0, 1], 2 * paces[2.0, 1])
    same = pricing.smooth_tiles(pixels, 2.0, tile=32).where("row between 15 and 25 and col between 40 and 80").collect()
    assert same and all(math.isclose(r.z, r.col * 0.1, abs_tol=1e-9) for r in same)


def test_dense_numbers(spark):
    from waymark.operators._scratch import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    got = [r.n for r in numbered(df, ["k"], "n").orderBy("k").collect()]
    assert got == list(range(1000)) and numbered(df.limit(0), ["k"], "n").count() == 0


def test_knapsack_bound_equals_a_plain_walk(spark):
    rnd = random.Random(11)
    rows = [(k, rnd.random() + 0.01, float(rnd.randint(1, 50)), float(rnd.randint(1, 50))) for k in range(500)]
    edges = spark.createDataFrame(rows, "edge_id long, score_mi double, time_fwd_s double, time_rev_s double")
    trails = spark.createDataFrame([(k // 5, k) for k in range(0, 500, 3)], "trail_id long, edge_id long")
    size = {}
    for k in range(0, 500, 3):
        size[k // 5] = size.get(k // 5, 0) + 1
    worth = [(m + (1 / size[k // 5] if k % 3 == 0 else 0), min(a, b)) for k, m, a, b in rows]
    left, best = 700.0, 0.0
    for w, t in sorted(worth, key=lambda x: -x[0] / x[1]):
        best, left = best + w * max(0.0, min(1.0, left / t)), left - t
    assert math.isclose(scoring.knapsack_bound(edges, trails, Race(budget_s=700.0)).first().bound, best, rel_tol=1e-9)


def test_repairs_try_every_missing_trail():
    import random

    for how in ("greedy", "regret"):
        assert sorted(search._insert(None, random.Random(1), [], list(range(20)), how, None, len)) == list(range(20))


def test_a_walk_of_no_arcs_takes_no_seconds_as_a_number_of_its_column():
    """where no trail fits the budget the walk is empty, and its time was an int."""
    p = search.Problem(0, way={(0, 0): (0.0, [])})
    assert search.decode(p, search.greedy(p, RACE), RACE) == [] and isinstance(p.seconds([]), float) and isinstance(p.score(set(), RACE), float)
