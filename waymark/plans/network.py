"""From tracks to a published plan, stage by stage, each stage's table kept in a folder.

    python -m waymark.plans.network --tracks in/tracks --out out --depot 0 0 --seeds 4

A stage whose table is there is read, not made again, unless it is forced.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from waymark.operators import adapt, graph, pricing, publish, rules, scoring, search, topology, walk
from waymark.params import Params
from waymark.sources import writers


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at a path, made first if it isn't there."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run(spark: SparkSession, tracks: DataFrame, out: str, depot: tuple[float, float], roads: DataFrame | None = None, pixels: DataFrame | None = None, raster: dict | None = None,
        params: Params = Params(), seeds: int = 4, iterations: int = 200, rule: rules.Rule = rules.Rule(), force: tuple[str, ...] = ()) -> dict:
    """tracks: trail_id, name, coords in metres; roads: name, coords; pixels: row, col, z with the
    raster's place in ``raster`` (x0, y0, resolution, rows, cols), flat ground without. Writes
    edges, nodes, timed edges, the route's steps and legs and a document under ``out`` and returns
    the report, which is written before and after publication."""
    p = params
    path = lambda name: f"{out}/{name}"
    made: dict = {}

    def network() -> dict:
        if not made:
            made["edges"], made["nodes"] = topology.build(tracks, roads, depot, p.topology)
        return made

    edges = stage(spark, path("edges"), lambda: network()["edges"], "topology" in force)
    nodes = stage(spark, path("nodes"), lambda: network()["nodes"], "topology" in force)

    def timed() -> DataFrame:
        points = pricing.stations(edges, p.elevation.step)
        if pixels is None:
            return pricing.price(edges, points.withColumn("z", F.lit(0.0)), p.speed)
        near = pricing.clip(pixels, edges, raster["x0"], raster["y0"], raster["resolution"], p.elevation.buffer)
        heights = pricing.smooth_tiles(near, p.elevation.sigma / raster["resolution"])
        return pricing.price(edges, pricing.sample(points, heights, **raster), p.speed)

    priced = stage(spark, path("edges_timed"), timed, "elevation" in force)
    arcs = stage(spark, path("arcs"), lambda: graph.arcs(priced), "graph" in force)
    home = nodes.where("is_depot").first().node_id
    problem = search.problem(arcs, graph.shortest(arcs), graph.chains(priced), home)
    grid = spark.createDataFrame([(rule.label, s, list(rule.require), list(rule.forbid), None) for s in range(1, seeds + 1)], "option string, seed long, require array<long>, forbid array<long>, floor double")
    found = search.solve_grid(spark, problem, grid, iterations, p.race).cache()
    best = search.ship(found).first()
    if best is None:
        raise RuntimeError("no seed found a walk that keeps the rule")
    base = {name: problem.score(problem.edges(search.decode(problem, order, p.race)), p.race) for name, order in (("greedy", search.greedy(problem, p.race)), ("best_ratio", search.best_ratio(problem, p.race)))}
    rows = [(0, k, a, *problem.arcs[a]) for k, a in enumerate(best.walk)]
    steps = spark.createDataFrame(rows, "route_id long, pos int, arc_id long, edge_id long, u long, v long, time_s double").join(priced.select("edge_id", "trail_id", "name", "length_m", "off_trail", "score_mi", F.col("u").alias("edge_u"), "coords"), "edge_id")
    trails = priced.where("trail_id is not null").select("trail_id", "edge_id")
    check = walk.continuity(steps, ["route_id"], F.lit(home), p.race.budget_s).first()
    if not check.ok:
        raise RuntimeError(check.problem)
    bound = scoring.knapsack_bound(priced, trails, p.race).first().bound
    report = {"score": best.score, "time_s": best.time_s, "arcs": len(best.walk), "seed": best.seed, "baselines": base, "bound": bound, "rule": rule.describe()}
    save = lambda: writers.text_file(spark.createDataFrame([(json.dumps(report),)], "document string"), path("report"))
    save()
    detail = adapt.running(steps, trails, p.race).cache()
    legs = walk.collapse(walk.legs(detail, ["route_id"], ["pos"], ["name", "cat"]), ["route_id"], "pos", ["time_s", "length_m"], ["elapsed_s", "running_unique", "running_trails", "running_score"], ["name", "cat", "off_trail"])
    in_legs = walk.legs(steps, ["route_id"], ["pos"], ["name"])
    lines = publish.stitched(in_legs, ["route_id", "leg"]).select("route_id", "leg", publish.leg_bearings(F.col("coords")).alias("b")).select("route_id", "leg", "b.*")
    printed = walk.collapse(walk.legs(detail, ["route_id"], ["pos"], ["name"]), ["route_id"], "pos", ["time_s", "length_m"], ["elapsed_s", "running_unique", "running_trails", "running_score"], ["name", "off_trail"])
    cues = publish.cue_sheet(publish.turn_cues(printed.join(lines, ["route_id", "leg"]), ["route_id"])).orderBy("leg")
    spans = adapt.nesting(adapt.detours(steps))
    cuts = adapt.thresholds(adapt.priced_cuts(steps, spans, priced, trails, p.race), p.race).cache()
    plans = adapt.salvage(cuts, steps, priced, trails, p.race).cache()
    totals = scoring.evaluate(steps, ["route_id"], priced, trails, p.race)
    done = publish.completion_order(detail, ["route_id"], trails, priced.where("trail_id is not null").groupBy("trail_id").agg(F.min_by("name", "edge_id").alias("name")))
    groups = spark.createDataFrame([], "route_id long, corridor string")
    document = publish.document(legs, totals, done, groups, adapt.summary(cuts, plans))
    publish.require_none(publish.cut_problems(cuts, plans))
    whole = publish.stitched(steps, ["route_id"])
    report["failed"] = writers.all_of({
        "cues": lambda: writers.csv_table(cues, path("cues")), "document": lambda: writers.text_file(document, path("document")),
        "layers": lambda: writers.layers(path("layers"), edges=priced, nodes=nodes, connectors=priced.where("off_trail"), route=detail),
        "track": lambda: writers.text_file(writers.gpx_text(publish.track_points(whole, ["route_id"], best.time_s), ["route_id"], "route"), path("track"), "text"),
        "backdrop": lambda: writers.text_file(publish.backdrop(priced), path("backdrop")),
    })
    save()
    return report


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description="Plan a walk over recorded tracks.")
    a.add_argument("--tracks", required=True, help="Parquet of trail_id, name, coords in metres")
    a.add_argument("--roads", help="Parquet of name, coords")
    a.add_argument("--pixels", help="Parquet of row, col, z")
    a.add_argument("--raster", nargs=5, type=float, metavar=("X0", "Y0", "RESOLUTION", "ROWS", "COLS"))
    a.add_argument("--out", required=True)
    a.add_argument("--depot", nargs=2, type=float, required=True)
    a.add_argument("--seeds", type=int, default=4)
    a.add_argument("--iterations", type=int, default=200)
    a.add_argument("--budget-hours", type=float, default=7.0)
    a.add_argument("--force", nargs="*", default=[], choices=["topology", "elevation", "graph"])
    o = a.parse_args(argv)
    spark = SparkSession.builder.appName("network").getOrCreate()
    raster = dict(zip(("x0", "y0", "resolution"), o.raster[:3])) | {"rows": int(o.raster[3]), "cols": int(o.raster[4])} if o.raster else None
    read = lambda path: spark.read.parquet(path) if path else None
    report = run(spark, read(o.tracks), o.out, tuple(o.depot), read(o.roads), read(o.pixels), raster, Params().with_(race={"budget_s": 3600 * o.budget_hours}), o.seeds, o.iterations, force=tuple(o.force))
    print(json.dumps(report))


if __name__ == "__main__":
    main()
