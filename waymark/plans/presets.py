"""Plans for a grid of speeds and options, published with a manifest.

Options: a free, b requires the group of trails, c forbids it, d gives up to three points of a's
score for as much time that can be shed as possible. Profiles are sampled once; every speed prices
them anew. The solves of a speed that don't wait for one another run side by side.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import speed as speeds
from waymark.operators import adapt, graph, pricing, publish, rules, scoring, search, walk
from waymark.operators._scratch import checkpoint
from waymark.params import Params
from waymark.sources import writers

FLOOR_GAP = 3.0


def solve_speed(spark: SparkSession, priced: DataFrame, depot: int, group: tuple[int, ...], options: str, seeds: int, iterations: int, p: Params) -> tuple[search.Problem, dict]:
    """The problem at one speed and the solution shipped for each option (those no seed could keep
    are left out). d waits for a, whose score is its floor."""
    arcs = checkpoint(graph.arcs(priced))
    problem = search.problem(arcs, graph.shortest(arcs), graph.chains(priced), depot)

    def solve(which: str, floor: float | None) -> dict:
        rows = [(o, s, list(r.require), list(r.forbid), floor) for o in which for r in [rules.for_option(o, group)] for s in range(1, seeds + 1)]
        if not rows:
            return {}
        grid = spark.createDataFrame(rows, "option string, seed long, require array<long>, forbid array<long>, floor double")
        return {r.option: r for r in search.ship(search.solve_grid(spark, problem, grid, iterations, p.race), floor).collect()}

    found = solve("".join(o for o in options if o in "abc") + ("a" if "d" in options and "a" not in options else ""), None)
    if "d" in options and "a" in found:
        found |= solve("d", found["a"].score - FLOOR_GAP)
    return problem, {o: r for o, r in found.items() if o in options}


def build(spark: SparkSession, edges: DataFrame, profiles: DataFrame, depot: int, group: tuple[int, ...], out: str, mph: list[float], options: str = "abcd", seeds: int = 2, iterations: int = 100, params: Params = Params()) -> list[dict]:
    """edges: a network before pricing; profiles: edge_id, pos, d, z. Writes a document per speed
    and option and the manifest under ``out``; returns a row of figures for each.

    Raises if a plan breaks its rule or a check fails; a slower speed that scores more is reported
    in the row of the faster one."""
    profiles = checkpoint(profiles)
    rows: list[dict] = []
    for v in sorted(mph):
        pace = spark.range(1).select(speeds.mph_to_pace(F.lit(v), params.speed)).first()[0]
        p = params.with_(speed={"pace": pace})
        priced = checkpoint(pricing.price(edges, profiles, p.speed))
        trails = checkpoint(priced.where("trail_id is not null").select("trail_id", "edge_id"))
        names = priced.where("trail_id is not null").groupBy("trail_id").agg(F.min_by("name", "edge_id").alias("name"))
        problem, found = solve_speed(spark, priced, depot, group, options, seeds, iterations, p)
        free = found["a"].score if "a" in found else None
        for option, best in sorted(found.items()):
            broken = search.breaches(problem, best.walk, rules.for_option(option, group))
            if broken:
                raise RuntimeError(f"{v} mph, option {option}: {broken} breaches")
            walked = [(0, k, a, *problem.arcs[a]) for k, a in enumerate(best.walk)]
            steps = spark.createDataFrame(walked, "route_id long, pos int, arc_id long, edge_id long, u long, v long, time_s double").join(priced.select("edge_id", "trail_id", "name", "length_m", "off_trail", "score_mi"), "edge_id")
            check = walk.continuity(steps, ["route_id"], F.lit(depot), p.race.budget_s).first()
            if check is None or not check.ok:
                raise RuntimeError(f"{v} mph, option {option}: {check.problem if check else 'no steps'}")
            detail = adapt.running(steps, trails, p.race)
            legs = walk.collapse(walk.legs(detail, ["route_id"], ["pos"], ["name", "cat"]), ["route_id"], "pos", ["time_s", "length_m"], ["elapsed_s", "running_unique", "running_trails", "running_score"], ["name", "cat", "off_trail"])
            cuts = checkpoint(adapt.thresholds(adapt.priced_cuts(steps, adapt.nesting(adapt.detours(steps)), priced, trails, p.race), p.race))
            plans = checkpoint(adapt.salvage(cuts, steps, priced, trails, p.race))
            publish.require_none(publish.cut_problems(cuts, plans))
            totals = scoring.evaluate(steps, ["route_id"], priced, trails, p.race).withColumns({"mph": F.lit(v), "option": F.lit(option), "delta_vs_free": F.lit(None if free is None else best.score - free).cast("double")})
            done = publish.completion_order(detail, ["route_id"], trails, names)
            document = publish.document(legs, totals, done, spark.createDataFrame([], "route_id long, corridor string"), adapt.summary(cuts, plans))
            name = f"preset_s{round(v * 10):02d}{option}.json"
            writers.text_file(document, f"{out}/{name}")
            slower = [r["score"] for r in rows if r["option"] == option]
            rows.append({"mph": v, "option": option, "score": best.score, "time_s": best.time_s, "shed_s": best.shed_s, "file": name, "falls": bool(slower) and best.score < max(slower) - 1e-9})
    listing = publish.manifest(spark.createDataFrame([(r["file"],) for r in rows], "name string"))
    writers.text_file(listing.agg(F.to_json(F.collect_list(F.struct("mph", "presets"))).alias("document")), f"{out}/manifest")
    return rows


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description="Publish plans for a grid of speeds and options.")
    a.add_argument("--network", required=True, help="folder with edges and nodes")
    a.add_argument("--out", required=True)
    a.add_argument("--speeds", nargs="+", type=float, default=[5.0, 5.5, 6.0, 6.5, 7.0, 7.5])
    a.add_argument("--options", default="abcd")
    a.add_argument("--group", nargs="*", type=int, default=[], help="trails that option b requires and c forbids")
    a.add_argument("--seeds", type=int, default=2)
    a.add_argument("--iterations", type=int, default=100)
    o = a.parse_args(argv)
    spark = SparkSession.builder.appName("presets").getOrCreate()
    edges, nodes = (spark.read.parquet(f"{o.network}/{n}") for n in ("edges", "nodes"))
    profiles = pricing.stations(edges, Params().elevation.step).withColumn("z", F.lit(0.0))
    print(json.dumps(build(spark, edges, profiles, nodes.where("is_depot").first().node_id, tuple(o.group), o.out, o.speeds, o.options, o.seeds, o.iterations)))


if __name__ == "__main__":
    main()
