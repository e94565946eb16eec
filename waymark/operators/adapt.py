"""What a planned walk can shed: closed detours, their price, thresholds, salvage plans."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import scoring, walk
from waymark.params import Race

LEAST_S, MOST_SHARE, TRIES = 120.0, 0.35, 40_000
BUDGET_SHARES = (0.93, 0.86, 0.79)


def detours(steps: DataFrame) -> DataFrame:
    """route_id, hinge, arc_start, arc_end (exclusive): every closed detour of each walk. Along the
    walk the path without loops is kept; where it meets a node it has, the arcs since then are a
    detour, and the path is unwound to that node. steps: route_id, pos, u, v. A walk is one
    row of arcs: it is as long as a person walks in a day."""

    def loops(frames):
        for f in frames:
            rows = []
            for route, arcs in zip(f.route_id, f.arcs):
                if not len(arcs):
                    continue
                stack, on = [(arcs[0]["u"], 0)], {arcs[0]["u"]: 0}
                for k, arc in enumerate(arcs):
                    v = arc["v"]
                    if v in on:
                        rows.append((route, v, stack[on[v]][1], k + 1))
                        for node, _ in stack[on[v] + 1 :]:
                            del on[node]
                        del stack[on[v] + 1 :]
                        stack[-1] = (v, k + 1)
                    else:
                        on[v] = len(stack)
                        stack.append((v, k + 1))
            yield pd.DataFrame(rows, columns=["route_id", "hinge", "arc_start", "arc_end"])

    walks = steps.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "u", "v"))).alias("arcs"))
    return walks.mapInPandas(loops, "route_id long, hinge long, arc_start int, arc_end int")


def nesting(spans: DataFrame) -> DataFrame:
    """Adds span_id (in order of start, then end falling), parent (the smallest span strictly around) and depth."""
    w = Window.partitionBy("route_id").orderBy("arc_start", F.desc("arc_end"))
    numbered = spans.withColumn("span_id", F.row_number().over(w) - 1)
    a, b = numbered.alias("a"), numbered.alias("b")
    inside = (F.col("a.route_id") == F.col("b.route_id")) & (F.col("b.arc_start") <= F.col("a.arc_start")) & (F.col("b.arc_end") >= F.col("a.arc_end")) & (F.col("a.span_id") != F.col("b.span_id")) & (F.col("b.arc_end") - F.col("b.arc_start") > F.col("a.arc_end") - F.col("a.arc_start"))
    size = F.col("b.arc_end") - F.col("b.arc_start")
    up = a.join(b, inside).groupBy("a.route_id", "a.span_id").agg(F.min(F.struct(size, F.col("b.span_id"))).alias("s"), F.count(F.lit(1)).alias("depth"))
    return numbered.join(up, ["route_id", "span_id"], "left").select(*numbered.columns, F.col("s.span_id").alias("parent"), F.coalesce("depth", F.lit(0)).alias("depth"))


def without_spans(steps: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Steps outside all spans arc_start <= pos < arc_end of their key."""
    inside = F.col("s.pos").between(F.col("c.arc_start"), F.col("c.arc_end") - 1)
    for c in by:
        inside = inside & F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}"))
    return steps.alias("s").join(spans.alias("c"), inside, "left_anti")


def span_sums(spans: DataFrame, steps: DataFrame) -> DataFrame:
    """Adds time_s, miles (edges count each time they are walked) and elapsed_end of each span,
    from running sums: two equi joins, no range join."""
    w = Window.partitionBy("route_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.select("route_id", "pos", F.sum("time_s").over(w).alias("t"), F.sum("score_mi").over(w).alias("m"))
    end = run.select("route_id", (F.col("pos") + 1).alias("arc_end"), F.col("t").alias("t1"), F.col("m").alias("m1"))
    start = run.select("route_id", (F.col("pos") + 1).alias("arc_start"), F.col("t").alias("t0"), F.col("m").alias("m0"))
    joined = spans.join(end, ["route_id", "arc_end"]).join(start, ["route_id", "arc_start"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(*spans.columns, (F.col("t1") - zero("t0")).alias("time_s"), (F.col("m1") - zero("m0")).alias("miles"), F.col("t1").alias("elapsed_end"))


def priced_cuts(steps: DataFrame, spans: DataFrame, edges: DataFrame, trails: DataFrame, race: Race = Race()) -> DataFrame:
    """Detours worth a thought (120 s or more, at most 0.35 of the walk), with the score and trails
    lost if each were dropped alone: route_id, span_id, time_s, miles_saved, points_lost (6
    places), lost_trails. steps: route_id, pos, edge_id, time_s, score_mi."""
    total = steps.groupBy("route_id").agg(F.sum("time_s").alias("total_s"))
    cut = span_sums(spans, steps).join(total, "route_id").where((F.col("time_s") >= LEAST_S) & (F.col("time_s") <= MOST_SHARE * F.col("total_s")))
    each = steps.select("route_id", "pos", "edge_id").join(cut.select("route_id", "span_id", "arc_start", "arc_end"), "route_id")
    left = each.where((F.col("pos") < F.col("arc_start")) | (F.col("pos") >= F.col("arc_end")))
    by = ["route_id", "span_id"]
    base = scoring.score(steps, ["route_id"], "edge_id", edges, trails, race).select("route_id", F.col("score").alias("base"))
    after = scoring.score(left, by, "edge_id", edges, trails, race).select(*by, F.col("score").alias("after"))
    done = scoring.completed(steps, ["route_id"], "edge_id", trails).join(cut.select(*by), "route_id")
    lost = done.join(scoring.completed(left, by, "edge_id", trails), [*by, "trail_id"], "left_anti").groupBy(*by).agg(F.array_sort(F.collect_list("trail_id")).alias("lost_trails"))
    out = cut.join(base, "route_id").join(after, by, "left").join(lost, by, "left")
    points = F.round(F.col("base") - F.coalesce("after", F.lit(0.0)), 6)
    empty = F.array().cast("array<long>")
    return out.select(*by, "arc_start", "arc_end", "time_s", "elapsed_end", "total_s", F.col("miles").alias("miles_saved"), points.alias("points_lost"), F.coalesce("lost_trails", empty).alias("lost_trails"))


def thresholds(cuts: DataFrame, race: Race = Race()) -> DataFrame:
    """Adds keep_before: the latest time at a detour's start at which it still fits with all that
    follows; null where it always does, at least 0."""
    after = F.col("total_s") - F.col("elapsed_end")
    keep = F.lit(race.budget_s) - (F.col("time_s") + after)
    start = F.col("elapsed_end") - F.col("time_s")
    return cuts.withColumn("keep_before", F.when(keep >= F.col("total_s"), None).otherwise(F.greatest(keep, F.lit(0.0)))).withColumn("planned_start_s", start)


def salvage(cuts: DataFrame, steps: DataFrame, edges: DataFrame, trails: DataFrame, race: Race = Race(), shares: tuple[float, ...] = BUDGET_SHARES) -> DataFrame:
    """route_id, budget_s, dropped (span ids), time_s, score, exhaustive: for each reduced budget the
    combination of detours apart from each other that keeps the most points, the fewest detours
    first. Beyond TRIES combinations, detours are dropped greedily by points per minute. A group is
    one walk with the edges of the trails it completes: a trail that the whole walk does not complete
    cannot be completed by dropping detours."""
    own = steps.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "edge_id", "time_s"))).alias("steps"))
    miles = steps.select("route_id", "edge_id").distinct().join(edges.select("edge_id", "score_mi"), "edge_id").groupBy("route_id").agg(F.collect_list(F.struct("edge_id", "score_mi")).alias("miles"))
    needs = scoring.completed(steps, ["route_id"], "edge_id", trails).join(trails, "trail_id").groupBy("route_id").agg(F.collect_list(F.struct("trail_id", "edge_id")).alias("needs"))
    spans = cuts.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("span_id", "arc_start", "arc_end", "time_s", "points_lost"))).alias("cuts"))
    rows = own.join(miles, "route_id", "left").join(needs, "route_id", "left").join(spans, "route_id", "left")

    def plans(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                arcs = [(s["edge_id"], s["time_s"]) for s in r.steps]
                mi = {m["edge_id"]: m["score_mi"] for m in (r.miles if r.miles is not None else ())}
                need: dict = {}
                for n in r.needs if r.needs is not None else ():
                    need.setdefault(n["trail_id"], set()).add(n["edge_id"])
                cut = [dict(c.items() if isinstance(c, dict) else c.asDict().items()) for c in (r.cuts if r.cuts is not None else ())]
                whole = sum(t for _, t in arcs)

                def worth(chosen):
                    gone = {p for c in chosen for p in range(c["arc_start"], c["arc_end"])}
                    have = {e for p, (e, _) in enumerate(arcs) if p not in gone}
                    done = sum(edges <= have for edges in need.values())
                    return min(done * race.per_trail, race.trail_cap) + min(sum(mi.get(e, 0.0) for e in have) * race.per_mile, race.mile_cap)

                def apart(chosen):
                    s = sorted((c["arc_start"], c["arc_end"]) for c in chosen)
                    return all(a[1] <= b[0] for a, b in zip(s, s[1:]))

                for share in shares:
                    budget, best, tried, full = race.budget_s * share, None, 0, True
                    for k in range(len(cut) + 1):
                        for chosen in combinations(cut, k):
                            tried += 1
                            if tried > TRIES:
                                full = False
                                break
                            left = whole - sum(c["time_s"] for c in chosen)
                            if left <= budget + 1e-6 and apart(chosen) and (best is None or worth(chosen) > best[0] + 1e-9):
                                best = (worth(chosen), chosen, left)
                        if not full:
                            break
                    if not full:
                        chosen = []
                        for c in sorted(cut, key=lambda c: (c["points_lost"] / max(c["time_s"] / 60, 1e-9), c["span_id"])):
                            if whole - sum(x["time_s"] for x in chosen) <= budget + 1e-6:
                                break
                            if apart([*chosen, c]):
                                chosen.append(c)
                        left = whole - sum(c["time_s"] for c in chosen)
                        if left <= budget + 1e-6 and (best is None or worth(chosen) > best[0]):
                            best = (worth(chosen), tuple(chosen), left)
                    if best:
                        out.append((r.route_id, budget, sorted(c["span_id"] for c in best[1]), best[2], best[0], full))
            yield pd.DataFrame(out, columns=["route_id", "budget_s", "dropped", "time_s", "score", "exhaustive"])

    return rows.mapInPandas(plans, "route_id long, budget_s double, dropped array<int>, time_s double, score double, exhaustive boolean")


def droppable_after(cuts: DataFrame, position: str = "from_pos") -> DataFrame:
    """Seconds that can still be shed: per route and ``position`` (a column of ``cuts``), the sum of
    detours that start at or after it and lie in no other of them."""
    open_ = cuts.where(F.col("arc_start") >= F.col(position)).withColumn("__len", F.col("arc_end") - F.col("arc_start"))
    a, b = open_.alias("a"), open_.alias("b")
    around = (F.col("a.route_id") == F.col("b.route_id")) & (F.col(f"a.{position}") == F.col(f"b.{position}")) & (F.col("b.arc_start") <= F.col("a.arc_start")) & (F.col("b.arc_end") >= F.col("a.arc_end")) & (F.col("b.__len") > F.col("a.__len"))
    return a.join(b, around, "left_anti").groupBy("route_id", position).agg(F.sum("time_s").alias("droppable_s"))


def front_load(steps: DataFrame, by: list[str], until_s: float, edges: DataFrame, trails: DataFrame, race: Race = Race()) -> DataFrame:
    """Score of the whole steps walked by a time; the first that overruns ends them."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    done = steps.withColumn("__t", F.sum("time_s").over(w)).where(F.col("__t") <= until_s)
    return scoring.score(done, by, "edge_id", edges, trails, race)


def bail_out(steps: DataFrame, home: DataFrame, home_edges: DataFrame, edges: DataFrame, trails: DataFrame, race: Race = Race()) -> DataFrame:
    """After each step: elapsed_s, home_s (the fastest way to the depot), finish_s, slack_s and the
    score of going home now, over edges walked and those on the way home. home: node, home_s;
    home_edges: node, edge_id."""
    w = Window.partitionBy("route_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = steps.withColumn("elapsed_s", F.sum("time_s").over(w)).join(home.withColumnRenamed("node", "v"), "v", "left")
    out = at.select("route_id", "pos", "elapsed_s", "home_s", (F.col("elapsed_s") + F.col("home_s")).alias("finish_s"), (race.budget_s - F.col("elapsed_s") - F.col("home_s")).alias("slack_s"))
    firsts = steps.groupBy("route_id", "edge_id").agg(F.min("pos").alias("first"))
    walked = steps.select("route_id", "pos").join(firsts, "route_id").where("first <= pos").select("route_id", "pos", "edge_id")
    back = steps.select("route_id", "pos", F.col("v").alias("node")).join(home_edges, "node").select("route_id", "pos", "edge_id")
    scored = scoring.score(walked.unionByName(back), ["route_id", "pos"], "edge_id", edges, trails, race).select("route_id", "pos", "score")
    return out.join(scored, ["route_id", "pos"])


def running(steps: DataFrame, trails: DataFrame, race: Race = Race()) -> DataFrame:
    """The walk's clock and score so far: elapsed_s, running_unique, running_trails, running_score."""
    out = walk.detail(steps, ["route_id"], ["pos"], "edge_id", F.col("trail_id"), F.col("score_mi"), F.col("time_s"))
    out = walk.running_completed(out, ["route_id"], "edge_id", "pos", trails)
    return out.withColumn("running_score", walk.running_score(F.col("running_unique"), F.col("running_trails"), race.per_trail, race.per_mile, race.trail_cap, race.mile_cap))


def summary(cuts: DataFrame, plans: DataFrame) -> DataFrame:
    """Per route a JSON document of its cuts, best points per minute first, and salvage plans."""
    rate = F.when(F.col("time_s") > 1e-9, F.col("points_lost") / (F.col("time_s") / 60)).otherwise(F.lit(float("inf")))
    c = cuts.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct(rate.alias("points_per_minute"), "span_id", "time_s", "points_lost", "lost_trails"))).alias("cuts"))
    s = plans.groupBy("route_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("budget_s", "score", "time_s", "dropped")))).alias("salvage"))
    return c.join(s, "route_id", "full").select("route_id", F.to_json(F.struct("cuts", "salvage")).alias("document"))
