"""Directed, time-weighted graphs as tables of edges and arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators._scratch import checkpoint, numbered


def arcs(edges: DataFrame) -> DataFrame:
    """Two arcs per edge, along it and back: arc_id (2 i and 2 i + 1 for the i-th edge by id),
    edge_id, u, v, time_s, gain_m, score_mi, trail_id, off_trail, name."""
    each = numbered(edges, ["edge_id"], "i")
    ways = F.array(
        F.struct((2 * F.col("i")).alias("arc_id"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("time_fwd_s").alias("time_s"), F.col("gain_fwd_m").alias("gain_m")),
        F.struct((2 * F.col("i") + 1).alias("arc_id"), F.col("v").alias("a"), F.col("u").alias("b"), F.col("time_rev_s").alias("time_s"), F.col("gain_rev_m").alias("gain_m")),
    )
    return each.select("edge_id", F.explode(ways).alias("w"), "score_mi", "trail_id", "off_trail", "name").select(
        "w.arc_id", "edge_id", F.col("w.a").alias("u"), F.col("w.b").alias("v"), "w.time_s", "w.gain_m", "score_mi", "trail_id", "off_trail", "name"
    )


def fastest_arcs(arcs_: DataFrame) -> DataFrame:
    """Of parallel arcs the fastest, of equally fast the one with the least id."""
    best = arcs_.groupBy("u", "v").agg(F.min(F.struct("time_s", "arc_id")).alias("best"))
    return best.select("u", "v", "best.arc_id", "best.time_s")


def degrees(edges: DataFrame) -> DataFrame:
    """node and degree; a self-loop counts twice."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def dangles(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("degree = 1").select("node")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "node", "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node of it), for every node of an edge.

    Labels fall to the least among neighbours and then jump to their label's own label, so the
    rounds grow with the logarithm of a component's width on all but contrived graphs. A round
    is cut off from the ones before by a checkpoint.
    """
    both = checkpoint(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpoint(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "v", "label": "theirs"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("theirs").alias("theirs"))
        low = labels.join(near, "node").select("node", F.least("label", "theirs").alias("low"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        stepped = checkpoint(low.join(up, "low", "left").select("node", F.least("low", "lower").alias("label"), "old"))
        labels = stepped.select("node", "label")
        if not stepped.where("label <> old").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def component_summary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """component, n_trails, miles (rounded to 2 places), names (sorted, comma separated), largest first."""
    each = edges.where(F.col("trail_id").isNotNull()).join(labels.withColumnRenamed("node", "u"), "u")
    return each.groupBy("component").agg(
        F.countDistinct("trail_id").alias("n_trails"), F.round(F.sum("length_m") / 1609.344, 2).alias("miles"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names")
    ).orderBy(F.desc("n_trails"), "component")


def shortest(arcs_: DataFrame, sources: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """src, dst, time_s, pred_arc of the fastest way from every source (all nodes, if not given) to
    every node it reaches, itself included with time 0 and no arc. Of equally fast ways the one of
    fewest arcs stays, and of these the one with the lesser last arc. Only distances that fell in the last round are relaxed again.

    rounds: the most arcs a way may have, if bounded.
    """
    best = checkpoint(fastest_arcs(arcs_))
    nodes = sources if sources is not None else best.select(F.col("u").alias("node")).unionByName(best.select(F.col("v").alias("node"))).distinct()
    nothing = F.lit(None).cast(best.schema["arc_id"].dataType)
    known = checkpoint(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("time_s"), nothing.alias("pred_arc")))
    front, n = known, 0
    while rounds is None or n < rounds:
        n += 1
        step = front.alias("f").join(best.alias("a"), F.col("f.dst") == F.col("a.u")).select("f.src", F.col("a.v").alias("dst"), (F.col("f.time_s") + F.col("a.time_s")).alias("time_s"), F.col("a.arc_id").alias("pred_arc"))
        step = step.groupBy("src", "dst").agg(F.min(F.struct("time_s", "pred_arc")).alias("new"))
        joined = known.withColumnsRenamed({"time_s": "old", "pred_arc": "old_arc"}).join(step, ["src", "dst"], "full")
        better = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new.time_s") < F.col("old")))
        merged = checkpoint(joined.select("src", "dst", F.when(better, F.col("new.time_s")).otherwise(F.col("old")).alias("time_s"), F.when(better, F.col("new.pred_arc")).otherwise(F.col("old_arc")).alias("pred_arc"), better.alias("fresh")))
        known, front = merged.drop("fresh"), merged.where("fresh").drop("fresh")
        if not front.limit(1).count():
            break
    return known


def path(known: DataFrame, arcs_: DataFrame, src, dst) -> list:
    """Arc ids from src to dst; [] if they are the same, None if dst is out of reach. Follows one
    source's tree, which has at most one row per node."""
    tree = known.where(F.col("src") == src).join(arcs_.select(F.col("arc_id").alias("pred_arc"), "u"), "pred_arc", "left").select("dst", "pred_arc", "u")
    before = {r.dst: (r.pred_arc, r.u) for r in tree.collect()}
    if dst not in before:
        return [] if src == dst else None
    out = []
    while dst != src:
        arc, dst = before[dst]
        out.append(arc)
    return out[::-1]


def path_arcs(steps: DataFrame, arcs_: DataFrame, by: list[str]) -> DataFrame:
    """Of walks given as nodes (by columns, pos, node): pos and arc_id of the fastest arc of each step."""
    w = Window.partitionBy(*by).orderBy("pos")
    pairs = steps.withColumn("v", F.lead("node").over(w)).where(F.col("v").isNotNull()).withColumnRenamed("node", "u")
    return pairs.join(fastest_arcs(arcs_), ["u", "v"], "left").select(*by, "pos", "arc_id", "time_s")


_CHAIN = "trail_id long, place int, edge_id long, forward boolean, complete boolean"


def chains(edges: DataFrame) -> DataFrame:
    """Each trail's edges strung into a walk: from a node of degree one, if there is any, along
    unused edges, least id first; a walk that gets stuck stays partial (complete false)."""

    def string(pdf):
        import pandas as pd

        left = {r.edge_id: (r.u, r.v) for r in pdf.sort_values("edge_id").itertuples()}
        at: dict = {}
        for e, (u, v) in left.items():
            at.setdefault(u, []).append(e)
            at.setdefault(v, []).append(e)
        ends = sorted(n for n, es in at.items() if len(es) == 1)
        here, rows = ends[0] if ends else min(at), []
        while step := next((e for e in at[here] if e in left), None):
            u, v = left.pop(step)
            forward = u == here
            here = v if forward else u
            rows.append((pdf.trail_id.iloc[0], len(rows), step, forward))
            if all(e not in left for e in at[here]):
                break
        return pd.DataFrame([(*r, not left) for r in rows], columns=["trail_id", "place", "edge_id", "forward", "complete"])

    return edges.where(F.col("trail_id").isNotNull()).select("trail_id", "edge_id", "u", "v").groupBy("trail_id").applyInPandas(string, _CHAIN)


def euler(bag: DataFrame, depot) -> DataFrame:
    """A closed walk from the depot over a bag of arcs, each as often as ``times`` says: route_id,
    pos, arc_id. bag: route_id, arc_id, u, v, times. Where arcs can't be joined into one closed
    walk, the part that hangs together with the depot is walked."""

    def circuit(pdf):
        import pandas as pd

        out: dict = {}
        for r in pdf.sort_values("arc_id", ascending=False).itertuples():
            out.setdefault(r.u, []).extend([(r.v, r.arc_id)] * int(r.times))
        stack, done = [(depot, None)], []
        while stack:
            node, arc = stack[-1]
            if out.get(node):
                stack.append(out[node].pop())
            else:
                done.append(stack.pop()[1])
        walked = [a for a in done[::-1] if a is not None]
        return pd.DataFrame({"route_id": pdf.route_id.iloc[0], "pos": range(len(walked)), "arc_id": walked})

    return bag.groupBy("route_id").applyInPandas(circuit, "route_id long, pos int, arc_id long")
