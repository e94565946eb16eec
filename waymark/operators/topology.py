"""From tracks to a noded network: splitting, endpoint clustering, pruning, the depot, road clips.

Lines are ``coords array<struct<x:double,y:double>>``. Pairs of lines that can touch are found by
an equi join on grid cells of their segments, so that no line is compared with all others; the
exact geometry then runs in numpy on one line and its partners at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import graph, planar
from waymark.operators._scratch import checkpoint, numbered
from waymark.params import Topology

COORDS = "array<struct<x:double,y:double>>"


def line(coords) -> np.ndarray:
    """A row's coords as an array of points."""
    return np.array([(p["x"], p["y"]) for p in coords], float).reshape(-1, 2)


def points(a: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in a]


def cells(x: Column, y: Column, size: float, around: int = 0) -> Column:
    """The grid cell of a place, or with ``around`` the block of cells about it, as an array."""
    near = F.array(*(F.struct((F.floor(x / size) + i).alias("i"), (F.floor(y / size) + j).alias("j")) for i in range(-around, around + 1) for j in range(-around, around + 1)))
    return near


def close_pairs(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """a_id, b_id, distance of points (id, x, y) no farther apart than the tolerance."""
    left = a.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(cells(F.col("x"), F.col("y"), tolerance, 1)).alias("cell"))
    right = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(cells(F.col("x"), F.col("y"), tolerance)).alias("cell"))
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return left.join(right, "cell").withColumn("distance", d).where(F.col("distance") <= tolerance).select("a_id", "b_id", "distance")


def nearest(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Of each point of a the nearest point of b within the tolerance, ties to the lesser id; null
    where there is none."""
    best = close_pairs(a, b, tolerance).groupBy("a_id").agg(F.min(F.struct("distance", "b_id")).alias("best"))
    return a.select(F.col("id").alias("a_id")).join(best, "a_id", "left").select("a_id", F.col("best.b_id").alias("b_id"), F.col("best.distance").alias("distance"))


def match_percentages(distances: DataFrame, tolerances: list[float]) -> DataFrame:
    """tolerance and the percentage (one decimal) of rows whose distance is at most that; a null
    distance is beyond all."""
    each = distances.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("t"), F.coalesce((F.col("distance") <= t).cast("double"), F.lit(0.0)).alias("ok")) for t in tolerances))).alias("r"))
    return each.groupBy(F.col("r.t").alias("tolerance")).agg(F.round(100 * F.avg("r.ok"), 1).alias("percent"))


def _line_cells(lines: DataFrame, size: float, margin: float) -> DataFrame:
    """id and each grid cell that a segment's box, widened by the margin, touches."""
    p = F.col("coords")
    box = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(
        F.floor((F.least(F.get(p, i)["x"], F.get(p, i - 1)["x"]) - margin) / size).alias("i0"), F.floor((F.greatest(F.get(p, i)["x"], F.get(p, i - 1)["x"]) + margin) / size).alias("i1"),
        F.floor((F.least(F.get(p, i)["y"], F.get(p, i - 1)["y"]) - margin) / size).alias("j0"), F.floor((F.greatest(F.get(p, i)["y"], F.get(p, i - 1)["y"]) + margin) / size).alias("j1")))
    seg = lines.where(F.size("coords") >= 2).select("id", F.explode(box).alias("b"))
    return seg.select("id", "b", F.explode(F.sequence("b.i0", "b.i1")).alias("i")).select("id", "i", F.explode(F.sequence("b.j0", "b.j1")).alias("j")).distinct()


def candidates(lines: DataFrame, tolerance: float, size: float = 100.0) -> DataFrame:
    """a_id, b_id of different lines whose segments come into the same cell, both ways round."""
    near = _line_cells(lines, size, tolerance / 2)
    return near.withColumnRenamed("id", "a_id").join(near.withColumnRenamed("id", "b_id"), ["i", "j"]).where("a_id <> b_id").select("a_id", "b_id").distinct()


def split(lines: DataFrame, p: Topology = Topology()) -> DataFrame:
    """Cuts lines where they cross, at both ends of stretches they share and where another line
    ends within the snap tolerance. lines: id, coords. Returns id, seq, coords, length_m; cuts
    closer than max(least edge, snap) to the one before are left out."""
    near = candidates(lines, p.snap).join(lines.select(F.col("id").alias("b_id"), F.col("coords").alias("other")), "b_id")
    partners = near.groupBy(F.col("a_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("b_id", "other"))).alias("others"))
    both = lines.join(partners, "id", "left")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                a, at = line(r.coords), []
                if len(a) < 2:
                    continue
                for o in r.others if r.others is not None else ():
                    b = line(o["other"])
                    if len(b) < 2:
                        continue
                    at += [x for x, _ in planar.crossings(a, b)]
                    d, gap = planar.project(a, b[[0, -1]])
                    at += d[gap <= p.snap].tolist()
                kept = planar.thin(np.array(at, float), planar.length(a), max(p.least_edge, p.snap))
                for x, y in zip(kept[:-1], kept[1:]):
                    if y - x > 0:
                        part = planar.substring(a, x, y)
                        rows.append((r.id, len([q for q in rows if q[0] == r.id]), points(part), planar.length(part)))
            yield pd.DataFrame(rows, columns=["id", "seq", "coords", "length_m"])

    return both.mapInPandas(cut, f"id long, seq int, coords {COORDS}, length_m double")


def junction_band(lines: DataFrame, low: float, high: float, size: float = 100.0) -> DataFrame:
    """Ends of lines that miss another line by low <= gap < high: id, which (start or end), other,
    gap, nearest first."""
    near = candidates(lines, 2 * high, size).join(lines.select(F.col("id").alias("b_id"), F.col("coords").alias("other")), "b_id").join(lines.select(F.col("id").alias("a_id"), "coords"), "a_id")

    def gaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                _, gap = planar.project(line(r.other), line(r.coords)[[0, -1]])
                rows += [(r.a_id, which, r.b_id, float(g)) for which, g in zip(("start", "end"), gap) if low <= g < high]
            yield pd.DataFrame(rows, columns=["id", "which", "other", "gap"])

    return near.mapInPandas(gaps, "id long, which string, other long, gap double").orderBy("gap", "id", "which", "other")


def node(edges: DataFrame, p: Topology = Topology()) -> tuple[DataFrame, DataFrame]:
    """Clusters endpoints within the snap tolerance of each other, transitively. Returns edges with
    u, v, their ends moved to their node's mean, and nodes: node_id (dense, in order of the least
    endpoint), x, y. edges: edge_id, coords and others."""
    c = F.col("coords")
    ends = edges.select("edge_id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.element_at(c, 1).alias("at")), F.struct(F.lit(1).alias("end"), F.element_at(c, -1).alias("at")))).alias("e"))
    ends = checkpoint(ends.select((F.col("edge_id") * 2 + F.col("e.end")).alias("id"), "e.at.x", "e.at.y"))
    links = close_pairs(ends, ends, p.snap).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
    labels = checkpoint(graph.components(links))
    placed = ends.join(labels.withColumnRenamed("node", "id"), "id")
    nodes = placed.groupBy("component").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    nodes = checkpoint(numbered(nodes, ["component"], "node_id"))
    of = checkpoint(placed.select("id", "component").join(nodes, "component").select("id", "node_id", "x", "y"))
    u = of.select((F.col("id") / 2).cast("long").alias("edge_id"), F.col("node_id").alias("u"), F.struct("x", "y").alias("pu")).where(F.col("id") % 2 == 0)
    v = of.select(F.floor(F.col("id") / 2).cast("long").alias("edge_id"), F.col("node_id").alias("v"), F.struct("x", "y").alias("pv")).where(F.col("id") % 2 == 1)
    moved = edges.join(u, "edge_id").join(v, "edge_id")
    n = F.size("coords")
    snapped = F.concat(F.array("pu"), F.slice("coords", 2, F.greatest(n - 2, F.lit(0))), F.array("pv"))
    moved = moved.withColumn("coords", snapped).drop("pu", "pv").withColumn("length_m", line_length(F.col("coords")))
    return moved, nodes.select("node_id", "x", "y")


def line_length(coords: Column) -> Column:
    steps = F.transform(F.sequence(F.lit(1), F.size(coords) - 1), lambda i: F.hypot(F.get(coords, i)["x"] - F.get(coords, i - 1)["x"], F.get(coords, i)["y"] - F.get(coords, i - 1)["y"]))
    return F.when(F.size(coords) < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, x: a + x))


def without_degenerate(edges: DataFrame, p: Topology = Topology()) -> DataFrame:
    """Drops loops shorter than the snap tolerance and edges of no length; longer loops stay."""
    return edges.where(~((F.col("u") == F.col("v")) & (F.col("length_m") < p.snap)) & (F.col("length_m") >= 1e-6))


def prune_orphans(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keeps components that hold a trail, and numbers the nodes left from 0 in their old order."""
    labels = checkpoint(graph.components(edges))
    own = edges.join(labels.withColumnsRenamed({"node": "u"}), "u")
    trails = own.where(F.col("trail_id").isNotNull()).select("component").distinct()
    kept = checkpoint(own.join(trails, "component", "left_semi").drop("component"))
    used = kept.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    left = nodes.join(used, "node_id", "left_semi")
    left = checkpoint(numbered(left, ["node_id"], "new"))
    for c in ("u", "v"):
        kept = kept.join(left.select(F.col("node_id").alias(c), F.col("new").alias("__new")), c).drop(c).withColumnRenamed("__new", c)
    return kept.select(*edges.columns), left.drop("node_id").withColumnRenamed("new", "node_id").select(*nodes.columns)


def add_depot(edges: DataFrame, nodes: DataFrame, x: float, y: float, p: Topology = Topology()) -> tuple[DataFrame, DataFrame]:
    """Ties a start point to the network: to an end of the nearest edge (ties to the least id) if
    one is within the snap tolerance, else to a new node that splits the edge in two; an access
    edge without a trail leads to it. Nodes get is_depot. The one edge concerned is the only row
    that reaches the driver."""

    def far(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [planar.project(line(c), np.array([[x, y]])) for c in f.coords]
            yield pd.DataFrame({"edge_id": f.edge_id, "gap": [float(g[0]) for _, g in found], "along": [float(d[0]) for d, _ in found]})

    best = edges.select("edge_id", "coords").mapInPandas(far, "edge_id long, gap double, along double").orderBy("gap", "edge_id").first()
    if best is None:
        raise ValueError("no edge to tie the depot to")
    edge = edges.where(F.col("edge_id") == best.edge_id).first()
    top_edge, top_node = edges.agg(F.max("edge_id")).first()[0], nodes.agg(F.max("node_id")).first()[0]
    a = line(edge.coords)
    total, spark = planar.length(a), edges.sparkSession
    depot, new_edges, new_nodes = top_node + 1, [], []
    base = edge.asDict(recursive=True)
    if best.along <= p.snap or total - best.along <= p.snap:
        hook, place = (edge.u, a[0]) if best.along <= total - best.along else (edge.v, a[-1])
        kept = edges
    else:
        hook, place, depot = top_node + 1, planar.at(a, best.along), top_node + 2
        kept = edges.where(F.col("edge_id") != best.edge_id)
        for k, (s, e, u, v) in enumerate(((0.0, best.along, edge.u, hook), (best.along, total, hook, edge.v)), 1):
            new_edges.append(base | {"edge_id": top_edge + k, "coords": points(planar.substring(a, s, e)), "length_m": e - s, "u": u, "v": v})
        new_nodes.append((hook, float(place[0]), float(place[1])))
    access = base | {c: None for c in ("trail_id",) if c in base} | {"edge_id": top_edge + 1 + len(new_edges), "name": "Start access", "coords": points(np.stack([place, [x, y]])), "length_m": float(np.hypot(*(place - [x, y]))), "u": hook, "v": depot}
    new_edges.append(access | ({"is_road": True} if "is_road" in base else {}) | ({"off_trail": False} if "off_trail" in base else {}))
    new_nodes.append((depot, float(x), float(y)))
    more = spark.createDataFrame([tuple(e[c] for c in edges.columns) for e in new_edges], edges.schema)
    extra = spark.createDataFrame(new_nodes, "node_id long, x double, y double")
    return kept.unionByName(more), nodes.select("node_id", "x", "y").unionByName(extra).withColumn("is_depot", F.col("node_id") == depot)


def clip_roads(roads: DataFrame, trails: DataFrame, p: Topology = Topology(), size: float = 250.0) -> DataFrame:
    """The parts of roads within reach of a trail: pieces of at least ``least_road``, gaps along
    the road of up to ``road_gap`` filled. roads: id, coords. Returns id, part, coords, length_m."""
    own = _line_cells(roads, size, p.road_reach).withColumnRenamed("id", "a_id")
    near = own.join(_line_cells(trails, size, 0.0).withColumnRenamed("id", "b_id"), ["i", "j"]).select("a_id", "b_id").distinct()
    near = near.join(trails.select(F.col("id").alias("b_id"), F.col("coords").alias("other")), "b_id").groupBy(F.col("a_id").alias("id")).agg(F.collect_list("other").alias("others"))

    def clip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                a = line(r.coords)
                spans = [s for s in planar.within(a, [line(o) for o in r.others], p.road_reach) if s[1] - s[0] >= p.least_road]
                merged = [s for s in planar.merge_gaps(spans, p.road_gap) if s[1] - s[0] >= p.least_road]
                rows += [(r.id, k, points(planar.substring(a, *s)), s[1] - s[0]) for k, s in enumerate(merged)]
            yield pd.DataFrame(rows, columns=["id", "part", "coords", "length_m"])

    return roads.join(near, "id").mapInPandas(clip, f"id long, part int, coords {COORDS}, length_m double")


def merge_intervals(spans: DataFrame, by: list[str], lo: str, hi: str, gap) -> DataFrame:
    """Joins spans whose gap to the farthest end so far is at most ``gap``: by columns, lo, hi, spans."""
    w = Window.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(lo) - reach) > gap, F.lit(True)).cast("int")
    grouped = spans.withColumn("__new", new).withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "__group").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("spans")).drop("__group")


def build(trails: DataFrame, roads: DataFrame | None = None, depot: tuple[float, float] | None = None, p: Topology = Topology()) -> tuple[DataFrame, DataFrame]:
    """The network of trails (trail_id, name, coords) and roads (name, coords): edges and nodes.

    Lines are simplified, split, noded, cleaned and pruned of roads that lead to no trail. Roads
    go through the same steps under negative keys.
    """
    lines = trails.select(F.col("trail_id").alias("id"), "name", "coords")
    if roads is not None:
        keyed = numbered(roads.select("name", "coords"), ["name", F.xxhash64("coords")], "k")
        lines = lines.unionByName(keyed.select((-F.col("k") - 1).alias("id"), "name", "coords"))

    def simple(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(coords=[points(planar.simplify(line(c), p.simplify)) for c in f.coords])

    lines = checkpoint(lines.mapInPandas(simple, f"id long, name string, coords {COORDS}"))
    parts = checkpoint(split(lines.select("id", "coords"), p))
    placed = numbered(parts.join(lines.select("id", "name"), "id"), [F.col("id") < 0, F.abs("id"), "seq"], "edge_id")
    edges = placed.select(
        "edge_id", F.when(F.col("id") >= 0, F.col("id")).alias("trail_id"), "name", "seq",
        "length_m", F.lit(False).alias("off_trail"), (F.col("id") < 0).alias("is_road"), "coords",
    )
    edges, nodes = node(checkpoint(edges), p)
    edges, nodes = prune_orphans(checkpoint(without_degenerate(edges, p)), nodes)
    return add_depot(edges, nodes, *depot, p) if depot else (edges, nodes.withColumn("is_depot", F.lit(False)))


def tolerance_sweep(trails: DataFrame, tolerances: list[float], p: Topology = Topology()) -> DataFrame:
    """tolerance, components, edges, nodes, dangles of the network built at each snap tolerance."""
    from dataclasses import replace

    rows = []
    for t in tolerances:
        edges, nodes = build(trails, p=replace(p, snap=t))
        edges = checkpoint(edges)
        rows.append((t, graph.components(edges).select("component").distinct().count(), edges.count(), nodes.count(), graph.dangles(edges).count()))
    return trails.sparkSession.createDataFrame(rows, "tolerance double, components long, edges long, nodes long, dangles long")


def validation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """check and value of a network's vital numbers, in one pass each."""
    named = edges.agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("trail_id").alias("trails"), F.sum((F.col("u") == F.col("v")).cast("int")).alias("self_loops"),
        F.min("length_m").alias("shortest_m"), F.median("length_m").alias("median_m"), F.max("length_m").alias("longest_m"),
        (F.sum(F.when(F.col("trail_id").isNotNull(), F.col("length_m"))) / 1609.344).alias("trail_miles"), F.sum(F.col("is_road").cast("int")).alias("road_edges"),
    )
    stacked = named.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value")) for c in named.columns))).alias("r")).select("r.*")
    counts = nodes.agg(F.lit("nodes").alias("check"), F.count(F.lit(1)).cast("double").alias("value"))
    ends = graph.dangles(edges).agg(F.lit("dangles").alias("check"), F.count(F.lit(1)).cast("double").alias("value"))
    return stacked.unionByName(counts).unionByName(ends)


def projected(lines: DataFrame, zone_lon: float, back: bool = False) -> DataFrame:
    """Lines with coords turned from longitude and latitude to metres of a zone, or back."""

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        way = planar.inverse_mercator if back else planar.transverse_mercator
        for f in frames:
            sizes = [len(c) for c in f.coords]
            flat = np.concatenate([line(c) for c in f.coords]) if len(f) else np.zeros((0, 2))
            x, y = way(flat[:, 0], flat[:, 1], zone_lon)
            yield f.assign(coords=[points(p) for p in np.split(np.stack([x, y], 1), np.cumsum(sizes)[:-1])] if len(f) else [])

    return lines.mapInPandas(turn, lines.schema)


def published_lines(lines: DataFrame, zone_lon: float, tolerance: float = 2.0, decimals: int = 5) -> DataFrame:
    """id and coords (latitude, longitude pairs as arrays) for a map: simplified in metres, turned
    to degrees and rounded."""

    def shrink(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for c in f.coords:
                x, y = planar.simplify(line(c), tolerance).T
                lon, lat = planar.inverse_mercator(x, y, zone_lon)
                out.append(np.round(np.stack([lat, lon], 1), decimals).tolist())
            yield pd.DataFrame({"id": f.id, "coords": out})

    return lines.select("id", "coords").mapInPandas(shrink, "id long, coords array<array<double>>")


def junctions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes where three or more ends meet: id, x, y."""
    busy = graph.degrees(edges).where("degree >= 3").select(F.col("node").alias("node_id"))
    return nodes.join(busy, "node_id", "left_semi").select(F.col("node_id").alias("id"), "x", "y")
