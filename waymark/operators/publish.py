"""Documents for publication and the checks they must pass first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import formats, turns
from waymark.operators import walk

SCORE_OFF, SECONDS_OFF, MILES_OFF = 1e-3, 1.0, 0.02


def edge_kind(off_trail, trail):
    return F.when(off_trail, "offtrail").when(trail.isNotNull(), "trail").otherwise("road")


def turn_cues(legs: DataFrame, by: list[str]) -> DataFrame:
    """Adds turn_deg, turn and glyph. legs: leg, bearing_in (at its start), bearing_out (at its end)."""
    w = Window.partitionBy(*by).orderBy("leg")
    out = legs.withColumn("turn_deg", turns.turn_degrees(F.lag("bearing_out").over(w), F.col("bearing_in")))
    return out.withColumn("turn", turns.turn_name(F.col("turn_deg"))).withColumn("glyph", turns.glyph(F.col("turn")))


def leg_bearings(coords, reach: float = 25.0):
    """A struct of the bearings a line begins and ends with, over up to ``reach`` metres of it."""
    n = F.size(coords)
    hyp = lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    total = F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), lambda i: hyp(F.get(coords, i - 1), F.get(coords, i))), F.lit(0.0), lambda a, x: a + x)

    def point(from_end: bool):
        line = F.reverse(coords) if from_end else coords
        start = F.struct(F.lit(0.0).alias("d"), F.element_at(line, 1)["x"].alias("px"), F.element_at(line, 1)["y"].alias("py"), F.element_at(line, 1)["x"].alias("x"), F.element_at(line, 1)["y"].alias("y"))

        def step(a, p):
            d = F.hypot(p["x"] - a["px"], p["y"] - a["py"])
            rest = F.least(d, F.greatest(F.lit(reach) - a["d"], F.lit(0.0)))
            t = F.when(d > 0, rest / d).otherwise(0.0)
            moved = rest > 0
            return F.struct((a["d"] + d).alias("d"), p["x"].alias("px"), p["y"].alias("py"), F.when(moved, a["px"] + t * (p["x"] - a["px"])).otherwise(a["x"]).alias("x"), F.when(moved, a["py"] + t * (p["y"] - a["py"])).otherwise(a["y"]).alias("y"))

        return F.aggregate(F.slice(line, 2, F.greatest(n - 1, F.lit(0))), start, step)

    a, b = point(False), point(True)
    first, last = F.element_at(coords, 1), F.element_at(coords, -1)
    zero = (n < 2) | (total == 0)
    return F.struct(F.when(zero, 0.0).otherwise(turns.bearing(a["x"] - first["x"], a["y"] - first["y"])).alias("bearing_in"), F.when(zero, 0.0).otherwise(turns.bearing(last["x"] - b["x"], last["y"] - b["y"])).alias("bearing_out"))


def stitched(steps: DataFrame, by: list[str]) -> DataFrame:
    """by columns and coords: the steps' lines end to end in walking order, joints once. steps:
    pos, u (where the step starts), edge_u, coords."""
    line = F.when(F.col("u") == F.col("edge_u"), F.col("coords")).otherwise(F.reverse("coords"))
    parts = F.array_sort(F.collect_list(F.struct("pos", line.alias("c"))))["c"]
    joined = steps.groupBy(*by).agg(F.flatten(parts).alias("all"))
    dropped = F.aggregate("all", F.array().cast("array<struct<x:double,y:double>>"), lambda a, p: F.when((F.size(a) > 0) & F.element_at(a, F.greatest(F.size(a), F.lit(1))).eqNullSafe(p), a).otherwise(F.concat(a, F.array(p))))
    return joined.select(*by, dropped.alias("coords"))


def cue_sheet(legs: DataFrame) -> DataFrame:
    """leg from 1, glyph, turn, turn_deg, segment, off_trail, miles, leg_min, elapsed, running
    columns, as printed. legs: leg, name, seconds, length_m, elapsed_s and the running columns."""
    return legs.select(
        (F.col("leg") + 1).alias("leg"), "glyph", "turn", "turn_deg", F.col("name").alias("segment"), "off_trail", F.round(F.col("length_m") / 1609.344, 2).alias("miles"),
        F.round(F.col("time_s") / 60, 1).alias("leg_min"), formats.clock(F.col("elapsed_s")).alias("elapsed"),
        F.round("running_unique", 2).alias("running_miles"), "running_trails", F.round("running_score", 2).alias("running_score"),
    )


def track_points(lines: DataFrame, by: list[str], total_s: float, start: str = "2000-01-01T07:00:00") -> DataFrame:
    """by columns, pos, x, y and time: the total is spread evenly over the line's points."""
    each = lines.select(*by, F.size("coords").alias("n"), F.posexplode("coords").alias("pos", "p"))
    at = F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1)).otherwise(0.0) * total_s
    return each.select(*by, "pos", "p.x", "p.y", F.date_format(F.to_timestamp(F.lit(start)) + F.make_dt_interval(secs=F.round(at, 0).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"))


def document(steps: DataFrame, totals: DataFrame, trails: DataFrame, corridors: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """route_id and one JSON document each: totals, steps in order, trails by completion, corridors."""
    s = steps.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("leg", *(c for c in steps.columns if c not in ("route_id", "leg"))))).alias("steps"))
    t = trails.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct(F.col("completed_at").isNull().alias("missed"), "completed_at", "name"))).alias("trails"))
    c = corridors.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct(*(x for x in corridors.columns if x != "route_id")))).alias("corridors"))
    whole = totals.select("route_id", F.struct(*(x for x in totals.columns if x != "route_id")).alias("totals"))
    out = whole.join(s, "route_id", "left").join(t, "route_id", "left").join(c, "route_id", "left")
    parts = ["totals", "steps", "trails", "corridors"]
    if cuts is not None:
        out = out.join(cuts.withColumnRenamed("document", "adaptive"), "route_id", "left")
        parts.append("adaptive")
    return out.select("route_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), *parts)).alias("document"))


def completion_order(steps: DataFrame, by: list[str], trails: DataFrame, names: DataFrame, pos: str = "pos", edge: str = "edge_id") -> DataFrame:
    """Every trail of ``names`` (trail_id, name) for every walk, with completed_at; unfinished ones
    null and last, then by name."""
    listed = names.agg(F.collect_set(F.struct("trail_id", "name")).alias("all")).withColumn("one", F.lit(1))
    every = steps.select(*by).distinct().withColumn("one", F.lit(1)).join(F.broadcast(listed), "one").select(*by, F.explode("all").alias("t")).select(*by, "t.*")
    done = every.join(walk.completions(steps, by, edge, pos, trails), [*by, "trail_id"], "left")
    return done.orderBy(*by, F.col("completed_at").asc_nulls_last(), "name")


def problems(steps: DataFrame, totals: DataFrame, budget_s: float) -> DataFrame:
    """route_id and problem for everything that keeps a document from publication; no rows means
    fit. steps: route_id, leg, cum_score, cum_s, cum_miles, cum_trails, cum_unique, cum_repeat,
    cum_offtrail, turn, glyph; totals: route_id, score, time_s, miles, trails."""
    last = steps.groupBy("route_id").agg(*(F.max_by(c, "leg").alias(c) for c in ("cum_score", "cum_s", "cum_miles", "cum_trails", "cum_unique", "cum_repeat", "cum_offtrail")))
    j = totals.join(last, "route_id", "left")
    off = lambda a, b, by: F.coalesce(F.abs(F.col(a) - F.col(b)) > by, F.lit(True))
    rules = {
        "score differs from the last step": off("score", "cum_score", SCORE_OFF), "time differs from the last step": off("time_s", "cum_s", SECONDS_OFF),
        "miles differ from the last step": off("miles", "cum_miles", MILES_OFF), "trails differ from the last step": off("trails", "cum_trails", 0.0),
        "categories do not add up": F.coalesce(F.abs(F.col("cum_unique") + F.col("cum_repeat") + F.col("cum_offtrail") - F.col("cum_miles")) > MILES_OFF, F.lit(True)),
        "over budget": F.col("time_s") > budget_s + SECONDS_OFF,
    }
    whole = j.select("route_id", F.explode(F.filter(F.array(*(F.when(c, name) for name, c in rules.items())), lambda x: x.isNotNull())).alias("problem"))
    wrong = steps.where(~turns.glyph(F.col("turn")).eqNullSafe(F.col("glyph"))).select("route_id", F.format_string("step %d: glyph does not fit its turn", F.col("leg").cast("int")).alias("problem"))
    w = Window.partitionBy("route_id").orderBy("leg")
    falls = steps.withColumn("p", F.lag("cum_score").over(w)).where(F.col("cum_score") < F.col("p") - 1e-9).select("route_id", F.format_string("step %d: score falls", F.col("leg").cast("int")).alias("problem"))
    return whole.unionByName(wrong).unionByName(falls)


def cut_problems(cuts: DataFrame, plans: DataFrame) -> DataFrame:
    """Checks of what a plan can shed: cuts lose nothing negative and save time; less budget never
    scores more."""
    bad = cuts.select("route_id", F.explode(F.filter(F.array(F.when(F.col("points_lost") < 0, "a cut gains points"), F.when(F.col("time_s") <= 0, "a cut saves no time")), lambda x: x.isNotNull())).alias("problem"))
    w = Window.partitionBy("route_id").orderBy("budget_s")
    rise = plans.withColumn("p", F.lag("score").over(w)).where(F.col("score") < F.col("p") - 1e-9).select("route_id", F.lit("a larger budget scores less").alias("problem"))
    return bad.unionByName(rise)


def require_none(found: DataFrame) -> None:
    """Raises if there are problems, naming up to ten."""
    rows = found.limit(10).collect()
    if rows:
        raise ValueError("; ".join(f"{r.route_id}: {r.problem}" for r in rows))


def pace_monotonic(presets: DataFrame, pace: str = "pace") -> DataFrame:
    """Rows whose score is below that of the next slower pace of the same option."""
    w = Window.partitionBy("option").orderBy(pace)
    return presets.withColumn("slower", F.lag("score").over(w)).where("score < slower - 1e-9")


def drift(ours: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: the largest difference of each column to what is stored."""
    b = stored.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return ours.join(b, key).agg(*(F.max(F.abs(F.col(c) - F.col(f"__{c}"))).alias(c) for c in columns))


def backdrop(edges: DataFrame) -> DataFrame:
    """One JSON document of the whole network: bounds and each edge's kind, miles and line."""
    kind = edge_kind(F.col("off_trail"), F.col("trail_id"))
    flat = edges.select("edge_id", kind.alias("kind"), F.bround(F.col("length_m") / 1609.344, 3).alias("miles"), "coords")
    ends = flat.select(F.explode("coords").alias("p")).agg(*(f(F.col(f"p.{c}")).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")))
    each = flat.agg(F.array_sort(F.collect_list(F.struct("edge_id", "kind", "miles", "coords"))).alias("edges"))
    return each.select(F.lit(1).alias("one"), "edges").join(ends.withColumn("one", F.lit(1)), "one").select(F.to_json(F.struct(F.struct("min_x", "min_y", "max_x", "max_y").alias("bounds"), "edges")).alias("document"))


def manifest(files: DataFrame) -> DataFrame:
    """One row per speed with its options in order, and one per pace sweep in order of pace, from
    names of files alone. files: name. Names that are no presets are left out."""
    speed = F.regexp_extract("name", r"preset_s(\d+)([abcd])\.json$", 1)
    option = F.regexp_extract("name", r"preset_s(\d+)([abcd])\.json$", 2)
    pace = F.regexp_extract("name", r"preset_p(\d+)\.json$", 1)
    tiers = files.where(speed != "").groupBy((speed.cast("int") / 10).alias("mph")).agg(F.array_sort(F.collect_list(F.struct(option.alias("option"), F.col("name").alias("file")))).alias("presets"))
    sweep = files.where(pace != "").select(F.lit(1).alias("one"), F.struct((pace.cast("int") / 100).alias("option"), F.col("name").alias("file")).alias("p"))
    sweep = sweep.groupBy("one").agg(F.array_sort(F.collect_list("p")).alias("p")).select(F.lit(None).cast("double").alias("mph"), F.transform("p", lambda x: F.struct(x["option"].cast("string").alias("option"), x["file"].alias("file"))).alias("presets"))
    return tiers.unionByName(sweep).orderBy(F.col("mph").asc_nulls_last())
