"""Operators on walks: rows of steps in order, one or many walks at once.

A walk has a key (``by``, a list of columns), an order, and for each step the edge walked. All
operators are windows partitioned by the walk, so walks spread over the cluster and one walk is
sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def _so_far(by: list[str], order: list[str]):
    return _ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def positions(steps: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds pos, from 0."""
    return steps.withColumn("pos", F.row_number().over(_ordered(by, order)) - 1)


def category(first_visit: Column, trail: Column, off_trail: Column | None = None) -> Column:
    """repeat for a step over an edge walked before, unique for a first visit of a trail, offtrail
    for the rest, which is where roads are counted."""
    return F.when(~first_visit, "repeat").when(trail.isNotNull(), "unique").otherwise("offtrail")


def detail(steps: DataFrame, by: list[str], order: list[str], edge: str, trail: Column, score: Column, seconds: Column | None = None) -> DataFrame:
    """Adds first_visit, cat, running_unique (score of first visits so far) and, where seconds are
    given, elapsed_s."""
    visit = F.row_number().over(_ordered([*by, edge], order)) == 1
    out = steps.withColumn("first_visit", visit)
    out = out.withColumn("cat", category(F.col("first_visit"), trail))
    out = out.withColumn("running_unique", F.sum(F.when(F.col("first_visit"), score).otherwise(0)).over(_so_far(by, order)))
    return out if seconds is None else out.withColumn("elapsed_s", F.sum(seconds).over(_so_far(by, order)))


def completions(steps: DataFrame, by: list[str], edge: str, pos: str, trails: DataFrame) -> DataFrame:
    """Where each trail is complete in each walk: the by columns, trail_id, completed_at (null
    for a trail of which an edge is missing, if any edge of it was walked).

    trails: trail_id and ``edge``, the edges each needs. A trail is complete at the latest of its
    edges' first visits.
    """
    firsts = steps.groupBy(*by, edge).agg(F.min(pos).alias("__first"))
    needs = trails.select("trail_id", edge).distinct()
    need = needs.groupBy("trail_id").agg(F.count(F.lit(1)).alias("__need"))
    met = firsts.join(needs, edge).groupBy(*by, "trail_id").agg(F.count(F.lit(1)).alias("__met"), F.max("__first").alias("__last"))
    return met.join(need, "trail_id").select(*by, "trail_id", F.when(F.col("__met") == F.col("__need"), F.col("__last")).alias("completed_at"))


def running_completed(steps: DataFrame, by: list[str], edge: str, pos: str, trails: DataFrame) -> DataFrame:
    """Adds running_trails: trails complete at or before each step."""
    done = completions(steps, by, edge, pos, trails).where("completed_at is not null").groupBy(*by, F.col("completed_at").alias(pos)).agg(F.count(F.lit(1)).alias("__done"))
    joined = steps.join(done, [*by, pos], "left")
    return joined.withColumn("running_trails", F.coalesce(F.sum("__done").over(_so_far(by, [pos])), F.lit(0))).drop("__done")


def running_score(miles: Column, trails: Column, per_trail: float, per_mile: float, trail_cap: float, mile_cap: float) -> Column:
    return F.least(trails * per_trail, F.lit(trail_cap)) + F.least(miles * per_mile, F.lit(mile_cap))


def legs(steps: DataFrame, by: list[str], order: list[str], key: list[str], breaks: Column | None = None) -> DataFrame:
    """Adds leg, from 0: a new one wherever a column of ``key`` changes (nulls are equal) or the
    boolean ``breaks`` says so."""
    w = _ordered(by, order)
    same = F.lag(F.struct(*key)).over(w).eqNullSafe(F.struct(*key)) & (F.row_number().over(w) > 1)
    new = ~same if breaks is None else ~same | breaks
    return steps.withColumn("__new", new.cast("int")).withColumn("leg", F.sum("__new").over(_so_far(by, order)) - 1).drop("__new")


def collapse(steps: DataFrame, by: list[str], pos: str, sums: list[str], lasts: list[str], keys: list[str]) -> DataFrame:
    """One row per leg: its keys, sums, the last value of running columns, first_pos, last_pos, steps."""
    return steps.groupBy(*by, "leg").agg(
        *(F.min_by(k, pos).alias(k) for k in keys), *(F.sum(c).alias(c) for c in sums), *(F.max_by(c, pos).alias(c) for c in lasts),
        F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count(F.lit(1)).alias("steps"),
    )


def boundaries(cuts: DataFrame, by: list[str], n: Column) -> DataFrame:
    """Positions at which spans arc_start, arc_end begin or end, inside the walk, once each."""
    at = cuts.select(*by, F.explode(F.array("arc_start", "arc_end")).alias("pos"), n.alias("__n"))
    return at.where((F.col("pos") > 0) & (F.col("pos") < F.col("__n"))).select(*by, "pos").distinct()


def forced_breaks(steps: DataFrame, by: list[str], order: list[str], key: list[str], at: DataFrame) -> DataFrame:
    """Legs that also begin at every position in ``at`` (by columns and pos)."""
    marked = steps.join(at.select(*by, "pos").distinct().withColumn("__break", F.lit(True)), [*by, "pos"], "left")
    return legs(marked, by, order, key, F.coalesce("__break", F.lit(False))).drop("__break")


def locate(cuts: DataFrame, steps: DataFrame, by: list[str]) -> DataFrame:
    """Adds leg_start and leg_end (inclusive) to spans of positions arc_start, arc_end (exclusive)."""
    start = steps.select(*by, F.col("pos").alias("arc_start"), F.col("leg").alias("leg_start"))
    end = steps.select(*by, (F.col("pos") + 1).alias("arc_end"), F.col("leg").alias("leg_end"))
    return cuts.join(start, [*by, "arc_start"], "left").join(end, [*by, "arc_end"], "left")


def cumulative_by_category(steps: DataFrame, by: list[str], order: list[str], value: str, categories: list[str]) -> DataFrame:
    """Adds for each category a running total of ``value``, and one over all."""
    w = _so_far(by, order)
    columns = {f"cum_{c}": F.sum(F.when(F.col("cat") == c, F.col(value)).otherwise(0)).over(w) for c in categories}
    return steps.withColumns(columns | {"cum_all": F.sum(value).over(w)})


def relief(gain: Column, loss: Column, from_node: Column, edge_u: Column) -> Column:
    """gain and loss of a step, swapped where the edge is walked against its direction."""
    ahead = from_node == edge_u
    return F.struct(F.when(ahead, gain).otherwise(loss).alias("gain_m"), F.when(ahead, loss).otherwise(gain).alias("loss_m"))


def without_repeats(points: DataFrame, by: list[str], order: list[str], place: list[str]) -> DataFrame:
    """Drops points at the place of the one before; points that come back later stay."""
    before = F.lag(F.struct(*place)).over(_ordered(by, order))
    return points.withColumn("__before", before).where(F.col("__before").isNull() | ~F.struct(*place).eqNullSafe(F.col("__before"))).drop("__before")


def continuity(steps: DataFrame, by: list[str], depot: Column, budget: float) -> DataFrame:
    """Per walk: ok and problem, the first of: does not start or end at the depot, a break between
    steps, over budget. steps: pos, u, v, time_s. Walks without steps have no row."""
    w = _ordered(by, ["pos"])
    joined = steps.withColumn("__next", F.lead("u").over(w)).withColumn("__depot", depot)
    a = joined.groupBy(*by).agg(
        F.min_by("u", "pos").alias("u"), F.max_by("v", "pos").alias("v"), F.first("__depot").alias("d"),
        F.min(F.when(F.col("__next") != F.col("v"), F.col("pos"))).alias("gap"), F.sum("time_s").alias("t"),
    )
    problem = (
        F.when(F.col("u") != F.col("d"), "starts away from the depot").when(F.col("v") != F.col("d"), "ends away from the depot")
        .when(F.col("gap").isNotNull(), F.format_string("break after step %d", F.col("gap").cast("int"))).when(F.col("t") > budget + 1e-6, "over budget")
    )
    return a.select(*by, problem.isNull().alias("ok"), problem.alias("problem"))
