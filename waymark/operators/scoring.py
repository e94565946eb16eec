"""Scores of sets of edges: miles of each edge once, trails that are complete, both capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import walk
from waymark.params import METRES_PER_MILE, Race

#: Ranges of worth per second that a knapsack's costs are added up in.
RANGES = 64


def completed(walked: DataFrame, by: list[str], edge: str, trails: DataFrame) -> DataFrame:
    """by columns and trail_id of the trails all of whose edges were walked (relational division)."""
    needs = trails.select("trail_id", edge).distinct()
    need = needs.groupBy("trail_id").agg(F.count(F.lit(1)).alias("__need"))
    met = walked.select(*by, edge).distinct().join(needs, edge).groupBy(*by, "trail_id").agg(F.count(F.lit(1)).alias("__met"))
    return met.join(need, "trail_id").where("__met = __need").select(*by, "trail_id")


def score(walked: DataFrame, by: list[str], edge: str, edges: DataFrame, trails: DataFrame, race: Race = Race()) -> DataFrame:
    """by columns, miles, trails, score. edges: ``edge`` and score_mi; unknown edges count nothing."""
    once = walked.select(*by, edge).distinct()
    miles = once.join(edges.select(edge, "score_mi"), edge, "left").groupBy(*by).agg(F.coalesce(F.sum("score_mi"), F.lit(0.0)).alias("miles"))
    done = completed(once, by, edge, trails).groupBy(*by).agg(F.count(F.lit(1)).alias("trails"))
    out = miles.join(done, by, "left").withColumn("trails", F.coalesce("trails", F.lit(0)))
    return out.withColumn("score", walk.running_score(F.col("miles"), F.col("trails"), race.per_trail, race.per_mile, race.trail_cap, race.mile_cap))


def evaluate(steps: DataFrame, by: list[str], edges: DataFrame, trails: DataFrame, race: Race = Race()) -> DataFrame:
    """Per walk: score, unique_miles, trails_completed, walked, offtrail, repeat, time_h, feasible,
    n_arcs. Roads count as repeat here, as they are no off-trail edges."""
    known = edges.select("edge_id", "length_m", "off_trail")
    sums = steps.select(*by, "edge_id", "time_s").join(known, "edge_id", "left").groupBy(*by).agg(
        (F.coalesce(F.sum("length_m"), F.lit(0.0)) / METRES_PER_MILE).alias("walked_miles"),
        (F.sum(F.when(F.col("off_trail"), F.col("length_m")).otherwise(0.0)) / METRES_PER_MILE).alias("offtrail_miles"),
        (F.sum("time_s") / 3600).alias("time_h"), (F.sum("time_s") <= race.budget_s + 1e-6).alias("feasible"), F.count(F.lit(1)).alias("n_arcs"),
    )
    scored = score(steps, by, "edge_id", edges, trails, race).withColumnsRenamed({"miles": "unique_miles", "trails": "trails_completed"})
    out = sums.join(scored, by)
    return out.withColumn("repeat_miles", F.col("walked_miles") - F.col("offtrail_miles") - F.col("unique_miles"))


def caps(miles: Column, trails: Column, race: Race = Race()) -> Column:
    """Which caps a score has reached, as a list of names."""
    return F.filter(F.array(F.when(miles >= race.mile_cap, "miles"), F.when(trails >= race.trail_cap, "trails")), lambda x: x.isNotNull())


def optimality(caps_: Column, gap_percent: Column) -> Column:
    """Proven only where no cap binds and the gap is closed."""
    return F.struct(((F.size(caps_) == 0) & (gap_percent == 0)).alias("proven"), gap_percent.alias("gap_pct"))


def coverage_bound(edges: DataFrame, race: Race = Race()) -> DataFrame:
    """One row: hours and miles no walk over all scored edges can undercut, and budget's share."""
    each = edges.where(F.col("trail_id").isNotNull()).select(F.least("time_fwd_s", "time_rev_s").alias("t"), "score_mi")
    return each.agg((F.sum("t") / 3600).alias("hours"), F.sum("score_mi").alias("miles"), (race.budget_s / F.sum("t")).alias("budget_share"))


def speed_ceiling(peak_mph: Column, race: Race = Race()) -> Column:
    """Whether the mile cap can bind at all at this peak speed within the budget."""
    most = peak_mph * race.budget_s / 3600
    return F.struct(most.alias("most_miles"), (most < race.mile_cap).alias("cap_cannot_bind"))


def knapsack_bound(edges: DataFrame, trails: DataFrame, race: Race = Race()) -> DataFrame:
    """One row: an upper bound on any walk's uncapped score. Each edge is worth its miles and its
    share of its trail's point, and costs its faster direction; the budget is filled in order of
    worth per second, the last edge in part."""
    share = trails.select("trail_id", "edge_id").distinct().withColumn("share", F.lit(race.per_trail) / F.count(F.lit(1)).over(Window.partitionBy("trail_id"))).groupBy("edge_id").agg(F.sum("share").alias("share"))
    each = edges.join(share, "edge_id", "left").select("edge_id", (F.col("score_mi") * race.per_mile + F.coalesce("share", F.lit(0.0))).alias("worth"), F.least("time_fwd_s", "time_rev_s").alias("t")).where("worth > 0")
    # Costs add up within ranges of worth per second, and over the ranges, of which there are few.
    each = each.withColumn("rate", F.when(F.col("t") > 0, F.col("worth") / F.col("t")).otherwise(F.lit(float("inf"))))
    cuts = each.where("t > 0").agg(F.percentile_approx("rate", [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("cuts")).first().cuts or []
    each = each.withColumn("range", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>"), lambda c: c > F.col("rate"))))
    totals = each.groupBy("range").agg(F.sum("t").alias("all_t"))
    before = totals.select("range", F.coalesce(F.sum("all_t").over(Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    order = Window.partitionBy("range").orderBy(F.desc("rate"), "edge_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = each.join(F.broadcast(before), "range").withColumn("spent", F.col("before") + F.coalesce(F.sum("t").over(order), F.lit(0.0)))
    room = F.lit(race.budget_s) - F.col("spent")
    part = F.when(F.col("t") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), room / F.col("t")))).otherwise((room >= 0).cast("double"))
    return spent.agg(F.coalesce(F.sum(F.col("worth") * part), F.lit(0.0)).alias("bound"))
