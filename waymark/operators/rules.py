"""Rules on walks: trails that must be complete, trails of which no edge may be walked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators import scoring


@dataclass(frozen=True)
class Rule:
    """What a walk owes. Free if it names nothing."""

    label: str = "free"
    require: tuple[int, ...] = ()
    forbid: tuple[int, ...] = ()

    def describe(self) -> dict:
        return {"label": self.label, "require": list(self.require), "forbid": list(self.forbid), "free": self.require == self.forbid == ()}


def for_option(option: str, trails: tuple[int, ...]) -> Rule:
    """Plans a and d are free, b requires the trails, c forbids them."""
    made = {"a": Rule(), "b": Rule("require", require=trails), "c": Rule("forbid", forbid=trails), "d": Rule()}
    if option not in made:
        raise ValueError(f"no such option: {option!r}")
    return made[option]


def members(names: DataFrame, groups: DataFrame) -> DataFrame:
    """corridor and trail_id. names: trail_id, name; groups: corridor, name (a small dimension)."""
    return names.join(groups, "name").select("corridor", "trail_id").distinct()


def offenders(walks: DataFrame, walked: DataFrame, by: list[str], edge: str, trails: DataFrame, rule: Rule) -> DataFrame:
    """by columns, kind and trail_id of each breach. walks: every walk's key, so that one without
    steps owes what is required too."""
    spark = walked.sparkSession
    forbid = spark.createDataFrame([(t,) for t in rule.forbid], "trail_id long")
    done = scoring.completed(walked, by, edge, trails)
    owed = walks.select(*by).distinct().withColumn("trail_id", F.explode(F.array(*map(F.lit, rule.require)).cast("array<long>")))
    missing = owed.join(done, [*by, "trail_id"], "left_anti").withColumn("kind", F.lit("missing"))
    entered = walked.join(trails.join(forbid, "trail_id", "left_semi"), edge).select(*by, "trail_id").distinct().withColumn("kind", F.lit("entered"))
    return missing.unionByName(entered).select(*by, "kind", "trail_id")


def violations(found: DataFrame, by: list[str]) -> DataFrame:
    """by columns, violations and messages in order of trail."""
    message = F.concat(F.when(F.col("kind") == "missing", "trail not complete: ").otherwise("trail entered: "), F.col("trail_id").cast("string"))
    rows = found.withColumn("m", F.struct("trail_id", message.alias("text"))).groupBy(*by)
    return rows.agg(F.count(F.lit(1)).alias("violations"), F.array_sort(F.collect_list("m"))["text"].alias("messages"))


def breakdown(corridors: DataFrame, facts: DataFrame, value: Column, done: Column) -> DataFrame:
    """Per corridor, in order of ``place``, its unique and total miles, complete and all trails;
    corridors without facts have a row of zeros. corridors: corridor, place; facts: corridor,
    trail_id, total."""
    each = facts.groupBy("corridor").agg(F.sum(value).alias("unique_miles"), F.sum("total").alias("total_miles"), F.sum(done.cast("int")).alias("completed"), F.countDistinct("trail_id").alias("n_trails"))
    zero = {"unique_miles": 0.0, "total_miles": 0.0, "completed": 0, "n_trails": 0}
    return corridors.join(each, "corridor", "left").fillna(zero).orderBy("place")
