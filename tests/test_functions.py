"""Scalar functions: physical and printed invariants."""

import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import formats, speed, turns
from waymark.params import Params, Speed


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_speed_peaks_on_a_gentle_descent(spark):
    p = Speed()
    rows = spark.range(-100, 101).select((F.col("id") / 200).alias("s")).select("s", speed.kmh(F.col("s"), p).alias("v")).collect()
    assert max(rows, key=lambda r: r.v).s == -p.offset and min(r.v for r in rows) >= p.least_kmh
    assert math.isclose(max(r.v for r in rows), p.base_kmh * p.pace)


def test_off_trail_is_a_share_of_the_floored_speed(spark):
    steep = F.lit(5.0)
    on, off = value(spark, speed.metres_per_second(steep)), value(spark, speed.metres_per_second(steep, off_trail=F.lit(True)))
    assert math.isclose(on, 0.15 / 3.6) and math.isclose(off, 0.6 * on)


@pytest.mark.parametrize("z,same", [([0.0, 0.0, 0.0], True), ([0.0, 30.0, 0.0], True), ([0.0, 10.0, 30.0], False)])
def test_profiles_both_ways(spark, z, same):
    d, h = F.array(*map(F.lit, [0.0, 100.0, 200.0])), F.array(*map(F.lit, z))
    ahead, back = value(spark, speed.profile_seconds(d, h)), value(spark, speed.profile_seconds(d, h, reverse=True))
    assert ahead > 0 and (math.isclose(ahead, back) if same else ahead > back)
    assert value(spark, speed.profile_gain(h)) - value(spark, speed.profile_gain(h, reverse=True)) == z[-1] - z[0]


def test_profiles_without_a_segment(spark):
    one = F.array(F.lit(0.0))
    assert value(spark, speed.profile_seconds(one, one)) == 0.0 == value(spark, speed.profile_gain(one))
    still = F.array(F.lit(1.0), F.lit(1.0))
    assert value(spark, speed.profile_seconds(still, F.array(F.lit(0.0), F.lit(9.0)))) == 0.0


def test_pace_round_trip(spark):
    assert math.isclose(value(spark, speed.mph_to_pace(speed.pace_to_mph(F.lit(1.7)))), 1.7)
    assert math.isclose(value(spark, speed.pace_to_mph(F.lit(Speed().pace))), 5.0)
    assert value(spark, speed.pace_summary(F.lit(1.0))).peak_kmh == 6.0


@pytest.mark.parametrize("into,name", [(0, "straight"), (30, "slight right"), (90, "right"), (150, "sharp right"), (180, "turn around"), (330, "slight left"), (270, "left"), (210, "sharp left")])
def test_turns_from_north(spark, into, name):
    got = value(spark, turns.turn_name(turns.turn_degrees(F.lit(0.0), F.lit(float(into)))))
    assert got == name and value(spark, turns.glyph(F.lit(name))) == turns.GLYPHS[name]


def test_turn_edges(spark):
    assert value(spark, turns.turn_name(F.lit(None).cast("double"))) == "start"
    for d, name in ((20.0, "slight right"), (55.0, "right"), (125.0, "sharp right"), (165.0, "sharp right"), (-19.9, "straight")):
        assert value(spark, turns.turn_name(F.lit(d))) == name
    assert value(spark, turns.bearing(F.lit(1.0), F.lit(0.0))) == 90.0 and value(spark, turns.bearing(F.lit(0.0), F.lit(0.0))) == 0.0


def test_formats(spark):
    cases = [
        (formats.clock(F.lit(3659.9)), "1:00"), (formats.hours_minutes(F.lit(3659.9)), "1:01"), (formats.minutes_seconds(F.lit(59.6)), "1:00"), (formats.time_of_day(F.lit(3600.0)), "08:00"),
        (formats.score_text(F.lit(48.19)), "48.1"), (formats.score_text(F.lit(0.3)), "0.3"), (formats.lat_lon(F.lit(1.0), F.lit(-2.5)), "1.00000, -2.50000"),
        (formats.preset_by_pace(F.lit(1.5)), "preset_p150.json"), (formats.preset_by_speed(F.lit(5.5), F.lit("b")), "preset_s55b.json"), (formats.preset_by_speed(F.lit(5.5), F.lit("x")), None),
        (formats.points_per_minute(F.lit(3.0), F.lit(0.0)), math.inf), (formats.points_per_minute(F.lit(3.0), F.lit(2.0)), 1.5),
    ]
    for column, want in cases:
        assert value(spark, column) == want


def test_parameters_are_replaced_by_part():
    p = Params().with_(race={"budget_s": 3600.0}, speed={"pace": 1.0})
    assert (p.race.budget_s, p.speed.pace, p.race.mile_cap) == (3600.0, 1.0, 40.0) and Params().race.budget_s == 25_200.0
