"""Speed, pace and profile arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.params import MILES_PER_KM, Speed


def kmh(slope: Column, p: Speed = Speed()) -> Column:
    """Exponential fall of speed with the slope's distance from a gentle descent, with a floor."""
    return F.greatest(F.lit(p.base_kmh) * F.exp(-p.steepness * F.abs(slope + p.offset)) * p.pace, F.lit(p.least_kmh))


def metres_per_second(slope: Column, p: Speed = Speed(), off_trail: Column | None = None) -> Column:
    """Off-trail speed is a share of the floored speed."""
    speed = kmh(slope, p) * 1000 / 3600
    return speed if off_trail is None else F.when(off_trail, speed * p.off_trail).otherwise(speed)


def segment_seconds(run: Column, rise: Column, p: Speed = Speed(), off_trail: Column | None = None) -> Column:
    """Of one profile segment; segments without length take no time."""
    return F.when(run <= 1e-9, 0.0).otherwise(run / metres_per_second(rise / run, p, off_trail))


def profile_seconds(d: Column, z: Column, p: Speed = Speed(), reverse: bool = False, off_trail: Column | None = None) -> Column:
    """Over a whole profile given as arrays of distance and height; under two points take none."""
    steps = F.sequence(F.lit(1), F.size(d) - 1)
    sign = -1.0 if reverse else 1.0
    seconds = F.transform(steps, lambda i: segment_seconds(F.get(d, i) - F.get(d, i - 1), sign * (F.get(z, i) - F.get(z, i - 1)), p, off_trail))
    return F.when(F.size(d) < 2, 0.0).otherwise(F.aggregate(seconds, F.lit(0.0), lambda a, x: a + x))


def profile_gain(z: Column, reverse: bool = False) -> Column:
    """Sum of the climbs."""
    steps = F.sequence(F.lit(1), F.size(z) - 1)
    sign = -1.0 if reverse else 1.0
    climbs = F.transform(steps, lambda i: F.greatest(sign * (F.get(z, i) - F.get(z, i - 1)), F.lit(0.0)))
    return F.when(F.size(z) < 2, 0.0).otherwise(F.aggregate(climbs, F.lit(0.0), lambda a, x: a + x))


def pace_to_mph(pace: Column, p: Speed = Speed()) -> Column:
    return F.lit(p.base_kmh) * pace * MILES_PER_KM


def mph_to_pace(mph: Column, p: Speed = Speed()) -> Column:
    return mph / (p.base_kmh * MILES_PER_KM)


def pace_summary(pace: Column, p: Speed = Speed()) -> Column:
    """A struct of what a pace means on the flat, downhill at the optimum and off trail."""
    flat = F.lit(p.base_kmh) * F.exp(F.lit(-p.steepness * abs(p.offset))) * pace
    peak = F.lit(p.base_kmh) * pace
    return F.struct(
        pace.alias("pace_factor"), F.round(flat, 3).alias("flat_kmh"), F.round(flat * MILES_PER_KM, 3).alias("flat_mph"), F.round(60 / (flat * MILES_PER_KM), 2).alias("flat_min_per_mile"),
        F.round(peak, 3).alias("peak_kmh"), F.round(peak * MILES_PER_KM, 3).alias("peak_mph"), F.lit(-p.offset).alias("peak_slope"), F.round(flat * p.off_trail * MILES_PER_KM, 3).alias("off_trail_mph"),
    )
