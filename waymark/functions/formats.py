"""Printed forms. Each keeps its own rounding direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """H:MM, minutes rounded down."""
    minutes = F.floor(seconds / 60)
    return F.format_string("%d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def hours_minutes(seconds: Column) -> Column:
    """H:MM, to the nearest minute."""
    minutes = F.floor(seconds / 60 + 0.5)
    return F.format_string("%d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def minutes_seconds(seconds: Column) -> Column:
    """M:SS, to the nearest second before it is split."""
    whole = F.floor(seconds + 0.5)
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("int"), (whole % 60).cast("int"))


def time_of_day(seconds: Column, start_hour: int = 7) -> Column:
    """Clock time after so many seconds, minutes rounded down."""
    minutes = F.floor(seconds / 60) + start_hour * 60
    return F.format_string("%02d:%02d", (F.floor(minutes / 60) % 24).cast("int"), (minutes % 60).cast("int"))


def score_text(score: Column) -> Column:
    """One decimal, cut and not rounded, so that a score never reads as more than it is."""
    return F.format_string("%.1f", F.floor(score * 10 + 1e-9) / 10)


def lat_lon(lat: Column, lon: Column) -> Column:
    return F.format_string("%.5f, %.5f", lat, lon)


def preset_by_pace(pace: Column) -> Column:
    return F.format_string("preset_p%03d.json", F.bround(pace * 100).cast("int"))


def preset_by_speed(mph: Column, option: Column) -> Column:
    """Null for an unknown option."""
    return F.when(option.isin("a", "b", "c", "d"), F.format_string("preset_s%02d%s.json", F.bround(mph * 10).cast("int"), option))


def points_per_minute(points: Column, minutes: Column) -> Column:
    """Infinite where a cut saves no time."""
    return F.when(minutes > 1e-9, points / minutes).otherwise(F.lit(float("inf")))
