"""Bearings and turns between legs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turn names and the glyphs printed for them.
GLYPHS = {
    "start": "●", "straight": "↑", "turn around": "↩", "slight left": "↖", "slight right": "↗",
    "left": "←", "right": "→", "sharp left": "↙", "sharp right": "↘",
}
STRAIGHT, SLIGHT, PLAIN, AROUND = 20, 55, 125, 165


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 where there is no direction."""
    return F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0)))


def turn_degrees(out: Column, into: Column) -> Column:
    """From the bearing one leg ends with to the one the next begins with, in [-180, 180), to a
    tenth of a degree; right is positive."""
    return F.round(F.pmod(into - out + 180, F.lit(360.0)) - 180, 1)


def turn_name(degrees: Column) -> Column:
    """Null is the start of a walk."""
    size, side = F.abs(degrees), F.when(degrees < 0, "left").otherwise("right")
    return (
        F.when(degrees.isNull(), "start").when(size < STRAIGHT, "straight").when(size > AROUND, "turn around")
        .when(size < SLIGHT, F.concat(F.lit("slight "), side)).when(size < PLAIN, side).otherwise(F.concat(F.lit("sharp "), side))
    )


def glyph(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in GLYPHS.items() for x in pair))[name]
