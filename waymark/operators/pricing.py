"""Heights and times of edges: rasters, profiles, directional walking times, checks against gains
published elsewhere."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import speed
from waymark.operators import planar
from waymark.operators._scratch import checkpoint
from waymark.operators.topology import line
from waymark.params import FEET_PER_METRE, METRES_PER_MILE, Elevation, Speed


def smooth(z: np.ndarray, sigma_px: float) -> np.ndarray:
    """Gaussian smoothing of a raster: holes take the mean and are holes again afterwards, edges
    repeat their last value. Nothing happens at a tenth of a pixel or less."""
    if sigma_px <= 0.1:
        return z
    holes = np.isnan(z)
    filled = np.where(holes, np.nanmean(z) if (~holes).any() else 0.0, z)
    reach = int(4 * sigma_px + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma_px) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(filled, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        filled = np.apply_along_axis(np.convolve, axis, padded, kernel, "valid")
    return np.where(holes, np.nan, filled)


def clip(pixels: DataFrame, edges: DataFrame, x0: float, y0: float, resolution: float, pad: float) -> DataFrame:
    """The pixels within ``pad`` metres of the box around all edges; a range filter that reaches the
    scan of a raster stored by row and column."""
    p = edges.select(F.explode("coords").alias("p"))
    x_min, x_max, y_min, y_max = p.agg(F.min("p.x"), F.max("p.x"), F.min("p.y"), F.max("p.y")).first()
    cols = int((x_min - pad - x0) // resolution), int((x_max + pad - x0) // resolution)
    rows = int((y0 - y_max - pad) // resolution), int((y0 - y_min + pad) // resolution)
    return pixels.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def smooth_tiles(pixels: DataFrame, sigma_px: float, tile: int = 256) -> DataFrame:
    """row, col, z of a raster, smoothed tile by tile with a halo as wide as the kernel, so that no
    task holds more than one tile. Holes take their tile's mean."""
    if sigma_px <= 0.1:
        return pixels
    halo = int(4 * sigma_px + 0.5)
    spread = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    tiled = pixels.select("row", "col", "z", F.explode(spread("row")).alias("ti")).select("*", F.explode(spread("col")).alias("tj"))

    def one(key, f):
        i, j = key
        r0, c0 = f.row.min(), f.col.min()
        grid = np.full((f.row.max() - r0 + 1, f.col.max() - c0 + 1), np.nan)
        grid[f.row - r0, f.col - c0] = f.z
        out = smooth(grid, sigma_px)
        own = f[(f.row // tile == i) & (f.col // tile == j)]
        return pd.DataFrame({"row": own.row, "col": own.col, "z": out[own.row - r0, own.col - c0]})

    return tiled.groupBy("ti", "tj").applyInPandas(one, "row long, col long, z double")


def stations(edges: DataFrame, step: float) -> DataFrame:
    """edge_id, pos, d, x, y: points along each edge no more than ``step`` apart, and its own."""

    def along(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = []
            for e, c in zip(f.edge_id, f.coords):
                a = line(c)
                d = planar.densify(a, step)
                x, y = planar.at(a, d).T
                parts.append(pd.DataFrame({"edge_id": e, "pos": range(len(d)), "d": d, "x": x, "y": y}))
            if parts:
                yield pd.concat(parts)

    return edges.select("edge_id", "coords").mapInPandas(along, "edge_id long, pos int, d double, x double, y double")


def sample(points: DataFrame, pixels: DataFrame, x0: float, y0: float, resolution: float, rows: int, cols: int) -> DataFrame:
    """Adds z, bilinear between pixel centres, places beyond the raster held at its rim. pixels:
    row, col, z; row 0 is the northernmost, (x0, y0) its outer corner. Four equi joins on one
    exploded table, so the raster is spread and never broadcast."""
    hold = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(n - 1.001))
    c = hold((F.col("x") - x0) / resolution - 0.5, cols)
    r = hold((y0 - F.col("y")) / resolution - 0.5, rows)
    placed = points.withColumns({"__c": c, "__r": r})
    fr, fc = F.col("__r") - F.floor("__r"), F.col("__c") - F.floor("__c")
    four = F.array(*(F.struct((F.floor("__r") + i).alias("row"), (F.floor("__c") + j).alias("col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)))
    names = points.columns
    each = placed.select(*names, F.explode(four).alias("p")).select(*names, "p.*").join(pixels, ["row", "col"])
    return each.groupBy(*names).agg(F.sum(F.col("w") * F.col("z")).alias("z"))


def price(edges: DataFrame, profiles: DataFrame, p: Speed = Speed()) -> DataFrame:
    """Adds time_fwd_s, time_rev_s, gain_fwd_m, gain_rev_m, min_ele_m, max_ele_m, length_mi,
    score_mi. profiles: edge_id, pos, d, z. Edges without a profile take no time."""
    w = Window.partitionBy("edge_id").orderBy("pos")
    off = edges.select("edge_id", "off_trail")
    seg = profiles.withColumns({"run": F.lead("d").over(w) - F.col("d"), "rise": F.lead("z").over(w) - F.col("z")}).join(off, "edge_id")
    sums = seg.groupBy("edge_id").agg(
        F.sum(speed.segment_seconds(F.col("run"), F.col("rise"), p, F.col("off_trail"))).alias("time_fwd_s"),
        F.sum(speed.segment_seconds(F.col("run"), -F.col("rise"), p, F.col("off_trail"))).alias("time_rev_s"),
        F.sum(F.greatest("rise", F.lit(0.0))).alias("gain_fwd_m"), F.sum(F.greatest(-F.col("rise"), F.lit(0.0))).alias("gain_rev_m"),
        F.min("z").alias("min_ele_m"), F.max("z").alias("max_ele_m"),
    )
    out = edges.join(sums, "edge_id", "left").fillna(0.0, ["time_fwd_s", "time_rev_s", "gain_fwd_m", "gain_rev_m"])
    out = out.withColumn("length_mi", F.col("length_m") / METRES_PER_MILE)
    return out.withColumn("score_mi", F.when(F.col("trail_id").isNotNull(), F.col("length_mi")).otherwise(0.0))


def price_paces(edges: DataFrame, profiles: DataFrame, paces: list[float], p: Speed = Speed()) -> DataFrame:
    """pace, edge_id, time_fwd_s, time_rev_s of all edges at all paces, in one pass over profiles."""
    w = Window.partitionBy("edge_id").orderBy("pos")
    seg = profiles.withColumns({"run": F.lead("d").over(w) - F.col("d"), "rise": F.lead("z").over(w) - F.col("z")}).where(F.col("run").isNotNull()).join(edges.select("edge_id", "off_trail"), "edge_id")
    seconds = lambda sign: [F.sum(speed.segment_seconds(F.col("run"), sign * F.col("rise"), replace(p, pace=x), F.col("off_trail"))) for x in paces]
    sums = seg.groupBy("edge_id").agg(*(c.alias(f"f{i}") for i, c in enumerate(seconds(1))), *(c.alias(f"r{i}") for i, c in enumerate(seconds(-1))))
    rows = F.array(*(F.struct(F.lit(x).alias("pace"), F.col(f"f{i}").alias("time_fwd_s"), F.col(f"r{i}").alias("time_rev_s")) for i, x in enumerate(paces)))
    return sums.select("edge_id", F.explode(rows).alias("p")).select("p.pace", "edge_id", "p.time_fwd_s", "p.time_rev_s")


def gains_by_trail(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("trail_id").isNotNull()).groupBy("trail_id").agg(F.sum("gain_fwd_m").alias("gain_m"), F.sum("gain_rev_m").alias("loss_m"))


def check_gains(edges: DataFrame, published: DataFrame) -> DataFrame:
    """Per trail: climbs both ways in feet against published ones (trail_id, name, gain_ft,
    rev_gain_ft; left join), differences and percent of at least 10 ft."""
    mine = gains_by_trail(edges).select("trail_id", F.bround(F.col("gain_m") * FEET_PER_METRE).alias("our_ft"), F.bround(F.col("loss_m") * FEET_PER_METRE).alias("our_rev_ft"))
    out = mine.join(published.select("trail_id", "name", "gain_ft", "rev_gain_ft"), "trail_id", "left")
    pct = lambda a, b: F.bround(100 * (F.col(a) - F.col(b)) / F.greatest(F.col(b), F.lit(10)), 1)
    return out.withColumns({"diff_ft": F.col("our_ft") - F.col("gain_ft"), "pct": pct("our_ft", "gain_ft"), "rev_diff_ft": F.col("our_rev_ft") - F.col("rev_gain_ft"), "rev_pct": pct("our_rev_ft", "rev_gain_ft")})


def agreement(pairs: DataFrame, ours: str, theirs: str) -> DataFrame:
    """One row: r2 (4 places), n, bias (mean of ours - theirs) and mae over pairs without null."""
    both = pairs.where(F.col(ours).isNotNull() & F.col(theirs).isNotNull())
    return both.agg(F.round(F.pow(F.corr(ours, theirs), 2), 4).alias("r2"), F.count(F.lit(1)).alias("n"), F.avg(F.col(ours) - F.col(theirs)).alias("bias"), F.avg(F.abs(F.col(ours) - F.col(theirs))).alias("mae"))


def both_ways(checked: DataFrame) -> DataFrame:
    """Pools the two directions of ``check_gains``: ours, theirs."""
    return checked.select(F.explode(F.array(F.struct(F.col("our_ft").alias("ours"), F.col("gain_ft").alias("theirs")), F.struct(F.col("our_rev_ft").alias("ours"), F.col("rev_gain_ft").alias("theirs")))).alias("p")).select("p.*")


def length_check(tracks: DataFrame) -> DataFrame:
    """Adds computed_mi, delta_mi and pct against official_dist_mi, taken as at least 0.05."""
    miles = F.col("length_m") / METRES_PER_MILE
    official = F.greatest(F.col("official_dist_mi"), F.lit(0.05))
    return tracks.withColumns({"computed_mi": F.bround(miles, 3), "delta_mi": F.bround(miles - F.col("official_dist_mi"), 3), "pct": F.bround(100 * (miles - F.col("official_dist_mi")) / official, 1)})


def worst(rows: DataFrame, column: str, k: int, tie: str) -> DataFrame:
    """The k rows farthest from 0, ties by ``tie``."""
    return rows.orderBy(F.abs(F.col(column)).desc_nulls_last(), tie).limit(k)


def sensitivity(edges: DataFrame, pixels: DataFrame, published: DataFrame, sigmas: list[float], raster: dict, e: Elevation = Elevation(), p: Speed = Speed()) -> DataFrame:
    """sigma, r2, bias, mae, hours and gain of all edges at each smoothing."""
    points = checkpoint(stations(edges, e.step))
    out = None
    for s in sigmas:
        heights = smooth_tiles(pixels, s / e.resolution)
        priced = checkpoint(price(edges, sample(points, heights, **raster), p))
        row = agreement(both_ways(check_gains(priced, published)), "ours", "theirs").withColumn("sigma", F.lit(float(s)))
        total = priced.agg((F.sum("time_fwd_s") / 3600).alias("hours"), F.sum("gain_fwd_m").alias("gain_m"), F.lit(float(s)).alias("sigma"))
        row = row.join(total, "sigma")
        out = row if out is None else out.unionByName(row)
    return out
