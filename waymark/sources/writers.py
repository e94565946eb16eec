"""Writers. Spark's committer makes each an all-or-nothing replacement of its folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layers(folder: str, **frames: DataFrame | None) -> None:
    """One Parquet folder per layer; empty connectors and missing layers are left out. Lists of raw
    heights stay out of the layers."""
    for name, df in frames.items():
        if df is None or (name == "connectors" and not df.limit(1).count()):
            continue
        df.drop("gpx_ele_m").write.mode("overwrite").parquet(f"{folder}/{name}")


def csv_table(df: DataFrame, path: str) -> None:
    """One CSV with a header; for cue sheets and other tables a person reads."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def quoted(*columns) -> F.Column:
    """A CSV line: values with a quote, comma or line break in quotes, quotes doubled, nulls empty."""
    one = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *(one(F.coalesce(c.cast("string"), F.lit(""))) for c in columns))


def browser_csv(meta: DataFrame, steps: DataFrame, cuts: DataFrame, plans: DataFrame) -> DataFrame:
    """route_id and a whole CSV file: a byte order mark, a block of facts, the steps, the cuts by
    points per minute and the salvage plans, with CRLF line ends. meta: route_id, key, value."""
    header = lambda *names: quoted(*map(F.lit, names))

    def block(df: DataFrame, names: list[str], order: list, place: int) -> DataFrame:
        rows = df.select("route_id", F.struct(*order).alias("o"), quoted(*map(F.col, names)).alias("l"))
        return rows.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("o", "l")))["l"].alias("ls")).select("route_id", F.lit(place).alias("place"), F.concat(F.array(header(*names)), F.col("ls")).alias("ls"))

    parts = block(meta, ["key", "value"], [F.col("key")], 0)
    parts = parts.unionByName(block(steps, [c for c in steps.columns if c != "route_id"], [F.col("leg")], 1))
    parts = parts.unionByName(block(cuts, ["span_id", "time_s", "points_lost"], [F.when(F.col("time_s") > 1e-9, F.col("points_lost") / F.col("time_s")).otherwise(F.lit(float("inf"))), F.col("span_id")], 2))
    parts = parts.unionByName(block(plans, ["budget_s", "score", "time_s"], [-F.col("budget_s")], 3))
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ls"))), lambda p: F.concat(p["ls"], F.array(F.lit("")))))
    return parts.groupBy("route_id").agg(F.concat(F.lit("﻿"), F.array_join(lines, "\r\n")).alias("text"))


def gpx_text(points: DataFrame, by: list[str], name: str) -> DataFrame:
    """by columns and a GPX 1.1 document with one track, from pos, x (lon), y (lat), time."""
    one = F.format_string('<trkpt lat="%.6f" lon="%.6f"><time>%s</time></trkpt>', F.col("y"), F.col("x"), F.col("time"))
    body = points.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", one.alias("p"))))["p"], "\n").alias("b"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="waymark" xmlns="http://www.topografix.com/GPX/1/1">\n<trk><name>{name}</name><trkseg>\n'
    return body.select(*by, F.concat(F.lit(head), "b", F.lit("\n</trkseg></trk>\n</gpx>\n")).alias("text"))


def text_file(df: DataFrame, path: str, column: str = "document") -> None:
    df.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def all_of(jobs: dict[str, Callable[[], None]]) -> dict[str, str]:
    """Runs each job; one that fails does not keep the others from running. Returns what went
    wrong, by name."""
    failed = {}
    for name, job in jobs.items():
        try:
            job()
        except Exception as e:  # reported to the caller, by name
            failed[name] = f"{type(e).__name__}: {e}"
    return failed
