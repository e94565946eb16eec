"""Streams against the batch operators; readers and writers round trip."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import publish, walk
from waymark.sources import readers, writers
from waymark.streaming import walks


def test_running_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("edge"), F.round("value").cast("long").alias("score"), F.lit(1).cast("long").alias("seconds"))
    parts = events.withColumn("k", F.ntile(3).over(Window.orderBy("ts")))
    for k in (1, 2, 3):
        parts.where(f"k = {k}").drop("k").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    # Files may be picked up in any order; batches are fed one file at a time by name.
    q = walks.running(stream, "3650 days").writeStream.format("memory").queryName("run").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("run")
    assert got.count() == events.count()
    last = got.groupBy("user_id").agg(F.max("running_unique").alias("r"), F.max("elapsed_s").alias("e"), F.sum(F.col("first_visit").cast("int")).alias("f"))
    want = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("e"), F.countDistinct("edge").alias("f"))
    assert last.select("user_id", "e", "f").exceptAll(want).count() == 0


def test_stretches(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 5, 9, 30, 33)] + [(2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    got = sorted((r.user_id, r.steps) for r in walks.merge_gaps(df, "10 minutes", "1 hour").collect())
    assert got == [(1, 2), (1, 3), (2, 1)]


PAGE = """<table><tr><th>System</th></tr>
<tr><td> West </td><td>2</td><td><b>Ridge</b></td><td>1.50</td><td>300</td><td>20</td><td>0.1</td></tr>
<tr><td>East</td><td>1</td><td>Creek</td><td>2.25</td><td>100</td><td>120</td><td>0.3</td></tr></table>"""


def test_trail_table(spark, tmp_path):
    (tmp_path / "p.html").write_text(PAGE)
    got = readers.trail_table(spark, str(tmp_path / "p.html"), expected=2).collect()
    assert [tuple(r) for r in got] == [("East", 1, "Creek", 2.25, 100, 120, 0.3), ("West", 2, "Ridge", 1.5, 300, 20, 0.1)]
    with pytest.warns(UserWarning):
        readers.trail_table(spark, str(tmp_path / "p.html"))
    (tmp_path / "q.html").write_text(PAGE.replace("<td>2</td>", "<td>1</td>"))
    (tmp_path / "r.html").write_text("nothing")
    for bad in ("q", "r"):
        with pytest.raises(ValueError):
            readers.trail_table(spark, str(tmp_path / f"{bad}.html"))


def test_gpx(spark, tmp_path):
    pts = [(1.0, 2.0, 5), (1.0, 2.0, 6), (1.0, 3.0, None), (1.0, 2.0, 7)]
    body = "".join(f'<trkpt lat="{a}" lon="{b}">{"" if e is None else f"<ele>{e}</ele>"}</trkpt>' for a, b, e in pts)
    (tmp_path / "7.gpx").write_text(f"<gpx><trk><trkseg>{body[: len(body) // 2]}{body[len(body) // 2 :]}</trkseg></trk></gpx>")
    points = readers.gpx(spark, str(tmp_path / "7.gpx"))
    assert [(r.pos, r.lat, r.lon) for r in points.orderBy("pos").collect()] == [(0, 1, 2), (1, 1, 3), (2, 1, 2)]
    track = readers.tracks(points).first()
    assert track.n_points == 3 and track.gpx_ele_m[0] == 5 and track.gpx_ele_m[1] != track.gpx_ele_m[1]
    meta = readers.with_metadata(readers.tracks(points).withColumn("trail_id", F.lit(1).cast("long")), spark.createDataFrame([("E", 1, "Creek", 1.0, 5, 6, 0.1)], readers.TRAIL_TABLE)).first()
    assert meta.official_dist_mi == 1.0 and meta.name == "Creek"
    with pytest.raises(ValueError):
        readers.with_metadata(readers.tracks(points).withColumn("trail_id", F.lit(9).cast("long")), spark.createDataFrame([], readers.TRAIL_TABLE))


def test_map_extracts(spark, tmp_path):
    way = lambda i, tags, nodes: {"type": "way", "id": i, "tags": tags, "nodes": nodes, "geometry": [{"lat": float(n), "lon": -float(n)} for n in nodes]}
    doc = {"elements": [way(1, {"name": "A"}, [1, 2]), way(2, {"name": "", "ref": "R9", "access": "no"}, [2, 3]), way(3, {"surface": "dirt"}, [4, 2]), way(4, {"name": "short"}, [9]), {"type": "node", "id": 5}]}
    (tmp_path / "osm.json").write_text(json.dumps(doc))
    got = readers.osm_roads(spark, str(tmp_path / "osm.json"), deny=[1]).orderBy("osm_id").collect()
    assert [(r.osm_id, r.name, r.surface, r.access) for r in got] == [(2, "R9", None, "no"), (3, "Forest road", "dirt", None)]
    shared = readers.shared_nodes(readers.osm_paths(spark, str(tmp_path / "osm.json"))).collect()
    assert [(r.node_id, r.ways) for r in shared] == [(2, 3)]
    layer = {"features": [{"properties": {"NAME": "F1"}, "geometry": {"type": "LineString", "coordinates": [[0.0, 1.0], [2.0, 3.0]]}}]}
    for k in ("open", "closed"):
        (tmp_path / f"{k}.json").write_text(json.dumps(layer))
    roads = readers.road_layers(spark, {k: str(tmp_path / f"{k}.json") for k in ("open", "closed")}).collect()
    assert sorted((r.name, r.access) for r in roads) == [("F1", "closed"), ("F1", "open")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 'a "b", c', 1.5), (1, 1, None, 2.0)], "route_id long, leg int, name string, points double")
    writers.csv_table(df, str(tmp_path / "cues"))
    assert spark.read.csv(str(tmp_path / "cues"), header=True).count() == 2
    meta = spark.createDataFrame([(1, "score", "48.1")], "route_id long, key string, value string")
    cuts = spark.createDataFrame([(1, 4, 60.0, 3.0), (1, 5, 60.0, 1.0)], "route_id long, span_id int, time_s double, points_lost double")
    plans = spark.createDataFrame([(1, 100.0, 2.0, 90.0), (1, 200.0, 3.0, 190.0)], "route_id long, budget_s double, score double, time_s double")
    text = writers.browser_csv(meta, df, cuts, plans).first().text
    lines = text.split("\r\n")
    assert text[0] == "﻿" and '0,"a ""b"", c",1.5' in lines and "1,,2.0" in lines
    assert lines.index("5,60.0,1.0") < lines.index("4,60.0,3.0") and lines.index("200.0,3.0,190.0") < lines.index("100.0,2.0,90.0")
    points = spark.createDataFrame([(1, 0, -86.0, 33.0, "t0"), (1, 1, -86.1, 33.1, "t1")], "route_id long, pos int, x double, y double, time string")
    gpx = writers.gpx_text(points, ["route_id"], "day").first().text
    (tmp_path / "r.gpx").write_text(gpx)
    assert readers.gpx(spark, str(tmp_path / "r.gpx")).count() == 2
    writers.layers(str(tmp_path / "layers"), edges=df, connectors=df.limit(0), route=None)
    assert sorted(p.name for p in (tmp_path / "layers").iterdir()) == ["edges"]
    done = []
    failed = writers.all_of({"a": lambda: done.append(1), "b": lambda: 1 / 0, "c": lambda: done.append(2)})
    assert done == [1, 2] and list(failed) == ["b"]


def test_manifest(spark):
    names = spark.createDataFrame([(n,) for n in ("preset_s50b.json", "preset_s50a.json", "preset_s55a.json", "preset_p150.json", "preset_p100.json", "other.json")], "name string")
    got = [(r.mph, [p.option for p in r.presets]) for r in publish.manifest(names).collect()]
    assert got == [(5.0, ["a", "b"]), (5.5, ["a"]), (None, ["1.0", "1.5"])]


def test_relief_and_locate(spark):
    r = spark.range(1).select(walk.relief(F.lit(5.0), F.lit(2.0), F.lit(7), F.lit(8)).alias("r")).first().r
    assert (r.gain_m, r.loss_m) == (2.0, 5.0)
    steps = spark.createDataFrame([(1, k, k // 3) for k in range(9)], "route_id long, pos int, leg int")
    cuts = spark.createDataFrame([(1, 3, 6)], "route_id long, arc_start int, arc_end int")
    assert [(x.leg_start, x.leg_end) for x in walk.locate(cuts, steps, ["route_id"]).collect()] == [(1, 1)]
    assert sorted(x.pos for x in walk.boundaries(cuts, ["route_id"], F.lit(9)).collect()) == [3, 6]
