"""Readers with explicit schemas: page tables, GPX tracks, map extracts, Parquet tables.

Fetching pages, tiles and map extracts over the network is left to whoever fills the folders read
here. All readers go through Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators import walk

TRAIL_TABLE = T.StructType([
    T.StructField("system", T.StringType()), T.StructField("trail_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("dist_mi", T.DoubleType()),
    T.StructField("gain_ft", T.LongType()), T.StructField("rev_gain_ft", T.LongType()), T.StructField("dist_th_mi", T.DoubleType()),
])
OSM = T.StructType([T.StructField("elements", T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType())),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))),
])))])
LAYER = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType())))])),
])))])
GPX = T.StructType([T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType()), T.StructField("ele", T.DoubleType())])


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def trail_table(spark: SparkSession, path: str, expected: int | None = 40) -> DataFrame:
    """Rows of an HTML table of trails, one cell per column of TRAIL_TABLE, sorted by trail_id.

    Raises if there are none or an id repeats; warns if there are not as many as expected.
    """
    import warnings

    page = spark.read.text(path, wholetext=True)
    rows = page.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    parsed = rows.select(cells.alias("c")).where(F.size("c") >= len(TRAIL_TABLE)).select(*(F.try_element_at("c", F.lit(i + 1)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(TRAIL_TABLE)))
    found = parsed.where(F.col("trail_id").isNotNull()).orderBy("trail_id")
    n, ids = found.agg(F.count(F.lit(1)), F.countDistinct("trail_id")).first()
    if not n:
        raise ValueError(f"no trails in {path}")
    if n != ids:
        raise ValueError(f"{n - ids} repeated trail ids in {path}")
    if expected and n != expected:
        warnings.warn(f"{n} trails where {expected} were expected", stacklevel=2)
    return found


def gpx(spark: SparkSession, path: str, row_tag: str = "trkpt") -> DataFrame:
    """trail_file, pos, lon, lat, ele of all track points of the files at a path, in order, without
    points at the place of the one before; a missing height is NaN. Raises if a file has fewer
    than two points left."""
    read = spark.read.format("xml").option("rowTag", row_tag).schema(GPX).load(path)
    points = read.select(F.input_file_name().alias("trail_file"), F.monotonically_increasing_id().alias("pos"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), F.coalesce("ele", F.lit(float("nan"))).alias("ele"))
    kept = walk.without_repeats(points, ["trail_file"], ["pos"], ["lon", "lat"])
    short = kept.groupBy("trail_file").count().where("count < 2").limit(1).collect()
    if short:
        raise ValueError(f"fewer than two points in {short[0].trail_file}")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("trail_file").orderBy("pos")) - 1)


def tracks(points: DataFrame) -> DataFrame:
    """trail_file, n_points, gpx_ele_m and coords of each track."""
    each = F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y"), "ele")))
    rows = points.groupBy("trail_file").agg(each.alias("p"))
    return rows.select("trail_file", F.size("p").alias("n_points"), F.col("p.ele").alias("gpx_ele_m"), F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("coords"))


def with_metadata(tracks_: DataFrame, table: DataFrame) -> DataFrame:
    """Tracks with their row of the trail table, by trail_id; raises where one has none."""
    lost = tracks_.join(table, "trail_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no metadata for trail {lost[0].trail_id}")
    renamed = {"dist_mi": "official_dist_mi", "gain_ft": "official_gain_ft", "rev_gain_ft": "official_rev_gain_ft", "dist_th_mi": "dist_to_th_mi"}
    return tracks_.join(table.withColumnsRenamed(renamed), "trail_id")


def _elements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OSM).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*").where(F.col("type") == "way")


def osm_roads(spark: SparkSession, path: str, deny: list[int] | None = None) -> DataFrame:
    """osm_id, name, surface, access, coords of the ways of a map extract with at least two points;
    unnamed ones go by their reference or as a forest road. deny: ids that are not wanted."""
    tag = lambda k: F.nullif(F.col("tags")[k], F.lit(""))
    ways = _elements(spark, path).where(F.size("geometry") >= 2)
    out = ways.select(F.col("id").alias("osm_id"), F.coalesce(tag("name"), tag("ref"), F.lit("Forest road")).alias("name"), tag("surface").alias("surface"), tag("access").alias("access"), F.transform("geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("coords"))
    return out.where(~F.col("osm_id").isin(list(deny))) if deny else out


def osm_paths(spark: SparkSession, path: str) -> DataFrame:
    """osm_id, pos, node_id, lon, lat of each node of each way."""
    pairs = F.arrays_zip("nodes", "geometry")
    each = _elements(spark, path).select(F.col("id").alias("osm_id"), F.posexplode(pairs).alias("pos", "p"))
    return each.select("osm_id", "pos", F.col("p.nodes").alias("node_id"), F.col("p.geometry.lon").alias("lon"), F.col("p.geometry.lat").alias("lat"))


def shared_nodes(paths: DataFrame) -> DataFrame:
    """node_id, ways (how often it occurs) and the place of the last occurrence, for nodes that
    occur more than once."""
    grouped = paths.groupBy("node_id").agg(F.count(F.lit(1)).alias("ways"), F.max_by(F.struct("lon", "lat"), F.struct("osm_id", "pos")).alias("at"))
    return grouped.where("ways > 1").select("node_id", "ways", "at.lon", "at.lat")


def road_layers(spark: SparkSession, layers: dict[str, str]) -> DataFrame:
    """name, access (the layer's key) and coords of line features of several files, unioned."""
    out = None
    for access, path in layers.items():
        f = spark.read.schema(LAYER).json(path, multiLine=True).select(F.explode("features").alias("f"))
        rows = f.where(F.size("f.geometry.coordinates") >= 2).select(
            F.coalesce(F.nullif(F.col("f.properties")["NAME"], F.lit("")), F.nullif(F.col("f.properties")["name"], F.lit("")), F.lit("Forest road")).alias("name"), F.lit(access).alias("access"),
            F.transform("f.geometry.coordinates", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("coords"),
        )
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def presets(spark: SparkSession, path: str) -> DataFrame:
    """Published documents at a path or pattern, with the file each came from."""
    return spark.read.json(path, multiLine=True).withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
