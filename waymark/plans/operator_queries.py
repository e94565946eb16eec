"""More registered queries: operators that take whole walks, edges and profiles, called as they are.

A user's events in time order are a walk: its edges are the event types by number, a step's time its
value in whole cents. An order is an edge, and its lines a profile of distance and height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import formats, speed
from waymark.operators import adapt, graph, pricing, rules, scoring, topology, walk
from waymark.params import FEET_PER_METRE, METRES_PER_MILE, MILES_PER_KM, Speed
from waymark.plans.catalogue import _table, cents, query
from waymark.sources.readers import tables

_P = Speed()


def _types(events: DataFrame) -> DataFrame:
    return events.select("event_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("event_type")).cast("long"))


def _steps(spark, sf) -> DataFrame:
    """route_id, pos, edge_id, u, v, time_s, score_mi: a user's events; the node after a step is its type."""
    events = _table(spark, sf, "events")
    numbered = events.join(_types(events), "event_type").withColumn("route_id", F.col("user_id").cast("long"))
    placed = walk.positions(numbered, ["route_id"], ["ts", "event_id"])
    before = F.lag("k").over(Window.partitionBy("route_id").orderBy("pos"))
    return placed.select("route_id", F.col("pos").cast("long").alias("pos"), F.col("k").alias("edge_id"), F.coalesce(before, F.col("k")).alias("u"), F.col("k").alias("v"), cents("value").cast("double").alias("time_s"), F.col("k").cast("double").alias("score_mi"))


def _type_edges(spark, sf) -> DataFrame:
    types = _types(_table(spark, sf, "events"))
    return types.select(F.col("k").alias("edge_id"), F.col("k").cast("double").alias("score_mi"), (100.0 * F.col("k")).alias("length_m"), (F.col("k") % 2 == 0).alias("off_trail"))


def _type_trails(spark, sf) -> DataFrame:
    """Four trails: all types, the first three, the even ones, those from the fourth on."""
    own = F.array_compact(F.array(F.lit(1), F.when(F.col("k") <= 3, 2), F.when(F.col("k") % 2 == 0, 3), F.when(F.col("k") >= 4, 4))).cast("array<long>")
    return _types(_table(spark, sf, "events")).select(F.explode(own).alias("trail_id"), F.col("k").alias("edge_id"))


_STEPS = """WITH types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
s AS (SELECT CAST(user_id AS BIGINT) AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, k AS edge_id, round(value * 100)::BIGINT AS secs FROM events JOIN types USING (event_type)),
steps AS (SELECT *, coalesce(lag(edge_id) OVER (PARTITION BY route_id ORDER BY pos), edge_id) AS u, edge_id AS v FROM s),
sets AS (SELECT CAST(t AS BIGINT) AS trail_id, k AS edge_id FROM types, (VALUES (1), (2), (3), (4)) AS v(t) WHERE t = 1 OR (t = 2 AND k <= 3) OR (t = 3 AND k % 2 = 0) OR (t = 4 AND k >= 4)),
need AS (SELECT trail_id, count(*) AS n FROM sets GROUP BY trail_id)"""


def _scored(have: str, by: str) -> str:
    """SQL for the score of ``have`` (by columns and edge_id, no repeats)."""
    return f"""miles AS (SELECT {by}, sum(edge_id)::DOUBLE AS miles FROM {have} GROUP BY {by}),
met AS (SELECT {by}, trail_id FROM {have} JOIN sets USING (edge_id) JOIN need USING (trail_id) GROUP BY {by}, trail_id, n HAVING count(*) = n),
done AS (SELECT {by}, count(*) AS trails FROM met GROUP BY {by}),
scored AS (SELECT {by}, miles, coalesce(trails, 0) AS trails, least(coalesce(trails, 0) * 1.0::DOUBLE, 40.0::DOUBLE) + least(miles, 40.0::DOUBLE) AS score FROM miles LEFT JOIN done USING ({by}))"""


@query(f"{_STEPS}, have AS (SELECT DISTINCT route_id, edge_id FROM steps), {_scored('have', 'route_id')} SELECT route_id, miles, trails, score FROM scored")
def walk_scores(spark, sf):
    """The score of each walk over its set of edges."""
    return scoring.score(_steps(spark, sf), ["route_id"], "edge_id", _type_edges(spark, sf), _type_trails(spark, sf))


@query(f"""{_STEPS}, run AS (SELECT *, sum(secs) OVER (PARTITION BY route_id ORDER BY pos) AS t FROM steps), have AS (SELECT DISTINCT route_id, edge_id FROM run WHERE t <= 20000), {_scored('have', 'route_id')}
SELECT route_id, miles, trails, score FROM scored""")
def front_load(spark, sf):
    """The score of the whole steps walked by a time."""
    return adapt.front_load(_steps(spark, sf), ["route_id"], 20_000.0, _type_edges(spark, sf), _type_trails(spark, sf))


@query(f"""{_STEPS}, firsts AS (SELECT route_id, edge_id, min(pos) AS f FROM steps GROUP BY ALL),
have AS (SELECT DISTINCT p.route_id, p.pos, x.edge_id FROM steps p JOIN firsts x ON x.route_id = p.route_id AND x.f <= p.pos UNION SELECT p.route_id, p.pos, t.k FROM steps p JOIN types t ON t.k <= least(p.v, 2)),
{_scored('have', 'route_id, pos')}, run AS (SELECT *, sum(secs) OVER (PARTITION BY route_id ORDER BY pos)::DOUBLE AS elapsed_s, 10.0::DOUBLE * v AS home_s FROM steps)
SELECT route_id, pos, elapsed_s, home_s, elapsed_s + home_s AS finish_s, 25200.0::DOUBLE - elapsed_s - home_s AS slack_s, score FROM run JOIN scored USING (route_id, pos)""")
def bail_out_curve(spark, sf):
    """At each step: when one is home, and the score over what was walked and lies on the way."""
    types = _types(_table(spark, sf, "events"))
    home = types.select(F.col("k").alias("node"), (10.0 * F.col("k")).alias("home_s"))
    way = types.select(F.col("k").alias("node"), F.explode(F.sequence(F.lit(1).cast("long"), F.least("k", F.lit(2).cast("long")))).alias("edge_id"))
    return adapt.bail_out(_steps(spark, sf), home, way, _type_edges(spark, sf), _type_trails(spark, sf))


@query(f"""{_STEPS}, have AS (SELECT DISTINCT route_id, edge_id FROM steps), {_scored('have', 'route_id')},
sums AS (SELECT route_id, (100 * sum(edge_id))::DOUBLE / {METRES_PER_MILE}::DOUBLE AS walked_miles, (100 * sum(CASE WHEN edge_id % 2 = 0 THEN edge_id ELSE 0 END))::DOUBLE / {METRES_PER_MILE}::DOUBLE AS offtrail_miles,
  sum(secs)::DOUBLE / 3600.0::DOUBLE AS time_h, sum(secs) <= 25200.000001::DOUBLE AS feasible, count(*) AS n_arcs FROM steps GROUP BY route_id)
SELECT route_id, walked_miles, offtrail_miles, time_h, feasible, n_arcs, miles AS unique_miles, trails AS trails_completed, score, walked_miles - offtrail_miles - miles AS repeat_miles FROM sums JOIN scored USING (route_id)""")
def route_evaluate(spark, sf):
    """What a walk is worth, and what of it is repeated or off the trails."""
    return scoring.evaluate(_steps(spark, sf), ["route_id"], _type_edges(spark, sf), _type_trails(spark, sf))


def _spans(spark, sf) -> DataFrame:
    """Spans of some steps from every other step on."""
    steps = _steps(spark, sf).where("pos % 2 = 0")
    return steps.select("route_id", F.col("pos").cast("int").alias("arc_start"), (F.col("pos") + 1 + F.col("pos") * 7 % 5).cast("int").alias("arc_end"), "time_s")


_SPANS = f"{_STEPS}, spans AS (SELECT route_id, pos AS arc_start, pos + 1 + pos * 7 % 5 AS arc_end, secs::DOUBLE AS time_s FROM steps WHERE pos % 2 = 0)"


@query(f"""{_SPANS}, n AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY arc_start, arc_end DESC) - 1 AS span_id FROM spans),
up AS (SELECT a.route_id, a.span_id, arg_min(b.span_id, (b.arc_end - b.arc_start) * 100000 + b.span_id) AS parent, count(*) AS depth FROM n a JOIN n b ON a.route_id = b.route_id AND b.arc_start <= a.arc_start AND b.arc_end >= a.arc_end AND b.arc_end - b.arc_start > a.arc_end - a.arc_start GROUP BY ALL)
SELECT n.route_id, arc_start, arc_end, n.span_id, parent, coalesce(depth, 0) AS depth FROM n LEFT JOIN up USING (route_id, span_id)""")
def span_nesting(spark, sf):
    """The smallest span around each, and how many are around it."""
    return adapt.nesting(_spans(spark, sf).drop("time_s"))


@query(f"""{_SPANS}, p AS (SELECT DISTINCT route_id, arc_start AS from_pos FROM spans WHERE arc_start % 10 = 0), o AS (SELECT spans.*, from_pos FROM spans JOIN p USING (route_id) WHERE arc_start >= from_pos)
SELECT route_id, from_pos, sum(time_s) AS droppable_s FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE a.route_id = b.route_id AND a.from_pos = b.from_pos AND b.arc_start <= a.arc_start AND b.arc_end >= a.arc_end AND b.arc_end - b.arc_start > a.arc_end - a.arc_start) GROUP BY route_id, from_pos""")
def droppable_from(spark, sf):
    """Seconds of spans that start at a position or later and lie in no other of them."""
    spans = _spans(spark, sf)
    at = spans.where("arc_start % 10 = 0").select("route_id", F.col("arc_start").alias("from_pos")).distinct()
    return adapt.droppable_after(spans.join(at, "route_id"))


@query(f"""{_SPANS}, n AS (SELECT route_id, count(*) AS n FROM steps GROUP BY route_id), b AS (SELECT route_id, arc_start AS pos FROM spans UNION SELECT route_id, arc_end FROM spans)
SELECT route_id, pos FROM b JOIN n USING (route_id) WHERE pos > 0 AND pos < n""")
def cut_boundaries(spark, sf):
    """Where spans begin or end inside a walk."""
    n = _steps(spark, sf).groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    return walk.boundaries(_spans(spark, sf).join(n, "route_id"), ["route_id"], F.col("n"))


@query(f"""{_SPANS}, l AS (SELECT *, CASE WHEN pos > 0 AND edge_id = u THEN 0 ELSE 1 END AS new FROM steps), g AS (SELECT *, sum(new) OVER (PARTITION BY route_id ORDER BY pos)::BIGINT - 1 AS leg FROM l)
SELECT s.route_id, arc_start, arc_end, a.leg AS leg_start, b.leg AS leg_end FROM spans s LEFT JOIN g a ON a.route_id = s.route_id AND a.pos = arc_start LEFT JOIN g b ON b.route_id = s.route_id AND b.pos + 1 = arc_end""")
def located_cuts(spark, sf):
    """The legs in which spans begin and end."""
    legs = walk.legs(_steps(spark, sf), ["route_id"], ["pos"], ["edge_id"])
    return walk.locate(_spans(spark, sf).drop("time_s"), legs, ["route_id"])


@query(f"{_STEPS} SELECT route_id, pos, CASE WHEN u = v THEN secs ELSE edge_id END AS gain_m, CASE WHEN u = v THEN edge_id ELSE secs END AS loss_m FROM steps")
def step_relief(spark, sf):
    """Gain and loss of steps, swapped against an edge's direction."""
    turned = walk.relief(F.col("time_s").cast("long"), F.col("edge_id"), F.col("u"), F.col("v"))
    return _steps(spark, sf).select("route_id", "pos", turned.alias("r")).select("route_id", "pos", "r.*")


@query("SELECT o_orderkey AS node FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def isolated_nodes(spark, sf):
    """Orders without a line: nodes that no edge has."""
    t = tables(spark, sf, "orders", "lineitem")
    return graph.isolated(t["orders"].select(F.col("o_orderkey").alias("node")), t["lineitem"].select(F.col("l_orderkey").alias("u"), (-F.col("l_partkey")).alias("v")))


_PROFILE = """WITH p AS (SELECT l_orderkey AS edge_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, l_quantity::DOUBLE AS z FROM lineitem),
seg AS (SELECT edge_id, pos, z, lead(z) OVER (PARTITION BY edge_id ORDER BY pos) - z AS rise FROM p)"""


def _seconds(sign: str, off: str) -> str:
    """SQL for the seconds of a segment of 100 metres."""
    return f"CASE WHEN rise IS NOT NULL THEN 100.0::DOUBLE / (greatest({_P.base_kmh}::DOUBLE * exp(-{_P.steepness}::DOUBLE * abs({sign}rise / 100.0::DOUBLE + {_P.offset}::DOUBLE)) * {_P.pace!r}::DOUBLE, {_P.least_kmh}::DOUBLE) * 1000 / 3600 * CASE WHEN {off} THEN {_P.off_trail}::DOUBLE ELSE 1.0::DOUBLE END) END"


def _profiles(spark, sf) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = _table(spark, sf, "lineitem").withColumn("pos", F.row_number().over(order))
    return lines.select(F.col("l_orderkey").alias("edge_id"), "pos", (100.0 * F.col("pos")).alias("d"), F.col("l_quantity").cast("double").alias("z"))


@query(f"""{_PROFILE}, sums AS (SELECT edge_id, round(sum({_seconds('', 'edge_id % 3 = 0')}), 3) AS time_fwd_s, round(sum({_seconds('-', 'edge_id % 3 = 0')}), 3) AS time_rev_s,
  sum(greatest(rise, 0)) AS gain_fwd_m, sum(greatest(-rise, 0)) AS gain_rev_m, min(z) AS min_ele_m, max(z) AS max_ele_m FROM seg GROUP BY edge_id)
SELECT o_orderkey AS edge_id, coalesce(time_fwd_s, 0) AS time_fwd_s, coalesce(time_rev_s, 0) AS time_rev_s, coalesce(gain_fwd_m, 0) AS gain_fwd_m, coalesce(gain_rev_m, 0) AS gain_rev_m, min_ele_m, max_ele_m,
  o_custkey::DOUBLE / {METRES_PER_MILE}::DOUBLE AS length_mi, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey::DOUBLE / {METRES_PER_MILE}::DOUBLE ELSE 0 END AS score_mi FROM orders LEFT JOIN sums ON edge_id = o_orderkey""")
def priced_edges(spark, sf):
    """Times, climbs, heights, miles and scored miles of edges from their profiles."""
    orders = _table(spark, sf, "orders")
    edges = orders.select(F.col("o_orderkey").alias("edge_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("trail_id"), F.col("o_custkey").cast("double").alias("length_m"), (F.col("o_orderkey") % 3 == 0).alias("off_trail"))
    priced = pricing.price(edges, _profiles(spark, sf))
    return priced.withColumns({c: F.round(c, 3) for c in ("time_fwd_s", "time_rev_s")}).drop("trail_id", "length_m", "off_trail")


@query(f"""{_PROFILE} SELECT edge_id, coalesce(sum(greatest(rise, 0)), 0)::DOUBLE AS gain_m, coalesce(sum(greatest(-rise, 0)), 0)::DOUBLE AS back_m, round(coalesce(sum({_seconds('', 'false')}), 0), 3) AS time_s, round(coalesce(sum({_seconds('-', 'false')}), 0), 3) AS back_s FROM seg GROUP BY edge_id""")
def profile_arrays(spark, sf):
    """Climbs and times over profiles held as arrays, both ways."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "d", "z")))
    lines = _profiles(spark, sf).groupBy("edge_id").agg(parts["d"].alias("d"), parts["z"].alias("z"))
    d, z = F.col("d"), F.col("z")
    return lines.select("edge_id", speed.profile_gain(z).alias("gain_m"), speed.profile_gain(z, True).alias("back_m"), F.round(speed.profile_seconds(d, z), 3).alias("time_s"), F.round(speed.profile_seconds(d, z, reverse=True), 3).alias("back_s"))


@query(f"""WITH m AS (SELECT p_size::BIGINT AS trail_id, sum(p_partkey)::DOUBLE AS g, sum(p_partkey % 97)::DOUBLE AS r FROM part GROUP BY p_size),
f AS (SELECT trail_id, round_even(g * {FEET_PER_METRE}::DOUBLE, 0) AS our_ft, round_even(r * {FEET_PER_METRE}::DOUBLE, 0) AS our_rev_ft, CASE WHEN trail_id % 5 > 0 THEN 'trail ' || trail_id END AS name, CASE WHEN trail_id % 5 > 0 THEN trail_id * 1000 END AS gain_ft, CASE WHEN trail_id % 5 > 0 THEN trail_id % 30 END AS rev_gain_ft FROM m)
SELECT trail_id, our_ft, our_rev_ft, name, gain_ft, rev_gain_ft, our_ft - gain_ft AS diff_ft, round_even(100 * (our_ft - gain_ft) / greatest(gain_ft, 10), 1) AS pct, our_rev_ft - rev_gain_ft AS rev_diff_ft, round_even(100 * (our_rev_ft - rev_gain_ft) / greatest(rev_gain_ft, 10), 1) AS rev_pct FROM f""".replace("greatest(gain_ft, 10)", "CASE WHEN gain_ft IS NOT NULL THEN greatest(gain_ft, 10) END").replace("greatest(rev_gain_ft, 10)", "CASE WHEN rev_gain_ft IS NOT NULL THEN greatest(rev_gain_ft, 10) END"))
def gains_published(spark, sf):
    """Climbs of trails against published ones, some of which are missing."""
    part = _table(spark, sf, "part")
    edges = part.select(F.col("p_size").cast("long").alias("trail_id"), F.col("p_partkey").cast("double").alias("gain_fwd_m"), (F.col("p_partkey") % 97).cast("double").alias("gain_rev_m"))
    named = part.select(F.col("p_size").cast("long").alias("trail_id")).distinct().where("trail_id % 5 > 0")
    published = named.select("trail_id", F.concat(F.lit("trail "), F.col("trail_id").cast("string")).alias("name"), (F.col("trail_id") * 1000).alias("gain_ft"), (F.col("trail_id") % 30).alias("rev_gain_ft"))
    return pricing.check_gains(edges, published)


@query("""WITH e AS (SELECT p_partkey AS u, p_partkey + p_size % 3 AS v, p_size::DOUBLE AS length_m, CASE WHEN p_size % 4 > 0 THEN p_size % 20 END AS trail_id, p_size % 4 = 0 AS is_road FROM part),
d AS (SELECT node FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node HAVING count(*) = 1),
a AS (SELECT count(*)::DOUBLE AS edges, count(DISTINCT trail_id)::DOUBLE AS trails, sum((u = v)::INT)::DOUBLE AS self_loops, min(length_m) AS shortest_m, median(length_m) AS median_m, max(length_m) AS longest_m,
  sum(CASE WHEN trail_id IS NOT NULL THEN length_m END) / 1609.344::DOUBLE AS trail_miles, sum(is_road::INT)::DOUBLE AS road_edges, (SELECT count(*) FROM part)::DOUBLE AS nodes, (SELECT count(*) FROM d)::DOUBLE AS dangles FROM e)
UNPIVOT a ON COLUMNS(*) INTO NAME "check" VALUE value""")
def network_validation(spark, sf):
    """A network's vital numbers."""
    part = _table(spark, sf, "part")
    edges = part.select(F.col("p_partkey").alias("u"), (F.col("p_partkey") + F.col("p_size") % 3).alias("v"), F.col("p_size").cast("double").alias("length_m"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 20).alias("trail_id"), (F.col("p_size") % 4 == 0).alias("is_road"))
    return topology.validation(edges, part.select(F.col("p_partkey").alias("node")))


@query(f"""WITH p AS (SELECT p_partkey, p_size / 25.0::DOUBLE AS pace, {_P.base_kmh}::DOUBLE * exp(-{_P.steepness}::DOUBLE * abs({_P.offset}::DOUBLE)) * (p_size / 25.0::DOUBLE) AS flat FROM part)
SELECT p_partkey, pace AS pace_factor, round(flat, 3) AS flat_kmh, round(flat * {MILES_PER_KM}::DOUBLE, 3) AS flat_mph, round(60 / (flat * {MILES_PER_KM}::DOUBLE), 2) AS flat_min_per_mile, round({_P.base_kmh}::DOUBLE * pace, 3) AS peak_kmh,
  round({_P.base_kmh}::DOUBLE * pace * {MILES_PER_KM}::DOUBLE, 3) AS peak_mph, -{_P.offset}::DOUBLE AS peak_slope, round(flat * {_P.off_trail}::DOUBLE * {MILES_PER_KM}::DOUBLE, 3) AS off_trail_mph FROM p""")
def pace_summaries(spark, sf):
    """What paces mean on the flat, downhill and off the trails."""
    return _table(spark, sf, "part").select("p_partkey", speed.pace_summary(F.col("p_size") / 25.0).alias("s")).select("p_partkey", "s.*")


@query(f"""WITH p AS (SELECT p_partkey, p_size / 25.0::DOUBLE AS pace FROM part) SELECT p_partkey, round({_P.base_kmh}::DOUBLE * pace * {MILES_PER_KM}::DOUBLE, 9) AS mph, round(pace, 9) AS pace FROM p""")
def paces_and_speeds(spark, sf):
    """Speed on the flat from pace, and back."""
    mph = speed.pace_to_mph(F.col("p_size") / 25.0)
    return _table(spark, sf, "part").select("p_partkey", F.round(mph, 9).alias("mph"), F.round(speed.mph_to_pace(mph), 9).alias("pace"))


@query("SELECT p_partkey, p_size * 25200.0::DOUBLE / 3600 AS most_miles, p_size * 25200.0::DOUBLE / 3600 < 40 AS cap_cannot_bind FROM part")
def speed_ceilings(spark, sf):
    """Whether the cap on miles can bind at a peak speed."""
    return _table(spark, sf, "part").select("p_partkey", scoring.speed_ceiling(F.col("p_size").cast("double")).alias("s")).select("p_partkey", "s.*")


@query("SELECT p_partkey, p_size < 40 AND p_partkey % 50 < 40 AND p_partkey % 3 = 0 AS proven, (p_partkey % 3)::DOUBLE AS gap_pct FROM part")
def proven_optimal(spark, sf):
    """Proven only where no cap binds and the gap is closed."""
    bound = scoring.caps(F.col("p_size").cast("double"), F.col("p_partkey") % 50)
    return _table(spark, sf, "part").select("p_partkey", scoring.optimality(bound, (F.col("p_partkey") % 3).cast("double")).alias("s")).select("p_partkey", "s.*")


@query("SELECT p_partkey, printf('%.5f, %.5f', p_retailprice::DOUBLE, -p_size::DOUBLE / 8) AS place FROM part")
def points_as_text(spark, sf):
    """Latitude and longitude to five places."""
    return _table(spark, sf, "part").select("p_partkey", formats.lat_lon(F.col("p_retailprice").cast("double"), -F.col("p_size").cast("double") / 8).alias("place"))


@query("SELECT DISTINCT r_name AS corridor, c_custkey AS trail_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def corridor_members(spark, sf):
    """The trails of each corridor, by name."""
    t = tables(spark, sf, "customer", "nation", "region")
    names = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("trail_id"), F.col("n_name").alias("name"))
    groups = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("corridor"), F.col("n_name").alias("name"))
    return rules.members(names, groups)
