"""Registered queries: each operator over the reference tables, with the SQL that says the same.

The tables hold no geometry, so they stand in for it: a walk is a user's events in time order, an
edge an event type, a score the event's value, a trail a set of event types, the arc graph pairs
of nations weighted by shipped lines, a time budget summed quantities. Sums that are compared are
over whole cents, so that they don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import formats, speed, turns
from waymark.operators import adapt, graph, pricing, publish, rules, scoring, search, topology, walk
from waymark.params import Race, Speed
from waymark.sources.readers import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tables(spark, sf, name)[name]


def cents(c):
    """Whole cents of an amount."""
    return F.round(F.col(c) * 100).cast("long")


BY, ORDER = ["user_id"], ["ts", "event_id"]
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_EVENTS = "WITH e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"


def _walks(spark: SparkSession, sf: str) -> DataFrame:
    return walk.positions(_table(spark, sf, "events").withColumn("cents", cents("value")), BY, ORDER)


#: Sets of event types that stand for trails, from the types there are: (name, types in order of name).
def _sets(events: DataFrame) -> DataFrame:
    types = events.select("event_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("event_type")))
    own = F.array_compact(F.array(F.lit(1), F.when(F.col("k") <= 3, 2), F.when(F.col("k") % 2 == 0, 3), F.when(F.col("k") >= 4, 4))).cast("array<long>")
    return types.select(F.explode(own).alias("trail_id"), "event_type")


_SETS = """types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
sets AS (SELECT CAST(t AS BIGINT) AS trail_id, event_type FROM types, (VALUES (1), (2), (3), (4)) AS v(t)
  WHERE t = 1 OR (t = 2 AND k <= 3) OR (t = 3 AND k % 2 = 0) OR (t = 4 AND k >= 4)),
need AS (SELECT trail_id, count(*) AS n FROM sets GROUP BY trail_id)"""


@query(f"""{_EVENTS}, v AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS first_visit FROM e)
SELECT user_id, event_id, pos, event_type, first_visit,
  CASE WHEN NOT first_visit THEN 'repeat' WHEN value >= 10 THEN 'unique' ELSE 'offtrail' END AS cat,
  CAST(sum(CASE WHEN first_visit THEN cents ELSE 0 END) OVER w AS BIGINT) AS running_unique,
  CAST(sum(cents) OVER w AS BIGINT) AS elapsed_s
FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def walk_detail(spark, sf):
    """First visits, categories, running unique total and clock of every walk."""
    steps = walk.detail(_walks(spark, sf), BY, ORDER, "event_type", F.when(F.col("value") >= 10, 1), F.col("cents"), F.col("cents"))
    return steps.select("user_id", "event_id", "pos", "event_type", "first_visit", "cat", "running_unique", "elapsed_s")


@query(f"""{_EVENTS}, l AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND pos > 0 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS leg, sum(cents) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS running FROM l)
SELECT user_id, leg, min(event_type) AS event_type, CAST(sum(cents) AS BIGINT) AS cents, CAST(arg_max(running, pos) AS BIGINT) AS running, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS steps FROM g GROUP BY user_id, leg""")
def walk_legs(spark, sf):
    """Steps of the same kind in a row make a leg."""
    steps = _walks(spark, sf).withColumn("running", F.sum("cents").over(Window.partitionBy(*BY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return walk.collapse(walk.legs(steps, BY, ["pos"], ["event_type"]), BY, "pos", ["cents"], ["running"], ["event_type"])


@query(f"""{_EVENTS}, l AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND pos > 0 AND pos % 7 <> 0 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS leg FROM l)
SELECT user_id, leg, min(event_type) AS event_type, CAST(sum(cents) AS BIGINT) AS cents, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS steps FROM g GROUP BY user_id, leg""")
def forced_break_legs(spark, sf):
    """Legs that also end wherever a planned cut begins or ends (here every seventh step)."""
    steps = _walks(spark, sf)
    at = steps.where("pos % 7 = 0 and pos > 0").select(*BY, "pos")
    return walk.collapse(walk.forced_breaks(steps, BY, ["pos"], ["event_type"], at), BY, "pos", ["cents"], [], ["event_type"])


@query(f"""{_EVENTS}, {_SETS}, firsts AS (SELECT user_id, event_type, min(pos) AS f FROM e GROUP BY ALL),
done AS (SELECT user_id, trail_id, max(f) AS at FROM firsts JOIN sets USING (event_type) JOIN need USING (trail_id) GROUP BY user_id, trail_id, n HAVING count(*) = n)
SELECT e.user_id, e.event_id, e.pos, (SELECT count(*) FROM done d WHERE d.user_id = e.user_id AND d.at <= e.pos) AS running_trails FROM e""")
def running_completion(spark, sf):
    """How many sets are complete at each step."""
    steps = _walks(spark, sf)
    return walk.running_completed(steps, BY, "event_type", "pos", _sets(steps)).select("user_id", "event_id", "pos", "running_trails")


@query(f"""{_EVENTS}, {_SETS}, firsts AS (SELECT user_id, event_type, min(pos) AS f FROM e GROUP BY ALL)
SELECT user_id, trail_id, CASE WHEN count(*) = any_value(n) THEN max(f) END AS completed_at FROM firsts JOIN sets USING (event_type) JOIN need USING (trail_id) GROUP BY user_id, trail_id""")
def completion_step(spark, sf):
    """The step at which each set is complete, null if it never is."""
    steps = _walks(spark, sf)
    return walk.completions(steps, BY, "event_type", "pos", _sets(steps)).select("user_id", "trail_id", "completed_at")


@query("""WITH l AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
s AS (SELECT o_custkey, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(DISTINCT p_brand) AS brands FROM l JOIN part ON p_partkey = l_partkey GROUP BY o_custkey)
SELECT o_custkey, cents, brands, least(brands * 1.0::DOUBLE, 40.0::DOUBLE) + least(cents * 0.0001::DOUBLE, 40.0::DOUBLE) AS score FROM s""")
def score_capped(spark, sf):
    """Distinct parts of a customer, once each, and brands, both capped."""
    t = tables(spark, sf, "orders", "lineitem", "part")
    once = t["orders"].join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    sums = once.join(t["part"], F.col("p_partkey") == F.col("l_partkey")).groupBy("o_custkey").agg(F.sum(cents("p_retailprice")).alias("cents"), F.countDistinct("p_brand").alias("brands"))
    return sums.withColumn("score", walk.running_score(F.col("cents"), F.col("brands"), 1.0, 0.0001, 40.0, 40.0))


@query(f"""WITH {_SETS}, days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events)
SELECT user_id, day, trail_id FROM days JOIN sets USING (event_type) JOIN need USING (trail_id) GROUP BY user_id, day, trail_id, n HAVING count(*) = n""")
def completion_division(spark, sf):
    """Users' days that have every type of a set (relational division)."""
    events = _table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return scoring.completed(events, ["user_id", "day"], "event_type", _sets(events))


@query(f"""WITH {_SETS}, days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events), walks AS (SELECT DISTINCT user_id, day FROM days),
done AS (SELECT user_id, day, trail_id FROM days JOIN sets USING (event_type) JOIN need USING (trail_id) GROUP BY user_id, day, trail_id, n HAVING count(*) = n),
bad AS (SELECT user_id, day, 'missing' AS kind, CAST(2 AS BIGINT) AS trail_id FROM walks w WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.user_id = w.user_id AND d.day = w.day AND trail_id = 2)
  UNION ALL SELECT DISTINCT user_id, day, 'entered', trail_id FROM days JOIN sets USING (event_type) WHERE trail_id = 3)
SELECT user_id, day, count(*) AS violations, string_agg(CASE kind WHEN 'missing' THEN 'trail not complete: ' ELSE 'trail entered: ' END || trail_id, '; ' ORDER BY trail_id) AS messages FROM bad GROUP BY user_id, day""")
def rule_offenders(spark, sf):
    """Walks that miss a required set or touch a forbidden one, with messages."""
    events = _table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    by = ["user_id", "day"]
    found = rules.offenders(events.select(*by), events, by, "event_type", _sets(events), rules.Rule("both", (2,), (3,)))
    return rules.violations(found, by).withColumn("messages", F.array_join("messages", "; "))


_SEGMENTS = f"{_EVENTS}, s AS (SELECT user_id, pos, lead(value) OVER w - value AS rise, epoch_us(lead(ts) OVER w) / 1e6 - epoch_us(ts) / 1e6 AS run FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos))"


def _segments(spark, sf):
    w = Window.partitionBy(*BY).orderBy("pos")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _walks(spark, sf).select("user_id", "pos", (F.lead("value").over(w) - F.col("value")).alias("rise"), (F.lead(at).over(w) - at).alias("run"))


def _kmh_sql(sign: str, pace: str) -> str:
    return f"greatest(6.0 * exp(-3.5 * abs({sign}rise / run + 0.05)) * {pace}, 0.15) * 1000 / 3600"


@query(f"""{_SEGMENTS} SELECT user_id, round(sum(CASE WHEN run <= 1e-9 THEN 0.0 ELSE run / ({_kmh_sql('', '1.25')}) END), 1) AS time_fwd_s, round(sum(CASE WHEN run <= 1e-9 THEN 0.0 ELSE run / ({_kmh_sql('-', '1.25')}) END), 1) AS time_rev_s,
  CAST(sum(CAST(round(greatest(rise, 0) * 100) AS BIGINT)) AS BIGINT) AS gain FROM s WHERE run IS NOT NULL GROUP BY user_id""")
def directional_time(spark, sf):
    """Walking time both ways over a profile, and its climbs."""
    p, s = Speed(pace=1.25), _segments(spark, sf).where("run is not null")
    way = lambda sign: F.round(F.sum(speed.segment_seconds(F.col("run"), sign * F.col("rise"), p)), 1)
    return s.groupBy("user_id").agg(way(1).alias("time_fwd_s"), way(-1).alias("time_rev_s"), F.sum(F.round(F.greatest("rise", F.lit(0.0)) * 100).cast("long")).alias("gain"))


@query(f"""{_SEGMENTS} SELECT pace, user_id, round(sum(CASE WHEN run <= 1e-9 THEN 0.0 ELSE run / ({_kmh_sql('', 'pace')}) END), 1) AS time_s FROM s, (VALUES (1.0::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) AS p(pace) WHERE run IS NOT NULL GROUP BY pace, user_id""")
def pace_sweep(spark, sf):
    """All walks priced at several paces in one pass."""
    s = _segments(spark, sf).where("run is not null")
    each = s.groupBy("user_id").agg(*(F.round(F.sum(speed.segment_seconds(F.col("run"), F.col("rise"), Speed(pace=x))), 1).alias(str(i)) for i, x in enumerate((1.0, 1.5, 2.0))))
    rows = F.array(*(F.struct(F.lit(x).alias("pace"), F.col(f"`{i}`").alias("time_s")) for i, x in enumerate((1.0, 1.5, 2.0))))
    return each.select("user_id", F.explode(rows).alias("p")).select("p.pace", "user_id", "p.time_s")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS lo, epoch_us(ts) + CAST(round(value * 1e8) AS BIGINT) AS hi, event_id FROM events),
r AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN lo - reach > 3600000000 OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS spans FROM g GROUP BY user_id, g""")
def interval_merge_gap(spark, sf):
    """Spans joined where the gap to the farthest end so far is at most an hour."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = _table(spark, sf, "events").select("user_id", at.alias("lo"), (at + F.round(F.col("value") * 1e8).cast("long")).alias("hi"))
    return topology.merge_intervals(spans, BY, "lo", "hi", 3_600_000_000)


@query(f"""{_EVENTS}, b AS (SELECT user_id, pos, CAST((event_id * 37) % 360 AS DOUBLE) AS brg FROM e), t AS (SELECT *, round((brg - lag(brg) OVER (PARTITION BY user_id ORDER BY pos) + 180 + 360) % 360 - 180, 1) AS turn_deg FROM b),
n AS (SELECT *, CASE WHEN turn_deg < 0 THEN 'left' ELSE 'right' END AS side FROM t)
SELECT user_id, pos, turn_deg, CASE WHEN turn_deg IS NULL THEN 'start' WHEN abs(turn_deg) < 20 THEN 'straight' WHEN abs(turn_deg) > 165 THEN 'turn around' WHEN abs(turn_deg) < 55 THEN 'slight ' || side WHEN abs(turn_deg) < 125 THEN side ELSE 'sharp ' || side END AS turn FROM n""")
def turn_classes(spark, sf):
    """Signed turns between successive bearings, by name."""
    legs = _walks(spark, sf).withColumn("bearing_in", (F.col("event_id") * 37 % 360).cast("double")).withColumn("bearing_out", F.col("bearing_in")).withColumn("leg", F.col("pos"))
    return publish.turn_cues(legs, BY).select("user_id", "pos", "turn_deg", "turn")


#: Nations as nodes: an arc from a customer's to a supplier's for shipments, lines as weight.
_ARCS = """WITH flow AS (SELECT c_nationkey AS u, s_nationkey AS v, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n, v) AS k FROM flow), arcs AS (SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, CAST(n AS DOUBLE) AS time_s, CAST(u * 100 + v AS BIGINT) AS arc_id FROM ranked WHERE k <= 3)"""


def _arcs(spark, sf, most: int | None = 3):
    t = tables(spark, sf, "lineitem", "orders", "customer", "supplier")
    j = t["lineitem"].join(t["orders"], F.col("o_orderkey") == F.col("l_orderkey")).join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).join(t["supplier"], F.col("s_suppkey") == F.col("l_suppkey"))
    flow = j.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("u"), F.col("s_nationkey").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = flow.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy("n", "v"))).where("true" if most is None else f"k <= {most}")
    return ranked.select("u", "v", F.col("n").cast("double").alias("time_s"), (F.col("u") * 100 + F.col("v")).alias("arc_id"))


@query(_ARCS.replace("WITH flow", "WITH RECURSIVE flow") + """, nodes AS (SELECT u AS x FROM arcs UNION SELECT v FROM arcs),
ways AS (SELECT x AS src, x AS dst, 0.0::DOUBLE AS t, 0 AS hops FROM nodes UNION SELECT w.src, a.v, w.t + a.time_s, hops + 1 FROM ways w JOIN arcs a ON a.u = w.dst WHERE hops < 4)
SELECT src, dst, min(t) AS time_s FROM ways GROUP BY src, dst""")
def apsp_nations(spark, sf):
    """Fastest ways of at most four arcs between all nodes of a sparse arc graph."""
    return graph.shortest(_arcs(spark, sf), rounds=4).select("src", "dst", "time_s")


@query()
def apsp_nations_whole(spark, sf):
    """Fastest ways of any number of arcs over all arcs between nations."""
    return graph.shortest(_arcs(spark, sf, None)).select("src", "dst", "time_s")


_LINKS = "WITH RECURSIVE edges AS (SELECT DISTINCT l_orderkey AS u, -l_partkey AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_linenumber <= 2 AND l_quantity >= 48)"


def _sparse(spark, sf):
    t = tables(spark, sf, "lineitem", "orders")
    urgent = t["orders"].where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return t["lineitem"].where("l_linenumber <= 2 and l_quantity >= 48").join(urgent, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("u"), (-F.col("l_partkey")).alias("v")).distinct()


@query(_LINKS + """, pairs AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u AS node, u AS other FROM pairs UNION SELECT r.node, b.v FROM reach r JOIN pairs b ON b.u = r.other)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def components(spark, sf):
    """Connected components of orders and parts that share large lines."""
    return graph.components(_sparse(spark, sf))


@query(_ARCS.replace("WHERE k <= 3", "WHERE true") + " SELECT least(u, v) AS u, greatest(u, v) AS v, arg_min(arc_id, (time_s, arc_id)) AS arc_id, min(time_s) AS time_s FROM arcs GROUP BY ALL")
def parallel_arc_min(spark, sf):
    """Of both directions between two nations the lighter, ties to the lesser id."""
    t = tables(spark, sf, "lineitem", "orders", "customer", "supplier")
    j = t["lineitem"].join(t["orders"], F.col("o_orderkey") == F.col("l_orderkey")).join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).join(t["supplier"], F.col("s_suppkey") == F.col("l_suppkey"))
    flow = j.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("a"), F.col("s_nationkey").cast("long").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("time_s"))
    return graph.fastest_arcs(flow.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "time_s", (F.col("a") * 100 + F.col("b")).alias("arc_id")))


@query(_LINKS.replace(" RECURSIVE", "") + " SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node")
def node_degree(spark, sf):
    return graph.degrees(_sparse(spark, sf))


@query(_LINKS.replace(" RECURSIVE", "") + " SELECT node FROM (SELECT u AS node FROM edges UNION ALL SELECT v FROM edges) GROUP BY node HAVING count(*) = 1")
def dangles(spark, sf):
    return graph.dangles(_sparse(spark, sf))


def _order_parts(spark, sf):
    return _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("u"), (-F.col("l_partkey")).alias("v")).distinct()


@query()
def components_whole(spark, sf):
    """Connected components of all orders and parts."""
    return graph.components(_order_parts(spark, sf))


@query()
def node_degree_whole(spark, sf):
    return graph.degrees(_order_parts(spark, sf))


@query()
def dangles_whole(spark, sf):
    return graph.dangles(_order_parts(spark, sf))


def _edges(spark, sf):
    """Parts as edges: quantities both ways as seconds, price as miles, brand as trail."""
    line, part = _table(spark, sf, "lineitem"), _table(spark, sf, "part")
    sums = line.groupBy("l_partkey").agg(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)).alias("time_fwd_s"), F.sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).otherwise(0.0)).alias("time_rev_s"))
    cols = part.join(sums, F.col("l_partkey") == F.col("p_partkey"))
    return cols.select(F.col("p_partkey").alias("edge_id"), "time_fwd_s", "time_rev_s", F.round(F.col("p_retailprice"), 0).alias("score_mi"), F.when(F.col("p_size") > 5, F.col("p_size").cast("long")).alias("trail_id"), F.col("p_brand").alias("name"))


_EDGES = """WITH sums AS (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END)::DOUBLE AS time_fwd_s, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0.0 END)::DOUBLE AS time_rev_s FROM lineitem GROUP BY l_partkey),
edges AS (SELECT p_partkey AS edge_id, time_fwd_s, time_rev_s, round(p_retailprice, 0) AS score_mi, CASE WHEN p_size > 5 THEN CAST(p_size AS BIGINT) END AS trail_id, p_brand AS name FROM part JOIN sums ON l_partkey = p_partkey)"""


@query(_EDGES + " SELECT sum(least(time_fwd_s, time_rev_s)) / 3600 AS hours, sum(score_mi) AS miles, 25200.0 / sum(least(time_fwd_s, time_rev_s)) AS budget_share FROM edges WHERE trail_id IS NOT NULL")
def coverage_bound(spark, sf):
    """The least time in which all scored edges can be walked."""
    return scoring.coverage_bound(_edges(spark, sf))


@query(_EDGES + """, trails AS (SELECT DISTINCT trail_id, edge_id FROM edges WHERE trail_id IS NOT NULL), need AS (SELECT trail_id, count(*) AS n FROM trails GROUP BY trail_id),
worth AS (SELECT e.edge_id, score_mi + coalesce(1.0::DOUBLE / n, 0) AS worth, least(time_fwd_s, time_rev_s) AS t FROM edges e LEFT JOIN need USING (trail_id)),
run AS (SELECT *, coalesce(sum(t) OVER (ORDER BY CASE WHEN t > 0 THEN worth / t ELSE 'inf'::DOUBLE END DESC, edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM worth WHERE t > 0)
SELECT round(sum(worth * greatest(0.0, least(1.0, (25200.0 - spent) / t))), 3) AS bound FROM run""")
def knapsack_bound(spark, sf):
    """An upper bound on any walk's score: edges by worth per second until the budget is full."""
    edges = _edges(spark, sf).where(F.least("time_fwd_s", "time_rev_s") > 0)
    whole = _edges(spark, sf)
    trails = whole.where("trail_id is not null").select("trail_id", "edge_id")
    return scoring.knapsack_bound(edges, trails).select(F.round("bound", 3).alias("bound"))


@query("""WITH p AS (SELECT round(l_extendedprice / 1000, 2) AS ours, l_quantity AS theirs FROM lineitem)
SELECT round(corr(ours, theirs) ** 2, 4) AS r2, count(*) AS n, round(avg(ours - theirs), 4) AS bias, round(avg(abs(ours - theirs)), 4) AS mae FROM p""")
def gain_correlation(spark, sf):
    """Agreement of two measurements: r2, bias, mean absolute error."""
    pairs = _table(spark, sf, "lineitem").select(F.round(F.col("l_extendedprice") / 1000, 2).alias("ours"), F.col("l_quantity").alias("theirs"))
    return pricing.agreement(pairs, "ours", "theirs").select("r2", "n", F.round("bias", 4).alias("bias"), F.round("mae", 4).alias("mae"))


_POINTS = """WITH pts AS (SELECT vec_id AS id, label, CAST(embedding[1] * 100 AS DOUBLE) AS x, CAST(embedding[2] * 100 AS DOUBLE) AS y FROM embeddings),
best AS (SELECT a.id AS a_id, arg_min(b.id, (sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id)) AS b_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM pts a JOIN pts b ON a.id % 2 = 0 AND b.id % 2 = 1 AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3 GROUP BY a.id),
found AS (SELECT id AS a_id, b_id, d FROM pts LEFT JOIN best ON a_id = id WHERE id % 2 = 0)"""


def _near(spark, sf):
    v = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.element_at("embedding", 1) * F.lit(100).cast("float")).cast("double").alias("x"), (F.element_at("embedding", 2) * F.lit(100).cast("float")).cast("double").alias("y"))
    return topology.nearest(v.where("id % 2 = 0"), v.where("id % 2 = 1"), 3.0)


@query(_POINTS + " SELECT a_id, b_id, round(d, 4) AS distance FROM found")
def nearest_neighbour(spark, sf):
    """Of each even point the nearest odd one within reach, over a grid of cells."""
    return _near(spark, sf).select("a_id", "b_id", F.round("distance", 4).alias("distance"))


@query(_POINTS + " SELECT tolerance, round(100 * avg(CASE WHEN d <= tolerance THEN 1.0::DOUBLE ELSE 0.0 END), 1) AS percent FROM found, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (3.0::DOUBLE)) AS t(tolerance) GROUP BY tolerance")
def match_pct_by_tolerance(spark, sf):
    """Share of points matched at each tolerance."""
    return topology.match_percentages(_near(spark, sf), [0.5, 1.0, 3.0])


@query("""WITH f AS (SELECT r_name AS corridor, n_nationkey AS trail_id, CAST(round(o_totalprice * 100) AS BIGINT) AS total, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderpriority = '2-HIGH' AND n_regionkey <> 3)
SELECT r_name AS corridor, r_regionkey AS place, coalesce(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN total ELSE 0 END) AS BIGINT), 0) AS unique_miles, coalesce(CAST(sum(total) AS BIGINT), 0) AS total_miles,
  coalesce(CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT), 0) AS completed, count(DISTINCT trail_id) AS n_trails FROM region LEFT JOIN f ON corridor = r_name GROUP BY ALL""")
def corridor_breakdown(spark, sf):
    """Totals per group of a dimension; groups without facts stay, with zeros."""
    t = tables(spark, sf, "orders", "customer", "nation", "region")
    facts = (
        t["orders"].where("o_orderpriority = '2-HIGH'").join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).join(t["nation"].where("n_regionkey <> 3"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t["region"], F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("corridor"), F.col("n_nationkey").alias("trail_id"), cents("o_totalprice").alias("total"), "o_orderstatus")
    )
    dimension = t["region"].select(F.col("r_name").alias("corridor"), F.col("r_regionkey").alias("place"))
    return rules.breakdown(dimension, facts, F.when(F.col("o_orderstatus") == "F", F.col("total")).otherwise(0), F.col("o_orderstatus") == "P")


@query(f"""{_EVENTS}, r AS (SELECT user_id, pos, cents, sum(cents) OVER w AS t, sum(cents) OVER (PARTITION BY user_id) AS total FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
c AS (SELECT a.user_id AS route_id, a.pos AS arc_start, b.pos + 1 AS arc_end, b.t - a.t + a.cents AS time_s, b.t AS elapsed_end, b.total AS total_s FROM r a JOIN r b ON a.user_id = b.user_id AND b.pos = a.pos + 2 WHERE a.pos % 5 = 0)
SELECT route_id, arc_start, arc_end, CAST(time_s AS BIGINT) AS time_s, CAST(elapsed_end - time_s AS BIGINT) AS planned_start_s, CASE WHEN 200000 - (time_s + total_s - elapsed_end) < total_s THEN CAST(greatest(200000 - (time_s + total_s - elapsed_end), 0) AS DOUBLE) END AS keep_before FROM c""")
def threshold_splits(spark, sf):
    """Until when each detour can still be kept."""
    steps = _walks(spark, sf).select(F.col("user_id").alias("route_id"), "pos", F.col("cents").alias("time_s"), F.col("cents").alias("score_mi"))
    last = steps.groupBy("route_id").agg(F.max("pos").alias("last"), F.sum("time_s").alias("total_s"))
    spans = steps.where("pos % 5 = 0").join(last, "route_id").where("pos + 2 <= last").select("route_id", F.col("pos").alias("arc_start"), (F.col("pos") + 3).alias("arc_end"), "total_s")
    sums = adapt.span_sums(spans, steps).withColumns({"time_s": F.col("time_s").cast("long")})
    return adapt.thresholds(sums, Race(budget_s=200_000.0)).select("route_id", "arc_start", "arc_end", "time_s", "planned_start_s", "keep_before")


@query(f"""{_EVENTS}, {_SETS}, r AS (SELECT *, sum(cents) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS t FROM e), w AS (SELECT DISTINCT user_id, event_type FROM r WHERE t <= 100000),
done AS (SELECT user_id, trail_id FROM w JOIN sets USING (event_type) JOIN need USING (trail_id) GROUP BY user_id, trail_id, n HAVING count(*) = n), k AS (SELECT user_id, count(*) AS n FROM done GROUP BY user_id)
SELECT w.user_id, sum(types.k * 0.5::DOUBLE) AS miles, coalesce(any_value(k.n), 0) AS trails, least(coalesce(any_value(k.n), 0) * 1.0::DOUBLE, 40.0::DOUBLE) + least(sum(types.k * 0.5::DOUBLE), 40.0::DOUBLE) AS score FROM w JOIN types USING (event_type) LEFT JOIN k ON k.user_id = w.user_id GROUP BY w.user_id""")
def front_load_prefix(spark, sf):
    """The score of what is walked whole by a given time."""
    steps = _walks(spark, sf).withColumn("time_s", F.col("cents"))
    sets = _sets(steps)
    edges = steps.select("event_type").distinct().withColumn("score_mi", F.row_number().over(Window.orderBy("event_type")) * 0.5)
    w = Window.partitionBy(*BY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    done = steps.withColumn("t", F.sum("time_s").over(w)).where("t <= 100000")
    return scoring.score(done, BY, "event_type", edges, sets)


@query("""SELECT l_orderkey, l_linenumber, round(100 * (l_extendedprice - l_quantity * 1500) / greatest(l_quantity * 1500, 10), 1) AS pct FROM lineitem ORDER BY abs(pct) DESC, l_orderkey * 10 + l_linenumber LIMIT 6""")
def worst_residuals(spark, sf):
    """The rows that disagree most."""
    l = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(100 * (F.col("l_extendedprice") - F.col("l_quantity") * 1500) / F.greatest(F.col("l_quantity") * 1500, F.lit(10)), 1).alias("pct"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return pricing.worst(l, "pct", 6, "tie").drop("tie")


@query(_EDGES + " SELECT edge_id, CASE WHEN name LIKE '%1' THEN 'offtrail' WHEN trail_id IS NOT NULL THEN 'trail' ELSE 'road' END AS kind, CASE WHEN trail_id IS NOT NULL THEN score_mi ELSE 0.0 END AS score_mi FROM edges WHERE edge_id % 7 <> 3")
def edge_kinds(spark, sf):
    """Kind and scored miles of each edge; edges on a deny list are left out."""
    e = _edges(spark, sf)
    return e.where(F.col("edge_id") % 7 != 3).select("edge_id", publish.edge_kind(F.col("name").like("%1"), F.col("trail_id")).alias("kind"), F.when(F.col("trail_id").isNotNull(), F.col("score_mi")).otherwise(0.0).alias("score_mi"))


@query(_EDGES + """, labels AS (SELECT edge_id, edge_id % 11 AS component FROM edges)
SELECT component, count(DISTINCT trail_id) AS n_trails, round(sum(score_mi) / 1609.344, 2) AS miles, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM edges JOIN labels USING (edge_id) WHERE trail_id IS NOT NULL GROUP BY component""")
def component_summary(spark, sf):
    """Trails, miles and names of each component."""
    e = _edges(spark, sf).withColumnRenamed("score_mi", "length_m").withColumn("u", F.col("edge_id"))
    return graph.component_summary(e, e.select(F.col("u").alias("node"), (F.col("u") % 11).alias("component")))


@query(_EDGES + """, n AS (SELECT *, row_number() OVER (ORDER BY edge_id) - 1 AS i FROM edges)
SELECT 2 * i AS arc_id, edge_id, trail_id AS u, edge_id AS v, time_fwd_s AS time_s, score_mi FROM n UNION ALL SELECT 2 * i + 1, edge_id, edge_id, trail_id, time_rev_s, score_mi FROM n""")
def arc_expansion(spark, sf):
    """Two arcs per edge."""
    e = _edges(spark, sf).withColumns({"u": F.col("trail_id"), "v": F.col("edge_id"), "gain_fwd_m": F.lit(0.0), "gain_rev_m": F.lit(0.0), "off_trail": F.lit(False)})
    return graph.arcs(e).select("arc_id", "edge_id", "u", "v", "time_s", "score_mi")


@query(f"""{_EVENTS}, c AS (SELECT *, CASE event_type WHEN 'click' THEN 'unique' WHEN 'view' THEN 'repeat' ELSE 'offtrail' END AS cat FROM e)
SELECT user_id, pos, CAST(sum(CASE WHEN cat = 'unique' THEN cents ELSE 0 END) OVER w AS BIGINT) AS cum_unique, CAST(sum(CASE WHEN cat = 'repeat' THEN cents ELSE 0 END) OVER w AS BIGINT) AS cum_repeat,
  CAST(sum(CASE WHEN cat = 'offtrail' THEN cents ELSE 0 END) OVER w AS BIGINT) AS cum_offtrail, CAST(sum(cents) OVER w AS BIGINT) AS cum_all FROM c WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""")
def category_totals(spark, sf):
    """Running totals by category."""
    cat = F.when(F.col("event_type") == "click", "unique").when(F.col("event_type") == "view", "repeat").otherwise("offtrail")
    steps = walk.cumulative_by_category(_walks(spark, sf).withColumn("cat", cat), BY, ["pos"], "cents", ["unique", "repeat", "offtrail"])
    return steps.select("user_id", "pos", "cum_unique", "cum_repeat", "cum_offtrail", "cum_all")


@query(f"""{_EVENTS}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM e) SELECT user_id, event_id, pos, event_type FROM l WHERE before IS NULL OR before <> event_type""")
def without_repeats(spark, sf):
    """Points at the place of the one before are dropped."""
    return walk.without_repeats(_walks(spark, sf), BY, ["pos"], ["event_type"]).select("user_id", "event_id", "pos", "event_type")


@query("""WITH r AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)
SELECT o_orderkey, CAST(s // 3600 AS VARCHAR) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') AS clock, CAST((s + 30) // 3600 AS VARCHAR) || ':' || lpad(CAST((s + 30) // 60 % 60 AS VARCHAR), 2, '0') AS rounded,
  CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS minutes, lpad(CAST((s // 3600 + 7) % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') AS of_day FROM r""")
def clock_formats(spark, sf):
    """Printed times, each with its own rounding."""
    s = F.floor("o_totalprice")
    return _table(spark, sf, "orders").select("o_orderkey", formats.clock(s).alias("clock"), formats.hours_minutes(s).alias("rounded"), formats.minutes_seconds(s).alias("minutes"), formats.time_of_day(s).alias("of_day"))


@query("""SELECT p_partkey, 'preset_s' || lpad(CAST(p_size AS VARCHAR), 2, '0') || chr(CAST(97 + p_partkey % 4 AS INT)) || '.json' AS by_speed, 'preset_p' || lpad(CAST(p_size * 5 AS VARCHAR), 3, '0') || '.json' AS by_pace FROM part WHERE p_size < 100""")
def preset_names(spark, sf):
    """File names of published plans."""
    option = F.element_at(F.array(*map(F.lit, "abcd")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _table(spark, sf, "part").where("p_size < 100").select("p_partkey", formats.preset_by_speed(F.col("p_size") / 10, option).alias("by_speed"), formats.preset_by_pace(F.col("p_size") / 20).alias("by_pace"))


@query("""WITH p AS (SELECT p_brand AS option, p_size AS pace, round(max(p_retailprice), 2) AS score FROM part GROUP BY ALL), l AS (SELECT *, lag(score) OVER (PARTITION BY option ORDER BY pace) AS slower FROM p) SELECT option, pace, score, slower FROM l WHERE score < slower - 1e-9""")
def pace_monotonic(spark, sf):
    """Plans that score less than a slower one."""
    p = _table(spark, sf, "part").groupBy(F.col("p_brand").alias("option"), F.col("p_size").alias("pace")).agg(F.round(F.max("p_retailprice"), 2).alias("score"))
    return publish.pace_monotonic(p)


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos FROM lineitem), n AS (SELECT *, lead(l_suppkey % 5) OVER (PARTITION BY l_orderkey ORDER BY pos) AS nxt FROM w),
a AS (SELECT l_orderkey AS route_id, arg_min(l_suppkey % 5, pos) AS u, arg_max(l_partkey % 5, pos) AS v, min(CASE WHEN nxt <> l_partkey % 5 THEN pos END) AS gap, sum(l_quantity) AS t FROM n GROUP BY l_orderkey),
p AS (SELECT route_id, CASE WHEN u <> 0 THEN 'starts away from the depot' WHEN v <> 0 THEN 'ends away from the depot' WHEN gap IS NOT NULL THEN 'break after step ' || gap WHEN t > 100 + 1e-6 THEN 'over budget' END AS problem FROM a)
SELECT route_id, problem IS NULL AS ok, problem FROM p""")
def route_validity(spark, sf):
    """What is wrong with a walk: its ends, a break, its time."""
    line = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route_id"), *_LINE_ORDER, (F.col("l_suppkey") % 5).alias("u"), (F.col("l_partkey") % 5).alias("v"), F.col("l_quantity").alias("time_s"))
    return walk.continuity(walk.positions(line, ["route_id"], _LINE_ORDER), ["route_id"], F.lit(0), 100.0)


@query("""WITH t AS (SELECT o_orderkey AS route_id, round(o_totalprice, 2) AS total FROM orders), l AS (SELECT l_orderkey AS route_id, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS parts, min(l_quantity) AS least FROM lineitem GROUP BY l_orderkey)
SELECT route_id, problem FROM t LEFT JOIN l USING (route_id), (VALUES ('no lines'), ('total differs'), ('no quantity')) AS p(problem)
WHERE (problem = 'no lines' AND parts IS NULL) OR (problem = 'total differs' AND abs(total - parts) > 1000) OR (problem = 'no quantity' AND least <= 0)""")
def quality_checks(spark, sf):
    """Constraints as rows: every breach is one, none is fit for publication."""
    t = tables(spark, sf, "orders", "lineitem")
    line = t["lineitem"].groupBy(F.col("l_orderkey").alias("route_id")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("parts"), F.min("l_quantity").alias("least"))
    j = t["orders"].select(F.col("o_orderkey").alias("route_id"), F.round("o_totalprice", 2).alias("total")).join(line, "route_id", "left")
    found = F.array(F.when(F.col("parts").isNull(), "no lines"), F.when(F.abs(F.col("total") - F.col("parts")) > 1000, "total differs"), F.when(F.col("least") <= 0, "no quantity"))
    return j.select("route_id", F.explode(F.array_compact(found)).alias("problem"))


@query("""SELECT CAST(s.mph AS DOUBLE) / 10 AS mph, string_agg(s.opt || '=' || s.name, ',' ORDER BY s.opt, s.name) AS presets FROM (SELECT p_size AS mph, chr(CAST(97 + p_partkey % 4 AS INT)) AS opt, 'preset_s' || lpad(CAST(p_size AS VARCHAR), 2, '0') || chr(CAST(97 + p_partkey % 4 AS INT)) || '.json' AS name FROM (SELECT DISTINCT p_size, p_partkey % 4 AS p_partkey FROM part WHERE p_size < 100)) s GROUP BY s.mph""")
def manifest(spark, sf):
    """Published files by speed, options in order."""
    names = preset_names(spark, sf).select(F.col("by_speed").alias("name")).distinct()
    return publish.manifest(names).select("mph", F.array_join(F.transform("presets", lambda x: F.concat(x["option"], F.lit("="), x["file"])), ",").alias("presets"))


def _routes(spark, sf) -> DataFrame:
    """Orders with their lines as steps between few nodes, from node to node."""
    line = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route_id"), *_LINE_ORDER, (F.col("l_partkey") % 3).alias("v"), F.col("l_partkey").alias("edge_id"), (F.col("l_quantity") * 20).alias("time_s"), (F.col("l_quantity") / 10).alias("score_mi"), (F.col("l_partkey") % 40).alias("trail_id"))
    steps = walk.positions(line, ["route_id"], _LINE_ORDER)
    steps = steps.drop(*_LINE_ORDER)
    return steps.withColumn("u", F.coalesce(F.lag("v").over(Window.partitionBy("route_id").orderBy("pos")), F.lit(0)))


@query()
def excursions(spark, sf):
    """Closed detours of walks, nested (a stack per walk: no SQL; see the tests)."""
    return adapt.nesting(adapt.detours(_routes(spark, sf)))


@query()
def cut_pricing(spark, sf):
    """What dropping each detour alone would cost and save."""
    steps = _routes(spark, sf)
    edges = steps.groupBy("edge_id").agg(F.max("score_mi").alias("score_mi"))
    trails = steps.select("trail_id", "edge_id").distinct()
    return adapt.thresholds(adapt.priced_cuts(steps, adapt.nesting(adapt.detours(steps)), edges, trails))


@query()
def droppable_after(spark, sf):
    """Seconds that outermost detours from the third step on would give back."""
    steps = _routes(spark, sf)
    spans = adapt.span_sums(adapt.nesting(adapt.detours(steps)).withColumn("from_pos", F.lit(2)), steps)
    return adapt.droppable_after(spans)


@query()
def salvage(spark, sf):
    """The best plan within a smaller budget, for every walk."""
    steps = _routes(spark, sf)
    edges = steps.groupBy("edge_id").agg(F.max("score_mi").alias("score_mi"))
    trails = steps.select("trail_id", "edge_id").distinct()
    race = Race(budget_s=3_000.0)
    cuts = adapt.priced_cuts(steps, adapt.nesting(adapt.detours(steps)), edges, trails, race)
    return adapt.salvage(cuts, steps, edges, trails, race)


@query(f"""WITH {_SETS.split('need AS')[0].rstrip().rstrip(',')} SELECT trail_id, count(*) AS edges, string_agg(event_type, ',' ORDER BY event_type) AS types FROM sets GROUP BY trail_id""")
def trail_edges(spark, sf):
    """The set of edges of each trail."""
    return _sets(_table(spark, sf, "events")).groupBy("trail_id").agg(F.count(F.lit(1)).alias("edges"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


def _event_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A small event's graph from nations: a depot, an edge to each nation, edges between those
    that trade least; regions are trails."""
    links = _arcs(spark, sf).join(_table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("u"), F.col("n_regionkey").cast("long").alias("trail_id"), "n_name"), "u")
    pairs = links.where("u < v").select((F.col("u") + 1).alias("u"), (F.col("v") + 1).alias("v"), F.col("time_s").alias("t"), "trail_id", F.col("n_name").alias("name"))
    spokes = _table(spark, sf, "nation").select(F.lit(0).cast("long").alias("u"), (F.col("n_nationkey") + 1).cast("long").alias("v"), (F.lit(40.0) + F.col("n_nationkey")).alias("t"), F.lit(None).cast("long").alias("trail_id"), F.lit("access").alias("name"))
    rows = pairs.unionByName(spokes).withColumn("edge_id", F.row_number().over(Window.orderBy("u", "v")).cast("long"))
    edges = rows.select("edge_id", "u", "v", F.col("t").alias("time_fwd_s"), (F.col("t") * 1.25).alias("time_rev_s"), F.lit(0.0).alias("gain_fwd_m"), F.lit(0.0).alias("gain_rev_m"), (F.col("t") * 20).alias("length_m"), F.when(F.col("trail_id").isNotNull(), F.col("t") / 60).otherwise(0.0).alias("score_mi"), "trail_id", F.lit(False).alias("off_trail"), "name")
    return edges, graph.arcs(edges)


@query()
def trail_chains(spark, sf):
    """Each trail's edges strung into one walk (a greedy walk per trail: no SQL; see the tests)."""
    return graph.chains(_event_graph(spark, sf)[0])


@query()
def decoder(spark, sf):
    """The two plain plans (cheapest next, best ratio) and the bound none can pass."""
    edges, arcs = _event_graph(spark, sf)
    p = search.problem(arcs, graph.shortest(arcs), graph.chains(edges), 0)
    race = Race(budget_s=2_000.0)
    rows = []
    for name, order in (("greedy", search.greedy(p, race)), ("best ratio", search.best_ratio(p, race))):
        found = search.decode(p, order, race)
        rows.append((name, p.score(p.edges(found), race), p.seconds(found), len(found)))
    plans = spark.createDataFrame(rows, "plan string, score double, time_s double, arcs int")
    bound = scoring.knapsack_bound(edges, edges.where("trail_id is not null").select("trail_id", "edge_id"), race)
    return plans.withColumn("bound", F.lit(bound.first().bound))


@query()
def alns_grid(spark, sf):
    """Seeds and options searched side by side, one task each."""
    edges, arcs = _event_graph(spark, sf)
    p = search.problem(arcs, graph.shortest(arcs), graph.chains(edges), 0)
    rows = [(option, seed, [1] if option == "b" else [], [1] if option == "c" else [], 1.0 if option == "d" else None) for option in "abcd" for seed in (1, 2)]
    grid = spark.createDataFrame(rows, "option string, seed long, require array<long>, forbid array<long>, floor double")
    return search.solve_grid(spark, p, grid, 40, Race(budget_s=2_000.0))


_DIM = """WITH l AS (SELECT l_orderkey AS route_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos, CAST(l_quantity * 20 AS BIGINT) AS secs FROM lineitem)"""


@query(_DIM + """, c AS (SELECT route_id, pos, CAST(sum(secs) OVER (PARTITION BY route_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS elapsed_s, CAST(sum(secs) OVER (PARTITION BY route_id) AS BIGINT) AS total FROM l)
SELECT route_id, pos, elapsed_s, 2000 - elapsed_s - (total - elapsed_s) // 2 AS slack_s FROM c""")
def bail_out_slack(spark, sf):
    """After each step: the clock, and what is left if the way home takes half of what remains."""
    steps = _routes(spark, sf)
    w = Window.partitionBy("route_id").orderBy("pos")
    run = steps.withColumn("elapsed_s", F.sum(F.col("time_s").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum(F.col("time_s").cast("long")).over(Window.partitionBy("route_id")))
    return run.select("route_id", "pos", "elapsed_s", (F.lit(2000) - F.col("elapsed_s") - F.floor((F.col("total") - F.col("elapsed_s")) / 2)).alias("slack_s"))


@query(_DIM + ", s AS (SELECT route_id, pos AS arc_start, pos + 2 AS arc_end FROM l WHERE pos % 3 = 1) SELECT l.route_id, pos, secs FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.route_id = l.route_id AND l.pos >= arc_start AND l.pos < arc_end)")
def without_spans(spark, sf):
    """The steps that are left when spans are dropped (a range anti join within a walk)."""
    steps = _routes(spark, sf).select("route_id", "pos", F.col("time_s").cast("long").alias("secs"))
    spans = steps.where("pos % 3 = 1").select("route_id", F.col("pos").alias("arc_start"), (F.col("pos") + 2).alias("arc_end"))
    return adapt.without_spans(steps, spans, ["route_id"])


@query(_EDGES + """, m AS (SELECT trail_id, CAST(sum(CAST(time_fwd_s AS BIGINT)) AS BIGINT) AS ours, CAST(sum(CAST(time_rev_s AS BIGINT)) AS BIGINT) AS theirs FROM edges WHERE trail_id IS NOT NULL GROUP BY trail_id)
SELECT trail_id, ours, theirs, ours - theirs AS diff, round(100.0::DOUBLE * (ours - theirs) / greatest(theirs, 10), 1) AS pct FROM m""")
def gain_check(spark, sf):
    """Sums per trail against a second source, in percent of at least ten."""
    e = _edges(spark, sf).where("trail_id is not null").groupBy("trail_id").agg(F.sum(F.col("time_fwd_s").cast("long")).alias("ours"), F.sum(F.col("time_rev_s").cast("long")).alias("theirs"))
    return e.withColumns({"diff": F.col("ours") - F.col("theirs"), "pct": F.round(100.0 * (F.col("ours") - F.col("theirs")) / F.greatest("theirs", F.lit(10)), 1)})


@query("""WITH a AS (SELECT n_name AS name FROM nation WHERE n_regionkey < 3), b AS (SELECT n_name AS name FROM nation WHERE n_regionkey > 1) SELECT name, 'missing' AS side FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'extra' FROM b WHERE name NOT IN (SELECT name FROM a)""")
def manifest_difference(spark, sf):
    """What a listing has and the folder lacks, and the other way round."""
    n = _table(spark, sf, "nation")
    a, b = n.where("n_regionkey < 3").select(F.col("n_name").alias("name")), n.where("n_regionkey > 1").select(F.col("n_name").alias("name"))
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


@query("""WITH ends AS (SELECT l_partkey % 500 AS node_id, l_orderkey AS osm_id, l_linenumber AS pos FROM lineitem WHERE l_quantity > 49) SELECT node_id, count(*) AS ways FROM ends GROUP BY node_id HAVING count(*) > 1""")
def shared_nodes(spark, sf):
    """Nodes that more than one way goes through."""
    from waymark.sources.readers import shared_nodes as shared

    ends = _table(spark, sf, "lineitem").where("l_quantity > 49").select((F.col("l_partkey") % 500).alias("node_id"), F.col("l_orderkey").alias("osm_id"), F.col("l_linenumber").alias("pos"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    return shared(ends).select("node_id", "ways")


@query("""WITH p AS (SELECT p_partkey AS trail_id, round(p_retailprice, 2) AS m, p_size / 100.0::DOUBLE AS official FROM part) SELECT trail_id, round(m / 1609.344, 3) AS computed_mi, round(m / 1609.344 - official, 3) AS delta_mi, round(100 * (m / 1609.344 - official) / greatest(official, 0.05), 1) AS pct FROM p""")
def length_check(spark, sf):
    """Computed lengths against official ones, in percent of at least 0.05."""
    p = _table(spark, sf, "part").select(F.col("p_partkey").alias("trail_id"), F.round("p_retailprice", 2).alias("length_m"), (F.col("p_size") / 100.0).alias("official_dist_mi"))
    return pricing.length_check(p).select("trail_id", "computed_mi", "delta_mi", "pct")


@query("""WITH ours AS (SELECT p_partkey AS k, p_retailprice AS a, CAST(p_size AS DOUBLE) AS b FROM part), stored AS (SELECT p_partkey AS k, round(p_retailprice, 0) AS a, CAST(p_size AS DOUBLE) AS b FROM part) SELECT max(abs(o.a - s.a)) AS a, max(abs(o.b - s.b)) AS b FROM ours o JOIN stored s USING (k)""")
def reprice_drift(spark, sf):
    """The largest difference of each column to what is stored."""
    part = _table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"))
    return publish.drift(part, part.withColumn("a", F.round("a", 0)), "k", ["a", "b"])


@query("""SELECT o_orderkey, floor(o_totalprice / 10000 * 10 + 1e-9) / 10 AS points, CASE WHEN o_totalprice / 60 > 1e-9 THEN round(100 / (o_totalprice / 60), 6) ELSE 'inf'::DOUBLE END AS per_minute,
  CASE WHEN o_totalprice / 10000 >= 40 THEN 'miles' ELSE '' END AS caps FROM orders""")
def caps_and_rates(spark, sf):
    """Caps a score has reached; points per minute; a score cut to a tenth."""
    o = _table(spark, sf, "orders")
    p = F.col("o_totalprice") / 10000
    return o.select("o_orderkey", F.floor(p * 10 + 1e-9).cast("double").alias("__p"), F.round(formats.points_per_minute(F.lit(100.0), F.col("o_totalprice") / 60), 6).alias("per_minute"), F.array_join(scoring.caps(p, F.lit(0)), ",").alias("caps")).select("o_orderkey", (F.col("__p") / 10).alias("points"), "per_minute", "caps")
