"""The route problem as an integer program, in tables: for whatever solver is at hand.

Variables: x_<arc> (0..3, how often an arc is walked), z_<edge> (edge used), y_<trail> (trail
complete), p_<node> (node visited), g_<arc> (flow that ties what is walked to the depot). A row is
one constraint; its coefficients are rows of (row, variable, coefficient).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.rules import Rule
from waymark.params import Race

MOST_WALKS = 3


def _name(letter: str, key: str) -> Column:
    return F.concat(F.lit(f"{letter}_"), F.col(key).cast("string"))


def _terms(df: DataFrame, row: Column, variable: Column, coefficient) -> DataFrame:
    return df.select(row.alias("row"), variable.alias("variable"), F.lit(coefficient).cast("double").alias("coefficient") if not isinstance(coefficient, Column) else coefficient.cast("double").alias("coefficient"))


def variables(arcs: DataFrame, trails: DataFrame, race: Race = Race()) -> DataFrame:
    """variable, kind (integer, binary, real), upper, objective. The objective is the uncapped
    score; where no cap binds at its optimum, that optimum is the best score."""
    edges = arcs.groupBy("edge_id").agg(F.max("score_mi").alias("score_mi"))
    nodes = arcs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    none = F.lit(0.0)
    parts = [
        arcs.select(_name("x", "arc_id").alias("variable"), F.lit("integer").alias("kind"), F.lit(float(MOST_WALKS)).alias("upper"), none.alias("objective")),
        edges.select(_name("z", "edge_id"), F.lit("binary"), F.lit(1.0), F.col("score_mi") * race.per_mile),
        trails.select("trail_id").distinct().select(_name("y", "trail_id"), F.lit("binary"), F.lit(1.0), F.lit(race.per_trail)),
        nodes.select(_name("p", "node"), F.lit("binary"), F.lit(1.0), none),
        arcs.select(_name("g", "arc_id"), F.lit("real"), F.lit(None).cast("double"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def constraints(arcs: DataFrame, trails: DataFrame, depot: int, race: Race = Race(), rule: Rule = Rule(), incumbent: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, sense, bound) and (row, variable, coefficient). The rows: as many ways in as out of
    each node; an edge counts only if walked; a trail only if all its edges count; the budget;
    nodes are visited if an arc into them is walked; flow only on walked arcs; each visited node
    takes one unit of what leaves the depot; trails a rule requires or forbids; at least the
    incumbent's score."""
    a = arcs.select("arc_id", "edge_id", "u", "v", "time_s")
    nodes = a.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    n = nodes.count()
    t, rows = [], []

    def add(name: str, keys: DataFrame, key: str, sense: str, bound, *terms: DataFrame) -> None:
        rows.append(keys.select(F.concat(F.lit(f"{name}_"), F.col(key).cast("string")).alias("row"), F.lit(sense).alias("sense"), F.lit(float(bound)).alias("bound")))
        t.extend(terms)

    row = lambda name, key: F.concat(F.lit(f"{name}_"), F.col(key).cast("string"))
    other = nodes.where(F.col("node") != depot)
    add("balance", nodes, "node", "=", 0, _terms(a, row("balance", "u"), _name("x", "arc_id"), 1), _terms(a, row("balance", "v"), _name("x", "arc_id"), -1))
    edges = a.select("edge_id").distinct()
    add("used", edges, "edge_id", "<=", 0, _terms(edges, row("used", "edge_id"), _name("z", "edge_id"), 1), _terms(a, row("used", "edge_id"), _name("x", "arc_id"), -1))
    pairs = trails.select("trail_id", "edge_id").distinct().withColumn("pair", F.concat_ws("_", "trail_id", "edge_id"))
    add("whole", pairs, "pair", "<=", 0, _terms(pairs, row("whole", "pair"), _name("y", "trail_id"), 1), _terms(pairs, row("whole", "pair"), _name("z", "edge_id"), -1))
    one = nodes.limit(1).select(F.lit("all").alias("k"))
    add("budget", one, "k", "<=", race.budget_s, _terms(a, F.lit("budget_all"), _name("x", "arc_id"), F.col("time_s")))
    add("visited", a, "arc_id", "<=", 0, _terms(a, row("visited", "arc_id"), _name("x", "arc_id"), 1), _terms(a, row("visited", "arc_id"), _name("p", "v"), -MOST_WALKS))
    add("carried", a, "arc_id", "<=", 0, _terms(a, row("carried", "arc_id"), _name("g", "arc_id"), 1), _terms(a, row("carried", "arc_id"), _name("x", "arc_id"), -float(n)))
    into, out = a.where(F.col("v") != depot), a.where(F.col("u") != depot)
    add("reached", other, "node", "=", 0, _terms(into, row("reached", "v"), _name("g", "arc_id"), 1), _terms(out, row("reached", "u"), _name("g", "arc_id"), -1), _terms(other, row("reached", "node"), _name("p", "node"), -1))
    need = trails.where(F.col("trail_id").isin(list(rule.require))).select("trail_id").distinct()
    add("require", need, "trail_id", ">=", 1, _terms(need, row("require", "trail_id"), _name("y", "trail_id"), 1))
    shut = a.join(trails.where(F.col("trail_id").isin(list(rule.forbid))).select("edge_id").distinct(), "edge_id", "left_semi")
    add("forbid", shut, "arc_id", "<=", 0, _terms(shut, row("forbid", "arc_id"), _name("x", "arc_id"), 1))
    if incumbent is not None:
        v = variables(arcs, trails, race).where("objective <> 0")
        add("incumbent", one, "k", ">=", incumbent, _terms(v, F.lit("incumbent_all"), F.col("variable"), F.col("objective")))
    merged = t[0]
    for part in t[1:]:
        merged = merged.union(part)
    merged = merged.groupBy("row", "variable").agg(F.sum("coefficient").alias("coefficient")).where("coefficient <> 0")
    heads = rows[0]
    for part in rows[1:]:
        heads = heads.union(part)
    return heads, merged


def violated(heads: DataFrame, terms: DataFrame, values: DataFrame) -> DataFrame:
    """The rows that a solution (variable, value; missing ones are 0) breaks, and by how much."""
    sums = terms.join(values, "variable").groupBy("row").agg(F.sum(F.col("coefficient") * F.col("value")).alias("sum"))
    each = heads.join(sums, "row", "left").withColumn("sum", F.coalesce("sum", F.lit(0.0)))
    over = F.when(F.col("sense") == "<=", F.col("sum") - F.col("bound")).when(F.col("sense") == ">=", F.col("bound") - F.col("sum")).otherwise(F.abs(F.col("sum") - F.col("bound")))
    return each.withColumn("over", over).where("over > 1e-6")


def lp_text(kinds: DataFrame, heads: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: the program in the LP format that solvers read."""
    plus = F.format_string("%+.9f %s", F.col("coefficient"), F.col("variable"))
    lines = terms.groupBy("row").agg(F.array_join(F.array_sort(F.collect_list(plus)), " ").alias("sum")).join(heads, "row")
    rows = lines.agg(F.array_join(F.array_sort(F.collect_list(F.format_string(" %s: %s %s %.9f", "row", "sum", "sense", "bound"))), "\n").alias("rows"))
    goal = kinds.where("objective <> 0").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%+.9f %s", "objective", "variable"))), " ").alias("goal"))
    of = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("variable")))), " ")
    bounds = kinds.agg(of("integer").alias("ints"), of("binary").alias("bins"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "integer", F.format_string(" 0 <= %s <= %.0f", "variable", "upper")))), "\n").alias("bounds"))
    one = rows.withColumn("k", F.lit(1)).join(goal.withColumn("k", F.lit(1)), "k").join(bounds.withColumn("k", F.lit(1)), "k")
    return one.select(F.concat(F.lit("Maximize\n obj: "), "goal", F.lit("\nSubject To\n"), "rows", F.lit("\nBounds\n"), "bounds", F.lit("\nGenerals\n "), "ints", F.lit("\nBinaries\n "), "bins", F.lit("\nEnd\n")).alias("document"))


def walk_of(values: DataFrame, arcs: DataFrame, depot: int) -> DataFrame:
    """The closed walk of a solution: route_id, pos, arc_id. values: variable, value."""
    from waymark.operators.graph import euler

    x = values.where(F.col("variable").startswith("x_") & (F.col("value") > 0.5)).select(F.substring("variable", 3, 30).cast("long").alias("arc_id"), F.round("value").cast("int").alias("times"))
    return euler(x.join(arcs.select("arc_id", "u", "v"), "arc_id").withColumn("route_id", F.lit(0).cast("long")).select("route_id", "arc_id", "u", "v", "times"), depot)


def gap_percent(best: float, bound: float) -> float:
    """How far a bound is above the best score, in percent of that score."""
    return 0.0 if bound <= best else 100.0 * (bound - best) / max(abs(best), 1e-9)
