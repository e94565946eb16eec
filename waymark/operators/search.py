"""Search for walks that score well. The graph is small and the search long, so each candidate
search is one row of a grid (speed, option, seed): rows are dealt over the cluster, the graph is
broadcast once, and each row is solved by a plain Python kernel.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.rules import Rule
from waymark.params import Race

PENALTY = 1000.0


@dataclass
class Problem:
    """A graph small enough for one task: arcs by id, the fastest ways between nodes, trails as
    chains of arcs that can be walked from either end."""

    depot: int
    arcs: dict[int, tuple] = field(default_factory=dict)  # arc -> edge, u, v, seconds
    miles: dict[int, float] = field(default_factory=dict)  # edge -> scored miles
    needs: dict[int, frozenset] = field(default_factory=dict)  # trail -> edges
    way: dict[tuple, tuple] = field(default_factory=dict)  # (u, v) -> seconds, arcs
    ways_to: dict[int, list] = field(default_factory=dict)  # trail -> [(start, end, seconds, arcs)]

    def score(self, edges: set, race: Race) -> float:
        done = sum(n <= edges for n in self.needs.values())
        return min(done * race.per_trail, race.trail_cap) + min(sum(self.miles.get(e, 0.0) for e in edges) * race.per_mile, race.mile_cap)

    def edges(self, walk: list[int]) -> set:
        return {self.arcs[a][0] for a in walk}

    def seconds(self, walk: list[int]) -> float:
        return sum((self.arcs[a][3] for a in walk), 0.0)


def problem(arcs: DataFrame, known: DataFrame, chains: DataFrame, depot: int) -> Problem:
    """Gathers a Problem: arcs (with score_mi and trail_id), shortest ways (src, dst, time_s,
    pred_arc) and trail chains. These are the graph of one event, a few hundred rows; its size is
    checked before anything is gathered."""
    if arcs.count() > 200_000:
        raise ValueError("the graph is too large to search within one task")
    out = Problem(depot)
    rows = arcs.collect()
    for r in rows:
        out.arcs[r.arc_id] = (r.edge_id, r.u, r.v, r.time_s)
        out.miles[r.edge_id] = r.score_mi
    fastest = {}
    for r in rows:
        if (r.edge_id, r.u, r.v) not in fastest:
            fastest[r.edge_id, r.u, r.v] = r.arc_id
    by_trail: dict = {}
    for r in chains.orderBy("trail_id", "place").collect():
        by_trail.setdefault(r.trail_id, []).append((r.edge_id, r.forward))
    along = {(r.edge_id): (r.u, r.v) for r in rows if r.arc_id % 2 == 0}
    for t, links in by_trail.items():
        out.needs[t] = frozenset(e for e, _ in links)
        ahead = [fastest[(e, *along[e])] if f else fastest[(e, *along[e][::-1])] for e, f in links]
        back = [fastest[(e, *along[e][::-1])] if f else fastest[(e, *along[e])] for e, f in links[::-1]]
        out.ways_to[t] = [(out.arcs[w[0]][1], out.arcs[w[-1]][2], out.seconds(w), w) for w in (ahead, back)]
    ends = {depot} | {n for w in out.ways_to.values() for s, e, *_ in w for n in (s, e)}
    before = {(r.src, r.dst): r for r in known.where(F.col("src").isin(sorted(ends))).collect()}
    for s in ends:
        for d in ends:
            if (r := before.get((s, d))) is None:
                continue
            walk, at = [], d
            while at != s:
                arc = before[s, at].pred_arc
                walk.append(arc)
                at = out.arcs[arc][1]
            out.way[s, d] = (r.time_s, walk[::-1])
    return out


def decode(p: Problem, order: list[int], race: Race = Race()) -> list[int]:
    """The walk of an order of trails: each is taken from the end with the smaller sum of approach
    and trail, if the way home still fits the budget after it; else the other end; else skipped.
    A trail whose edges are all walked already needs no visit."""
    here, spent, walk, seen = p.depot, 0.0, [], set()
    for t in order:
        if p.needs[t] <= seen:
            continue
        options = sorted(((p.way[here, s][0] + sec, k) for k, (s, _, sec, _) in enumerate(p.ways_to[t]) if (here, s) in p.way))
        for cost, k in options:
            s, e, _, links = p.ways_to[t][k]
            if (e, p.depot) in p.way and spent + cost + p.way[e, p.depot][0] <= race.budget_s + 1e-6:
                part = p.way[here, s][1] + links
                walk += part
                seen |= p.edges(part)
                spent, here = spent + cost, e
                break
    return walk + p.way[here, p.depot][1]


def order_of(p: Problem, walk: list[int]) -> list[int]:
    """Trails in the order in which a walk completes them."""
    first: dict = {}
    for k, a in enumerate(walk):
        first.setdefault(p.arcs[a][0], k)
    done = [(max(first[e] for e in need), t) for t, need in p.needs.items() if all(e in first for e in need)]
    return [t for _, t in sorted(done)]


def breaches(p: Problem, walk: list[int], rule: Rule) -> int:
    have = p.edges(walk)
    return sum(not p.needs[t] <= have for t in rule.require if t in p.needs) + sum(bool(p.needs[t] & have) for t in rule.forbid if t in p.needs)


def shed_seconds(p: Problem, walk: list[int], most_share: float = 0.35, least: float = 120.0) -> float:
    """Seconds in outermost closed detours that could be dropped."""
    clock = [0.0]
    for a in walk:
        clock.append(clock[-1] + p.arcs[a][3])
    stack, spans = [(p.depot, 0)], []
    for k, a in enumerate(walk):
        v = p.arcs[a][2]
        place = next((i for i, (n, _) in enumerate(stack) if n == v), None)
        if place is None:
            stack.append((v, k + 1))
        else:
            start = stack[place][1]
            if least <= clock[k + 1] - clock[start] <= most_share * clock[-1]:
                spans = [s for s in spans if s[0] < start] + [(start, k + 1)]
            del stack[place + 1 :]
            stack[-1] = (v, k + 1)
    return sum(clock[b] - clock[a] for a, b in spans)


def objective(p: Problem, walk: list[int], race: Race, rule: Rule, floor: float | None = None) -> float:
    """The score, less a penalty per breach. With a floor, walks at or above it are ranked by how
    much they can shed instead (minutes, then points in the first five hours)."""
    value = p.score(p.edges(walk), race) - PENALTY * breaches(p, walk, rule)
    if floor is None:
        return value
    if value < floor:
        return PENALTY * (value - floor)
    early, t = [], 0.0
    for a in walk:
        t += p.arcs[a][3]
        if t > 18_000:
            break
        early.append(a)
    return shed_seconds(p, walk) / 60 + p.score(p.edges(early), race) / 1000


def _fits(p: Problem, order: list[int], race: Race) -> list[int]:
    """The trails of an order that its walk completes, in that order's own sequence."""
    have = p.edges(decode(p, order, race))
    return [t for t in order if p.needs[t] <= have]


def greedy(p: Problem, race: Race = Race(), pool: list[int] | None = None) -> list[int]:
    """Always the trail that is cheapest to reach and walk and still fits."""
    order, left, here, spent = [], sorted(pool if pool is not None else p.needs), p.depot, 0.0
    while True:
        best = None
        for t in left:
            for s, e, sec, _ in p.ways_to[t]:
                if (here, s) in p.way and (e, p.depot) in p.way:
                    cost = p.way[here, s][0] + sec
                    if spent + cost + p.way[e, p.depot][0] <= race.budget_s and (best is None or cost < best[0]):
                        best = (cost, t, e)
        if best is None:
            return order
        spent, here = spent + best[0], best[2]
        order.append(best[1])
        left.remove(best[1])


def best_ratio(p: Problem, race: Race = Race(), pool: list[int] | None = None) -> list[int]:
    """Always the trail that adds most score per second."""
    order, left = [], sorted(pool if pool is not None else p.needs)
    walk = decode(p, order, race)
    while True:
        now, spent, best = p.score(p.edges(walk), race), p.seconds(walk), None
        for t in left:
            new = decode(p, [*order, t], race)
            more, cost = p.score(p.edges(new), race) - now, max(p.seconds(new) - spent, 1.0)
            if more > 1e-9 and (best is None or more / cost > best[0]):
                best = (more / cost, t, new)
        if best is None:
            return order
        order.append(best[1])
        left.remove(best[1])
        walk = best[2]


def _remove(p: Problem, rnd: random.Random, order: list[int], k: int, how: str, race: Race) -> list[int]:
    """Trails to take out of an order."""
    if not order:
        return []
    k = min(k, len(order))
    if how == "random":
        return rnd.sample(order, k)
    if how == "segment":
        if len(order) <= k:
            return []
        i = rnd.randrange(len(order) - k + 1)
        return order[i : i + k]
    if how == "cluster":
        anchor = p.ways_to[rnd.choice(order)][0][0]
        far = lambda t: min(p.way.get((anchor, s), (math.inf,))[0] for s, *_ in p.ways_to[t])
        return sorted(order, key=lambda t: (far(t), t))[:k]
    whole = decode(p, order, race)
    base, spent = p.score(p.edges(whole), race), p.seconds(whole)

    def loss(t: int) -> float:
        rest = decode(p, [x for x in order if x != t], race)
        return (base - p.score(p.edges(rest), race)) / max(spent - p.seconds(rest), 1.0)

    return sorted(order, key=lambda t: (loss(t), t))[:k]


def _insert(p: Problem, rnd: random.Random, order: list[int], pool: list[int], how: str, race: Race, value) -> list[int]:
    """An order with trails of the pool put where they help."""
    order, pool = list(order), [t for t in pool if t not in order]
    if how == "random":
        rnd.shuffle(pool)
        for t in pool[: rnd.randint(1, 5)]:
            new = [*order]
            new.insert(rnd.randint(0, len(order)), t)
            if value(new) >= value(order):
                order = new
        return order
    while pool:
        now, best = value(order), None
        for t in pool:
            gains = sorted(((value([*order[:i], t, *order[i:]]) - now, -i) for i in range(len(order) + 1)), reverse=True)
            rank = gains[0][0] - gains[min(1, len(gains) - 1)][0] if how == "regret" else gains[0][0]
            if gains[0][0] > 1e-9 and (best is None or rank > best[0]):
                best = (rank, t, -gains[0][1])
        if best is None:
            break
        order.insert(best[2], best[1])
        pool.remove(best[1])
    return order


def large_neighbourhood(p: Problem, seed: int, iterations: int, race: Race = Race(), rule: Rule = Rule(), floor: float | None = None, start: list[int] | None = None) -> dict:
    """Adaptive large-neighbourhood search. Destroy and repair steps are drawn by weights that
    follow their success; worse orders are accepted with a probability that cools down; the best
    walk without a breach is kept, or the best of all where none was found."""
    rnd = random.Random(seed)
    pool = sorted(t for t in p.needs if t not in rule.forbid)
    value = lambda order: objective(p, decode(p, order, race), race, rule, floor)
    now = list(start) if start is not None else _fits(p, greedy(p, race, pool), race)
    value_now = value(now)
    best, value_best, legal = now, value_now, breaches(p, decode(p, now, race), rule) == 0
    weights = {k: 1.0 for k in ("random", "worst", "segment", "cluster", "+greedy", "+regret", "+random")}
    heat = 2.0
    draw = lambda names: rnd.choices(names, [weights[n] for n in names])[0]
    for _ in range(iterations):
        out, into = draw(["random", "worst", "segment", "cluster"]), draw(["+greedy", "+regret", "+random"])
        gone = set(_remove(p, rnd, now, rnd.randint(1, max(1, len(now) // 3)), out, race))
        new = _insert(p, rnd, [t for t in now if t not in gone], pool, into[1:], race, value)
        value_new, reward = value(new), 0.0
        if value_new > value_now + 1e-9 or rnd.random() < math.exp(min(0.0, (value_new - value_now) / heat)):
            reward = 1.5 if value_new > value_now + 1e-9 else 0.5
            now, value_now = new, value_new
        clean = breaches(p, decode(p, new, race), rule) == 0
        if (clean, value_new) > (legal, value_best + 1e-9):
            best, value_best, legal, reward = new, value_new, clean, 3.0
        for name in (out, into):
            weights[name] = max(0.05, 0.85 * weights[name] + 0.15 * reward)
        heat *= 0.995
    walk = decode(p, best, race)
    return {"order": best, "walk": walk, "score": p.score(p.edges(walk), race), "time_s": p.seconds(walk), "breaches": breaches(p, walk, rule), "shed_s": shed_seconds(p, walk)}


def adaptive(p: Problem, seed: int, iterations: int, floor: float, race: Race = Race(), rule: Rule = Rule()) -> dict:
    """A walk at or above the floor that can shed as much as possible: half the steps go to the plain
    score, the rest on from there."""
    plain = large_neighbourhood(p, seed, iterations // 2, race, rule)
    return large_neighbourhood(p, seed, iterations - iterations // 2, race, rule, floor, start=plain["order"])


def exact(p: Problem, race: Race = Race(), rule: Rule = Rule()) -> dict:
    """The best closed walk of a tiny graph, by enumerating walks that don't pass an arc more than
    twice; for tests and for bounding the search on toy networks."""
    after: dict = {}
    for a, (_, u, _, _) in p.arcs.items():
        after.setdefault(u, []).append(a)
    home = {n: s for (n, d), (s, _) in p.way.items() if d == p.depot}
    best = {"score": -math.inf, "walk": []}

    def go(at: int, walk: list[int], spent: float, used: dict) -> None:
        if at == p.depot:
            s = p.score(p.edges(walk), race)
            if s > best["score"] + 1e-12 and not breaches(p, walk, rule):
                best.update(score=s, walk=list(walk))
        for a in after.get(at, ()):
            _, _, v, t = p.arcs[a]
            if used.get(a, 0) < 1 and spent + t + home.get(v, 0.0) <= race.budget_s + 1e-6:
                used[a] = used.get(a, 0) + 1
                go(v, [*walk, a], spent + t, used)
                used[a] -= 1

    go(p.depot, [], 0.0, {})
    return best


def solve_grid(spark: SparkSession, p: Problem, grid: DataFrame, iterations: int, race: Race = Race()) -> DataFrame:
    """Searches every row of grid: option, seed, require, forbid (arrays of trails), floor (null:
    none). Returns option, seed, score, time_s, breaches, shed_s, walk (arc ids). Each row is a
    task of its own; a lost executor repeats its rows, which are the same for the same seed."""
    held = spark.sparkContext.broadcast(p)

    def solve(frames):
        for f in frames:
            out = []
            for r in f.itertuples():
                rule = Rule(r.option, tuple(r.require), tuple(r.forbid))
                floor = None if r.floor is None or math.isnan(r.floor) else r.floor
                x = large_neighbourhood(held.value, int(r.seed), iterations, race, rule) if floor is None else adaptive(held.value, int(r.seed), iterations, floor, race, rule)
                out.append((r.option, int(r.seed), x["score"], x["time_s"], x["breaches"], x["shed_s"], x["walk"]))
            yield pd.DataFrame(out, columns=["option", "seed", "score", "time_s", "breaches", "shed_s", "walk"])

    dealt = grid.repartition(max(1, min(grid.count(), 10_000)), "option", "seed")
    return dealt.mapInPandas(solve, "option string, seed long, score double, time_s double, breaches int, shed_s double, walk array<long>")


def ship(solutions: DataFrame, floor: float | None = None) -> DataFrame:
    """Of each option the solution to publish: without breaches, above the floor if there is one,
    the one that can shed most; else the best score, ties to the lesser seed."""
    ok = solutions.where("breaches = 0")
    key = F.struct("score", -F.col("seed")) if floor is None else F.struct((F.col("score") >= floor).alias("above"), F.when(F.col("score") >= floor, F.col("shed_s")).otherwise(F.col("score")).alias("rank"), -F.col("seed"))
    return ok.groupBy("option").agg(F.max_by(F.struct("seed", "score", "time_s", "shed_s", "walk"), key).alias("s")).select("option", "s.*")
