"""Mixing against a plain walk over all copies."""

import hashlib
import re

import pytest

from waymark.llm import mixing


def brute(rows: list[tuple], weights=(1, 2, 3), repeats=3) -> list[tuple]:
    """rows: doc_id, text, source. doc_id, size, target and taken by sorting all copies."""
    docs = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(f"mix-1:{'' if d is None else d}".encode()).hexdigest()) for d, t, s in rows]
    names = sorted({d[1] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(d[2] for d in docs if d[1] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, free, target = sum(size.values()), set(names), {}
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > repeats * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: float(repeats * size[s]) for s in over}
        free -= over
    copies = []
    for i, s in enumerate(names):
        queue, sent = sorted((d for d in docs if d[1] == s), key=lambda d: (d[3], d[0] is not None, d[0] or 0, d[2])), 0
        for _ in range(repeats):
            for d in queue:
                sent += d[2]
                copies.append((sent / weight[s], i, d))
    copies.sort(key=lambda c: c[:2])
    taken, upto = {}, 0
    for _, _, d in copies:
        upto += d[2]
        if upto <= total:
            taken[d] = taken.get(d, 0) + d[2]
    return sorted((str(d[0]), d[2], round(target[d[1]], 6), taken.get(d, 0)) for d in docs)


def rows_of(df) -> list[tuple]:
    return sorted((str(r.doc_id), r["size"], round(r.target, 6), r.taken) for r in df.collect())


@pytest.mark.parametrize("n", [1, 7, 300])
def test_skewed_sources(spark, n):
    rows = [(i, "w " * ((i * 37) % 50), "abcdefg"[min(6, i % 13)] if i % 3 else "hot") for i in range(n)]
    assert rows_of(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))) == brute(rows)


def test_scarce_sources_are_capped(spark):
    rows = [(i, "w " * 10, "big") for i in range(90)] + [(100 + i, "x y", s) for i, s in enumerate(["small", None, "tiny", None])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert rows_of(got) == brute(rows)
    assert {r.source: r.taken for r in got.where("source <> 'big'").collect()} == {"small": 6, "tiny": 6}


def test_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), longest=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.longest).all() and abs(by.taken.sum() - got["size"].sum()) <= by.longest.max()


def test_edges_of_the_input(spark):
    rows = [(1, None, "a", "x"), (2, "", None, "x"), (None, "one two", "a", "x"), (3, "one", "b", "x"), (3, "one", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place string")
    got = mixing.mix(df).collect()
    assert len(got) == 5 and all(r.taken <= 3 * r["size"] for r in got)
    took = mixing.take(df)
    assert took.columns == df.columns and took.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 == mixing.take(df.limit(0)).count()
    assert mixing.mix(df.where("doc_id = 1")).first().taken == 0
