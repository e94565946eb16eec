"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.llm import simhash


def brute(prints: list[int], ids: list) -> list:
    """component_id of each row by comparing all pairs."""
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 2
    label = np.arange(len(a))
    while True:
        new = np.where(near, label[None, :], len(a)).min(1)
        if (new == label).all():
            break
        label = new
    least = {k: min((i for i, x in zip(ids, label) if x == k and i is not None), default=None) for k in set(label)}
    return [least[k] for k in label]


def clustered(n: int, hubs: int, seed: int = 1) -> list[int]:
    """Fingerprints around a few hubs, so that buckets are large and chains long."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(hubs)]
    out = []
    for _ in range(n):
        x = rnd.choice(centres + out[-50:])
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            x ^= 1 << rnd.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("pairs", [128, 2])
def test_links_find_every_component(spark, pairs):
    prints = sorted(set(clustered(600, 5)))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "print long"), pairs).collect()
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    got = [root(x) for x in signed]
    want = brute(prints, list(range(len(prints))))
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


def test_fingerprint_matches_spark_hash(spark):
    df = spark.createDataFrame([("One two\tTHREE",)], "text string")
    assert df.select(F.xxhash64(F.lit("one two three"))).first()[0] == np.array([simhash.fingerprint("One two\tTHREE")], np.uint64).view(np.int64)[0]
    assert simhash.fingerprint("") == 0 == simhash.fingerprint(" \n")
    assert simhash.fingerprint("É a") != simhash.fingerprint("é a")


def test_documents(spark):
    """The whole small table against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [simhash.fingerprint(r.text) for r in rows]
    for r, p, c in zip(rows, prints, brute(prints, [r.doc_id for r in rows])):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{p:016x}", c)


def test_edges_of_the_input(spark):
    """Nulls, empty texts, repeated rows, clashing columns, an empty table."""
    rows = [(3, None, "x"), (1, "", "y"), (None, " ", "z"), (7, "a b c d", "x"), (7, "a b c d", "x"), (5, "A b c d", "w"), (9, "w " * 50_000, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, print string")
    got = [tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(x[2] for x in got) == [1, 1, 1, 5, 5, 5, 9]
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.keep_one_of_each(df.limit(0)).count()


def test_row_order_does_not_matter(spark):
    pdf = pd.DataFrame({"doc_id": range(40), "text": [f"alpha beta {i % 7} gamma" for i in range(40)]})
    a = simhash.near_duplicates(spark.createDataFrame(pdf)).toPandas().sort_values("doc_id").component_id.tolist()
    b = simhash.near_duplicates(spark.createDataFrame(pdf.sample(frac=1, random_state=2)).repartition(5)).toPandas().sort_values("doc_id").component_id.tolist()
    assert a == b
