"""Connected components by alternating large-star and small-star rounds on tables of edges.

Edges are first thinned within tasks, which settles small graphs at once; rounds follow until all
components are stars. Nothing but counts reaches the driver. Each round's tables are written to the shared folder, so both sides of every join are plain exchanges that adaptive execution can split where a
node has very many neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import materialise


#: Edges a task thins out at once; its memory is bounded by them.
EDGES = 1_000_000


def _forest(most: int):
    """The edges of a task thinned, ``most`` at a time, to one per node, towards the least node it
    reaches among them."""

    def thinned(parent: dict[int, int], root) -> Iterator[pa.RecordBatch]:
        nodes = np.fromiter(parent, np.int64, len(parent))
        roots = np.fromiter(map(root, list(parent)), np.int64, len(parent))
        for i in range(0, len(nodes), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 65536]), pa.array(roots[i : i + 65536])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = x = parent.get(p, p)
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                if len(parent) >= most:
                    yield from thinned(parent, root)
                    parent.clear()
        yield from thinned(parent, root)

    return run


def _thin(edges: DataFrame, most: int) -> DataFrame:
    """edges: u, v, materialised. As many tasks as ``most`` edges each call for."""
    few = edges.coalesce(max(1, -(-edges.count() // most)))
    return materialise(few.mapInArrow(_forest(most), "u long, v long"), "edges")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return not ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").limit(1).count()


def _star(edges: DataFrame) -> DataFrame:
    """edges: u, v. Ties the neighbours v of each u, and u, to the least of them."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    return edges.join(least, "u")


def connected_components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """edges: two long columns, the ends of links (repeated, reversed and self links are fine).
    Returns node, root for every node with a link to another: the least node it can reach.
    No links give no rows."""
    a, b = edges.columns
    now = _thin(materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), "links"), most)
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_star(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = _star(large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = _thin(materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "small"), most)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
