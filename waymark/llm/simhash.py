"""SimHash near-duplicates with a pigeonring filter.

A 64-bit fingerprint is a ring of three segments. If two fingerprints differ in at most two bits,
then from some segment on, every chain of 1, 2 and 3 consecutive segments has at most 0, 1 and 2
differing bits (its share of the budget). The first two conditions make join keys: the start
segment as it is, and one half of the next segment as it is (a single differing bit leaves one
half alone), six keys of 31 to 33 bits in all. The chain conditions are then tested in full, and
last the whole distance.

Fingerprints are first made distinct, so exact copies cost nothing here. Buckets of up to
``PAIRS`` fingerprints are paired up. In larger buckets pairs would grow with the square of the
bucket: there, a fingerprint is sent to each of the 65 points within one bit of it. Two
fingerprints differ in at most two bits exactly if they share such a point, and no point has more
than 65 fingerprints, so this finds every link in linear size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import ROW, lookup, materialise, row_by_row, text_batches, text_of, with_row_key
from waymark.llm.components import connected_components

SHINGLE = 3
DISTANCE = 2
PAIRS = 128
#: First bit and width of each segment, and of each segment's two halves.
RING = ((0, 21), (21, 21), (42, 22))
HALVES = (((0, 10), (10, 11)), ((21, 10), (31, 11)), ((42, 11), (53, 11)))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text; 0 if it has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return digest(join(words), 42)
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for i in range(0, n, 65536):
        part = words[i : min(n, i + 65536) + shingle - 1]
        hashes = np.fromiter((digest(join(x), 42) for x in zip(*(part[k:] for k in range(shingle)))), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints.view(np.int64))], [*b.schema.names[:-1], "print"])

    return run


def fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ROW and print (long) of each row, computed once."""
    text_batches(df.sparkSession)
    keyed = with_row_key(df)
    rows = keyed.select(F.col(doc_id).alias("doc_id"), *ROW, text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return row_by_row(keyed, rows.mapInArrow(_fingerprints(shingle), f"doc_id {kind}, {ROW[0]} long, {ROW[1]} long, print long"), "prints")


def _bits(c, first: int, width: int):
    return F.shiftrightunsigned(c, first).bitwiseAND(F.lit((1 << width) - 1))


def _keys(c) -> list:
    """The six join keys of a fingerprint."""
    return [
        F.lit((2 * i + j) << 33) + F.shiftleft(_bits(c, *RING[i]), 11) + _bits(c, *HALVES[(i + 1) % 3][j])
        for i in range(3) for j in range(2)
    ]


def links(prints: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """prints: one column of distinct fingerprints (long). Returns links a, b that connect exactly
    what links of at most two differing bits connect."""
    keys = prints.select("print", F.explode(F.array(*_keys(F.col("print")))).alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialise(lookup(keys, sizes, "key", "members", 6 * prints.count()).where("members is not null"), "members")
    few = members.where(F.col("members") <= pairs).select("key", "print")
    diff = F.col("a.print").bitwiseXOR(F.col("b.print"))
    start = F.shiftrightunsigned(F.col("a.key"), 34)
    chains = [F.bit_count(_bits(diff, *RING[i])) + F.bit_count(_bits(diff, *RING[(i + 1) % 3])) for i in range(3)]
    two = F.when(start == 0, chains[0]).when(start == 1, chains[1]).otherwise(chains[2])
    near = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.print") < F.col("b.print")) & (two <= 1) & (F.bit_count(diff) <= DISTANCE))
    paired = near.select(F.col("a.print").alias("a"), F.col("b.print").alias("b")).distinct()
    many = members.where(F.col("members") > pairs).select("print").distinct()
    points = F.array(F.col("print"), *(F.col("print").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    around = many.select("print", F.explode(points).alias("point")).groupBy("point").agg(F.collect_set("print").alias("all")).where(F.size("all") > 1)
    shared = around.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    return paired.unionByName(shared)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ROW, fingerprint, component_id and cluster (a fingerprint) of each row of ``df``.

    component_id is the least id reachable over links of at most two differing bits. Texts without
    a word (null and empty too) have fingerprint zero and link like any other; null ids don't
    count for component_id unless a component has no other. Repeated rows share a component. An
    empty table gives no rows.
    """
    rows = fingerprints(df, text, doc_id, shingle)
    n = rows.count()
    classes = materialise(rows.groupBy("print").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("least")), "classes")
    nodes = connected_components(links(classes.select("print")))
    known = classes.join(nodes, F.col("print") == F.col("node"), "left").withColumn("root", F.coalesce("root", "print"))
    shared = known.groupBy("root").agg(F.sum("members").alias("all"), F.min("least").alias("component_id")).where("all > 1")
    table = materialise(known.join(shared, "root").select("print", "members", "root", "component_id"), "labels")
    return lookup(rows, table, "print", "members", n).select(
        "doc_id", *ROW, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("root", "print").alias("cluster"),
    )


def keep_one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with one row of each component of near-duplicates: the one with the least id (of
    repeated ids, the first; a null id only where all ids are null). Rows with nothing near them all
    stay. Null texts count as empty, and texts without a word are near each other; an empty table gives no rows."""
    keyed = with_row_key(df)
    found = materialise(near_duplicates(keyed, text, doc_id), "near")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)).alias("first")
    stay = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), first).where("rows > 1")
    marked = lookup(found, stay, "cluster", "rows", found.count()).where("rows is not null")
    gone = marked.where(F.struct(*ROW) != F.struct(*(F.col("first")[c] for c in ROW))).select(*ROW)
    return keyed.join(gone.hint("merge"), list(ROW), "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
