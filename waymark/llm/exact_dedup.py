"""Exact deduplication by two passes over a Bloom filter.

Pass one folds the digests of all texts into a filter of cells that were hit twice or more. Pass
two sends only the rows whose cell is in the filter through a shuffle; all other texts are unique
for sure and pass straight through. The filter is built in parts: each task emits the cells it
has seen, so many hashes at a time that its memory is bounded, the parts of a block of cells meet in one group, and only the bits of cells hit twice
reach the driver, at most ``2 ** MAX_LOG2 / 8`` bytes however large the input is. Beyond
``2 ** MAX_LOG2 / CELLS_PER_ROW`` rows the filter gets denser and lets more unique rows shuffle;
results stay the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import lookup, materialise, text_of

CELLS_PER_ROW = 8
MAX_LOG2 = 30
BLOCK = 16
#: Hashes that a task sorts at once; its memory is some 100 bytes for each.
AT_ONCE = 1 << 20


#: A function that makes hashes of a task's batches.
Hashes = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def _as_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The first column."""
    for b in batches:
        yield b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def cells_seen(log2: int, at_once: int = AT_ONCE, of: Hashes = _as_hashes):
    """Over batches that ``of`` makes hashes of: by block, the cells they hit, those hit again once more."""
    mask = np.uint64((1 << log2) - 1)

    def said(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells = np.sort(np.concatenate(parts))
        cells = cells[np.concatenate([[True, True], cells[2:] != cells[:-2]])[: len(cells)]]
        blocks = cells >> np.uint32(BLOCK)
        starts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        blocks = blocks[starts]
        ends = (np.append(starts, len(cells)) * 2).astype(np.int32)
        low = pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(ends), pa.py_buffer(cells.astype(np.uint16))])
        made = pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), low], ["block", "cells"])
        for i in range(0, len(blocks), 4096):
            yield made.slice(i, 4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for hashes in of(batches):
            parts.append((hashes & mask).astype(np.uint32))
            n += len(hashes)
            if n >= at_once:
                yield from said(parts)
                parts, n = [], 0
        if n:
            yield from said(parts)

    return run


def repeated_cells(keys: DataFrame, n_rows: int, cells_per_row: int = CELLS_PER_ROW, max_log2: int = MAX_LOG2, least: int = 2, of: Hashes = _as_hashes) -> tuple[np.ndarray, int]:
    """keys: one long column of well-mixed hashes, or rows that ``of`` makes such hashes of, which then
    never leave the task. Returns the bits of the cells that ``least`` (1 or 2) or more hashes hit, and
    the filter's size as a power of two."""
    log2 = min(max_log2, max(BLOCK, int(np.ceil(np.log2(max(1, n_rows) * cells_per_row)))))

    def merged(part: pa.Table) -> pa.Table:
        hits, parts = np.zeros(1 << BLOCK, np.int64), part["cells"].to_pylist()
        for i in range(0, len(parts), 256):
            hits += np.bincount(np.frombuffer(b"".join(parts[i : i + 256]), np.uint16), minlength=1 << BLOCK)
        bits = np.packbits(hits >= least, bitorder="little")
        return pa.table({"block": part["block"][:1], "bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())}).slice(0, int(bits.any()))

    found = keys.mapInArrow(cells_seen(log2, of=of), "block int, cells binary").groupBy("block").applyInArrow(merged, "block int, bits binary")
    bits = np.zeros((1 << log2) >> 3, np.uint8)
    size = (1 << BLOCK) >> 3
    # One job for all blocks, which reach Python as they come; an iterator would run a job for each partition in turn.
    for b in found.toArrow().to_batches():
        for block, part in zip(b.column("block").to_pylist(), b.column("bits")):
            bits[block * size : (block + 1) * size] = np.frombuffer(zlib.decompress(part.as_py()), np.uint8)
    return bits, log2


def in_filter(bits: np.ndarray, log2: int, hashes: np.ndarray) -> np.ndarray:
    """Of each hash whether its cell's bit is set."""
    cells = hashes & np.uint64((1 << log2) - 1)
    return (bits[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1


def maybe_repeated(spark, bits: np.ndarray, log2: int):
    """A function of a hash column: false only where no other row has the same hash."""
    held = spark.sparkContext.broadcast(bits)

    def maybe(keys: pa.Array) -> pa.Array:
        return pa.array(in_filter(held.value, log2, keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    return F.arrow_udf(maybe, "boolean")


def exact_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Null text counts as empty; a null id is
    below all others. Of repeated rows (equal id and text) exactly one is kept. An empty table
    gives no rows; columns other than the two named are ignored.
    """
    rows = materialise(
        df.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(text_of(text), 256)).alias("sha"), F.monotonically_increasing_id().alias("uid")), "digests"
    )
    n = rows.count()
    maybe = maybe_repeated(df.sparkSession, *repeated_cells(rows.select(F.xxhash64("sha")), n))
    suspect = maybe(F.xxhash64("sha"))
    groups = materialise(
        rows.where(suspect).groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("top")).where("group_size > 1"), "groups"
    )
    shuffled = lookup(rows.where(suspect), groups, "sha", "group_size", n)
    straight = rows.where(~suspect).withColumns({"group_size": F.lit(None).cast("long"), "top": F.lit(None).cast(groups.schema["top"].dataType)})
    return shuffled.unionByName(straight).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("top.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with one row of each distinct text, the one with the largest id, all columns kept.

    Null text counts as empty, a null id is below all others; of rows with the same id and text the
    one whose columns have the largest hash stays, so that reruns agree. An empty table gives no rows.
    Rows with a text of their own don't move. Of equal texts, each task first keeps its best row,
    so a text that fills a third of the table costs a row per task.
    """
    mark = F.sha2(text_of(text), 256)
    keys = materialise(df.select(F.xxhash64(mark).alias("key")), "keys")
    maybe = maybe_repeated(df.sparkSession, *repeated_cells(keys, keys.count()))
    suspect = maybe(F.xxhash64(mark))
    every = [F.col(f"`{c}`") for c in df.columns]
    order = F.struct(F.col(doc_id).isNotNull(), F.col(doc_id), F.xxhash64(*every))
    best = df.where(suspect).groupBy(mark.alias("__sha")).agg(F.max_by(F.struct(*every), order).alias("__row"))
    return df.where(~suspect).unionByName(best.select("__row.*"))
