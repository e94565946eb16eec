"""Line deduplication over range-partitioned line hashes.

Every line long enough gives a 128-bit hash of its key. The hashes are range-partitioned and
sorted together with the document (largest first), so a line that most documents hold is spread
over as many range partitions as its rows need. Each task streams its part in order: the first
row of a key is the occurrence that stays, and from the fifth document on the others go. Only
the first and last key of a task can go on in its neighbours; their rows wait, and what the tasks
counted of these keys, at most two rows a task, is added up and broadcast. What comes back is a
compressed bitmap of the lines each document keeps, never text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import ROW, on_disks, row_by_row, text_batches, text_of, with_row_key

MIN_POINTS = 40
MIN_DOCS = 5
_SPACE = b" \t\n\x0b\x0c\r"
_OCCURRENCE = f"h1 long, h2 long, doc long, {ROW[0]} long, {ROW[1]} long, n_lines int, lines binary"
_GONE, _WAITS, _COUNTED = 0, 1, 2


def _occurrences(min_points: int):
    schema = pa.schema([(n, pa.int64()) for n in ("h1", "h2", "doc", *ROW)] + [("n_lines", pa.int32()), ("lines", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, f, i, text in zip(*(b.column(c).to_pylist() for c in ("doc", *ROW, "text"))):
                lines, at = text.encode("utf-8", "surrogatepass").split(b"\n"), {}
                for k, line in enumerate(lines):
                    if len(line) >= min_points and len(key := line.strip(_SPACE)) >= min_points and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_points):
                        at.setdefault(xxhash.xxh3_128_digest(key.lower()), []).append(k)
                out += [(*np.frombuffer(h, np.int64).tolist(), doc, f, i, len(lines), np.array(ks, np.int32).tobytes()) for h, ks in at.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def _stream(min_docs: int):
    """Over rows sorted by key and document, largest first: which occurrences go."""

    def out(rows: pa.RecordBatch, kind: int, counted=None) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, counted or 0, np.int64))], [*rows.schema.names, "kind", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # rows of the open key, fewer than min_docs
        key, first, n, top = None, False, 0, None  # the open key once its rows are no longer held
        begun = False
        for b in batches:
            if held is not None:
                b, held = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0], None
            if not b.num_rows:
                continue
            h1, h2, doc = (b.column(c).to_numpy() for c in range(3))
            at = 0
            if key is not None:
                same = (h1 == key[0]) & (h2 == key[1])
                at = b.num_rows if same.all() else int(np.argmin(same))
                n += at
                if first and at:
                    yield out(b.slice(0, at), _WAITS)
                elif at and (go := doc[:at] != top[2]).any():
                    yield out(b.slice(0, at).filter(pa.array(go)), _GONE)
                if at == b.num_rows:
                    continue
                if first:
                    yield out(top[3], _COUNTED, n)
                key, first = None, False
            new = np.flatnonzero((h1[at + 1 :] != h1[at:-1]) | (h2[at + 1 :] != h2[at:-1])) + at + 1 if at < b.num_rows - 1 else np.array([], np.int64)
            starts = np.concatenate([[at], new]).astype(np.int64)
            lengths = np.diff([*starts, b.num_rows])
            if not begun:  # the first key of all may have begun in the task before
                begun, size = True, int(lengths[0])
                yield out(b.slice(0, size), _WAITS)
                if len(starts) == 1:
                    key, first, n, top = (h1[at], h2[at]), True, size, (None, None, doc[at], b.slice(at, 1))
                    continue
                yield out(b.slice(at, 1), _COUNTED, size)
                starts, lengths = starts[1:], lengths[1:]
            last, size = int(starts[-1]), int(lengths[-1])
            if size < min_docs:
                held = b.slice(last)
                starts, lengths = starts[:-1], lengths[:-1]
            else:
                key, first, n, top = (h1[last], h2[last]), False, size, (None, None, doc[last], b.slice(last, 1))
            long = lengths >= min_docs
            if long.any():
                rows = np.concatenate([np.arange(s + 1, s + k)[doc[s + 1 : s + k] != doc[s]] for s, k in zip(starts[long], lengths[long])])
                if len(rows):
                    yield out(b.take(pa.array(rows)), _GONE)
        if held is not None:
            yield out(held, _WAITS)
            yield out(held.slice(0, 1), _COUNTED, held.num_rows)
        elif key is not None:
            yield out(top[3], _COUNTED, n)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for n, parts in zip(b.column("n_lines").to_pylist(), b.column("gone").to_pylist()):
            keep = np.ones(n, bool)
            for p in parts:
                keep[np.frombuffer(p, np.int32)] = False
            out.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], [*ROW, "n_lines", "keep"])


def keep_bitmaps(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """ROW, n_lines and keep (a zlib-compressed bitmap, first line in the highest bit) of each row
    that loses a line; all others keep every line. See ``kept_lines`` for the rule."""
    rows = with_row_key(df).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), *ROW, text_of(text).alias("text"))
    found = row_by_row(rows, rows.mapInArrow(_occurrences(min_points), _OCCURRENCE), "lines")
    order = ["h1", "h2", F.col("doc").desc(), *ROW]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    # The order is total, so that a task made again decides alike.
    decided = on_disks(ranged.mapInArrow(_stream(min_docs), f"{_OCCURRENCE}, kind byte, docs long"))
    total = decided.where(F.col("kind") == _COUNTED).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("doc").alias("top"))
    waiting = decided.where(F.col("kind") == _WAITS).join(F.broadcast(total.where(F.col("all_docs") >= min_docs)), ["h1", "h2"]).where("doc <> top")
    gone = decided.where(F.col("kind") == _GONE).select(*ROW, "n_lines", "lines").unionByName(waiting.select(*ROW, "n_lines", "lines"))
    by_row = gone.groupBy(*ROW).agg(F.max("n_lines").alias("n_lines"), F.collect_list("lines").alias("gone"))
    return by_row.mapInArrow(_bitmaps, f"{ROW[0]} long, {ROW[1]} long, n_lines int, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, keep in zip(b.column("text").to_pylist(), b.column("keep").to_pylist()):
            lines = text.encode("utf-8", "surrogatepass").split(b"\n")
            n = len(lines)
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
                lines = [x for x, k in zip(lines, bits) if k]
            out.append((n, n - len(lines), b"\n".join(lines)))
        n, dropped, kept = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])


def without_repeated_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text left, as UTF-8 bytes) of each row of ``df``."""
    text_batches(df.sparkSession)
    keyed = with_row_key(df)
    rows = keyed.select(F.col(doc_id).alias("doc_id"), *ROW, text_of(text).alias("text"))
    joined = rows.join(keep_bitmaps(keyed, text, doc_id, min_points, min_docs).select(*ROW, "keep").hint("merge"), list(ROW), "left")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "keep").mapInArrow(_apply, f"doc_id {kind}, n_lines long, n_dropped long, kept binary")


def kept_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: doc_id, n_lines (before), n_dropped, kept_sha256.

    Lines are split at ``\\n``; a null or empty text has one empty line. A line's key is the line
    without ASCII white space at its ends and with A-Z lower-cased. A key of at least MIN_POINTS
    code points that MIN_DOCS or more rows hold goes from all of them but those with the largest
    id holding it (a null id is below all others; repeated rows with that id all keep it). An
    empty table gives no rows.
    """
    return without_repeated_lines(df, text, doc_id).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
