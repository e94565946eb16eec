"""Packing documents into fixed windows by non-negative least squares.

Each document is tokenised once. Its full windows are sequences of their own; what is left, its
tail, is packed with other tails. The tails' histogram over lengths is at most ``window - 1``
counts. Shallow combinations of two to four lengths that fill a window exactly are enumerated,
non-negative least squares gives how often to repeat each so that together they use the histogram
up, and the counts are rounded down and corrected so that no length is used more than it occurs.
Tails that no combination uses are packed greedily end to end in order of length, cut where a
window is full, so that only the very last window can have padding.

Which tail goes where follows from its rank among tails of its length, and that rank from counts
by task and length taken while tokenising. So rows move once, in a join on (task, length) that no
length, however frequent, can skew. The driver sees the histogram and the plan, both of bounded
size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import row_by_row, text_batches, text_of

WINDOW = 1024
STEPS = 400


class Plan(NamedTuple):
    """For each length, in order of rank: ranks below ``until`` go to place ``offset`` of sequence
    ``base + rank - since``; past the last, ranks from ``rest_since`` on go end to end from token
    ``rest_at``."""

    length: np.ndarray
    since: np.ndarray
    until: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    rest_since: np.ndarray
    rest_at: np.ndarray
    templates: int


def combinations(window: int) -> list[tuple[int, ...]]:
    """Combinations of lengths that fill a window: all pairs, and threes and fours with near equal
    or doubling rests."""
    found = set()
    for a in range(1, window):
        rest = window - a
        for parts in ((rest,), (rest // 2, rest - rest // 2), (rest // 3, rest - rest // 3), (rest // 4, rest - rest // 4), (rest // 3, rest // 3, rest - 2 * (rest // 3)), (rest // 8, rest // 4, rest - rest // 8 - rest // 4)):
            if min(parts) > 0:
                found.add(tuple(sorted((a, *parts), reverse=True)))
    return sorted(found, key=lambda c: (len(c), c))


def solve(histogram: np.ndarray, combos: list[tuple[int, ...]], steps: int = STEPS) -> np.ndarray:
    """How often to use each combination: minimises |A x - histogram| over x >= 0 by accelerated
    projected gradient, where column j of A counts the lengths in combination j."""
    rows = np.concatenate([np.array(c) for c in combos])
    cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    m = len(histogram)
    forward = lambda x: np.bincount(rows, x[cols], m)
    back = lambda r: np.bincount(cols, r[rows], len(combos))
    v = np.ones(len(combos))
    for _ in range(20):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(forward(v))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(forward(y) - histogram))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: np.ndarray, window: int = WINDOW, steps: int = STEPS) -> Plan:
    """histogram[k]: tails of length k, 0 <= k < window."""
    combos = combinations(window)
    wanted = np.floor(solve(histogram.astype(float), combos, steps) + 1e-6).astype(np.int64) if histogram.any() else np.zeros(len(combos), np.int64)
    left, used = histogram.astype(np.int64).copy(), np.zeros(window, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    base = 0
    for again in (False, True):  # a second round uses what rounding down has left
        for c, n in zip(combos, wanted):
            lengths, times = np.unique(c, return_counts=True)
            most = int((left[lengths] // times).min())
            n = most if again else min(int(n), most)
            if n <= 0:
                continue
            offset = 0
            for k in c:
                slots.append((k, int(used[k]), int(used[k]) + n, base, offset))
                used[k] += n
                offset += k
            left[lengths] -= n * times
            base += n
    slots.sort()
    at = np.zeros(window, np.int64)
    total = 0
    for k in range(window - 1, 0, -1):
        at[k], total = total, total + int(left[k]) * k
    return Plan(*(np.array(x, np.int64) for x in (zip(*slots) if slots else [[]] * 5)), used, at, base)


def _encoder(path: str, end: int):
    """Token ids of a text, with the end mark. The vocabulary's ranks give the same ids several
    times faster; texts with a special token's string go to the tokenizer itself."""
    import base64
    import json
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t["content"] for t in json.loads(tokenizer.to_str()).get("added_tokens", [])]
    slow = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    encode = slow
    ranked = path.removesuffix(".json") + ".tiktoken"
    if os.path.exists(ranked):
        import public_tokenizers
        import tiktoken

        with open(ranked, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(text: str) -> np.ndarray:
        found = slow(text) if any(s in text for s in special) else encode(text)
        return np.array([*found, end], "<u4")

    return ids


def _tokenise(tokenizer: str | None, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        ids_of = _encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end)
        task, seen, chunks = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for b in batches:
            out = []
            for text in b.column("text"):
                ids = ids_of(text.as_py())
                full, k = divmod(len(ids), window)
                crcs = [zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(full)]
                tail = ids[full * window :].astype("<u2" if ids.max() < 65536 else "<u4").tobytes()
                out.append((len(ids), task, k, int(seen[k]), chunks, crcs, tail))
                seen[k] += 1
                chunks += full
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            columns = zip(*out) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "tokens", "task", "tail", "nth", "chunk", "crcs", "ids"])

    return run


def _place(p, window: int, chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = p.value
        first = np.searchsorted(plan.length, np.arange(window + 1))
        for b in batches:
            out = []
            for row, (tokens, tail, nth, before, chunk, chunk_before, crcs, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("tokens", "tail", "nth", "before", "chunk", "chunk_before", "crcs", "ids")))):
                out += [(row, i * window, window, crc, tokens, chunk_before + chunk + i, 0) for i, crc in enumerate(crcs)]
                if not tail:
                    continue
                rank, start = before + nth, len(crcs) * window
                values = np.frombuffer(ids, "<u2" if len(ids) == 2 * tail else "<u4").astype("<u4")
                if rank < plan.rest_since[tail]:
                    lo, hi = first[tail], first[tail + 1]
                    s = lo + int(np.searchsorted(plan.until[lo:hi], rank, side="right"))
                    out.append((row, start, tail, zlib.crc32(values.tobytes()), tokens, chunks + int(plan.base[s] + rank - plan.since[s]), int(plan.offset[s])))
                    continue
                at, done = int(plan.rest_at[tail] + (rank - plan.rest_since[tail]) * tail), 0
                while done < tail:
                    n = min(tail - done, window - at % window)
                    out.append((row, start + done, n, zlib.crc32(values[done : done + n].tobytes()), tokens, chunks + plan.templates + at // window, at % window))
                    done, at = done + n, at + n
            columns = list(zip(*out)) if out else [()] * 7
            doc = b.column("doc_id").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, tokenizer: str | None = None, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizer file that every executor can read; None for the installed
    ``byte_bpe_50k.json``. Null text counts as empty: one token, the end mark. Every row of ``df``
    is a document, repeated rows and null ids too. Sequences are numbered from 0 without a gap;
    an empty table gives no rows. ids_crc32 is over the piece's ids as little-endian 32-bit words.
    """
    text_batches(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    schema = f"doc_id {kind}, tokens long, task int, tail int, nth long, chunk long, crcs array<long>, ids binary"
    docs = row_by_row(df, rows.mapInArrow(_tokenise(tokenizer, window, end), schema), "tokens")
    counts = docs.groupBy("task", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("crcs")).alias("full"))
    histogram, chunks = np.zeros(window, np.int64), 0
    for k, n, full in counts.groupBy("tail").agg(F.sum("n"), F.sum("full")).collect():
        histogram[k], chunks = n if k else 0, chunks + full
    solved = df.sparkSession.sparkContext.broadcast(plan(histogram, window))
    earlier = (Window.unboundedPreceding, -1)
    by_task = counts.groupBy("task").agg(F.sum("full").alias("full"))
    by_task = by_task.select("task", F.coalesce(F.sum("full").over(Window.partitionBy().orderBy("task").rowsBetween(*earlier)), F.lit(0)).alias("chunk_before"))
    ranks = counts.select("task", "tail", F.coalesce(F.sum("n").over(Window.partitionBy("tail").orderBy("task").rowsBetween(*earlier)), F.lit(0)).alias("before"))
    starts = ranks.join(by_task, "task")
    pieces = docs.join(starts, ["task", "tail"]).select("doc_id", "tokens", "tail", "nth", "before", "chunk", "chunk_before", "crcs", "ids")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.mapInArrow(_place(solved, window, chunks), schema)
