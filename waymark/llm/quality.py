"""Quality rules judged by an isolation forest.

One pass over the texts gives each document's rule statistics. An isolation forest is grown on a
bounded sample of labelled rows: each tree splits a small subsample at random until rows stand
alone, so a document that is unlike the many ends after few splits. The threshold on the mean path
length is calibrated on all labelled rows through a histogram of their scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import SPACE, hash_sample, materialise, row_by_row, text_batches, text_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Bound on the labelled rows that the forest is grown on, trees, rows of a tree.
FIT_ROWS, TREES, TREE_ROWS = 8192, 100, 2048
#: Share of the labelled good rows that the threshold may reject at most.
MAX_LOSS = 0.01
BINS = 4000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_punct", "n_digits", "n_distinct", "n_lines", "max_run")


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS and MORE of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    code: dict[bytes, int] = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    covered = longest = 0
    if n >= 3:
        size = len(code)
        pair = codes[:-1] * size + codes[1:]
        if size >= 1 << 20:  # keep the triple within 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        triple = pair[:-1] * size + codes[2:]
        order = np.argsort(triple, kind="stable")
        ranked = triple[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[k : n - 2 + k] |= twice
        covered = int(mark.sum())
    if n:
        longest = int(np.bincount(codes).max())
    b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = int(b[:128].sum() + b[192:].sum())
    return (
        n, points - sum(int(b[ord(c)]) for c in SPACE), sum(int(b[ord(c)]) for c in SYMBOLS), len(lines) - len(set(lines)), covered,
        int(b[65:91].sum()), int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()), int(b[48:58].sum()), len(code), len(lines), longest,
    )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([statistics(t.as_py()) for t in b.column("text")], np.int64).reshape(-1, len(COUNTS) + len(MORE))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in found.T.copy())], ["doc_id", *COUNTS, *MORE])


def features(x: np.ndarray) -> np.ndarray:
    """Rates that don't depend on a text's length, from the columns COUNTS and MORE."""
    n, chars, symbols, dup, repeat, upper, punct, digits, distinct, lines, longest = x.T.astype(float)
    words, chars, lines = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    return np.stack([chars / words, symbols / words, dup / lines, repeat / words, upper / chars, punct / chars, digits / chars, longest / words], 1)


class Forest(NamedTuple):
    """Trees as arrays of nodes: feature (-1: leaf), threshold, left child (right is next), depth."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    per_tree: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher: fewer splits set the row apart."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, depth in zip(self.feature, self.threshold, self.left, self.depth):
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = rows[inner]
                node = at[go]
                at[go] = left[node] + (x[go, feature[node]] >= threshold[node])
            total += depth[at]
        return 2.0 ** (-total / len(self.feature) / self.per_tree)


def _expected(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    rnd, rows = np.random.default_rng(seed), min(rows, len(x))
    limit = int(np.ceil(np.log2(max(2, rows))))
    out = []
    for _ in range(trees):
        nodes: list[list] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, x[rnd.permutation(len(x))[:rows]], 0)]
        while todo:
            k, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            open_ = np.flatnonzero(high > low)
            if depth >= limit or not len(open_):  # of equal rows none stands alone
                nodes[k] = [-1, 0.0, 0, depth + _expected(len(part))]
                continue
            f = int(rnd.choice(open_))
            cut = high[f] - (high[f] - low[f]) * rnd.random()  # above the least, so that neither side is empty
            if not low[f] < cut <= high[f]:
                cut = high[f]
            nodes[k] = [f, cut, len(nodes), 0.0]
            right = part[:, f] >= cut
            for side in (~right, right):
                todo.append((len(nodes), part[side], depth + 1))
                nodes.append([-1, 0.0, 0, 0.0])
        out.append(nodes)
    size = max(map(len, out))
    cells = np.array([t + [[-1, 0.0, 0, 0.0]] * (size - len(t)) for t in out], float)
    return Forest(cells[..., 0].astype(int), cells[..., 1], cells[..., 2].astype(int), cells[..., 3], _expected(rows))


def threshold(good: np.ndarray, bad: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """good, bad: labelled rows by bin of score. The score from which rows are rejected: of the
    bins that lose at most ``max_loss`` of the good rows those that reject the most bad ones, of
    these those that lose the fewest, and of these the middle; above every score if nothing is labelled bad."""
    if not bad.sum():
        return 2.0
    lost = np.append(good[::-1].cumsum()[::-1], 0)
    caught = np.append(bad[::-1].cumsum()[::-1], 0)
    allowed = lost <= max_loss * good.sum()
    best = allowed & (caught == caught[allowed].max())
    best = np.flatnonzero(best & (lost == lost[best].min()))
    return 2.0 if not caught[best[0]] else float((best[0] + best[-1]) / 2 / BINS)


def judge(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS, max_loss: float = MAX_LOSS) -> DataFrame:
    """One row per row of ``df``: doc_id, COUNTS, base_failed, score and kept.

    labels: doc_id and quality (1 good, 0 bad; a repeated id counts as its least, null ids and
    null labels as none). The forest is grown on at most ``fit_rows`` rows labelled good, picked by
    hash; statistics cover all rows, the threshold all labelled rows that pass the base rules.
    Null text counts as empty and fails the base rules. Without labelled good rows the base rules
    decide alone. Repeated rows are judged alike; an empty table gives no rows.
    """
    text_batches(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    columns = ", ".join(f"{c} long" for c in (*COUNTS, *MORE))
    stats = row_by_row(df, rows.mapInArrow(_statistics, f"doc_id {kind}, {columns}"), "statistics")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good = stats.join(materialise(marks, "marks"), "doc_id").where("quality = 1")
    sample = hash_sample(good, ["doc_id", *COUNTS], fit_rows).select(*COUNTS, *MORE).collect()
    base = stats.withColumn("base_failed", failed)
    if not sample:
        return base.select("doc_id", *COUNTS, "base_failed", F.lit(0.0).alias("score"), (~F.col("base_failed")).alias("kept"))
    forest = df.sparkSession.sparkContext.broadcast(grow(features(np.array(sample, np.int64))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).to_numpy() for c in (*COUNTS, *MORE)], 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *COUNTS, "base_failed")), pa.array(forest.value.score(features(x)))], ["doc_id", *COUNTS, "base_failed", "score"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    scored = row_by_row(df, base.mapInArrow(score, f"doc_id {kind}, {counts}, base_failed boolean, score double"), "scores")
    binned = scored.where("not base_failed").join(marks, "doc_id").groupBy(F.floor(F.col("score") * BINS).alias("bin"), "quality").agg(F.count(F.lit(1)).alias("n"))
    bins = np.zeros((2, BINS + 1))
    for k, quality, n in binned.collect():
        bins[int(quality == 1), k] += n
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < threshold(bins[1], bins[0], max_loss)))
