"""Exact copies and repeated lines against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from waymark.llm import exact_dedup, line_dedup

SCHEMA = "doc_id long, text string, sha string"


def copies(rows) -> list:
    by = defaultdict(list)
    for k, (d, t, _) in enumerate(rows):
        by[t or ""].append((d is not None, d or 0, k))
    out = []
    for t, g in by.items():
        top = max(g)
        keep = top[1] if top[0] else None
        for n, (known, d, k) in enumerate(sorted(g)):
            out.append((str(d if known else None), str(keep), len(g), n == len(g) - 1, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 40, 3000])
def test_copies(spark, n):
    rnd = random.Random(n)
    rows = [(k if k % 11 else None, rnd.choice(["hot", "hot", None, "", f"t{rnd.randrange(50)}", f"only {k}"]), "x") for k in range(n)]
    rows += [(5, "again", "x"), (5, "again", "x"), (6, "z" * 200_000, "x")] if n else []
    df = spark.createDataFrame(rows, SCHEMA).repartition(3) if n else spark.createDataFrame([], SCHEMA)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(df).collect())
    assert got == copies(rows)
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t, _ in rows}
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((x[1], texts[x[4]]) for x in got if x[3])


def test_the_filter_passes_every_repeat(spark):
    rnd = np.random.default_rng(1)
    keys = rnd.integers(-(2**63), 2**63 - 1, 5000)
    keys = np.concatenate([keys, keys[:300]])
    df = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(4)
    bits, log2 = exact_dedup.repeated_cells(df, len(keys))
    rows = df.select("key", exact_dedup.maybe_repeated(spark, bits, log2)("key").alias("m")).collect()
    passed = [r.key for r in rows if r.m]
    assert {int(k) for k in keys[:300]} <= set(passed) and len(passed) < 600 + 0.3 * len(keys)


def lines_kept(rows) -> list:
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for k, (d, t, _) in enumerate(rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add((d is not None, d or 0, k))
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(held[key(x)]) < 5 or max(held[key(x)])[:2] == (d is not None, d or 0)]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("n", [0, 3, 60, 800])
def test_lines(spark, n):
    rnd = random.Random(n)
    pool = [f"{'é' if k % 2 else 'E'}line {k} " + "word " * 9 for k in range(30)]
    rows = []
    for k in range(n):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 6))] + ["the line that nearly all documents have, in full"] * (k % 3 > 0) + [f"own {k}"]
        lines = [x.upper() if rnd.random() < 0.2 and x.isascii() else f"\t {x}\r" if rnd.random() < 0.2 else x for x in lines]
        rows.append((k if k % 13 else None, "\n".join(lines), "x"))
    rows += [(900, rows[1][1], "x"), (900, rows[1][1], "x"), (901, None, "x"), (902, "", "x"), (903, "\n\n" + "y" * 300_000, "x")] if n else []
    df = spark.createDataFrame(rows, SCHEMA).repartition(4) if n else spark.createDataFrame([], SCHEMA)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.kept_lines(df).collect())
    assert got == lines_kept(rows)


def test_streams_agree_however_rows_are_cut(spark):
    """A key may span many batches and tasks."""
    import pyarrow as pa

    rnd = random.Random(9)
    rows = sorted((rnd.choice([1, 1, 1, 2, 3, 4, 5, 6]), 0, -rnd.randrange(60), 0, k) for k in range(300))
    names = ["h1", "h2", "doc", *line_dedup.ROW, "n_lines", "lines"]
    batch = lambda part: pa.RecordBatch.from_arrays([*(pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([-x[2] for x in part], pa.int64()), pa.array([x[3] for x in part], pa.int64()), pa.array([x[4] for x in part], pa.int64())), pa.array([1] * len(part), pa.int32()), pa.array([b""] * len(part))], names)
    whole = {}
    for x in rows:
        whole.setdefault(x[0], []).append(x)
    want = {x[4] for g in whole.values() if len(g) >= 5 for x in g if x[2] != g[0][2]}
    for tasks in (1, 2, 7, 40):
        edges = sorted(rnd.sample(range(1, 300), tasks - 1))
        gone, waiting, total = set(), [], defaultdict(lambda: [0, -1])
        for a, b in zip([0, *edges], [*edges, 300]):
            cuts = sorted({a, b, *(rnd.randrange(a, b) for _ in range(4))})
            for out in line_dedup._stream(5)(batch(rows[i:j]) for i, j in zip(cuts, cuts[1:])):
                for r in out.to_pylist():
                    if r["kind"] == line_dedup._GONE:
                        gone.add(r[line_dedup.ROW[1]])
                    elif r["kind"] == line_dedup._WAITS:
                        waiting.append(r)
                    else:
                        t = total[r["h1"]]
                        t[0], t[1] = t[0] + r["docs"], max(t[1], r["doc"])
        gone |= {r[line_dedup.ROW[1]] for r in waiting if total[r["h1"]][0] >= 5 and r["doc"] != total[r["h1"]][1]}
        assert gone == want


def test_bitmaps_are_small(spark):
    line = "a line of boilerplate that is longer than forty characters"
    df = spark.createDataFrame([(k, "\n".join([f"own {k}"] * 50 + [line]), "") for k in range(9)], SCHEMA)
    maps = line_dedup.keep_bitmaps(df).collect()
    assert len(maps) == 8 and all(np.unpackbits(np.frombuffer(zlib.decompress(m.keep), np.uint8), count=51).tolist() == [1] * 50 + [0] for m in maps)


def test_cells_are_told_a_bounded_number_at_a_time():
    """a task held all its hashes at once."""
    import pyarrow as pa

    rnd, read = np.random.default_rng(3), []
    keys = rnd.integers(1 << 40, size=(50, 100))
    keys[1::2, :30] = keys[::2, :30]

    def batches():
        for k in keys:
            read.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(k)], ["key"])

    hits: dict[int, int] = defaultdict(int)
    for n, b in enumerate(exact_dedup.cells_seen(20, 300)(batches())):
        assert n or len(read) == 3
        for block, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for low in np.frombuffer(cells, np.uint16).tolist():
                hits[block << 16 | low] += 1
    every = np.unique(keys.ravel() & (1 << 20) - 1, return_counts=True)
    assert len(read) == 50 and {c for c, n in hits.items() if n > 1} == set(every[0][every[1] > 1].tolist()) and set(hits) == set(every[0].tolist())


def test_cells_hit_once_or_more(spark):
    keys = [int(k) for k in np.random.default_rng(4).integers(1 << 62, size=500)]
    bits, log2 = exact_dedup.repeated_cells(spark.createDataFrame([(k,) for k in keys], "k long"), len(keys), least=1)
    assert int(np.unpackbits(bits).sum()) == len({k & (1 << log2) - 1 for k in keys})


def test_line_dedup_writes_no_scratch_tables(spark, tmp_path, monkeypatch):
    """Each scratch file makes the executor start a process that shows its memory twice."""
    import pandas as pd

    from waymark.llm import _common

    pd.DataFrame({"doc_id": range(8), "text": ["x" * 50 + "\n" + str(i) for i in range(8)]}).to_parquet(tmp_path / "d.parquet")
    monkeypatch.setattr(_common, "materialise", lambda *a: pytest.fail("a scratch table"))
    got = {r.doc_id: r.n_dropped for r in line_dedup.kept_lines(spark.read.parquet(str(tmp_path / "d.parquet"))).collect()}
    assert got == {i: int(i < 7) for i in range(8)}
