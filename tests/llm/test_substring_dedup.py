"""Substring deduplication against brute force and on planted passages."""

import random

import numpy as np
import pytest

from waymark.llm import substring_dedup as sd


def words(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 8))) for _ in range(n)]


def near(a: list[str], b: list[str]) -> bool:
    """Word edit distance of at most EDITS, or one's last words are the other's first; plain dynamic programming."""
    if a[sd.EDITS :] == b[: -sd.EDITS] or b[sd.EDITS :] == a[: -sd.EDITS]:
        return True
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > sd.EDITS:
            return False
    return row[-1] <= sd.EDITS


def change(rnd: random.Random, w: list[str], n: int) -> list[str]:
    """n edits at different places: a word replaced, dropped or put in."""
    w = [*w]
    for at in sorted(rnd.sample(range(len(w)), n), reverse=True):
        new = "".join(rnd.choices("klmnop", k=6))
        w[at : at + 1] = rnd.choice([[new], [new], [new], [], [w[at], new]])
    return w


def paragraphs(texts: list[str]) -> dict[int, list[str]]:
    """The words of each class."""
    doc, start, found = sd.cut_texts(texts)
    split = [t.split() for t in texts]
    return {c: split[d][s : s + sd.SPAN] for c, d, s in zip(sd.classes_of(found).tolist(), doc, start)}


@pytest.mark.parametrize("pairs", [sd.PAIRS, 2])
def test_links_connect_what_brute_force_connects(spark, pairs):
    rnd = random.Random(4)
    base = [words(rnd, 60) for _ in range(3)]
    held = paragraphs([" ".join(change(rnd, rnd.choice(base), rnd.randint(0, 3))) for _ in range(150)])
    codes = sd.packed(np.array([[sd.xxhash.xxh64_intdigest(x.encode()) >> 44 for x in w] for w in held.values()])).tolist()
    classes = spark.createDataFrame([(c, *w) for c, w in zip(held, codes)], "class long, " + ", ".join(f"{w} long" for w in sd.WORDS))
    links = {tuple(r) for r in sd.class_links(classes, pairs).collect()}
    parent = {c: c for c in held}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = list(held)
    want = {(a, b) for i, a in enumerate(every) for b in every[:i] if near(held[a], held[b])}
    assert len(want) > 200
    for a, b in links:
        parent[root(a)] = root(b)
    assert sum(root(a) == root(b) for a, b in want) >= 0.98 * len(want)
    assert all(near(held[a], held[b]) for a, b in links)


def test_remainders_are_shared_by_near_copies_alone():
    """Left to itself, the way for large buckets finds exactly the near copies."""
    rnd = random.Random(14)
    base = [words(rnd, sd.SPAN + 4) for _ in range(2)]
    texts = [change(rnd, rnd.choice(base), rnd.randint(0, 4)) for _ in range(160)]
    texts = [w[k : k + sd.SPAN] for w, k in ((w, rnd.randint(0, 3)) for w in texts) if len(w) >= sd.SPAN + k]
    texts = [list(x) for x in dict.fromkeys(map(tuple, texts))]
    codes = np.array([[sd.xxhash.xxh64_intdigest(x.encode()) >> 44 for x in w] for w in texts], np.uint32)
    five = sd._shingles(codes)
    held = {}
    for k, row in enumerate(five.tolist()):
        for x in row:
            held.setdefault(x, set()).add(k)
    lone = np.array([sum(1 << i for i, x in enumerate(row) if len(held[x]) == 1) for row in five.tolist()], np.int64)
    shared = {}
    for k, h in zip(*(x.tolist() for x in sd.remainders(codes, lone))):
        shared.setdefault(h, set()).add(k)
    got = {(a, b) for g in shared.values() for a in g for b in g if a < b}
    want = {(a, b) for b in range(len(texts)) for a in range(b) if near(texts[a], texts[b])}
    assert got == want and len(want) > 100


def test_planted_passages(spark):
    """51 words in the middle of different texts are found in both; other texts are left alone."""
    rnd = random.Random(8)
    passages = [words(rnd, 51) for _ in range(20)]
    rows = []
    for k, p in enumerate(passages):
        for side in (0, 1):
            rows.append((100 * side + k, " ".join(words(rnd, rnd.randint(0, 90)) + p + words(rnd, rnd.randint(0, 90)))))
    rows += [(1000 + k, " ".join(words(rnd, 200))) for k in range(30)]
    rows += [(2000 + k, " ".join(words(rnd, 60) + ["license", "line", "of", "few", "words"] * 2)) for k in range(30)]
    got = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.removed) for r in got} == {(k, k, False) for k in range(20)} | {(100 + k, k, True) for k in range(20)}
    texts = dict(rows)
    for r in got:  # a near copy may have up to EDITS other words at its end, and one that begins EDITS words on as many more
        inside = texts[r.doc_id].split()[r.start_word : r.end_word - 2 * sd.EDITS]
        assert " ".join(inside) in " ".join(passages[r.keep_id])


def test_edges_of_the_input(spark):
    text = " ".join(words(random.Random(2), 70))
    rows = [(5, text, "c"), (5, text, "c"), (None, "x " + text, "c"), (7, None, "c"), (8, "", "c"), (9, "w " * 60_000, "c"), (10, "w " * 60_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cluster string")
    got = sd.repeated_passages(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.removed) for r in got) == [(False, 5, True), (False, 5, True), (False, 9, False), (False, 10, True), (True, 0, False)]
    assert {(r.start_word, r.end_word > 59_980) for r in got if (r.doc_id or 0) > 8} == {(0, True)}
    assert sd.repeated_passages(df.limit(0)).count() == 0


def test_cutting_does_not_depend_on_neighbours():
    rnd = random.Random(6)
    texts = ["", " ".join(words(rnd, 26)), "a b", " ".join(words(rnd, 27)), " ".join(words(rnd, 400)), "w " * 300, " ".join(words(rnd, 51))]
    doc, start, found = sd.cut_texts(texts)
    for k, t in enumerate(texts):
        _, s, f = sd.cut_texts([t])
        assert (s == start[doc == k]).all() and (f == found[doc == k]).all()
    assert {1, 3, 4, 5, 6} >= set(doc.tolist()) >= {4, 5, 6} and (doc == 5).sum() < 30 and [x for _, c in sd.chunks(texts, 50) for x in c] == texts


def edited(rnd: random.Random, n: int, size: int, edits: int) -> list[tuple[int, str]]:
    """Passages in two texts each, the second time with words changed, dropped or put in."""
    rows = []
    for k in range(n):
        p = words(rnd, size)
        rows += [(1000 * side + k, " ".join(words(rnd, rnd.randint(0, 60)) + x + words(rnd, rnd.randint(0, 60)))) for side, x in enumerate((p, change(rnd, p, edits)))]
    return rows


def test_edited_passages(spark):
    """Passages of 60 to 120 words with 1, 2 and 3 edits: found against their own source, and by words."""
    rnd, rows, clean = random.Random(22), [], 40
    for edits in (1, 2, 3):
        for size in (60, 120):
            rows += [(i + 100_000 * edits + 10_000 * (size // 60), t) for i, t in edited(rnd, 40, size, edits)]
    rows += [(900_000 + k, " ".join(words(rnd, 200))) for k in range(clean)]
    got = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.doc_id < 900_000 for r in got)
    assert all(r.keep_id == r.doc_id - r.doc_id % 10_000 + r.doc_id % 1000 for r in got)
    for edits in (1, 2, 3):
        for size in (60, 120):
            low = 100_000 * edits + 10_000 * (size // 60)
            mine = [r for r in got if low + 1000 <= r.doc_id < low + 2000 and r.removed]
            share = len({r.doc_id for r in mine}) / 40
            by_word = sum(r.end_word - r.start_word for r in mine) / (40 * size)
            print(f"{edits} edits in {size} words: passages {share:.2f}, words {by_word:.2f}")
            assert share >= (0.9 if edits < 3 or size > 60 else 0.8)


def test_words_have_the_codes_of_the_library():
    """Codes worked out for all words at once are those of xxhash, whatever a word's length, place and neighbours."""
    rnd = random.Random(31)
    text = "".join("".join(rnd.choices("abyz09é-", k=rnd.randint(1, 70))) + rnd.choice([" ", "\n", " \t ", "\x0b", "\r\n\x0c", "  "]) for _ in range(900))
    for raw in (text.encode(), b"\n" + text.encode() + b"x", b"a", b"a" * 40, b"", b" \n "):
        split = raw.split()
        begins, codes = sd.word_codes(raw, 100)
        assert [raw[b : b + len(x)] for b, x in zip(begins.tolist(), split)] == split and len(begins) == len(split)
        assert codes.tolist() == [sd.xxhash.xxh64_intdigest(x) >> 44 for x in split]


def test_thinned_remainders_hold_the_same_classes_together():
    rng = np.random.default_rng(12)
    classes, rests = rng.integers(300, size=4000), rng.integers(900, size=4000).astype(np.uint64)
    classes[:2500], rests[:2500] = rng.integers(30, size=2500), rng.integers(400, size=2500).astype(np.uint64)

    def parts(pairs):
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for c, r in pairs:
            parent[root(("c", c))] = root(("r", r))
        held = {}
        for x in [*parent]:
            held.setdefault(root(x), set()).add(x)
        return {frozenset(x) for x in held.values()}

    every = list(zip(classes.tolist(), rests.tolist()))
    few = list(zip(*(x.tolist() for x in sd.thinned(classes, rests))))
    assert set(few) <= set(every) and len(few) < 0.6 * len(every)
    assert parts(few) == parts(every)
    assert [len(x) for x in sd.thinned(classes[:0], rests[:0])] == [0, 0]


def test_a_filter_takes_one_job(spark):
    """Blocks of a filter came in a job for each partition; hundreds of partitions took minutes."""
    held = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    tracker = spark.sparkContext.statusTracker()
    try:
        spark.sparkContext.setJobGroup("filter", "filter")
        bits, log2 = sd.repeated_cells(spark.range(400_000).selectExpr("xxhash64(id div 2)"), 400_000)
        jobs = len(tracker.getJobIdsForGroup("filter"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name, value in held.items():
            spark.conf.set(name, value)
    assert log2 == 22 and 150_000 < np.unpackbits(bits).sum() <= 200_000 and jobs < 5
