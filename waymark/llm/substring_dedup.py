"""Substring deduplication: MinHash banding over content-anchored paragraphs.

A repeated passage can begin anywhere in a line, so paragraphs are cut where the text itself says
so: of every ``SPREAD`` five-word shingles in a row the one with the least hash is an anchor, and
the ``SPAN`` words from it are a paragraph. Any passage of SPREAD + SPAN + 1 = 51 words or more
has a whole paragraph inside it, cut in the same place in every document.

Equal paragraphs are one class. Two classes are near copies if their word edit distance is
``EDITS`` = 2 or less (a similarity of 24 / 26 = 0.92), or if the last 24 words of one are the
first 24 of the other; every pair whose five-word shingles have a Jaccard similarity of 0.8 or
more (20 of 22 in common) is among these, and so is a pair with one or two words changed, which
leave a Jaccard similarity of 0.63 and 0.38.

Candidates come from ``BANDS`` = 6 bands of one MinHash over the shingles, at about the same place
in both paragraphs; anchors are no part of a key. A pair with a word changed in its middle collides
with a probability of 1 - (1 - 0.63) ** 6 = 0.997, one with two words far apart changed with 0.94.
A Bloom filter (two cells a key) of keys held by two rows or more lets paragraphs go that nothing can collide with.
Buckets of up to ``PAIRS`` classes are paired and verified. The classes of larger buckets are sent
to what is left of them without two words instead: two paragraphs are near copies exactly if they
share one of these remainders, so that nothing grows with the square of a bucket. A shingle that
only one such class has must be hit by the words left out, which leaves few remainders. Classes
linked by either way are clustered by connected components, and of each cluster the document with
the least id keeps its copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import ROW, discard, lookup, materialise, row_by_row, text_batches, text_of, with_row_key
from waymark.llm.components import connected_components
from waymark.llm.exact_dedup import AT_ONCE, in_filter, maybe_repeated, repeated_cells

SHINGLE, SPREAD, SPAN = 5, 24, 26
BAG = SPAN - SHINGLE + 1
EDITS = 2
BANDS = 6
#: A key tells the place of its shingle in steps of so many words, every other band's half a step on.
STEP = 8
PAIRS = 32
#: Remainders of a class of a large bucket, about.
REMAINDERS = 128
#: Characters of text that are cut at once; a longer text is cut whole.
CHUNK = 1_000_000
#: Characters of text for each paragraph, about; the filter's size follows from it, up to a power of two.
CHARS, MAX_LOG2 = 80, 29
#: Columns that hold a paragraph's word codes, three in each.
WORDS = [f"w{k}" for k in range(-(-SPAN // 3))]
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
#: The primes of XXH64, which is worked out here for all short words at once.
_P = [np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_ODD = np.random.default_rng(5).integers(1 << 63, size=BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _shingles(w: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE words along the last axis; w: word codes."""
    n = w.shape[-1] - SHINGLE + 1
    out = w[..., :n].astype(np.uint64)
    for k in range(1, SHINGLE):
        out = _mix(out) + w[..., k : n + k].astype(np.uint64)
    return _mix(out)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _xxh64(text: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 of stretches of ``text``, behind which 8 more bytes lie."""
    one, two, three, four, five = _P
    n = len(text)
    eights, fours = (np.ndarray(n - k + 1, f"<u{k}", text, strides=1) for k in (8, 4))
    every = np.frombuffer(text, np.uint8)
    h = size.astype(np.uint64) + five
    for k in range(3):
        at = np.flatnonzero(size >= 8 * k + 8)
        h[at] = _turned(h[at] ^ _turned(eights[begin[at] + 8 * k] * two, 31) * one, 27) * one + four
    done = size & ~7
    at = np.flatnonzero(size & 4)
    h[at] = _turned(h[at] ^ fours[begin[at] + done[at]].astype(np.uint64) * one, 23) * two + three
    done = size & ~3
    for k in range(3):
        at = np.flatnonzero(size & 3 > k)
        h[at] = _turned(h[at] ^ every[begin[at] + done[at] + k].astype(np.uint64) * five, 11) * one
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(size > 31):
        h[k] = xxhash.xxh64_intdigest(text[begin[k] : begin[k] + size[k]])
    return h


def word_codes(text: bytes, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``text`` begin and their codes, the first 20 bits of XXH64, so many at once."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.concatenate([[True], space]) != np.concatenate([space, [True]]))
    begin, size = edges[::2], edges[1::2] - edges[::2]
    codes, text = np.zeros(len(begin), np.uint32), text + bytes(8)
    for k in range(0, len(begin), at_once):
        codes[k : k + at_once] = _xxh64(text, begin[k : k + at_once], size[k : k + at_once]) >> np.uint64(44)
    return begin, codes


def _runs(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of the ``n`` values from each place. A column lies in one piece, so that what is done to
    short rows runs along the columns."""
    return values[at + np.arange(n)[:, None]].T


def cut_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The paragraphs of texts: the text's number, the start word, and SPAN word codes of 20 bits
    (one row each). Words are separated by ASCII white space; A-Z are lower-cased."""
    return _cut(texts)[:3]


def _cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``cut_texts``, and the BAG shingles of each paragraph."""
    split = [t.encode("utf-8", "surrogatepass") for t in texts]
    begins, w = word_codes(b" ".join(split).lower())
    upto = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in split]))
    sizes = np.diff(upto, prepend=0)
    total = len(w)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, SPAN), np.uint32), np.zeros((0, BAG), np.uint64)
    if total < SPAN:
        return none
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(total) - (np.cumsum(sizes) - sizes)[doc]
    left = sizes[doc] - place
    n = total - SHINGLE + 1
    shingles = _shingles(w)
    # The least of SPREAD in a row: hashes with their place in the low bits, ties to the first.
    bits = np.uint64(max(24, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (shingles & ~low) | np.arange(n, dtype=np.uint64)
    least[left[:n] < SHINGLE] = ~np.uint64(0)
    widths = {1: least}
    for k in (1, 2, 4, 8):
        widths[2 * k] = np.minimum(widths[k][:-k], widths[k][k:]) if len(widths[k]) > k else widths[k][:0]
    found = []
    if len(widths[8]) > 16:
        runs = np.minimum(widths[16][: len(widths[8]) - 16], widths[8][16:])
        least = (runs[left[: len(runs)] >= SPREAD + SHINGLE - 1] & low).astype(np.int64)
        found.append(least[np.concatenate([[True], least[1:] != least[:-1]])[: len(least)]])
    for k in np.flatnonzero((sizes >= SPAN) & (sizes < SPREAD + SHINGLE - 1)):
        first = int(sizes[:k].sum())
        found.append(np.array([first + int(shingles[first : first + sizes[k] - SHINGLE + 1].argmin())]))
    anchors = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    anchors = anchors[left[anchors] >= SPAN]
    if not len(anchors):
        return none
    # Where a few words come over and over, one equal paragraph follows another: every so often is enough.
    own, start = doc[anchors], place[anchors]
    equal = np.concatenate([[False], (own[1:] == own[:-1]) & (shingles[anchors[1:]] == shingles[anchors[:-1]])])
    at = np.flatnonzero(equal)
    equal[at] = (_runs(w, anchors[at], SPAN) == _runs(w, anchors[at - 1], SPAN)).all(1)
    since = (start - start[~equal][np.cumsum(~equal) - 1]) // (SPREAD // 2)
    kept = ~equal | (since != np.concatenate([[-1], since[:-1]]))
    return own[kept], start[kept], _runs(w, anchors[kept], SPAN), _runs(shingles, anchors[kept], BAG)


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about ``size`` characters, each with the number of its first."""
    at = begin = total = 0
    for at, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield begin, texts[begin : at + 1]
            begin, total = at + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def _sequence(words: np.ndarray, first: int = 0) -> np.ndarray:
    """Hashes of words at places ``first`` and on, which add up to the hash of a sequence."""
    places = np.arange(first, first + words.shape[1], dtype=np.uint64) << np.uint64(32)
    return _mix(_mix(words.astype(np.uint64) + places) + _A)


def packed(words: np.ndarray) -> np.ndarray:
    """Rows of word codes as rows of as many integers as WORDS has."""
    w = np.zeros((len(words), 3 * len(WORDS)), np.int64)
    w[:, :SPAN] = words
    return w[:, 0::3] << 40 | w[:, 1::3] << 20 | w[:, 2::3]


def _words_in(b: pa.RecordBatch) -> np.ndarray:
    """The word codes in a batch's columns WORDS; a column lies in one piece, as in ``_runs``."""
    found = np.empty((3 * len(WORDS), b.num_rows), np.uint32)
    for k, c in enumerate(WORDS):
        three = b.column(c).to_numpy()
        found[3 * k], found[3 * k + 1], found[3 * k + 2] = three >> 40, three >> 20 & 0xFFFFF, three & 0xFFFFF
    return found[:SPAN].T


def classes_of(words: np.ndarray) -> np.ndarray:
    """Of rows of word codes: the class, a hash of the paragraph."""
    return _mix(_sequence(words).sum(1)).view(np.int64)


def band_keys(bags: np.ndarray) -> np.ndarray:
    """Of rows of the shingles of paragraphs: BANDS keys, each a MinHash of the shingles with its rough place."""
    keys = np.zeros((len(bags), BANDS), np.uint64)
    if len(bags):
        five, places = np.uint64(5), np.arange(BAG, dtype=np.uint64)
        for k in range(BANDS):
            least = bags * _ODD[k]
            least &= ~np.uint64(31)
            least |= places
            least = least.min(1)
            step = ((least & np.uint64(31)) + np.uint64(STEP // 2 * (k % 2))) // np.uint64(STEP)
            keys[:, k] = _mix(_mix(least >> five) + np.uint64(k * 32) + step)
    return keys


def _cells(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key; it is held by two rows only if the filter's cells of both were hit twice."""
    return keys, _mix(keys ^ _B)


def _all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Both hashes of the band keys of paragraphs, each once for each row."""
    for b in batches:
        for _, texts in chunks(b.column("text").to_pylist()):
            doc, _, _, bags = _cut(texts)
            keys = band_keys(bags)
            own = keys ^ _mix(doc.astype(np.uint64) + np.uint64(1))[:, None]
            yield from _cells(keys.ravel()[np.unique(own, return_index=True)[1]])


def _suspects(seen, log2: int, with_words: bool):
    """The paragraphs of which some key may be in more than one row. A task gives a class's words
    once only, and again when it has seen very many classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = seen.value, set()
        for b in batches:
            for begin, texts in chunks(b.column("text").to_pylist()):
                doc, start, words, bags = _cut(texts)
                one, two = (in_filter(bits, log2, x) for x in _cells(band_keys(bags)))
                hit = (one & two).any(1)
                if hit.any():
                    classes = classes_of(words[hit])
                    rows = b.select(["doc_id", *ROW]).take(pa.array(doc[hit] + begin))
                    columns, names = [pa.array(start[hit].astype(np.int32)), pa.array(classes)], ["doc_id", *ROW, "start", "class"]
                    if with_words:
                        if len(sent) > 100_000:
                            sent.clear()
                        said = np.array([c in sent or bool(sent.add(c)) for c in classes.tolist()])
                        columns, names = [*columns, *(pa.array(w, mask=said) for w in packed(words[hit]).T.copy())], [*names, *WORDS]
                    yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names)

    return run


def sketches(words: np.ndarray) -> np.ndarray:
    """Of rows of word codes: 64 bits, one for each word. Near copies differ in 2 * EDITS of them at most."""
    return np.bitwise_or.reduce(np.uint64(1) << (words & np.uint32(63)).astype(np.uint64), 1).view(np.int64)


def _class_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The band keys of classes."""
    for b in batches:
        yield band_keys(_shingles(_words_in(b))).ravel()


def _keys(seen, log2: int):
    """seen: the cells of keys hit twice; the rows of keys whose cell was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seen.value
        for b in batches:
            words = _words_in(b)
            keys = band_keys(_shingles(words)).ravel()
            at = np.flatnonzero(in_filter(bits, log2, keys))
            each = [x[at // BANDS] for x in (b.column("class").to_numpy(), sketches(words))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, each), pa.array(keys[at].view(np.int64))], ["class", "sketch", "key"])

    return run


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs as strings of a character for each word, so that Spark's edit distance counts words."""
    for b in batches:
        every = (_words_in(b) + np.uint32(0x10000)).astype("<u4").tobytes().decode("utf-32-le")
        yield pa.RecordBatch.from_arrays([b.column("class"), pa.array([every[i : i + SPAN] for i in range(0, len(every), SPAN)], pa.string())], ["class", "letters"])


def _shingles_in(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        yield _shingles(_words_in(b)).ravel()


_PAIRS_OF_PLACES = np.array(list(combinations(range(SPAN), EDITS)))
_HIT = np.array([sum(1 << k for k in range(max(0, i - SHINGLE + 1), min(BAG, i + 1))) for i in range(SPAN)], np.int64)


def remainders(words: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of word codes: the number of the row and a hash, for each way to leave words out that
    hits all ``lone`` shingles (a bit for each): two words of any place, their places kept; one word,
    the rest moved up (a near copy may have a word more, in a gap that is hit as well); the first
    two or last two words."""
    out = []
    with np.errstate(over="ignore"):
        h = _sequence(words)
        total = h.sum(1)
        one, two = _PAIRS_OF_PLACES.T
        ok = (lone[:, None] & ~(_HIT[one] | _HIT[two])[None, :]) == 0
        row, pair = np.nonzero(ok)
        marks = _mix(np.arange(len(one), dtype=np.uint64) + np.uint64(7))
        out.append((row, total[row] - h[row, one[pair]] - h[row, two[pair]] + marks[pair]))
        moved = _sequence(words[:, 1:])
        before = np.concatenate([np.zeros((len(words), 1), np.uint64), h.cumsum(1)[:, :-1]], 1)
        after = np.concatenate([moved[:, ::-1].cumsum(1)[:, ::-1], np.zeros((len(words), 1), np.uint64)], 1)
        rest = lone[:, None] & ~_HIT[None, :]
        lowest = rest & -rest
        row, place = np.nonzero(rest < lowest * (1 << (SHINGLE - 1)) + (rest == 0))
        out.append((row, before[row, place] + after[row, place] + _A))
        every = np.arange(len(words))
        out.append((np.concatenate([every, every]), np.concatenate([h[:, :-EDITS].sum(1), _sequence(words[:, EDITS:]).sum(1)]) + _B))
    return np.concatenate([r for r, _ in out]), np.concatenate([s for _, s in out])


def _remainders(shared, log2: int):
    """shared: the cells of shingles hit twice; a shingle whose cell was hit once is one class's alone.
    Makes pairs of classes and remainders, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bits = shared.value
        for b in batches:
            if b.num_rows:
                words = _words_in(b)
                alone = ~in_filter(bits, log2, _shingles(words))
                row, rest = remainders(words, (alone.astype(np.int64) << np.arange(BAG)).sum(1))
                yield b.column("class").to_numpy()[row], _mix(rest)

    return run


def thinned(classes: np.ndarray, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of a class and a remainder as few as hold the same classes together, each remainder among
    them: every remainder with its least class, and one of those that tie the same two classes."""
    order = np.lexsort((classes, rests))
    classes, rests = classes[order], rests[order]
    first = np.concatenate([[True], rests[1:] != rests[:-1]])[: len(rests)]
    least = classes[np.flatnonzero(first)[np.cumsum(first) - 1]]
    order = np.lexsort((classes, least))
    other = np.concatenate([[True], (classes[order][1:] != classes[order][:-1]) | (least[order][1:] != least[order][:-1])])[: len(rests)]
    kept = first.copy()
    kept[order[other]] = True
    classes, rests = classes[kept], rests[kept]
    order = np.argsort(classes, kind="stable")  # a class's rows together take less space in a shuffle
    return classes[order], rests[order]


def _shared_remainders(made, seen, log2: int, at_once: int = AT_ONCE):
    """The pairs that ``made`` makes of which the remainder's cell was hit twice, thinned so many at a time."""

    def said(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        classes, rests = thinned(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(classes), pa.array(rests.view(np.int64))], ["class", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, parts, n = seen.value, [], 0
        for classes, rests in made(batches):
            hit = in_filter(bits, log2, rests)
            parts.append((classes[hit], rests[hit]))
            n += int(hit.sum())
            if n >= at_once:
                yield said(parts)
                parts, n = [], 0
        if n:
            yield said(parts)

    return run


def near(a: Column, b: Column) -> Column:
    """Whether two paragraphs, as letters, are near copies."""
    short = SPAN - EDITS
    shifted = (F.substring(a, EDITS + 1, short) == F.substring(b, 1, short)) | (F.substring(b, EDITS + 1, short) == F.substring(a, 1, short))
    return (F.levenshtein(a, b, EDITS) >= 0) | shifted


def _among(classes: DataFrame, some: DataFrame, n: int) -> DataFrame:
    """The classes that are in ``some`` (column class, ``n`` rows at most), and a few others: those that
    a filter lets through, so that the words of all the rest are not shuffled."""
    return classes.where(maybe_repeated(classes.sparkSession, *repeated_cells(some.select("class"), n, max_log2=MAX_LOG2, least=1))("class"))


def class_links(classes: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """classes: class (unique) and WORDS. Links a, b whose components are those of all near copies that collide."""
    spark = classes.sparkSession
    words = classes.select("class", *WORDS)
    bits, log2 = repeated_cells(words, BANDS * max(1, classes.count()), max_log2=MAX_LOG2, of=_class_keys)
    seen = spark.sparkContext.broadcast(bits)
    some = materialise(words.mapInArrow(_keys(seen, log2), "class long, sketch long, key long"), "keys")
    seen.unpersist()
    discard(spark)
    buckets = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(lookup(some, buckets, "key", "n", max(1, some.count())).where("n is not null"), "members")
    discard(spark, some)
    few = members.where(F.col("n") <= pairs)
    alike = F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch"))) <= 2 * EDITS
    close = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.class") < F.col("b.class")) & alike)
    close = materialise(close.select(F.col("a.class").alias("a"), F.col("b.class").alias("b")).distinct(), "close")
    discard(spark)
    those = close.select(F.explode(F.array("a", "b")).alias("class"))
    letters = _among(classes, those, 2 * close.count()).select("class", *WORDS).mapInArrow(_letters, "class long, letters string")
    paired = close
    for side in "ab":
        paired = paired.join(letters.select(F.col("class").alias(side), F.col("letters").alias(f"of_{side}")), side)
    paired = materialise(paired.where(near(F.col("of_a"), F.col("of_b"))).select("a", "b"), "paired")
    crowded = members.where(F.col("n") > pairs).select("class")
    large = materialise(_among(classes, crowded, crowded.count()).select("class", *WORDS).join(crowded.distinct(), "class", "left_semi"), "large")
    discard(spark, members, close)
    n = max(1, large.count())
    bits, log2 = repeated_cells(large, BAG * n, max_log2=MAX_LOG2, of=_shingles_in)
    made = _remainders(spark.sparkContext.broadcast(bits), log2)
    # Most remainders are one class's alone; a filter lets them go before anything leaves the task.
    bits, log2 = repeated_cells(large, REMAINDERS * n, max_log2=MAX_LOG2, of=lambda batches: (rest for _, rest in made(batches)))
    rests = large.mapInArrow(_shared_remainders(made, spark.sparkContext.broadcast(bits), log2), "class long, rest long")
    least = rests.withColumn("least", F.min("class").over(Window.partitionBy("rest"))).where("class <> least")
    return paired.unionByName(least.select(F.col("least").alias("a"), F.col("class").alias("b")).distinct())


def repeated_passages(df: DataFrame, text: str = "text", doc_id: str = "doc_id", pairs: int = PAIRS) -> DataFrame:
    """One row per passage that repeats across rows of ``df``: doc_id, start_word, end_word
    (exclusive), cluster, n_copies, keep_id, removed.

    A passage is a run of overlapping repeated paragraphs with the same keep_id: the least id among
    the rows that hold its cluster (null below all others), which keeps its copy (removed false).
    cluster is the least cluster of its paragraphs, n_copies how often the most frequent of its clusters occurs.
    Texts under SPAN words (null and empty too) have no paragraphs; of repeated rows all keep or
    lose alike; an empty table gives no rows.
    """
    spark = df.sparkSession
    text_batches(spark)
    keyed = with_row_key(df)
    kind = df.schema[doc_id].dataType.simpleString()
    rows = keyed.select(F.col(doc_id).alias("doc_id"), *ROW, text_of(text).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits, log2 = repeated_cells(rows.select("text"), max(1, BANDS * size // CHARS), max_log2=MAX_LOG2, of=_all_keys)
    discard(spark)
    seen = spark.sparkContext.broadcast(bits)
    place = f"doc_id {kind}, {ROW[0]} long, {ROW[1]} long, start int, class long"
    cut = rows.mapInArrow(_suspects(seen, log2, True), f"{place}, {', '.join(f'{w} long' for w in WORDS)}")
    row = F.xxhash64(*ROW)
    least = [F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("unnamed"), F.min(row).alias("r0"), F.max(row).alias("r1")]
    classes = materialise(cut.groupBy("class").agg(*least, *(F.max(w).alias(w) for w in WORDS)), "classes")
    discard(spark)
    # Texts are cut once more for the places: paragraphs with their words would take a disk's space beside the classes' shuffle.
    placed = row_by_row(rows, rows.mapInArrow(_suspects(seen, log2, False), place), "places")
    n_placed = max(1, placed.count())
    seen.unpersist()
    others = connected_components(class_links(classes, pairs))
    nodes = others.unionByName(others.select(F.col("root").alias("node"), "root").distinct())
    known = classes.drop(*WORDS).join(nodes.withColumnRenamed("node", "class"), "class", "left").withColumn("cluster", F.coalesce("root", "class")).where("root is not null or r0 <> r1")
    known = materialise(known, "known")
    discard(spark, classes, others)
    clusters = known.groupBy("cluster").agg(F.min("id").alias("id"), F.max("unnamed").alias("unnamed"), F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.sum("n").alias("n_copies")).where("r0 <> r1")
    clusters = clusters.select("cluster", "n_copies", F.when(~F.col("unnamed"), F.col("id")).alias("keep_id"))
    known = known.select("class", "n", "cluster", (F.col("r0") == F.col("r1")).alias("alone")).join(clusters, "cluster")
    placed = lookup(placed, known, "class", "n", n_placed).where("cluster is not null")
    # A paragraph that is like others but equal to none may differ from them in its last words.
    placed = placed.withColumn("end", F.col("start") + SPAN - F.when(F.col("alone"), EDITS).otherwise(0))
    by = [*ROW, "keep_id"]
    order = Window.partitionBy(*by).orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")
    runs = placed.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order)).groupBy("doc_id", *by, "run")
    passages = runs.agg(F.min("start").cast("long").alias("start_word"), F.max("end").cast("long").alias("end_word"), F.min("cluster").alias("cluster"), F.max("n_copies").alias("n_copies"))
    return passages.select("doc_id", "start_word", "end_word", "cluster", "n_copies", "keep_id", (~F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("removed"))
