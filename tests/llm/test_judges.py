"""Personal data, quality and toxicity: exact parts by brute force, learnt parts held out."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import pii, quality, toxicity

SF = "/root/testdata/sf0.01"
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text: str) -> list:
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 16 <= len(digits) <= 19 and luhn) or (k == 3 and 8 <= len(digits) <= 15):
                out.append((k, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("a1.@+ -()é\n0459Z_%"), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(plain_spans(text))


def test_base_spans_on_cards_and_long_runs():
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1111 x 4111111111111112", "1" * 20_000, "a" * 50_000 + "@b.c", "1." * 5000, "+1 (463) 555-2194 or +12", "x@y.z@w.v", "@b.c@d.e", "999.1.1.1 001.2.3.4.5"):
        assert sorted(pii.base_spans(text)) == sorted(plain_spans(text)), text[:40]


def test_personal_data_in_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    secrets = 0
    for r in pii.find(docs).collect():
        text, base = texts[r.doc_id], sorted(plain_spans(texts[r.doc_id]))
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in range(4)]
        assert r.spans.startswith(said)
        more = [x.split(":") for x in r.spans[len(said) :].strip(",").split(",") if x]
        planted = re.findall(r'AKIA[0-9A-Z]{16}|(?<=token = ")[0-9a-f]+|password=[0-9a-f]{12,}', text)
        secrets += len(planted)
        for kind, s, e in more:
            assert kind in pii.ADDED and all(int(e) <= a or int(s) >= b for _, a, b in base)
        if base or planted or not more:
            assert len(more) >= len(planted)
        else:
            raise AssertionError((r.doc_id, [text[int(s) : int(e)] for _, s, e in more]))
    assert secrets > 10


def test_no_pattern_cuts_or_loses_a_long_span():
    digits = " ".join("7" * 60)
    for text, value in (("password=" + "aB3$" * 100, "aB3$" * 100), ("id 8" + "1" * 59, "8" + "1" * 59), (digits, digits), ("x" * 90 + " at mail dot com", None), ("the passphrase is hunter2xyz now", "hunter2xyz"), ("met Anna Maria Kowalska there", "Anna Maria Kowalska")):
        spans = [text[s:e] for _, s, e in pii.candidates(text)]
        assert (value or text) in spans, text[:40]
    long = "q9" * 200
    assert pii.shape_features(long, 0, 0, 400) != pii.shape_features("q9" * 32 + "Q-" * 168, 0, 0, 400)


def test_many_spans_in_one_text_take_no_square_time():
    """5 MB of numbers, and spans kept apart as by comparing each with each."""
    rnd = random.Random(5)
    for _ in range(200):
        spans = [(rnd.randrange(3), s, s + rnd.randint(1, 9)) for s in (rnd.randrange(60) for _ in range(12))]
        others, taken, want = spans[:4], [x[1:] for x in spans[:4]], []
        for k, s, e in sorted(spans[4:], key=lambda x: (x[1] - x[2], x[1], x[0])):
            if all(e <= a or s >= b for a, b in taken):
                want.append((k, s, e))
                taken.append((s, e))
        assert pii.apart(spans[4:], others) == sorted(want)
    text = "\n".join(str(rnd.randrange(10**6, 10**9)) for _ in range(500_000))
    began = time.perf_counter()
    assert len(pii.candidates(text)) > 400_000 and time.perf_counter() - began < 60


def planted(rnd: random.Random, kind: str) -> str:
    d = lambda n: "".join(rnd.choices("0123456789", k=n))
    w = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    return {
        "secret": lambda: rnd.choice([f'token = "{d(6)}{w(14)}{d(6)}"', "AKIA" + "".join(rnd.choices("ABCDEFGHJKLMNP0123456789", k=15)) + "7", f"password={w(5)}{d(4)}{w(3)}"]),
        "number": lambda: rnd.choice([f"ssn {d(3)}-{d(2)}-{d(4)}", f"call ({d(3)}) {d(3)}-{d(4)}", f"phone {d(3)}-{d(3)}-{d(4)}"]),
        "address": lambda: f"{w(6)} at {w(7)} dot {rnd.choice(['com', 'org', 'net'])}",
        "name": lambda: f"Dr. {rnd.choice(sorted(pii.NAMES)).title()} {w(7).title()}",
        "none": lambda: rnd.choice([f"version {d(1)}.{d(2)}.{d(2)}", f"2021-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", f"page {d(3)}", f"table {' '.join(d(3) for _ in range(7))}", w(16), f"{w(4)}: {w(6)}"]),
    }[kind]()


def test_precision_and_recall_of_added_kinds(spark):
    """One planted span a text; others have harmless numbers, dates, versions and words."""
    rnd, rows, want = random.Random(12), [], {}
    for k in range(1200):
        kind = ("secret", "number", "address", "name", "none", "none")[k % 6]
        value = planted(rnd, kind)
        text = " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(12)) + " "
        want[k] = kind, len(text), len(text) + len(value)
        rows.append((k, text + value + " and so on"))
    said = {k: {"hit": 0, "found": 0, "all": 0} for k in pii.ADDED}
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        kind, s, e = want[r.doc_id]
        got = [(x.split(":")[0], int(x.split(":")[1]), int(x.split(":")[2])) for x in r.spans.split(",") if x]
        assert [sum(g[0] == a for g in got) for a in pii.ADDED] == [r[f"n_{a}"] for a in pii.ADDED] and r.n_spans == len(got)
        for g in got:
            if g[0] in said:
                said[g[0]]["found"] += 1
                said[g[0]]["hit"] += g[0] == kind and g[1] < e and s < g[2]
        if kind in said:
            said[kind]["all"] += 1
    for kind, n in said.items():
        recall, precision = n["hit"] / n["all"], n["hit"] / max(1, n["found"])
        print(f"{kind}: recall {recall:.2f}, precision {precision:.2f}")
        assert recall > 0.85 and precision > 0.85, (kind, n)


def test_em_finds_who_is_reliable():
    rnd = np.random.default_rng(0)
    truth = rnd.random(4000) < 0.3
    rates = [(0.9, 0.05), (0.8, 0.1), (0.7, 0.02), (0.5, 0.5)]
    votes = np.stack([np.where(rnd.random(4000) < np.where(truth, a, b), 1, 0) for a, b in rates], 1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, given_, p = pii.reliabilities(patterns, counts.astype(float))
    assert abs(prior - 0.3) < 0.05 and ((p[inverse] > 0.5) == truth).mean() > 0.93
    assert abs(given_[1, 0, 2] - 0.9) < 0.06 and abs(given_[0, 0, 2] - 0.05) < 0.05


EDGE = [(1, None, "x"), (2, "", "x"), (None, "mail a@b.cd and 1.2.3.4", "x"), (3, "say +1 (463) 555-2194", "x"), (3, "say +1 (463) 555-2194", "x"), (4, "w " * 60_000, "x")]


def test_edges_of_the_input(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 1), (None, 0, 1), (4, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    found = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_phone, r.spans) for r in pii.find(df).collect())
    assert found == [(0, 1, 1, 0, "email:5:11,ip:16:23"), (1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 0, 0, 1, "phone:4:21"), (3, 0, 0, 1, "phone:4:21"), (4, 0, 0, 0, "")]
    q = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality.judge(df, labels).collect())
    assert q == [(0, 4, True, False), (1, 0, True, False), (2, 0, True, False), (3, 4, True, False), (3, 4, True, False), (4, 60_000, True, False)]
    t = toxicity.judge(df, labels).collect()
    assert len(t) == 6 and all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in t)
    assert toxicity.without_toxic(df, labels).columns == df.columns
    none = labels.limit(0)
    for f in (lambda d, x: pii.find(d), quality.judge, toxicity.judge, toxicity.without_toxic):
        assert f(df.limit(0), none).count() == 0 and f(df, none).count() == 6


def plain_counts(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\r\x0b#|é€😀"), max_size=80))
def test_rule_counts(text):
    assert quality.statistics(text)[:5] == plain_counts(text)


def test_quality_of_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.judge(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.base_failed == ((got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words))).all() and not (got.kept & got.base_failed).any()
    open_ = got[~got.base_failed]
    assert open_[open_.quality == 1].kept.mean() > 0.98 and open_[open_.quality == 0].kept.mean() < 0.1


def test_quality_on_held_out_labels(spark):
    """Grown and calibrated on the labels of one half by crc32 of the id, judged on the other."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    half = labels.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 2 == 0)
    got = quality.judge(docs, spark.createDataFrame(labels[half])).toPandas().merge(labels[~half], on="doc_id")
    open_ = got[~got.base_failed]
    lost, caught = 1 - open_[open_.quality == 1].kept.mean(), 1 - open_[open_.quality == 0].kept.mean()
    print("held out: good ones lost", lost, "bad ones caught", caught)
    assert len(open_) > 1500 and lost < 0.01 and caught > 0.85


def test_forest_nodes_split_their_own_rows():
    """No side of a split is empty, and rows of a tree end alone or at the depth limit."""
    x = np.random.default_rng(9).normal(0, 1, (300, 3))
    forest = quality.grow(x, trees=5, rows=64)
    for feature, cut, left in zip(forest.feature, forest.threshold, forest.left):
        reached = [np.arange(0)] * len(feature)
        reached[0] = np.arange(300)
        for k in np.flatnonzero(feature >= 0):
            rows = reached[k]
            side = x[rows, feature[k]] >= cut[k]
            reached[left[k]], reached[left[k] + 1] = rows[~side], rows[side]
            assert len(rows[~side]) and len(rows[side])


def test_forest_sets_strangers_apart():
    rnd = np.random.default_rng(4)
    usual = rnd.normal(0, 1, (2000, 3))
    forest = quality.grow(usual)
    far = forest.score(np.array([[6.0, 0, 0], [0, -7.0, 3.0]]))
    assert far.min() > np.quantile(forest.score(usual), 0.98)
    assert quality.threshold(np.array([9.0, 1, 0, 0]), np.array([0, 0, 5.0, 5]), 0.2) * quality.BINS in (1.0, 1.5, 2.0)
    assert quality.threshold(np.zeros(4), np.zeros(4)) > 1


def test_toxicity_on_held_out_documents(spark):
    """Some one in twenty of the documents marked toxic here have none of the words the others have."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.judge(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    print("held out: recall", held[held.toxic == 1].predicted.mean(), "false alarms", held[held.toxic == 0].predicted.mean())
    assert len(held) > 500 and held[held.toxic == 1].predicted.mean() > 0.88 and held[held.toxic == 0].predicted.mean() < 0.02


def test_gradients_are_right():
    """Against finite differences, on a network small enough to nudge."""
    rnd = np.random.default_rng(2)
    net = toxicity.Network(np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rnd.normal(0, 1, (6, toxicity.INPUTS))
    ids = rnd.integers(0, 6, (5, 3))
    mask = (np.arange(5)[:, None] < np.array([5, 3, 2])[None]).astype(float)
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss() -> float:
        tables = {d: x @ net.p[f"W{d}"] + net.p[f"c{d}"] for d in "fb"}
        p = toxicity._sigmoid(net._forward(tables, ids, mask)[0])
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    grads = net.gradients(x, ids, mask, y, w)
    for name in [*net.p, "x"]:
        flat = (x if name == "x" else net.p[name]).reshape(-1)
        for k in rnd.choice(flat.size, min(4, flat.size), replace=False):
            keep = flat[k]
            flat[k] = keep + 1e-3
            up = loss()
            flat[k] = keep - 1e-3
            down = loss()
            flat[k] = keep
            assert np.isclose((up - down) / 2e-3, grads[name].reshape(-1)[k], atol=2e-4, rtol=2e-2), (name, k)


def test_windows_cover_whole_texts():
    doc, first, length = toxicity.windows([0, 3, 64, 65, 200])
    assert doc.tolist() == [1, 2, 3, 3, 4, 4, 4, 4, 4, 4]
    for k, (a, n) in enumerate(zip(np.cumsum([0, 0, 3, 64, 65]), [0, 3, 64, 65, 200])):
        covered = {i for s, m in zip(first[doc == k], length[doc == k]) for i in range(s, s + m)}
        assert covered == set(range(a, a + n))


def test_a_score_does_not_depend_on_neighbours():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(["alpha", "beta", "vile", "gamma"], k=n)) for n in (5, 70, 0, 300, 64)] * 4
    net = toxicity.train(texts, np.array([int(k % 2) for k in range(20)]), epochs=1)
    together = list(net.document_scores(iter(texts)))
    assert np.allclose(together, [next(net.document_scores(iter([t]))) for t in texts], atol=1e-5) and together[2] == 0.0


def test_long_words_reach_the_network_whole():
    """A text without spaces is taken whole, in training and in scoring."""
    word = "".join(chr(0x4E00 + k) for k in range(300))
    cut = toxicity.pieces([b"ab", raw := word.encode()])
    assert cut[0] == b"ab" and cut[1] + b"".join(x[toxicity.LAP :] for x in cut[2:]) == raw and max(map(len, cut)) <= toxicity.PIECE
    words = toxicity.Words()
    clean, other = words.add(word + "x" * 60), words.add(word + "y" * 60)
    assert len(clean) > 1 and clean[0] == other[0] and clean[-1] != other[-1]
    assert toxicity.pieces([b"a" * 60]) == [b"a" * 60] and toxicity.pieces([b"a" * 61]) == [b"a" * 60, b"a" * 13]


def test_a_secret_is_spanned_to_its_end():
    text = "password=" + "aB3$" * 100
    assert (0, 9, len(text)) in [(k, s, e) for k, s, e in pii.candidates(text)] or any(e == len(text) and s == 9 for _, s, e in pii.candidates(text))
