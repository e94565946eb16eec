"""The pipeline against brute force, stage by stage."""

import corpus_pipeline
from tests.llm import test_mixing, test_simhash
from waymark.llm import simhash, toxicity


def near_copies(rows: list, n: int) -> list:
    """Rows with a word changed so that one or two bits of the fingerprint differ."""
    out = []
    for r in sorted(rows, key=lambda r: (len(r.text), r.doc_id))[-n:]:
        words, own = r.text.split(" "), simhash.fingerprint(r.text)
        for k in range(len(words)):
            text = " ".join([*words[:k], "changed", *words[k + 1 :]])
            if 0 < (simhash.fingerprint(text) ^ own).bit_count() <= 2:
                out.append((10**6 + r.doc_id, text, r.lang, r.source, len(text)))
                break
    return out


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = near_copies([r for r in docs.collect() if r.lang == "en"], 20)
    assert len(more) > 5
    docs = corpus_pipeline.materialise(docs.unionByName(spark.createDataFrame(more, docs.schema)), "docs")
    net = toxicity.fit(docs, labels)
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        nonlocal docs
        docs = corpus_pipeline.materialise(stages[name](spark, docs, sf), "test")
        return docs.collect()

    rows = docs.collect()
    clean = [r for r, s in zip(rows, net.document_scores(r.text for r in rows)) if s < 0.5]
    assert sorted(run("toxicity")) == sorted(clean) and len(clean) < len(rows)
    last = {r.text: r for r in sorted(clean)}
    assert sorted(run("exact dedup")) == sorted(last.values()) and len(last) < len(clean)
    rows = sorted(last.values())
    part = test_simhash.brute([simhash.fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    kept = [r for r, c in zip(rows, part) if r.doc_id == c]
    assert sorted(run("near dedup")) == kept and len(kept) < len(rows)
    want = test_mixing.brute([(r.doc_id, r.text, r.source) for r in kept])
    mixed = run("mixing")
    for d, size, _, taken in want:
        assert sum(str(r.doc_id) == d for r in mixed) == (taken // size if size else 0)
    pieces = stages["packing"](spark, docs, sf).collect()
    once = {r.doc_id: r for r in mixed}
    assert sum(p.length for p in pieces) == sum(next(p.doc_tokens for p in pieces if p.doc_id == d) * sum(r.doc_id == d for r in mixed) for d in once)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, toxicity double, first string, cluster long, size string"


def through(spark, docs, sf: str = "/root/testdata/sf0.001") -> dict:
    """The rows after each stage."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), "test")
        assert name == "packing" or docs.columns == columns
        out[name] = docs.collect()
    return out


def test_nulls_repeats_one_source_and_clashing_columns(spark):
    """Texts that differ a lot, all from one source, between null, empty, repeated and very long ones."""
    words = ["".join(chr(97 + (k * 7 + i * i * 3 + i * k) % 26) for i in range(6)) for k in range(400)]
    texts = [" ".join(words[(k * 13 + i * (k + 3)) % 400] for i in range(60)) for k in range(12)]
    more = (9, 0.5, "x", 7, "s")
    rows = [(k, t, "en", "hot", 1, *more) for k, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "hot", 1, *more)] * 2 + [(None, texts[1], "en", "hot", 1, *more), (None, "only " + texts[2][::-1], None, None, None, *(None,) * 5)]
    rows += [(200, None, "en", "hot", 1, *more), (201, "", None, "hot", 1, *more), (202, "long " * 40_000, "en", "hot", 1, *more)]
    got = through(spark, spark.createDataFrame(rows, SCHEMA))
    assert len(got["toxicity"]) == len(rows)
    exact = got["exact dedup"]
    assert len(exact) == len({r.text or "" for r in got["toxicity"]}) and sum(r.doc_id == 100 for r in exact) == 1 and not any(r.doc_id == 0 for r in exact)
    assert {r.doc_id for r in exact if r.text == texts[1]} == {1} and {r.doc_id for r in exact if not r.text} == {201}
    near = got["near dedup"]
    assert {r.doc_id for r in near} <= {r.doc_id for r in exact} and sum(r.doc_id is None for r in near) == 1
    assert {r.text for r in got["mixing"]} <= {r.text for r in near} and all(r.text for r in got["mixing"])
    total = sum(len((r.text or "").split()) for r in near)
    assert abs(sum(len(r.text.split()) for r in got["mixing"]) - total) <= 40_001
    assert sum(p.length for p in got["packing"]) > 0 and {p.doc_id for p in got["packing"]} == {r.doc_id for r in got["mixing"]}


def test_no_documents(spark):
    got = through(spark, spark.createDataFrame([], SCHEMA))
    assert all(not rows for rows in got.values())
