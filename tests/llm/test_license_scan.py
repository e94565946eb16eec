"""License scans against brute force over all windows."""

from waymark.llm import license_scan as ls


def brute(text: str, words: list[str]) -> bool:
    """Whether some stretch of a template's length has 0.8 of its shingles."""
    own = ls.words_of(text or "")
    sh = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    need, have = set(sh(words)), sh(own)
    n = len(need)
    return any(len(need & set(have[i : i + n])) >= 0.8 * n for i in range(max(0, len(have) - n) + 1)) if have else False


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.template) for r in ls.scan(docs).collect()}
    want = {(r.doc_id, name) for r in docs.collect() for name, t in ls.TEMPLATES.items() if brute(r.text, ls.words_of(t))}
    assert want and got == want


def test_edges_of_the_input(spark):
    mit = ls.TEMPLATES["mit"].split()
    edited = " ".join(w if i % 40 != 20 else "EDITED" for i, w in enumerate(mit))
    rows = [
        (1, "x y " + ls.TEMPLATES["mit"].upper() + " tail " + ls.TEMPLATES["mit-notice"], "h"), (2, edited, "h"), (3, " ".join(mit[:40]), "h"),
        (None, "w " * 30_000 + ls.TEMPLATES["cc-by-nc-notice"] + " w" * 30_000, "h"), (4, None, "h"), (5, "", "h"), (6, ls.TEMPLATES["gpl-notice"], "h"), (6, ls.TEMPLATES["gpl-notice"], "h"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted(((r.doc_id or 0, r.template, r.start_word) for r in ls.scan(df).collect()))
    assert got == [(0, "cc-by-nc-notice", 30_000), (1, "mit", 2), (1, "mit-notice", len(ls.words_of(rows[0][1])) - 5), (2, "mit", 0), (6, "gpl-notice", 0), (6, "gpl-notice", 0)]
    assert ls.scan(df.limit(0)).count() == 0
