"""Packing: every token once, windows gapless, counts as a tokenizer gives them."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from waymark.llm import packing


def check(docs: list[tuple], rows: list, window: int) -> int:
    """Round trip of all pieces; returns the padding."""
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += window - at
    assert sorted(by_seq) == list(range(len(by_seq)))
    return padding


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    rows = packing.pack(docs).collect()
    assert check([(r.doc_id, r.text) for r in docs.collect()], rows, 1024) < 1024
    assert len(rows) < 2.2 * 1000 + sum(r.doc_tokens // 1024 for r in {r.doc_id: r for r in rows}.values())


@pytest.mark.parametrize("text", ["a b c", "<|endoftext|> special <|endoftext|>", "é" * 700, " \n\t"])
def test_one_hot_length(spark, text):
    docs = [(i, text) for i in range(300)] + [(300, None), (301, ""), (302, "x " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert check(docs, packing.pack(df, window=64).collect(), 64) < 64


def test_edges_of_the_input(spark):
    df = spark.createDataFrame([(None, "a b", "x"), (1, "a b", "y"), (1, "a b", "y")], "doc_id long, text string, tail string")
    rows = packing.pack(df).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert packing.pack(df.limit(0)).count() == 0


def test_plan_uses_no_length_more_than_it_occurs():
    rnd = np.random.default_rng(3)
    for h in (rnd.integers(0, 50, 1024), np.eye(1024, dtype=int)[700] * 999, np.zeros(1024, int)):
        h[0] = 0
        p = packing.plan(h)
        per = np.bincount(p.length, p.until - p.since, 1024).astype(int) if len(p.length) else np.zeros(1024, int)
        assert (per == p.rest_since).all() and (per <= h).all()
    assert packing.plan(rnd.integers(90, 110, 1024)).templates > 0.95 * 100 * 1023 / 2.6 / 1.2


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text(st.sampled_from("ab' \n\t1.,!éß€😀"), max_size=200))
def test_ranks_give_the_tokenizers_ids(text):
    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert ENCODER(text).tolist() == [*want, 0]


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"), 0)


def test_long_words_and_special_strings():
    for text in ("x" * 5000, "é" * 3000, "<|endoftext|>", "a<|endoftext|>b <|endoftext|", "﻿​", "😀" * 500, "1" * 999):
        assert ENCODER(text).tolist() == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 0]
