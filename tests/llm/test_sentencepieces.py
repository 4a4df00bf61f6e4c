"""Encoding and decoding against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymill.llm import sentencepieces as s

from . import data

ODD = [*"abTheingo  \n\t▁.,é漢😀\x00\x7f\x85　​<s>0123", "  ", "    ", "</s>", "<0x0A>", "\r\n", "ﬁ", "é", "﻿", "�", "aa"]


@pytest.fixture(scope="module")
def pieces():
    return s.Pieces(s.model_path(), cached=50)


def ids(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u4")


def told(pieces, text: str) -> list[int]:
    return pieces.library.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD) | st.characters(exclude_categories=["Cs"]), max_size=40).map("".join))
def test_as_the_library(pieces, text):
    got = ids(pieces.encode(text))
    assert got.tolist() == told(pieces, text)
    assert pieces.decode(got) == pieces.library.decode(got.tolist())
    pieces.check()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 258) | st.integers(259, 31999) | st.sampled_from([0, 1, 2, 29871, 259]), max_size=10))
def test_decoding_any_ids(pieces, given_ids):
    assert pieces.decode(np.array(given_ids, np.int64)) == pieces.library.decode(given_ids)


def test_long_texts(pieces):
    for text in ("abc" * 30_000, " " * 5000 + "x", "word " * 20_000, "\n" * 3000):
        got = ids(pieces.encode(text))
        assert got.tolist() == told(pieces, text) and pieces.decode(got) == text
    pieces.check()


def test_whole_texts_where_stretches_may_meet(pieces):
    whole = s.Pieces(s.model_path())
    whole.stretches = None
    for _, text in data.rows():
        assert whole.encode(text or "") == pieces.encode(text or "")
    whole.check()


def test_a_difference_is_an_error(pieces):
    wrong = s.Pieces(s.model_path())
    wrong.scores = {p: -x for p, x in wrong.scores.items()}
    wrong.encode("several ordinary words")
    with pytest.raises(ValueError, match="merge-type"):
        wrong.check()


def test_query_on_awkward_rows(spark, pieces, tmp_path):
    rows = data.rows()
    folder = data.table(spark, rows, tmp_path)
    got = sorted(map(tuple, s.op12_sentencepiece(spark, folder).collect()), key=str)
    want = []
    for doc_id, text in rows:
        own = told(pieces, text or "")
        decoded = pieces.library.decode(own)
        want.append((doc_id, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_operator_and_empty_table(spark):
    docs = data.frame(spark, data.rows())
    back = s.decode(s.encode(docs))
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(i, (t or "").replace("▁", " ")) for i, t in data.rows()], key=str)
    assert s.round_trip(data.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id int, ids binary")
    assert s.decode(nothing).collect() == [(1, "")]
