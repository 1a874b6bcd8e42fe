"""Byte-pair counts against another library over the same vocabulary."""

import base64
import random

import pytest

from tablewright.functions import text
from tablewright.functions.text import bpe_token_count
from tablewright.plans.evaluation_queries import e9_bpe_tokens
from tests.conftest import SF

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_given_documents(spark, codec):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.tokens for r in e9_bpe_tokens(spark, SF).collect()}
    assert got == {i: None if t is None else len(codec.encode_ordinary(t)) for i, t in texts.items()}


def test_odd_texts(spark, codec):
    texts = [None, "", " ", "<|endoftext|> a", "é 漢字 🙂", "ab\n\n  c" * 500, "x" * 3000, "twice", "twice"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    rows = df.select("i", bpe_token_count(df["t"], P.path("byte_bpe_50k.json")).alias("n")).collect()
    want = {i: None if t is None else len(codec.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert {r.i: r.n for r in rows} == want
    assert df.limit(0).select(bpe_token_count(df["t"], P.path("byte_bpe_50k.json"))).collect() == []


def test_tokens_held_at_once_are_bounded(codec, monkeypatch):
    class Counted:
        most = 0

        def encode(self, piece, add_special_tokens):
            self.most = max(self.most, len(piece))
            return codec.encode_ordinary(piece)

    monkeypatch.setattr(text, "BLOCK_CHARS", 40)
    monkeypatch.setattr(text, "KEPT_PIECES", 30)
    rng, counted = random.Random(1), Counted()
    pieces = text.PieceCounts(counted)
    # every kind of white space, and marks that only look like it
    letters = " \t\n\r\f\v\x85\xa0\u1680\u2003\u2028\u202f\u3000\x1c\x1f\u180e\u200bab1!'sé漢."
    for size in [0, 1, 2, 5, 9] * 200 + [40, 41, 80, 400] * 20:
        t = "".join(rng.choices(letters, k=size))
        assert pieces.of(t) == len(codec.encode_ordinary(t))
        assert len(pieces) <= 30
    assert pieces.of("some words " * 900) == len(codec.encode_ordinary("some words " * 900))
    assert counted.most < 80
    assert pieces.of("x" * 300) == len(codec.encode_ordinary("x" * 300)) and not any(len(p) > text.KEPT_CHARS for p in pieces)
