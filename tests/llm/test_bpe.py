import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from tablewright.llm import bpe
from tests.conftest import SF
from tests.llm.helpers import documents, odd

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Library.from_file(PATH)
TRICKY = [
    "", "   ", "<|endoftext|>a<|startoftext|><|endoftext", "ΑΣ ΟΔΥΣΣΕΥΣ İstanbul straße ǅ", "don't I'LL we'Ve it's's",
    "日本語 12345 ½ Ⅷ x²", "aaaaaaaaaaaaaaaaaaaa" * 4, "a\x1cb\x85c d", "</w> <w> </W>x", "é ạ̈ 한글", "😀👩‍👩‍👧 !!!???...",
    "\x00\x01\x7f", "abc" * 3000, "!?" * 2000,
]


def check(text, packed, decoded):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert decoded == LIBRARY.decode(ids, skip_special_tokens=False).encode()


@pytest.mark.parametrize("text", TRICKY)
def test_tricky_texts(text):
    coder = bpe.tokenizer(PATH)
    packed = coder.encode(text)
    check(text, packed, b"".join(coder.decode(packed)))


def test_blocks_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(bpe, "BLOCK_IDS", 7)
    text = "Some words, a longword" + "x" * 90 + " and the rest of it. " * 20
    coder = bpe.tokenizer(PATH)
    packed = coder.encode(text)
    check(text, packed, b"".join(coder.decode(packed)))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bpe.encode(docs, PATH, keep_text=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check(texts[r.doc_id], bytes(r.ids), r.decoded.encode())
        assert r.n_tokens == len(r.ids) // 4 and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_odd_rows(spark):
    rows = bpe.encode(documents(spark, odd(), clash=("n_tokens", "ids")), PATH).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(r[0] or 0 for r in odd())
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1: 0, 2: 0, 3: 0}
    assert bpe.encode(documents(spark, []), PATH).count() == 0
