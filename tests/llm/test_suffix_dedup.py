import hashlib
import random

import numpy as np
import pytest

from tablewright.llm import suffix_dedup
from tests.llm.helpers import documents, odd

LENGTH, GRAM = 12, 5


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    met = {}
    for i, b in enumerate(data):
        for s in range(len(b) - length + 1):
            met.setdefault(b[s : s + length], []).append((i, s))
    lost = [np.zeros(len(b), dtype=bool) for b in data]
    for places in met.values():
        if len(places) > 1:
            for i, s in places:
                lost[i][s : s + length] = True
    out = []
    for b, gone in zip(data, lost):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, rows, **clash):
    got = suffix_dedup.removed(documents(spark, rows, **clash), LENGTH, GRAM)
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()]
    want = [(row[0], *p) for row, p in zip(rows, plain([r[1] for r in rows], LENGTH))]
    assert sorted(found, key=str) == sorted(want, key=str)


def made(seed, count):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé") for _ in range(rng.randint(8, 40))) for _ in range(6)]
    pieces = lambda: [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))]
    return [(i, "".join(pieces()), "en", "a") for i in range(count)]


@pytest.mark.parametrize("busy", [10_000, 2])
def test_against_brute_force(spark, monkeypatch, busy):
    monkeypatch.setattr(suffix_dedup, "RUN_STRETCHES", busy)
    rows = made(1, 120) + odd("ab" * 300 + "x" * 200)
    compare(spark, rows, clash=("t1", "starts", "run"))


def test_empty_and_clean(spark):
    compare(spark, [])
    compare(spark, [(1, "nothing here is twice", "en", "a")])


def test_texts_without_repeats(spark):
    rows = [(1, "left once 0123456789abcdef", "en", "a"), (2, "0123456789abcdef right é", "en", "a"), (3, None, "en", "a")]
    kept = {r.doc_id: r.text for r in suffix_dedup.without_repeats(documents(spark, rows), LENGTH, GRAM).collect()}
    assert kept == {1: "left once ", 2: " right é", 3: None}


def test_blocks_change_no_window(monkeypatch):
    data = np.frombuffer(("abcabd" * 40 + "xyz" * 30 + "q" * 100).encode(), dtype=np.uint8)
    owner = lambda: {
        s: int(run) for part in suffix_dedup.stretches(data, LENGTH, GRAM) for a, b, run in zip(*part) for s in range(a, b + 1)
    }
    whole = owner()
    monkeypatch.setattr(suffix_dedup, "BLOCK", 37)
    assert owner() == whole and len(whole) == len(data) - LENGTH + 1


def test_family_levels():
    rng = np.random.default_rng(4)
    family, every = suffix_dedup.Family(), []
    for _ in range(40):
        batch = rng.integers(0, 3_000, 50, dtype=np.uint64)
        family.add(batch)
        every.append(batch)
    every = np.concatenate(every)
    values, counts = np.unique(every, return_counts=True)
    twice = np.isin(every, values[counts > 1])
    assert (np.concatenate(family.twice) == twice).all()
    assert len(family.levels) <= 7 and sum(len(k) for k, _ in family.levels) == len(every)
