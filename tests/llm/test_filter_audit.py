import random
import re
from itertools import permutations

import numpy as np
import pytest

from tablewright.llm import filter_audit as A
from tests.llm.helpers import documents, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fails(rows):
    """Per row the letters that it fails."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows),
        }
        out.append({k for k, v in fails.items() if v})
    return out


def plain_audit(rows, labels):
    """Apply every order to every document, one filter after the other."""
    fails = plain_fails(rows)
    parts = [r[3] or "" for r in rows]
    good = [any(q == 1 for i, q, _ in labels if i == r[0] and i is not None) for r in rows]
    toxic = [any(t == 1 for i, _, t in labels if i == r[0] and i is not None) for r in rows]
    out, shapley = {}, {}
    for part in set(parts):
        for order in map("".join, permutations("ABCDE")):
            left = [k for k, p in enumerate(parts) if p == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [k for k in left if f in fails[k]]
                redundant = sum(f in fails[k] for k in gone)
                left, gone = [k for k in left if f not in fails[k]], gone + hit
                alone = sum(fails[k] == {f} for k, p in enumerate(parts) if p == part)
                out[part, order, step] = [len(left), len(hit), redundant, alone, sum(good[k] for k in hit), sum(toxic[k] for k in hit)]
                shapley[part, f] = shapley.get((part, f), 0) + len(hit)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", A.F.lit("x"))


def audited(spark, rows, labels, clash=()):
    got = A.audit(A.class_counts(documents(spark, rows, clash), frame(spark, labels))).collect()
    return {(r.part, r.filter_order, r.step): tuple(r[k] for k in A.FIGURES) for r in got}


def test_min_plus_against_loops():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 9, (4, 3)).astype(float), draw.integers(0, 9, (3, 5)).astype(float)
    a[a > 6] = np.inf
    want = [[min(a[i, k] + b[k, j] for k in range(3)) for j in range(5)] for i in range(4)]
    assert np.array_equal(A.min_plus(a, b), want)


def test_ranks_of_an_order():
    orders = A.Orders()
    at = orders.names.index("CADBE")
    assert orders.ranks(np.array([0, 0b00010, 0b10001, 0b00101]))[:, at].tolist() == [5, 3, 1, 0]


@pytest.mark.parametrize("seed", range(2))
def test_against_filters_applied_one_by_one(spark, seed):
    draw = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "delta", "EPS", "zeta|", "eta", "theta"] + [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(draw.choices(words[: draw.choice([3, 30, 68])], k=draw.choice([5, 55, 80]))), "en", draw.choice("ab")) for i in range(60)]
    rows += [(200 + i, draw.choice(rows)[1], "en", draw.choice(["a", None])) for i in range(40)]
    labels = [(r[0], draw.randrange(2), draw.randrange(2)) for r in rows if draw.random() < 0.6]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_odd_rows(spark):
    rows = odd() + [(None, "no id at all", "en", "a"), (9, "", "en", ""), (6, None, "en", None)]
    labels = [(1, None, 1), (4, 1, 0), (4, 0, 1), (None, 1, 1), (6, 1, None)]
    got = audited(spark, rows, labels, clash=("part", "mask", "digest", "n", "first", "good", "quality", "toxic"))
    assert got == plain_audit(rows, labels)


def test_empty_tables(spark):
    rows = [(1, "a b", "en", "s")]
    assert audited(spark, rows, [])["s", "ABCDE", 1][:2] == (0, 1)
    docs = documents(spark, rows)
    assert A.audit(A.class_counts(docs.limit(0), frame(spark, [(1, 1, 1)]))).count() == 0
