import random
import re
import zlib
from collections import Counter

import pytest

from tablewright.llm import pivotal_grams as P
from tests.llm.helpers import documents, odd


def one_edit(a, b):
    """One code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    met = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            met[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in met.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def vocabulary(seed, size=250):
    draw = random.Random(seed)
    made = set()
    while len(made) < size:
        word = "".join(draw.choice("abcé") for _ in range(draw.randrange(5, 9)))
        made.add(word)
        at = draw.randrange(len(word))
        made.add(draw.choice([word[:at] + word[at + 1 :], word[:at] + "b" + word[at:], word[:at] + "c" + word[at + 1 :]]))
    return {w: draw.choice([3, 4, 6, 13, 30, 100]) for w in sorted(made) if len(w) >= 5}


@pytest.mark.parametrize("seed", range(3))
def test_groups_against_all_pairs(spark, seed):
    counts = vocabulary(seed)
    found = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert {tuple(r) for r in P.grouped(found).collect()} == plain_variants(counts)


def test_words_that_repeat_a_letter(spark):
    counts = {"aaaaa": 9, "aaaaaa": 4, "aaaaaaa": 3, "aaaab": 50, "baaaa": 50, "ababa": 3, "babab": 3, "ababab": 7}
    found = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in P.grouped(found).collect()} == plain_variants(counts)


def test_texts_against_plain_words(spark):
    draw = random.Random(5)
    base = [w for w in vocabulary(7, 80)]
    rows = [(i, " ".join(draw.choices(base, k=60)).title() + ", x1y Straße ÀÉÎ", "en", "s") for i in range(40)]
    rows += odd("Colour colours " * 3_000) + [(7, "Colour " * 4, "en", None)] * 3
    docs = documents(spark, rows, clash=("word", "n", "form", "root"))
    counts = plain_words(rows)
    assert {tuple(r) for r in P.words(docs).collect()} == set(counts.items())
    assert {tuple(r) for r in P.variants(docs).collect()} == plain_variants(counts)


def test_long_path_of_forms(spark):
    counts = {"abcde" + "f" * k: 3 * 2**k for k in range(14)}
    found = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: r for r in P.grouped(found).collect()}
    assert {r.root for r in got.values()} == {"abcde" + "f" * 13}
    assert got["abcde"].form == "abcdef"


def test_pivots_are_apart_and_rarest():
    counts = {"ab": 5, "bc": 1, "cd": 2, "de": 9, "ef": 4}
    every, first = P.prefix("abcdef", counts)
    assert first == [1, 2, 4] and P.pivots("abcdef", first, counts) == [1, 4]
    assert every == first
    with pytest.raises(ValueError, match="no 2 bigrams apart"):
        P.pivots("abc", [0, 1], {"ab": 1, "bc": 1})


def test_nothing(spark):
    assert P.variants(documents(spark, [(1, "a b c", "en", "s"), (2, None, None, None)])).count() == 0
    assert P.variants(documents(spark, [(1, "a b c", "en", "s")]).limit(0)).count() == 0
