import random
import re

import numpy as np

from tablewright.llm import pii
from tests.llm.helpers import documents, odd

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PARTS = ["@", "a", "b.", "-", "+1", " ", "(", "1", "23.", "4", "4111111111111111", "x@y.z", "1.2.3.4", ")", "_", "%", "é", "٣", "0"]


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 22)))
        assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "a." * 150_000 + "@"):
        pii.base_spans(text)
        pii.candidates(text[:20_000])


def test_trees_learn():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(2000, 4))
    labels = ((rows[:, 0] > 0) & (rows[:, 2] < 0.5)).astype(float)
    trees = pii.Trees().fit(rows[:1500], labels[:1500])
    assert ((trees.chance(rows[1500:]) > 0.5) == labels[1500:]).mean() > 0.95


def test_detector_adds_near_misses_and_leaves_clean_texts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    def card(valid):
        while True:
            number = "".join(rng.choice("0123456789") for _ in range(16))
            if pii.luhn(number) == valid:
                return number
    rows = []
    for i in range(300):
        item = [f"mail {word()}.{i}@mail.example.com", f"{word()} {card(True)} {word()}", f"+1 (377) 555-0{i:03d}", f"from 10.2.{i % 250}.7",
                f"version {i}{i % 7}01 of id={word()}12345{i:04d}x", f"{word()} {word()}"][i % 6]
        rows.append((i, f"{word()} {item} {word()}", "en", "a"))
    rows += [(1000, f"{word()} {card(False)} {word()}", "en", "a"), (1001, "Published in 1999, 12 of 34 pages.", "en", "a")]
    docs = documents(spark, rows, clash=("spans", "kind", "label"))
    detector = pii.fit(docs)
    found = {r.doc_id: r for r in pii.detect(docs, detector).collect()}
    assert found[1000].n_card == 0 and found[1000].spans.startswith("card:")
    assert found[1001].spans == ""
    for i, text, _, _ in rows[:300]:
        assert set(pii.spelled(plain(text)).split(",")) <= set(found[i].spans.split(","))
    clean = {r.doc_id: r.text for r in pii.redacted(docs, detector).collect()}
    assert "[CARD]" in clean[1] and "@" not in clean[0] and clean[1001] == rows[-1][1]


def test_odd_rows(spark):
    docs = documents(spark, odd())
    detector = pii.fit(docs)
    rows = pii.detect(docs, detector).collect()
    assert len(rows) == len(odd()) and {r.spans for r in rows} == {""}
    assert {r.doc_id: r.text for r in pii.redacted(docs, detector).collect()}[1] is None
    assert pii.detect(docs.limit(0), pii.fit(docs.limit(0))).count() == 0
