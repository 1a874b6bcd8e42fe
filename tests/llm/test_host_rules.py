import random
import re

import pytest

from tablewright.llm import host_rules as H
from tests.llm.helpers import documents, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The measures word by word."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines, dup = lines + 1, dup + (line in seen)
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, dup, len(covered))


@pytest.mark.parametrize("seed", range(30))
def test_measures_against_plain_ones(seed):
    draw = random.Random(seed)
    text = "".join(draw.choice(["a", "b", "é", " ", " ", "\n", "\t", "|", "#", " ", "漢", "\x0b"]) for _ in range(draw.randrange(200)))
    assert H.measured(text) == plain(text)


def test_odd_rows(spark):
    docs = documents(spark, odd(), clash=("host", "rows", "rejected", "n_words", "kept", "of"))
    got = sorted(H.judged(docs).collect(), key=str)
    assert len(got) == len(odd())
    by_id = {(r.doc_id, r.host): r for r in got}
    for doc_id, text, _, source in odd():
        r = by_id[doc_id, source]
        assert tuple(r[m] for m in H.MEASURES) == (plain(text) if len(text or "") < 1000 else (30_000, 120_000, 0, 1, 0, 30_000))
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert r.kept == (not r.base_failed and not r.host_rejected)
    assert H.judged(docs.limit(0)).count() == 0


def clean(i):
    return " ".join(f"word{i}x{k}" for k in range(60))


def test_hosts_of_junk_go_and_small_or_clean_ones_stay(spark):
    rows = [(i, clean(i), "en", f"good{i % 8}") for i in range(400)]
    rows += [(1000 + i, clean(i) if i % 5 == 0 else "too few", "en", "bad") for i in range(100)]
    rows += [(2000, "too few", "en", "small"), (2001, clean(1), "en", "small"), (3000, clean(2), "en", None)]
    got = {r.doc_id: r for r in H.judged(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _, source in rows:
        assert got[doc_id].host_rejected == (source == "bad")
        assert got[doc_id].kept == (source != "bad" and text != "too few")


def test_shrinkage_against_plain_figures(spark):
    rows = [(i, clean(i) if (i * 7) % 10 > i % 4 else "few", "en", f"h{i % 4}") for i in range(400)] + [(999, "few", "en", "tiny")]
    marked = H.measures(documents(spark, rows)).cache()
    got = {r.host: r for r in H.host_rates(marked).where("rule = 'few_words'").collect()}
    n, f = {}, {}
    for _, text, _, host in rows:
        n[host], f[host] = n.get(host, 0) + 1, f.get(host, 0) + (text == "few")
    rate = {h: f[h] / n[h] for h in n}
    mean = sum(rate.values()) / len(rate)
    spread = sum((r - mean) ** 2 for r in rate.values()) / len(rate)
    between = spread - mean * (1 - mean) * sum(1 / x for x in n.values()) / len(n)
    assert between > 0
    weight = mean * (1 - mean) / between - 1
    for h in n:
        assert got[h].shrunk == pytest.approx((f[h] + mean * weight) / (n[h] + weight))
    assert rate["tiny"] == 1 and got["tiny"].shrunk < 1


def test_hot_and_light_hosts_meet_their_verdicts(spark):
    rows = [(i, clean(1) if i % 3 else "few", "en", "hot" if i % 2 else f"h{i}") for i in range(1200)]
    docs = documents(spark, rows)
    verdicts = H.host_verdicts(H.measures(docs))
    assert H.with_verdicts(H.measures(docs), verdicts).groupBy("host").count().count() == 601
    assert H.judged(docs).count() == 1200
