import random
import re

import pytest

from tablewright.llm import minhash, simhash
from tests.conftest import SF
from tests.llm.helpers import documents
from tests.llm.test_simhash import same_groups


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts, least=0.8):
    sets = [plain_shingles(t) for t in texts]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b or len(a & b) >= least * len(a | b) > 0) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    groups = plain_groups([t for _, t in texts])
    kept = sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect())
    assert kept == [texts[g][0] for g in sorted(set(groups))]


def test_lightly_edited_copies_go(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base), "en", "a")]
    # each changed word changes five of 296 shingles: 291 / 301 and so on down to 0.8 and below it
    for n, changed in enumerate((1, 3, 6, 7, 20), 2):
        rows.append((n, " ".join(f"x{n}{i}" if i % 15 == 7 and i < 15 * changed else w for i, w in enumerate(base)), "en", "a"))
    groups = plain_groups([r[1] for r in rows])
    kept = sorted(r.doc_id for r in simhash.one_of_each_group(documents(spark, rows)).collect())
    assert kept == [rows[g][0] for g in sorted(set(groups))] == [1, 5, 6]


def test_chains_in_one_bucket_are_followed(spark):
    # neighbours are similar, texts further apart are not, and all share most of their shingles
    words = [f"w{i}" for i in range(400)]
    rows = [(n, " ".join(words[20 * n : 20 * n + 250]), "en", "a") for n in range(8)]
    assert [r.doc_id for r in simhash.one_of_each_group(documents(spark, rows)).collect()] == [0]
    groups = {r.node: r.component for r in minhash.similar_groups(documents(spark, rows)).collect()}
    assert len(groups) == 8 and same_groups(list(groups.values()), plain_groups([r[1] for r in rows]))


def test_only_the_chosen_rows_stay_written(spark):
    import os

    from tablewright.session import shared_dir

    there = lambda: set(os.listdir(shared_dir(spark).removeprefix("file://") + "/tablewright"))
    docs = documents(spark, [(i, f"one text of some words {i % 3}", "en", "a") for i in range(6)])
    simhash.one_of_each_group(docs).collect()
    before = there()
    assert sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect()) == [0, 1, 2]
    assert [name.split("-")[0] for name in there() - before] == ["chosen"]


def test_repeated_and_null_ids_leave_one_row(spark):
    text, other = "one text of some words here", "quite another text of words"
    rows = [
        (3, text, "en", "b"), (3, text, "en", "a"), (3, text, "en", "a"), (None, text, "en", "a"), (7, other, "en", "a"),
        (None, "without any id at all here", "en", "a"), (None, "without any id at all here", "en", "a"), (7, "a third text of more words", "en", "a"),
    ]
    kept = simhash.one_of_each_group(documents(spark, rows)).collect()
    assert sorted(((r.doc_id or 0, r.text, r.source) for r in kept)) == [
        (0, "without any id at all here", "a"), (3, text, "a"), (7, "a third text of more words", "a"), (7, other, "a"),
    ]


def test_prefixes_of_similar_sets_meet():
    draw = random.Random(3)
    for _ in range(3_000):
        n = draw.choice([1, 2, 5, 9, 40, 150])
        left = set(draw.sample(range(400), n))
        right = {draw.randrange(400) if draw.random() < 0.15 else x for x in left} | set(draw.sample(range(400), draw.randrange(1 + n // 5)))
        if len(left & right) < 0.8 * len(left | right):
            continue
        ends = [set(sorted(x)[: minhash.prefix_length(len(x), 0.8)]) for x in (left, right)]
        assert ends[0] & ends[1]
        # at the first that they share, enough is left of both
        first = min(left & right)
        for x in (left, right):
            assert len([y for y in x if y >= first]) >= 0.8 / 1.8 * (len(left) + len(right)) - 1e-9


@pytest.mark.parametrize("seed", range(2))
def test_families_of_copies_against_all_pairs(spark, seed):
    draw = random.Random(seed)
    rows = []
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(draw.choice([60, 150]))]
        for _ in range(50):
            edits = draw.choice([0.005, 0.02, 0.03, 0.05])
            rows.append((len(rows), " ".join(f"x{draw.random()}" if draw.random() < edits else w for w in base), "en", "a"))
        for k in range(12):
            # drifts step by step, so that chains lead away from the family
            text = rows[-1][1].split()
            text[(7 * k) % len(text)] = f"y{family}x{k}"
            rows.append((len(rows), " ".join(text[: len(text) - k % 3]), "en", "a"))
    want = plain_groups([r[1] for r in rows])
    kept = sorted(r.doc_id for r in simhash.one_of_each_group(documents(spark, rows)).collect())
    assert kept == sorted({rows[g][0] for g in want}) and 8 < len(kept) < len(rows) // 2
