import re

import numpy as np
import xxhash

from tablewright.llm import simhash
from tests.conftest import SF
from tests.llm.helpers import documents, odd


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints, limit=4):
    """Index of the first member of each row's group."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def same_groups(names, groups):
    return len(set(zip(names, groups))) == len(set(names)) == len(set(groups))


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [plain_fingerprint(t) for _, t in texts]
    assert [rows[i].fp & (2**64 - 1) for i, _ in texts] == prints
    want = [texts[g][0] for g in plain_groups(prints)]
    assert [rows[i].component_id for i, _ in texts] == want


def test_odd_rows(spark):
    docs = documents(spark, odd(), clash=("fp", "component_id", "root"))
    rows = [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert 2**60 + 1 in {i for i, _, _ in rows}
    assert len(rows) == len(odd())
    assert {c for i, _, c in rows if i in (1, 2, 3)} == {1}
    assert [c for i, _, c in rows if i == 6] == [5, 5]
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 1 in ids and 5 in ids and 4 in ids and None in ids and not ids & {2, 3, 6}


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_tree_gives_the_groups_of_a_dense_node():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = centre[rng.integers(0, 3, 900)]
    for _ in range(3):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, len(values), dtype=np.uint64))
    values = np.unique(np.concatenate([values, rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    found = dict(simhash.node_links(values))
    assert len(found) < len(values)
    names = [found.get(int(v), int(v)) for v in values]
    assert same_groups(names, plain_groups([int(v) for v in values]))


def test_masks_miss_no_pair():
    rng = np.random.default_rng(3)
    for rows in (10, 10**4, 10**7, 10**9, 10**12):
        masks = simhash.masks(rows)
        for _ in range(200):
            change = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not m & change for m in masks)


def test_the_pipeline_takes_its_first_links_from_the_index(spark, monkeypatch):
    asked = []
    confirmed = simhash.minhash.confirmed
    monkeypatch.setattr(simhash.minhash, "confirmed", lambda pairs, *a: asked.append(pairs.count()) or confirmed(pairs, *a))
    # one word of a long text changed: few bits differ
    words = [f"w{k}" for k in range(3000)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(5)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.one_of_each_group(docs).collect()] == [0]
    assert asked == [4, 0]
