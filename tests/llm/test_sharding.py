import zlib

from tablewright.llm import sharding
from tests.conftest import SF
from tests.llm.helpers import documents, odd


def check(rows, texts, count, room):
    """Sizes near equal, slots without a gap, equal texts together unless they are many."""
    assert len(rows) == len(texts)
    total = sum(r.size for r in rows)
    share = [sum(r.size for r in rows if r.shard == s) for s in range(count)]
    assert max(share) - total / count <= room and total / count - min(share) <= room
    for s in range(count):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    for key in {r.key for r in rows}:
        group = [r for r in rows if r.key == key]
        shards = {r.shard for r in group}
        assert len(shards) == 1 or sum(r.size for r in group) > sharding.WHOLE * total / count
        assert shards == set(range(min(shards), max(shards) + 1))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shards(docs).collect()
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    check(rows, texts, 24, max(r.size for r in rows))


def test_hot_group_is_cut_inside(spark):
    rows = [(i, "a copy that a third of all rows hold", "en", "a") for i in range(400)]
    rows += [(1000 + i, f"text number {i} " * (1 + i % 5), "en", "a") for i in range(800)]
    got = sharding.shards(documents(spark, rows), count=6).collect()
    check(got, rows, 6, 200)
    assert len({r.shard for r in got if r.doc_id < 400}) > 1


def test_runs_number_the_same_slots(spark, monkeypatch):
    rows = [(i, f"text {i % 300}", "en", "a") for i in range(900)]
    docs = documents(spark, rows)
    monkeypatch.setattr(sharding, "RUN_ROWS", 30)
    got = sharding.shards(docs, count=4).collect()
    check(got, rows, 4, 200)
    order = [(r.shard, r.slot) for r in sorted(got, key=lambda r: (r.key, r.id))]
    assert order == sorted(order)


def test_odd_rows(spark):
    rows = odd("word " * 50)
    got = sharding.shards(documents(spark, rows, clash=("key", "size", "shard", "run")), count=3).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(r[0] or 0 for r in rows)
    assert {r.size for r in got if r.doc_id in (1, 2)} == {8}
    assert {r.text_crc32 for r in got if r.doc_id == 1} == {0}
    assert sharding.shards(documents(spark, [])).count() == 0


def test_written_shards(spark, tmp_path):
    docs = documents(spark, [(i, f"text {i} " * 5, "en", "a") for i in range(60)])
    sharding.write_shards(docs, f"{tmp_path}/out", count=3)
    back = spark.read.parquet(f"{tmp_path}/out")
    want = {r.doc_id: r.shard for r in sharding.shards(docs, count=3).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want
