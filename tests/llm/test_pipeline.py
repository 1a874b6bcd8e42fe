import corpus_pipeline
from tablewright.llm.bpe import tokenizer
from tests.conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        counts.append(docs.count())
        assert docs.where("n_chars <> length(text)").count() == 0
    start, known, single, clean, mixed = counts
    assert start * 0.97 <= known <= start and single == clean <= known and mixed > 0
    texts = sorted(r.text for r in docs.collect())
    assert not any("@mail" in t for t in texts)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    coder = tokenizer(corpus_pipeline.TOKENIZER)
    assert sorted(bytes(r.ids) for r in rows) == sorted(coder.encode(t) for t in texts)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
