import math
import zlib

from tablewright.llm import language
from tests.llm.helpers import documents, odd

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    model = language.fit(docs, rows_each=300)
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)
    # what no language taught: other languages, other scripts, noise; and what they taught
    foreign = [
        "O rato roeu a roupa do rei de Roma e a rainha com raiva resolveu remendar",
        "Pies biegnie przez las i szuka swojego pana, który czeka przy drodze",
        "Собака бежит по лесу и ищет своего хозяина у дороги",
        "世界人权宣言 人人生而自由", "aaaa bbbb cccc", "asdkjh qwelkj zxcmnb poiqwe lkjasd",
    ]
    assert all(x < model.threshold for x in model.predict(foreign)[1])
    letters = [language.cleaned(r.text) for r in docs.where("doc_id % 10 = 2").collect()]
    missed = [x >= model.threshold for x in model.predict([language.noise(x, i) for i, x in enumerate(filter(None, letters))])[1]]
    assert sum(missed) <= 0.1 * len(missed) and model.missed <= 0.15 and model.wrong <= 0.02
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - sum(r.rejected for r in rows)
    odd_rows = {r.doc_id: r for r in language.identify(documents(spark, odd() + [(8, "12 ½ !?", "en", "a")]), model).collect()}
    assert [odd_rows[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4
    assert odd_rows[1].score == 0 and odd_rows[1].rejected and odd_rows[2**60 + 1].lang_pred in model.languages
    assert language.identify(docs.limit(0), model).count() == 0


def test_without_labels(spark):
    docs = documents(spark, [(1, "some text", None, "a"), (2, None, "en", "a")], clash=("rejected", "place"))
    rows = language.identify(docs, language.fit(docs)).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in rows} == {("und", 0.0, True)}
    assert language.identify(docs.limit(0), language.fit(docs.limit(0))).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = documents(spark, [(i, f"text {i}", "zz" if i in held else "en", "a") for i in range(200)])
    assert language.fit(docs).languages == ["en"]


def test_noise_keeps_length_and_blanks_and_repeats():
    text = language.cleaned("The quick brown fox, jumps over 12 lazy dogs")
    for place in range(8):
        other = language.noise(text, place)
        assert other != text and other == language.noise(text, place)
        assert [i for i, x in enumerate(other) if x == " "] == [i for i, x in enumerate(text) if x == " "]
    assert language.noise(" ", 3) == " "


def test_sample_is_bounded_where_ids_repeat(spark):
    same = [(None, "the same words again and again", "en", "a")] * 3000
    docs = documents(spark, same + [(i, f"les autres mots {i}", "fr", "a") for i in range(300)])
    rows = language.training_rows(docs, 50)
    texts = rows[rows["place"] % 4 == 0].groupby("lang").size()
    assert all(texts <= 50) and len(rows) <= 4 * 2 * 50


def test_forward_pass_against_plain_sums(spark):
    docs = spark.read.parquet(DOCS).where("doc_id < 200")
    model = language.fit(docs, 40)
    for r in docs.where("doc_id < 20").collect():
        letters, total = language.cleaned(r.text), [0.0] * (len(model.languages) + 1)
        found = language.buckets(letters)
        for b in found:
            for i, vote in enumerate(model.votes[b]):
                total[i] += vote / len(found)
        raw = [(t + b) / model.temperature for t, b in zip(total, model.bias)]
        chance = [math.exp(x) / sum(map(math.exp, raw)) for x in raw][: len(model.languages)]
        names, scores = model.predict([r.text])
        assert abs(scores[0] - max(chance)) < 1e-4 and names[0] == model.languages[chance.index(max(chance))]
