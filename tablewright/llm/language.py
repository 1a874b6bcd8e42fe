"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, everything but letters becomes one blank, and its runs
of one to four characters, blanks at word borders included, are hashed into
``BUCKETS``. The mean of the buckets' embeddings goes through a linear softmax;
both are trained together by stochastic gradient descent in numpy, on whole
texts and on one short piece of each, so that short texts are known too.

Noise is a class of its own, so that a text of no language has a place to go: each
training row also gives a piece, and each ``NOISE_OF``-th a whole text, whose letters
are shuffled, exchanged for one another, moved to another script, or repeated. Noise is never an answer; what
it is given is missing from the score of the best language.

Training rows: at most ``ROWS_EACH`` labelled rows of a language (a bounded
sample by hash of doc_id and text, cut before it leaves the executors), of which a
tenth is kept aside to calibrate: a temperature makes the score a probability,
and a text is *rejected* when its score is below the middle between what all but
``REJECTED`` of the rightly labelled texts reach and what noise reaches, and
below ``SURE``. ``Model.missed`` and ``Model.wrong`` are the shares of noise that
is accepted and of labelled texts that are rejected, of the rows kept aside.
Ties at the edge of the sample are rows of one id and one text, so it does not
matter which of them is taken. Rows that repeat are answered one by one, and an
empty table gives no rows.

A text that is null or has no letter is ``und`` with score 0 and rejected;
without labelled rows all texts are. Whole texts are read, of any length.
Language labels are listed on the driver, one row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import in_slices, map_exactly

BITS = 14
BUCKETS = 1 << BITS
WIDTH = 16
LONGEST = 4
ROWS_EACH = 1_000
REJECTED = 0.0002
#: Whole texts are many times as long as pieces, and the driver holds the sample.
NOISE_OF = 8
#: Share of the noise kept aside that may score higher than what counts as noise's reach.
NOISE = 0.01
#: No text of at least this score is rejected.
SURE = 0.5
UNKNOWN = "und"
BLOCK = 1_000_000
#: Texts whose bucket counts are held at once.
TOGETHER = 64
OTHER = re.compile(r"[\W\d_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0x100000001B3)
#: Where the letters of noise of another script begin.
SCRIPTS = (0x0400, 0x0590, 0x0905, 0x0E01, 0x3041, 0x4E00, 0xAC00)


def buckets(letters: str) -> np.ndarray:
    """The bucket of each run of one to ``LONGEST`` characters."""
    codes = np.frombuffer(letters.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    out, run = [], codes
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(codes) < n:
                break
            run = run[:-1] * STEP + codes[n - 1 :]
        out.append(((run * MULTIPLIER) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


def cleaned(text: str | None) -> str | None:
    """Letters in lower case between single blanks; None without a letter."""
    plain = OTHER.sub(" ", (text or "").lower()).strip()
    return f" {plain} " if any(map(str.isalpha, plain)) else None


def counts(letters: str) -> np.ndarray:
    """How often each bucket is met; long texts in blocks that overlap by no run."""
    total = np.zeros(BUCKETS)
    for at in range(0, len(letters), BLOCK):
        total += np.bincount(buckets(letters[at : at + BLOCK]), minlength=BUCKETS)
    return total


def chances(raw: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    raw = raw / temperature
    raw = np.exp(raw - raw.max(axis=1, keepdims=True))
    return raw / raw.sum(axis=1, keepdims=True)


def noise(letters: str, place: int) -> str:
    """A text of no language, as long as the cleaned text and with its blanks; ``place`` chooses its kind."""
    rng = np.random.default_rng(place)
    codes = np.frombuffer(letters.encode("utf-32-le"), dtype="<u4").copy()
    at = codes != 32
    if not at.any():
        return letters
    known = np.unique(codes[at])
    kind = place % 4
    if kind == 0:
        codes[at] = rng.permutation(codes[at])
    elif kind == 1:
        codes[at] = rng.permutation(known)[np.searchsorted(known, codes[at])]
    elif kind == 2:
        codes[at] = codes[at] % 997 + int(rng.choice(SCRIPTS))
    else:
        runs = np.repeat(rng.choice(known, len(codes)), rng.integers(2, 9))[: len(codes)]
        codes[at] = runs[at]
    return codes.tobytes().decode("utf-32-le")


@dataclass
class Model:
    languages: list[str]
    #: Embeddings times the linear layer: what each bucket adds to each language.
    votes: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    threshold: float = 0.0
    missed: float = 0.0
    wrong: float = 0.0

    def scores(self, means: np.ndarray) -> np.ndarray:
        """The chance of each language; what is missing to one is noise."""
        return chances(means @ self.votes + self.bias, self.temperature)[:, : len(self.languages)]

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for at in range(0, len(texts), TOGETHER):
            means, rows = [], []
            for i, text in enumerate(texts[at : at + TOGETHER]):
                letters = cleaned(text)
                if letters:
                    count = counts(letters)
                    means.append((count / count.sum()).astype(np.float32))
                    rows.append(at + i)
            if rows:
                found = self.scores(np.stack(means))
                scores[rows] = found.max(axis=1)
                for row, best in zip(rows, found.argmax(axis=1), strict=True):
                    names[row] = self.languages[best]
        return names, scores


def held_out() -> Column:
    """Rows that nothing is learned from: CRC-32 of the doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, rows_each: int = ROWS_EACH) -> pd.DataFrame:
    """(lang, place, bucket, count) of a bounded sample: whole texts, a short piece of each, noise of it, noise of some whole texts.

    ``place`` modulo 4 tells which of the four it is; ``lang`` of noise is null.
    Buckets are packed as 16-bit and their shares as 32-bit numbers, to be small on the driver.
    """
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()
    )
    sizes = {r["lang"]: r["rows"] for r in usable.groupBy("lang").agg(F.count("*").alias("rows")).collect()}
    if not sizes:
        return pd.DataFrame({"lang": [], "place": [], "bucket": [], "count": []})
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_007))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(rows_each * 1_000_000_007 // n))])

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for lang, place, text in zip(frame["lang"], frame["place"], frame["text"], strict=True):
                letters = cleaned(text)
                if not letters:
                    continue
                start = int(place) % len(letters)
                piece = letters[start : start + 20 + int(place) % 60]
                texts = [letters, piece, noise(piece, int(place))]
                if place // 16 % NOISE_OF == 0:
                    texts.append(noise(letters, int(place)))
                for i, some in enumerate(texts):
                    if not some.strip():
                        continue
                    count = counts(some)
                    met = np.nonzero(count)[0]
                    share = (count[met] / count.sum()).astype("<f4")
                    out.append((lang if i < 2 else None, int(place) * 4 + i, met.astype("<u2").tobytes(), share.tobytes()))
            yield pd.DataFrame(out, columns=["lang", "place", "bucket", "count"])

    # rows of one id and one text share a place, however many they are
    first = Window.partitionBy("lang").orderBy("place")
    return (
        usable.withColumn("place", place).where(F.col("place") < share[F.col("lang")])
        .withColumn("_row", F.row_number().over(first)).where(F.col("_row") <= rows_each)
        .select("lang", "place", "text")
        .mapInPandas(features, "lang string, place long, bucket binary, count binary").toArrow().to_pandas()
        .sort_values(["place", "lang"], kind="stable").reset_index(drop=True)
    )


def dense(rows: pd.DataFrame) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS))
    for i, (bucket, count) in enumerate(zip(rows["bucket"], rows["count"], strict=True)):
        out[i, np.frombuffer(bucket, dtype="<u2")] = np.frombuffer(count, dtype="<f4")
    return out


def train(rows: pd.DataFrame, epochs: int = 5, rate: float = 8.0, batch: int = 64) -> Model:
    languages = sorted(rows["lang"].dropna().unique())
    if not languages:
        return Model([])
    rng = np.random.default_rng(5)
    aside = (rows["place"] // 4 % 10 == 7).to_numpy()
    if aside.all() or not rows["lang"][aside].notna().any():
        aside = np.zeros(len(rows), dtype=bool)
    fit, calibrate = rows[~aside], rows[aside] if aside.any() else rows
    truth, classes = _truth(fit, languages), len(languages) + 1
    embedding = rng.normal(0, 0.3, (BUCKETS, WIDTH))
    linear = rng.normal(0, 0.3, (WIDTH, classes))
    bias = np.zeros(classes)
    # rare languages count as much as frequent ones
    weight = 1.0 / np.maximum(1, np.bincount(truth, minlength=classes))
    weight = (weight / weight[truth].mean())[truth]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for some in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // batch)):
            means = dense(fit.iloc[some])
            hidden = means @ embedding
            chance = chances(hidden @ linear + bias)
            chance[np.arange(len(some)), truth[some]] -= 1
            chance *= (weight[some] / len(some))[:, None]
            back = chance @ linear.T
            linear -= step / 8 * hidden.T @ chance
            bias -= step / 8 * chance.sum(axis=0)
            met = np.nonzero(means.any(axis=0))[0]
            embedding[met] -= step * 8 * means[:, met].T @ back
    model = Model(languages, embedding @ linear, bias)
    return calibrated(model, calibrate)


def _truth(rows: pd.DataFrame, languages: list[str]) -> np.ndarray:
    """The number of each row's language; noise comes after the last."""
    at = {name: i for i, name in enumerate(languages)}
    return np.array([at.get(x, len(languages)) for x in rows["lang"]], dtype=np.int64)


def calibrated(model: Model, rows: pd.DataFrame) -> Model:
    """Temperature of least log loss, then the score between those of rightly labelled whole texts and of noise."""
    raw = np.concatenate([dense(rows.iloc[i : i + 64]) @ model.votes for i in range(0, len(rows), 64)]) + model.bias
    truth = _truth(rows, model.languages)

    def loss(temperature: float) -> float:
        return -np.log(np.maximum(1e-12, chances(raw, temperature)[np.arange(len(truth)), truth])).mean()

    model.temperature = min(np.geomspace(0.1, 10, 41), key=loss)
    found = chances(raw, model.temperature)[:, : len(model.languages)]
    best, score = found.argmax(axis=1), found.max(axis=1)
    whole = (rows["place"] % 4 == 0).to_numpy()
    noisy = truth == len(model.languages)
    right = score[whole & (best == truth)]
    if len(right):
        reached = float(np.quantile(right, REJECTED))
        met = float(np.quantile(score[noisy], 1 - NOISE)) if noisy.any() else reached * 0.6
        model.threshold = min(SURE, (reached + min(met, reached)) / 2)
        model.wrong = float((score[whole] < model.threshold).mean())
        model.missed = float((score[noisy] >= model.threshold).mean()) if noisy.any() else 0.0
    return model


def fit(docs: DataFrame, rows_each: int = ROWS_EACH) -> Model:
    return train(training_rows(docs, rows_each))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, scores = model.predict(frame["text"].tolist())
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "held_out": frame["held_out"], "lang_pred": names, "score": scores,
                "rejected": [n == UNKNOWN or s < model.threshold for n, s in zip(names, scores, strict=True)],
            })

    return map_exactly(
        docs.select("doc_id", held_out().alias("held_out"), "text"), run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rejected ones; no column changes."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames):
            names, scores = model.predict(frame["text"].tolist())
            yield frame[[n != UNKNOWN and s >= model.threshold for n, s in zip(names, scores, strict=True)]]

    return map_exactly(docs, run, docs.schema)
