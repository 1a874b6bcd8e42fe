"""Personal data: overlapping candidates, boosted trees, calibrated thresholds.

*Base spans* follow fixed formats (``base_spans``): mail addresses, IPv4
addresses, card numbers that pass their check digit, and phone numbers with a
country code. They are always part of the result.

*Candidates.* Generators of high recall propose overlapping spans around every
at-sign and every group of at least four digits, each span once for each kind
that it might be. Boosted trees score a candidate by its format (digits, groups,
marks, lengths) and its context (the characters and words beside it), never by
a check digit or a limit on a number's parts. They are trained without labels by
hand: base spans are positive, candidates outside a kind's format are negative,
and those that are near the format but fail the rule, such as a card number with
a wrong digit, are left open, which is what the model is there to judge. The
scores of labelled candidates that were kept aside set each kind's threshold:
the lowest at which ``PRECISION`` of what is selected is right. Selected
candidates that overlap no base span, the best first and none over another, are
added.

Training reads at most ``DOCUMENTS`` documents and ``ROWS`` candidates, a
bounded sample by hash. Without positives or negatives there is no model, and
the base spans are the result.

Null and empty texts have no spans. Offsets count code points, end exclusive.
Whole texts are read, of any length; every scan is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import in_slices, map_exactly, text_or_empty

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
DOCUMENTS = 4_000
ROWS = 40_000
ROUNDS, DEPTH, RATE, BINS = 30, 3, 0.3, 32
PRECISION = 0.995

#: Fixed formats of the base spans.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Candidates.
DIGITS = re.compile(r"(?:\+|\(|\+\()?[0-9](?:[\x20().-]{0,2}[0-9])*")
AT = re.compile(r"[\w.%+'-]{1,64}[\x20]?(?:@|[\[(]at[\])])[\x20]?[\w-]{1,64}(?:[\x20]?(?:\.|[\[(]dot[\])])[\x20]?[\w-]{1,64})*")
LEAST_DIGITS = 4

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed formats, leftmost and without overlap for each kind, by start, then kind."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        local = text[end:at]
        name = len(local) - len(local.rstrip(LOCAL)) if local[-1:] in LOCAL and local else 0
        found = DOMAIN.match(text, at) if name else None
        if found:
            out.append((at - name, EMAIL, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in ADDRESS.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), IP, m.end()))
        for m in NUMBER.finditer(text):
            if m.end() - m.start() < 12:
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), CARD, m.end()))
        for m in CALL.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def candidates(text: str) -> list[Span]:
    """Overlapping spans that might be personal data, with a kind for each."""
    found: set[Span] = set()
    if "@" in text or "at" in text:
        at = text.find("@")
        if at >= 0 or "(at)" in text or "[at]" in text:
            found.update((m.start(), EMAIL, m.end()) for m in AT.finditer(text))
    if DIGIT.search(text):
        for m in DIGITS.finditer(text):
            pieces = [(m.start(), m.end())]
            if " " in m[0]:
                pieces += [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^\x20]+", m[0])]
            for start, end in pieces:
                digits = sum(map(str.isdigit, text[start:end]))
                if digits < LEAST_DIGITS:
                    continue
                bare = start + (text[start] in "+(" )
                found.add((bare, CARD, end))
                found.add((start, PHONE, end))
                if "." in text[start:end]:
                    found.add((bare, IP, end))
    return sorted(found)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    start, kind, end = span
    body = text[start:end]
    groups = [len(g) for g in re.findall(r"[0-9]+", body)] or [0]
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    left, right = before[-1:], after[:1]
    name, _, host = body.partition("@")
    words = before.split(" ")
    return [
        *(float(kind == k) for k in range(4)),
        float(sum(groups)), float(len(body)), float(len(groups)), float(groups[0]), float(groups[-1]), float(max(groups)),
        float(min(groups)), float(body.count(" ")), float(body.count("-")), float(body.count(".")),
        float(body.count("(")), float(body.startswith("+")), float(body.count("@")), float(host.count(".")),
        float(len(name)), float(len(host.rpartition(".")[2])), float(sum(map(str.isalpha, body))),
        _side(left), _side(right), float(left.isalnum()), float(right.isalnum()),
        float(len(words[-1])), float(len(after.split(" ")[0])),
        float(any(c in "=:\"'#" for c in before[-3:])), float(before[-2:-1].isdigit()), float(len(set(body))),
    ]


def _side(char: str) -> float:
    if not char:
        return 0.0
    return 1.0 if char.isspace() else 2.0 if char.isalpha() else 3.0 if char.isdigit() else 4.0


def weak_label(text: str, span: Span, base: set[Span]) -> int | None:
    """1 for a base span, 0 for what is outside the kind's format, None for what is near it."""
    if span in base:
        return 1
    start, kind, end = span
    body = text[start:end]
    digits = sum(map(str.isdigit, body))
    apart = not (text[start - 1 : start].isalnum() if start else False) and not text[end : end + 1].isalnum()
    near = {
        EMAIL: True, IP: body.count(".") == 3, CARD: 12 <= digits <= 19, PHONE: 9 <= digits <= 15,
    }[kind]
    return None if near and (apart or kind == EMAIL) else 0


@dataclass
class Trees:
    """Boosted regression trees of a fixed depth for the log-odds, on binned features."""

    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    #: For each tree: feature and bin of each inner node, in level order, and the leaves' values.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, i], side="left") for i, e in enumerate(self.edges)], axis=1)

    @staticmethod
    def _leaf(bins: np.ndarray, split: np.ndarray, at: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), dtype=np.int64)
        for _ in range(DEPTH):
            right = bins[np.arange(len(bins)), split[node]] > at[node]
            node = 2 * node + 1 + right
        return node - (2**DEPTH - 1)

    def fit(self, rows: np.ndarray, labels: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(rows[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(rows.shape[1])]
        bins = self.binned(rows)
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(rows), self.start)
        for _ in range(ROUNDS):
            chance = 1 / (1 + np.exp(-score))
            slope, bend = labels - chance, chance * (1 - chance)
            split, at = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, BINS, dtype=np.int64)
            node = np.zeros(len(rows), dtype=np.int64)
            for level in range(DEPTH):
                first, count = 2**level - 1, 2**level
                best = np.full(count, 1e-6)
                for f in range(bins.shape[1]):
                    cell = (node - first) * (BINS + 1) + bins[:, f]
                    g = np.bincount(cell, slope, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                    h = np.bincount(cell, bend, count * (BINS + 1)).reshape(count, -1).cumsum(axis=1)
                    all_g, all_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                    top = gain.argmax(axis=1)
                    better = gain[np.arange(count), top] > best
                    best = np.where(better, gain[np.arange(count), top], best)
                    split[first : first + count] = np.where(better, f, split[first : first + count])
                    at[first : first + count] = np.where(better, top, at[first : first + count])
                node = 2 * node + 1 + (bins[np.arange(len(bins)), split[node]] > at[node])
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, slope, 2**DEPTH) / (np.bincount(leaf, bend, 2**DEPTH) + 1)
            score = score + value[leaf]
            self.trees.append((split, at, value))
        return self

    def chance(self, rows: np.ndarray) -> np.ndarray:
        bins = self.binned(rows)
        score = np.full(len(rows), self.start)
        for split, at, value in self.trees:
            score = score + value[self._leaf(bins, split, at)]
        return 1 / (1 + np.exp(-score))


@dataclass
class Detector:
    trees: Trees | None = None
    thresholds: tuple[float, ...] = (1.0,) * 4

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text."""
        base = [base_spans(t) for t in texts]
        if self.trees is None:
            return [(b, b) for b in base]
        rows, owner, spans = [], [], []
        for i, text in enumerate(texts):
            for span in candidates(text):
                if not any(b[0] < span[2] and span[0] < b[2] for b in _around(base[i], span)):
                    owner.append(i)
                    spans.append(span)
                    rows.append(features(text, span))
        added: list[list[Span]] = [[] for _ in texts]
        if rows:
            chance = self.trees.chance(np.array(rows))
            for k in np.lexsort(([s[0] for s in spans], -chance)):
                taken = added[owner[k]]
                if chance[k] >= self.thresholds[spans[k][1]] and not any(
                    a[0] < spans[k][2] and spans[k][0] < a[2] for a in taken
                ):
                    taken.append(spans[k])
        return [(b, sorted(b + a) if a else b) for b, a in zip(base, added, strict=True)]


def _around(spans: list[Span], span: Span) -> list[Span]:
    """The sorted spans that may overlap: few texts have more than a handful."""
    if len(spans) < 16:
        return spans
    starts = [s[0] for s in spans]
    from bisect import bisect_left

    return spans[max(0, bisect_left(starts, span[0]) - 8) : bisect_left(starts, span[2])]


def training_rows(docs: DataFrame, documents: int = DOCUMENTS, rows: int = ROWS) -> pd.DataFrame:
    """(kind, label, place, row): labelled candidates of a bounded sample of documents with digits or at-signs."""
    usable = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    number = usable.count()
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_007))

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for where, text in zip(frame["place"], frame["text"], strict=True):
                base = set(base_spans(text))
                for span in candidates(text):
                    known = weak_label(text, span, base)
                    if known is not None:
                        mixed = (int(where) * 1_000_003 + span[0] * 7 + span[1]) % 1_000_000_007
                        out.append((span[1], known, mixed, features(text, span)))
            yield pd.DataFrame(out, columns=["kind", "label", "place", "row"])

    found = (
        usable.withColumn("place", place).where(F.col("place") < F.lit(documents * 1_000_000_007 // max(1, number)))
        .mapInPandas(label, "kind int, label int, place long, row array<double>")
    )
    return found.orderBy("place", "kind").limit(rows).toPandas()


def fit(docs: DataFrame, documents: int = DOCUMENTS, rows: int = ROWS) -> Detector:
    sample = training_rows(docs, documents, rows)
    if sample["label"].nunique() < 2:
        return Detector()
    table = np.stack(sample["row"].to_numpy())
    labels = sample["label"].to_numpy(dtype=float)
    aside = (sample["place"] % 5 == 3).to_numpy()
    if len(np.unique(labels[~aside])) < 2:
        aside = np.zeros(len(sample), dtype=bool)
    trees = Trees().fit(table[~aside], labels[~aside])
    held = aside if aside.any() else np.ones(len(sample), dtype=bool)
    chance, kinds, truth = trees.chance(table[held]), sample["kind"].to_numpy()[held], labels[held]
    return Detector(trees, tuple(_threshold(chance[kinds == k], truth[kinds == k]) for k in range(4)))


def _threshold(chance: np.ndarray, truth: np.ndarray) -> float:
    """The lowest score above one half from which on the selected are nearly all right; 1.0 selects none."""
    if not truth.any():
        return 1.01
    order = np.argsort(-chance, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    good = np.nonzero((right >= PRECISION) & (chance[order] >= 0.5))[0]
    return float(chance[order][good[-1]]) if len(good) else 1.01


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame, detector: Detector) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every document; counts are of base spans."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for base, every in detector.spans(frame["text"].tolist()):
                counts = [sum(s[1] == k for s in base) for k in range(4)]
                rows.append((*counts, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(every)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    return map_exactly(
        docs.select("doc_id", text_or_empty().alias("text")), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind's name."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with personal data replaced in column text; null texts stay null."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in in_slices(frames):
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            found = detector.spans(texts)
            clean = [redact(t, s) if isinstance(o, str) else None for o, t, (_, s) in zip(frame["text"], texts, found, strict=True)]
            yield frame.assign(text=clean)

    return map_exactly(docs, run, docs.schema)
