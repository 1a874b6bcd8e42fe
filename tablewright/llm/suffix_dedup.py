"""Exact removal of long repeated passages with a logarithmic family of suffix arrays.

Every byte that lies in a ``LENGTH``-byte string which also starts elsewhere, in
another text or in the same, is removed; overlaps count, and all strings are
judged on the input. Texts are UTF-8 bytes, and no string crosses two texts.

*Where to look.* Each window of ``LENGTH`` bytes is given to one of its
``GRAM``-byte runs, the one with the least hash, the leftmost of equals. That
depends on the window's bytes alone, so equal windows have equal runs, and
windows can only repeat where a run does. The owners of a run are summed up before
the shuffle, and most texts leave here. What is left are
*stretches*: the windows of one run in one text, as one piece of bytes. Equal
stretches count once.

*The index family.* Stretches with one run meet in one task. Their windows, the
suffixes of the stretch compared over ``LENGTH`` bytes, come in batches, and each
batch gets a suffix array: sorted, so that suffixes which agree over the whole
length are neighbours. Since only agreement over the whole length counts, the
order is that of a 64-bit fingerprint of these bytes. A new array is merge-scanned
against the arrays of all existing levels for equal suffixes, on both sides, and
then joins the family: levels of about equal size are merged, so sizes grow
geometrically and a suffix is moved a logarithmic number of times.

A run that very many different stretches share is not given to one task: its
windows' fingerprints are counted by a shuffle with partial sums instead.

Null texts are empty. Texts shorter than ``LENGTH`` lose nothing, unless they
repeat nothing anyway. A text that occurs twice and is long enough loses all its
bytes. Texts of any length are read in blocks. Rows of equal text share their
result, whatever their doc_id, so null and repeated ids are allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import partitions_for, text_or_empty
from tablewright.session import durable, fresh_path

LENGTH = 400
GRAM = 64
BLOCK = 1 << 20
#: Stretches for one task, and of one run for one task.
TASK_STRETCHES = 20_000
RUN_STRETCHES = 20_000
#: Texts that a task remembers to have looked at.
REMEMBERED = 50_000

MULTIPLIER = 0x5851F42D4C957F2D
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
LETTERS = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

ARRAYS = "array<int>"


def _powers(kind: str, count: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < count:
        base = np.full(max(count, BLOCK + LENGTH), {"up": MULTIPLIER, "down": INVERSE}[kind], dtype=np.uint64)
        base[0] = 1
        have = _POWERS[kind] = np.cumprod(base)
    return have[:count]


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of the ``width`` bytes from each place on."""
    count = len(data) - width + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(LETTERS[data] * _powers("up", len(data)), out=sums[1:])
    raw = (sums[width:] - sums[:count]) * _powers("down", count)
    return (raw ^ (raw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def stretches(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, last window, run's hash) of each run that windows are given to, block by block."""
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        windows = len(part) - length + 1
        hashes = window_hashes(part, gram)
        # the hash's upper bits, then the place: least hash first, leftmost of equals
        order = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        rows = -(-len(order) // width)
        padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(order)] = order
        grid = padded.reshape(rows, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64((1 << 24) - 1)
        starts = np.concatenate([[0], np.nonzero(np.diff(least))[0] + 1])
        ends = np.concatenate([starts[1:], [windows]]) - 1
        yield starts + at, ends + at, hashes[least[starts].astype(np.int64)].view(np.int64)


class Family:
    """Suffix arrays of geometrically growing size, and which suffixes were met twice."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted suffixes, their numbers
        self.twice: list[np.ndarray] = []  # by batch
        self.count = 0

    def add(self, suffixes: np.ndarray) -> None:
        """A batch of suffixes: its array, a merge-scan against each level, and its place in the family."""
        order = np.argsort(suffixes, kind="stable")
        keys, numbers = suffixes[order], order + self.count
        equal = keys[1:] == keys[:-1]
        met = np.zeros(len(keys), dtype=bool)
        met[1:] |= equal
        met[:-1] |= equal
        self.twice.append(np.zeros(len(keys), dtype=bool))
        self.count += len(keys)
        for level_keys, level_numbers in self.levels:
            low = np.searchsorted(level_keys, keys, side="left")
            here = low < len(level_keys)
            here[here] = level_keys[low[here]] == keys[here]
            met |= here
            if here.any():
                ends = np.searchsorted(level_keys, keys[here], side="right")
                change = np.zeros(len(level_keys) + 1, dtype=np.int64)
                np.add.at(change, low[here], 1)
                np.add.at(change, ends, -1)
                self._mark(level_numbers[np.cumsum(change[:-1]) > 0])
        self._mark(numbers[met])
        while self.levels and len(self.levels[-1][0]) <= 2 * len(keys):
            other_keys, other_numbers = self.levels.pop()
            keys, numbers = np.concatenate([other_keys, keys]), np.concatenate([other_numbers, numbers])
            order = np.argsort(keys, kind="stable")
            keys, numbers = keys[order], numbers[order]
        self.levels.append((keys, numbers))

    def _mark(self, numbers: np.ndarray) -> None:
        bounds = np.cumsum([0, *map(len, self.twice)])
        batch = np.searchsorted(bounds, numbers, side="right") - 1
        for b in np.unique(batch):
            self.twice[b][numbers[batch == b] - bounds[b]] = True


def suffixes_of(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all windows of some stretches, and how many each has."""
    counts = np.array([len(p) - length + 1 for p in pieces], dtype=np.int64)
    out, at, size = [], 0, 0
    for i, piece in enumerate(pieces):
        size += len(piece)
        if size >= BLOCK or i == len(pieces) - 1:
            some = pieces[at : i + 1]
            data = np.frombuffer(b"".join(some), dtype=np.uint8)
            hashes = window_hashes(data, length)
            starts = np.cumsum([0, *map(len, some[:-1])])
            number = counts[at : i + 1]
            place = np.arange(number.sum()) + np.repeat(starts - np.cumsum(number) + number, number)
            out.append(hashes[place])
            at, size = i + 1, 0
    return (np.concatenate(out) if out else np.empty(0, dtype=np.uint64)), counts


def covered(twice: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first, last window) of each run of windows that were met twice."""
    stretch = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(twice)) - np.repeat(np.cumsum(counts) - counts, counts)
    hit = np.nonzero(twice)[0]
    if not len(hit):
        return hit, hit, hit
    new = np.concatenate([[True], (np.diff(hit) > 1) | (stretch[hit[1:]] != stretch[hit[:-1]])])
    first = hit[new]
    last = np.concatenate([hit[np.nonzero(new)[0][1:] - 1], hit[-1:]])
    return stretch[first], place[first], place[last]


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t1, t2): texts with a 128-bit name."""
    text = text_or_empty()
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"))


def shared_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(t1, t2, first, last, run) of the stretches whose run is met elsewhere too."""
    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for frame in frames:
            names, sizes, found = [], [], []
            for t1, t2, text in zip(frame["t1"].tolist(), frame["t2"].tolist(), frame["text"], strict=True):
                if (t1, t2) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add((t1, t2))
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                for part in stretches(data, length, gram):
                    names.append((t1, t2))
                    sizes.append(len(part[0]))
                    found.append(part)
            if found:
                both = np.repeat(np.array(names, dtype=np.int64), sizes, axis=0)
                first, last, run = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"t1": both[:, 0], "t2": both[:, 1], "first": first, "last": last, "run": run})

    path = fresh_path(texts.sparkSession, "runs")
    texts.where(F.octet_length("text") >= length).mapInPandas(
        look, "t1 long, t2 long, first int, last int, run long"
    ).write.parquet(path)
    found = texts.sparkSession.read.parquet(path)
    # a run is shared if its least and greatest owner differ; that is summed before the shuffle
    owner = F.xxhash64("t1", "t2", "first")
    owners = found.groupBy("run").agg(F.min(owner).alias("least"), F.max(owner).alias("greatest"))
    # written, so that both sides of the join are plain shuffles and a hot run can be split
    shared = durable(owners.where("least <> greatest").select("run"))
    return found.join(shared, "run", "left_semi")


def cut_out(texts: DataFrame, length: int, pieces: bool) -> DataFrame:
    """(t1, t2, first, size, run, s1, s2) of each stretch, or (run, s1, s2, piece) with its bytes.

    A task gives the bytes of equal stretches once, as far as it remembers.
    """
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for frame in frames:
            names, bodies, keep, at, owners = [], [], [], [], []
            for t1, t2, text, firsts, lasts, runs in zip(
                frame["t1"].tolist(), frame["t2"].tolist(), frame["text"], frame["firsts"], frame["lasts"], frame["runs"],
                strict=True,
            ):
                data = text.encode("utf-8", "surrogatepass")
                for first, last, run in zip(firsts.tolist(), lasts.tolist(), runs.tolist(), strict=True):
                    body = data[first : last + length]
                    name = hashlib.md5(body).digest()
                    names.append(name)
                    if pieces:
                        keep.append(name not in seen)
                        if len(seen) < REMEMBERED:
                            seen.add(name)
                        bodies.append(body if keep[-1] else b"")
                    owners.append((t1, t2))
                    at.append((first, len(body), run))
            if not names:
                continue
            name = np.frombuffer(b"".join(names), dtype=np.int64).reshape(-1, 2)
            place, owner = np.array(at, dtype=np.int64), np.array(owners, dtype=np.int64)
            if pieces:
                rows = np.array(keep)
                yield pd.DataFrame({
                    "run": place[rows, 2], "s1": name[rows, 0], "s2": name[rows, 1],
                    "piece": [b for b, k in zip(bodies, keep, strict=True) if k],
                })
            else:
                yield pd.DataFrame({
                    "t1": owner[:, 0], "t2": owner[:, 1], "first": place[:, 0], "size": place[:, 1], "run": place[:, 2],
                    "s1": name[:, 0], "s2": name[:, 1],
                })

    return texts.mapInPandas(
        cut, "run long, s1 long, s2 long, piece binary" if pieces
        else "t1 long, t2 long, first int, size int, run long, s1 long, s2 long",
    )


def search(pieces: DataFrame, length: int, partitions: int) -> DataFrame:
    """(s1, s2, starts, ends): repeated bytes of each stretch, found by one index family in each task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, names, counts = Family(), [], []
        seen: set[tuple[int, int]] = set()
        for frame in frames:
            name = frame[["s1", "s2"]].to_numpy()
            fresh = np.zeros(len(name), dtype=bool)
            for i, key in enumerate(map(tuple, name.tolist())):
                if key not in seen:
                    seen.add(key)
                    fresh[i] = True
            if fresh.any():
                suffixes, number = suffixes_of(frame["piece"][fresh].tolist(), length)
                family.add(suffixes)
                names.append(name[fresh])
                counts.append(number)
        for twice, name, number in zip(family.twice, names, counts, strict=True):
            yield _intervals(*covered(twice, number), name, length)

    return pieces.repartition(partitions, "run").select("s1", "s2", "piece").mapInPandas(
        run, f"s1 long, s2 long, starts {ARRAYS}, ends {ARRAYS}"
    )


def _intervals(stretch: np.ndarray, first: np.ndarray, last: np.ndarray, names: np.ndarray, length: int) -> pd.DataFrame:
    at, begin = np.unique(stretch, return_index=True)
    cuts = begin[1:]
    return pd.DataFrame({
        "s1": names[at, 0], "s2": names[at, 1],
        "starts": pd.Series(np.split(first, cuts) if len(at) else [], dtype=object),
        "ends": pd.Series(np.split(last + length, cuts) if len(at) else [], dtype=object),
    })


def count_windows(pieces: DataFrame, length: int) -> DataFrame:
    """As ``search``, for runs with very many stretches: windows are counted by a shuffle with partial sums."""
    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                suffixes, number = suffixes_of(frame["piece"].tolist(), length)
                stretch = np.repeat(np.arange(len(frame)), number)
                yield pd.DataFrame({
                    "suffix": suffixes.view(np.int64), "s1": frame["s1"].to_numpy()[stretch],
                    "s2": frame["s2"].to_numpy()[stretch],
                    "place": np.arange(len(stretch)) - np.repeat(np.cumsum(number) - number, number),
                })

    windows = pieces.select("s1", "s2", "piece").mapInPandas(spread, "suffix long, s1 long, s2 long, place int")
    often = windows.groupBy("suffix").agg(F.count("*").alias("met")).where("met > 1").select("suffix")
    places = windows.join(often, "suffix").groupBy("s1", "s2").agg(F.collect_list("place").alias("starts"))
    return places.withColumn("ends", F.transform("starts", lambda p: (p + length).cast("int")))


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(t1, t2, text, starts, ends): texts with bytes that are also in another text or elsewhere in it.

    The spans of bytes may overlap. Equal texts are one here.
    """
    spark = docs.sparkSession
    texts = texts_of(docs).drop("doc_id")
    shared = shared_runs(texts, length, gram).groupBy("t1", "t2").agg(
        F.collect_set(F.struct("first", "last", "run")).alias("at")
    ).select(
        "t1", "t2", F.col("at.first").alias("firsts"), F.col("at.last").alias("lasts"), F.col("at.run").alias("runs")
    )
    once = texts.where(F.octet_length("text") >= length).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    path = fresh_path(spark, "stretches")
    once.join(shared, ["t1", "t2"]).write.parquet(path)
    kept = spark.read.parquet(path)
    owners = durable(cut_out(kept, length, pieces=False))
    pieces = cut_out(kept, length, pieces=True)
    names = owners.groupBy("run", "s1", "s2").agg(F.count("*").alias("times"), F.first("size").alias("size"))
    number = names.count()
    busy = durable(names.groupBy("run").count().where(F.col("count") > RUN_STRETCHES).select("run"))
    tasks = partitions_for(number, TASK_STRETCHES)
    if busy.isEmpty():
        partial = search(pieces, length, tasks)
    else:
        hot = pieces.join(busy, "run", "left_semi").dropDuplicates(["s1", "s2"])
        partial = search(pieces.join(busy, "run", "left_anti"), length, tasks).unionByName(count_windows(hot, length))
    # a stretch that is met twice is elsewhere as a whole
    whole = names.where("times > 1").select(
        "s1", "s2", F.array(F.lit(0)).alias("starts"), F.array("size").alias("ends")
    )
    single = names.where("times = 1").select("s1", "s2")
    spans = partial.join(single, ["s1", "s2"], "left_semi").unionByName(whole)
    placed = owners.join(spans, ["s1", "s2"]).select(
        "t1", "t2",
        F.transform("starts", lambda p: p + F.col("first")).alias("starts"),
        F.transform("ends", lambda p: p + F.col("first")).alias("ends"),
    )
    of_text = placed.groupBy("t1", "t2").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")
    )
    return kept.select("t1", "t2", "text").join(of_text, ["t1", "t2"])


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs, in order; neighbours that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.nonzero(new)[0]
    return starts[at], reach[np.concatenate([at[1:], [len(starts)]]) - 1]


def without(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    edges = [0, *(x for pair in zip(starts.tolist(), ends.tolist(), strict=True) for x in pair), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def cleaned(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(t1, t2, n_removed, n_spans, kept_sha256, kept): what is left of each text that loses bytes.

    A passage may begin or end inside a character: what is left of it is U+FFFD in
    ``kept``, but counts as it is for the digest. Texts that occur twice are not
    listed for that.
    """
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, starts, ends in zip(frame["text"], frame["starts"], frame["ends"], strict=True):
                starts, ends = merged(starts, ends)
                left = without(text.encode("utf-8", "surrogatepass"), starts, ends)
                rows.append((int((ends - starts).sum()), len(starts), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            out = pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256", "kept"])
            yield pd.concat([frame[["t1", "t2"]], out], axis=1)

    return repeated(docs, length, gram).mapInPandas(
        cut, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept string"
    )


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    texts = texts_of(docs)
    rows = texts.select(
        "doc_id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")
    )
    lost = cleaned(docs, length, gram).drop("kept")
    copies = texts.where(F.octet_length("text") >= length).groupBy("t1", "t2").agg(F.count("*").alias("copies"))
    facts = copies.where("copies > 1").join(lost, ["t1", "t2"], "full")
    twice = F.col("copies").isNotNull()
    zero = F.lit(0).cast("long")
    return rows.join(facts, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes",
        F.when(twice, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(twice, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(twice, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages taken out of column text; a cut character becomes U+FFFD, null stays null."""
    lost = cleaned(docs, length, gram).select("t1", "t2", "kept")
    named = docs.withColumns({"t1": F.xxhash64(text_or_empty()), "t2": F.xxhash64(F.lit(7), text_or_empty())})
    copies = named.where(F.octet_length("text") >= length).groupBy("t1", "t2").count().where("count > 1").drop("count")
    facts = copies.withColumn("twice", F.lit(True)).join(lost, ["t1", "t2"], "full")
    text = F.when(F.col("twice"), F.lit("")).otherwise(F.coalesce("kept", "text"))
    return named.join(facts, ["t1", "t2"], "left").withColumn("text", text).select(*docs.columns)
