"""Document fingerprints: a homomorphic multiset hash over paragraphs.

Each paragraph is hashed to a wide vector of ``LANES`` bits, and a document's
fingerprint is the lane-wise sum of the vectors of all its paragraphs, modulo
``2**30``, with the whole number of paragraphs as one more word. Sums do not depend
on order, so equal multisets of paragraphs have equal fingerprints, and adding
or taking away paragraphs adds or subtracts their fingerprint (``insert``,
``delete``) without the rest of the document.

A paragraph is what stands between line breaks; it is cut further where a
sentence ends, so that an edit changes only the sentences that it touches. White
space around a piece does not count and empty pieces are left out, so a null or
empty text has the zero fingerprint.

A lane read as ``2 * sum - count`` is a sum of random signs, one per paragraph.
The cosine of two such vectors estimates the cosine of the two paragraph
multisets, which ``likeness`` gives between 0 and 1: 1 for equal fingerprints
(two empty ones too), 0 where just one of them is empty. The estimate's
standard error is below ``1 / sqrt(LANES)``.

All of it is built-in DataFrame functions. Two lanes share a 64-bit word: a
32-bit field holds a 30-bit lane, so that adding two never carries into the
next or overflows the word, and a mask takes the sum modulo ``2**30``. An array
in Spark holds fewer than ``2**29`` pieces, so sums of one text never wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import text_or_empty

#: 32 lanes from each hash seed.
SEEDS = (11, 23, 37, 53)
LANES = 32 * len(SEEDS)
#: Bit 0 of both 32-bit fields of a word, and the 30 bits that a lane keeps.
ONES = 0x0000000100000001
KEEP = 0x3FFFFFFF3FFFFFFF
LANE = 0x3FFFFFFF
PIECES = r"[\r\n]+|(?<=[.!?])\s+"


def paragraphs(text: Column) -> Column:
    """The pieces of a text that are hashed, as an array with repeats."""
    return F.filter(F.transform(F.split(text, PIECES), lambda p: F.trim(p)), lambda p: p != "")


def with_words(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """``docs`` with the packed lanes of a text in column ``name``.

    One word holds the count, then come 16 words of two lanes for each seed.
    Pieces and hashes are columns of their own on the way, so each is made once.
    """
    pieces, hashes = f"_{name}_pieces", [f"_{name}_{seed}" for seed in SEEDS]
    step = docs.withColumn(pieces, paragraphs(text)).withColumns({
        column: _hashes(F.col(pieces), seed) for column, seed in zip(hashes, SEEDS, strict=True)
    })
    zero = F.lit(0).cast("long")
    count = F.size(hashes[0]).cast("long")
    lanes = [F.aggregate(column, zero, _adds(shift)) for column in hashes for shift in range(16)]
    return step.drop(pieces).withColumn(name, F.array(count, *lanes)).drop(*hashes)


def _hashes(pieces: Column, seed: int) -> Column:
    return F.transform(pieces, lambda p: F.xxhash64(F.lit(seed), p))


def _adds(shift: int):
    """Adds the bits at ``shift`` in both 32-bit fields of a hash to a word of two lanes."""
    ones, keep = F.lit(ONES).cast("long"), F.lit(KEEP).cast("long")
    return lambda total, h: (total + F.shiftrightunsigned(h, shift).bitwiseAND(ones)).bitwiseAND(keep)


def insert(left: Column, right: Column) -> Column:
    """The fingerprint of two texts' paragraphs together."""
    return F.concat(
        F.array(F.element_at(left, 1) + F.element_at(right, 1)),
        F.zip_with(_lanes(left), _lanes(right), lambda a, b: (a + b).bitwiseAND(F.lit(KEEP).cast("long"))),
    )


def delete(left: Column, right: Column) -> Column:
    """The fingerprint of the paragraphs of ``left`` without those of ``right``."""
    return insert(left, F.concat(F.array(-F.element_at(right, 1)), F.transform(_lanes(right), lambda b: _negative(b))))


def _lanes(words: Column) -> Column:
    return F.slice(words, 2, 16 * len(SEEDS))


def _negative(word: Column) -> Column:
    # per field: 2**30 - lane, where neither step can borrow from the next field
    flipped = word.bitwiseXOR(F.lit(KEEP).cast("long"))
    return (flipped + F.lit(ONES).cast("long")).bitwiseAND(F.lit(KEEP).cast("long"))


def fingerprint_text(words: Column) -> Column:
    """The packed lanes as one lowercase hexadecimal string."""
    return F.lower(F.concat_ws("", F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0"))))


def _signs(words: Column) -> Column:
    """Each lane as a sum of signs, wrapped to the middle of its range."""
    count = F.element_at(words, 1)
    lanes = F.flatten(F.transform(_lanes(words), lambda w: F.array(
        *[F.shiftrightunsigned(w, 32 * i).bitwiseAND(F.lit(LANE).cast("long")) for i in range(2)]
    )))
    half = (LANE + 1) // 2
    return F.transform(
        lanes,
        lambda c: (F.pmod(c * 2 - count + half, F.lit(LANE + 1)) - half).cast("double"),
    )


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def likeness(left: str, right: str) -> Column:
    """Between 0 and 1; see the module. Both names come from ``with_signs``."""
    norm = F.sqrt(F.col(f"{left}_square") * F.col(f"{right}_square"))
    cosine = F.when(norm > 0, _dot(F.col(f"{left}_signs"), F.col(f"{right}_signs")) / norm).otherwise(0.0)
    return F.when(F.col(left) == F.col(right), 1.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine))
    )


def with_signs(docs: DataFrame, *names: str) -> DataFrame:
    """What ``likeness`` needs of the packed fingerprints in these columns."""
    signed = docs.withColumns({f"{n}_signs": _signs(F.col(n)) for n in names})
    return signed.withColumns({f"{n}_square": _dot(F.col(f"{n}_signs"), F.col(f"{n}_signs")) for n in names})


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the packed fingerprint of each whole text in column ``name``."""
    return with_words(docs, text_or_empty(text), name)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, text, own, next_text, next): each document beside the one after it by descending doc_id.

    ``own`` and ``next`` are the fingerprints of the two texts.

    After the last comes the first. Rows of the same doc_id follow each other by
    text; a null doc_id comes last. doc_id must be a number. Documents are cut
    into ranges of doc_id; each text is moved once, and the first document of a
    range is also sent to the range before it.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    count = buckets or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)
    cuts = sorted(set(rows.stat.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.25 / count)))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(
        F.lit(len(cuts) + 1) - _cuts_above(F.col("doc_id"), cuts)
    )
    # one id per range: a small, bounded result
    firsts = rows.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("doc_id")).orderBy("bucket").collect()
    if not firsts:
        return fingerprints(rows, name="own").withColumns({"next_text": F.lit(""), "next": F.col("own")})
    before = {f["bucket"]: firsts[(i + 1) % len(firsts)]["bucket"] for i, f in enumerate(firsts)}
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    first_id = F.create_map(*[F.lit(x).cast("long") if i % 2 else F.lit(x) for f in firsts for i, x in enumerate((f["bucket"], f["doc_id"]))])
    placed = fingerprints(rows, name="own").withColumn("bucket", bucket)
    is_first = F.col("doc_id").eqNullSafe(first_id[F.col("bucket")])
    own = F.struct(F.col("bucket").alias("at"), F.lit(0).alias("copy"))
    copied = F.struct(to[F.col("bucket")].alias("at"), F.lit(1).alias("copy"))
    placed = placed.select(
        "doc_id", "text", "own", F.explode(F.when(is_first, F.array(own, copied)).otherwise(F.array(own))).alias("place")
    ).select("doc_id", "text", "own", "place.at", "place.copy")
    order = Window.partitionBy("at").orderBy(F.col("copy"), F.col("doc_id").desc_nulls_last(), F.col("text"))
    return (
        placed.withColumns({"next_text": F.lead("text").over(order), "next": F.lead("own").over(order)})
        .where(F.col("copy") == 0)
        .select("doc_id", "text", "own", "next_text", "next")
    )


def _cuts_above(value: Column, cuts: list[float]) -> Column:
    """How many cuts are at or above the value, by halving, so that the expression is log deep."""
    def count(low: int, high: int) -> Column:
        if low == high:
            return F.lit(len(cuts) - low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(cuts[middle]), count(low, middle)).otherwise(count(middle + 1, high))

    return count(0, len(cuts))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text and of the next one, and their likeness.

    Edited text: the last half of the code points, rounded down, gives way to as
    many from the start of the next document by descending doc_id.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    texts = (
        with_next(docs)
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", F.concat(
            F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
            F.substring(F.col("next_text"), F.lit(1), half),
        ))
    )
    marked = with_words(texts, F.col("edited"), "changed").select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "changed", "next"
    )
    return with_signs(marked, "own", "changed", "next").select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_text(F.col("own")).alias("fingerprint"),
        fingerprint_text(F.col("changed")).alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "next").alias("near_next"),
    )
