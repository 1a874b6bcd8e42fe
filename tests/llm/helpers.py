"""Small frames with what the operators must bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, clash=()):
    """(doc_id, text, lang, source) rows, with n_chars and further columns named as in ``clash``."""
    full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    for name in clash:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def odd(long_text="word " * 30_000):
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, long_text, "en", "b"),
        (5, "the same text twice here", "en", "b"), (6, "the same text twice here", "en", "b"),
        (6, "the same text twice here", "en", "b"), (None, "no id at all", "en", "a"), (2**60 + 1, "Ünï çødé 漢字 😀", None, "ü"),
    ]
