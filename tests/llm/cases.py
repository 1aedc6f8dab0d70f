"""Documents with the hard cases: nulls, blanks, odd characters, long texts, ties, repeated rows."""

DOCS = [
    (1, "One two three four five six seven eight nine ten"),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "word"),
    (6, "It's HE'S «quoted» 12 3.4!! ΑΣ Σ <|endoftext|> a×b!! İ x\x1cy"),
    (6, "same id, another text"),
    (7, "repeated row of a few words here"),
    (7, "repeated row of a few words here"),
    (8, "lorem ipsum dolor sit amet " * 3000),
    (None, "no id at all"),
]


def docs(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "en", "x", 1, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, length string")


def empty(spark):
    return docs(spark, DOCS).limit(0)
