"""Documents with nulls, empty and long texts, ties, repeats and extra columns."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "fp string, a long, b long, cell long, n_tokens string, word string, kind string"
)


def edge_documents(spark):
    texts = [
        (1, "Plain words go here, and more words follow after them.", "en", "s"),
        (2, None, None, None),
        (3, "", "en", "s"),
        (4, " \t\n ", "en", "s"),
        (5, "Plain words go here, and more words follow after them.", "de", "s"),
        (5, "Plain words go here, and more words follow after them.", "de", "s"),
        (None, "no id at all in this row", "en", None),
        (7, "x" * 30_000, "en", "t"),
        (8, "many words " * 9_000, None, "s"),
        (9, "é中文 😀 <|endoftext|> ½ 12", "fr", "s"),
        (10, "!!! 123", "fr", "s"),
    ]
    rows = [(*r, len(r[1] or ""), *[None] * 7) for r in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
