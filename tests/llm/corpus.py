"""Small documents with every awkward case."""

LONG = " ".join(f"word{i % 97}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, size long, "
    "digest string, label int, _salt int, key string, words array<string>, attributes map<string,string>"
)


def rows():
    """Nulls in each column, empty and long texts, ties, repeated rows and ids, and columns
    that carry names the operators use themselves."""
    texts = [
        (1, "the same text here", "en", "a"), (2, "the  same\ttext here", "en", "a"), (3, None, None, None), (4, "", "en", "b"),
        (5, "   ", None, "b"), (6, LONG, "en", "a"), (6, LONG, "en", "a"), (7, "12 34 %%", "en", "c"), (None, "no id at all", "en", "c"),
        (None, "no id at all", "en", "c"), (9, "der die das und ist nicht", "de", "b"), (9, "an other text under one id", "en", None),
        (10, f"before one {PASSAGE} after one", "en", "a"), (11, f"start two {PASSAGE} end two", "en", "a"),
        (12, f"{PASSAGE} {PASSAGE}", "en", "b"), (13, "The Same Text Here", "en", "b"), (14, "naïve <|endoftext|> ▁x y \U0001f600\n\n  z", "fr", "a"),
        (100, f"query words {PASSAGE}", "en", "c"), (200, None, "en", "a"), (15, "the same text here", "en", "z"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "r", None, 3, "d", None, 1, None, [], {"a": "b"}) for i, t, lang, s in texts]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
