import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a table of documents out of (doc_id, text[, lang[, source]])."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Null, empty, without letters, repeated rows, an id that two texts share, no id, odd white space, a long text.
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "123 456 !!", None, "b"),
    (4, "Hello there, this is a text.", "en", None),
    (4, "Hello there, this is a text.", "en", None),
    (5, "Hello there,  this\tis \n\n another \x0b text. ", "fr", "c"),
    (5, "é ü ñ — ½ 中文字 🙂   x", None, "c"),
    (None, "no id at all", "en", "a"),
    (None, None, None, None),
    (6, "word " * 20_000, "en", "d"),
]


@pytest.fixture
def odd(docs):
    """ODD with extra columns whose names clash with those that the operators use."""
    from pyspark.sql import functions as F

    df = docs(ODD)
    for name in ("k", "raw", "row", "fp", "size", "taken", "rank", "label", "held_out", "spans", "h"):
        df = df.withColumn(name, F.lit(name))
    return df
