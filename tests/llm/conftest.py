import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Extra columns whose names the operators use themselves.
    *[T.StructField(c, T.StringType()) for c in ("key", "n", "row", "score", "shard", "size", "a", "b", "at", "cls", "host", "n_words", "label", "piece")],
])


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text, lang, source) rows, with extra clashing columns."""

    def build(rows):
        full = [(i, t, lang, src, len(t) if t is not None else None, *["x"] * 14) for i, t, lang, src in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


EDGE = [
    (1, None, "en", "h1"), (2, "", "en", "h1"), (3, " \t\n ", None, None), (4, "one", "en", "h1"), (4, "one", "en", "h1"),
    (None, "one", "de", "h2"), (5, "long " * 30000, "en", "h2"), (6, "x" * 200000, None, "h2"), (7, "été ß 中文 🙂 <|endoftext|> a", "fr", "h3"),
    (8, "the quick brown fox jumps over the lazy dog again and again " * 6, "en", "h1"),
    (9, "the quick brown fox jumps over the lazy dog again and again " * 6, "en", "h1"),
]
