import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()),
                     T.StructField("size", T.StringType()), T.StructField("_kept", T.StringType()),
                     T.StructField("shard", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table, with extra columns whose names clash, from (id, text[, lang[, source]]) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None,
                 None if r[1] is None else len(r[1]), "x", "y", None, "z") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


def passage(start, words):
    return " ".join(f"word{start + i}x" for i in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows."""
    long_text = "\n".join(passage(1000 * k, 40) for k in range(300))
    return [(1, passage(0, 80), "en", "a"), (2, passage(0, 80), "en", "a"), (2, passage(0, 80), "en", "a"),
            (3, "", "fr", None), (4, None, None, "b"), (None, passage(0, 80), "en", None), (None, None, None, None),
            (5, "Ein kurzer Text.", "de", "b"), (5, "Another text, same id.", "en", "c"), (6, long_text, "en", "a"),
            (7, long_text + " end", "en", "c"), (8, " \n\t ", None, "b"), (9, "x" * 50_000, "en", "c"), (10, "one two", None, "a"),
            (11, "1234 5678 !!", None, "c")]
