import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
CLASHING = ["rid", "g", "n", "h", "c0", "c1", "p", "f", "id", "t", "k", "__n", "__s", "__h", "key", "shard", "arc"]
PROSE = "the quick brown fox jumps over the lazy dog while seven quiet owls watch from a mossy branch and nobody counts the stars tonight because clouds hide them all"


def make(spark, rows, extra=False):
    """A documents table of (doc_id, text[, lang]) rows; with ``extra``, further columns named like our own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
    schema = DOCS
    if extra:
        schema = T.StructType([*DOCS.fields, *(T.StructField(c, T.IntegerType()) for c in CLASHING)])
        full = [(*r, *range(len(CLASHING))) for r in full]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties, repeated rows and repeated ids."""
    long = " ".join(f"word{i * 7919 % 10007}" for i in range(60000))
    return [
        (1, PROSE), (2, PROSE), (2, PROSE), (3, ""), (4, ""), (5, None), (6, None), (None, PROSE), (None, None), (7, "   \n\t "), (8, "x"), (9, "x"),
        (10, long), (11, long), (12, long[:-1] + "!"), (13, PROSE.replace("quick", "slow")), (14, "a" * 300000), (15, "!!! ??? ..."), (16, "日本語のテキスト"), (17, "another text"), (17, "a different one"),
        (18, None), (18, None), (19, "café \U0001f600 naïve"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows, extra=True)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
