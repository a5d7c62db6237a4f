import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for their own columns
    T.StructField("row", T.LongType()), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("doc", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("lang_pred", T.StringType())])

TEXTS = [
    None, "", "   \t\n ", "one", "two words", "Same text here of five words", "Same  text here\nof five words",
    "same text here of five words", "éèê ñ ß 漢字 😀", "1234 $$$ !!!", "word " * 3000, "x" * 20000, "a\x00b \x1c c\x85d e",
    "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again and again",
    "So the quick brown fox jumps over the lazy dog and runs away from the big bad wolf again and again",
]


@pytest.fixture(scope="session")
def odd_rows():
    """Odd rows: nulls in every column, empty and long texts, ties, repeats."""
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", None if t is None else len(t), i, None, 0.5, "d", "g", "xx")
            for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], rows[13]]  # repeated rows
    rows.append((None, "a text without id that is long enough", None, None, None, None, None, None, None, None, None))
    rows.append((3, "another text of id three", None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3, "text")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r.doc_id, r.text) for r in small.select("doc_id", "text").orderBy("doc_id").collect()]
