import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    long_ = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 59),
        (2, "the quick brown fox jumps over the lazy dog again and again", None, None, None),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, "   \n\t ", "en", None, 6),
        (6, long_, "en", "a", len(long_)),
        (None, "no id here at all but words", "en", "c", 27),
        (None, None, None, None, None),
        (7, "ein\u00e9 Zeile\nna\u00efve  double  blanks \U0001f600\nthird line of this text", "de", "a", 10),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("size", "node", "shard", "slot", "score", "level", "chunk", "h", "x", "part", "length", "target", "copies", "bands", "key", "uid", "block"):
        d = d.withColumn(c, F.lit("clash"))
    return d
