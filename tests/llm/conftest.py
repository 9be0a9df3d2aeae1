import pytest
from pyspark.sql import functions as F

EDGES = [
    (None, "no id at all, yet words enough for a shingle or two"),
    (None, None),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (7, "one two three"),
    (8, "One two\tthree"),
    (9, "one two three"),
    (9, "one two three"),
    (9, "another text under the same id"),
    (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 12),
    (11, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 12),
    (12, "line of text\nsecond line\n" * 40),
    (13, "Über Größe ñandú été <|endoftext|> it's 1234 　\x1c ﬁ K İ" + "x" * 300),
    (-1, "negative ids come first"),
    (1 << 40, "the cat sat on the mat and the dog lay by the door of the house " * 3000),
]


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    return df.withColumns({c: F.lit(k) for k, c in enumerate(("bucket", "key", "node", "uid", "row", "copies", "chunk", "length", "best", "sigs", "n", "h", "m", "label", "count", "score"))})


@pytest.fixture(scope="session")
def empty(edges):
    return edges.where("false")


def plain(df):
    """[(doc_id, text)] with null text as empty, by id."""
    return sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
