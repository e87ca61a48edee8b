import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000)) + "\n" + "x" * 50_000
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here."), (7, LONG),
        (8, "Äpfel, ßtraße!\nÄpfel, ßtraße!\n\nend"), (9, "😀 <|endoftext|> ... ###"), (10, "a b c d e f g " * 40)]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, blank and very long texts, repeated rows, a null id, clashing extra columns."""
    rows = [(i, t, None if i == 4 else "en", None if i == 2 else f"s{(i or 0) % 3}", len(t or "")) for i, t in EDGE]
    return spark.createDataFrame(rows, SCHEMA).withColumns(
        {"score": F.lit("kept?"), "node": F.lit(1), "id": F.lit(2), "k1": F.lit("x"), "ids": F.lit(3), "n": F.lit(4)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
