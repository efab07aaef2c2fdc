import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    return SF


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def make_docs(spark, texts, **more):
    """Documents with all columns of the table, and one with a clashing name on request."""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, value in more.items():
        df = df.withColumn(name, value)
    return df


#: Null, empty, white space, ties and repeats, and a very long text.
EDGES = [None, "", " \n\t ", "one", "one two", "one two three four five six", "one two three four five six", "word " * 50_000, "\U0001f600 é ñ ​ " * 20, "line\nline\nline"]
