import pytest

LONG = "doc_id long, text string"

#: Nulls, empty and white texts, ties, repeated rows, one long text.
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (None, "alone here with no id at all"), (4, "same words here now"),
    (5, "same  words here\nnow"), (5, "same  words here\nnow"), (6, "same words here now"),
    (7, "word " * 20_000), (None, None), (8, "x"), (9, "é ü 漢字 " * 50),
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with columns whose names operators use themselves."""
    frame = spark.createDataFrame(ODD, LONG)
    for name in ("fp", "digest", "_key", "_gone", "_leak", "_score", "_text", "n", "words"):
        frame = frame.selectExpr("*", f"'{name}' as {name}")
    return frame


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], LONG)
