import pytest

LONG = "Wörter und words 12 " * 20_000


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and long texts, repeated rows, and names that operators use themselves."""
    rows = [
        (1, "a b c d e f g h", "en", "s1"),
        (1, "a b c d e f g h", "en", "s1"),
        (2, "a  b\tc\nd e f g h", "en", None),
        (3, None, None, None),
        (4, "", "en", "s2"),
        (5, " \n ", "fr", "s2"),
        (None, "idiot words without id", "de", "s1"),
        (None, None, None, None),
        (6, LONG, "de", "s3"),
        (7, "%%% 123 ---", "en", "s3"),
    ]
    rows = [(*r, 9, "x", 0, "y", True) for r in rows]
    names = "doc_id bigint, text string, lang string, source string, _id int, _text string, size int, score string, kept boolean"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet").cache()
