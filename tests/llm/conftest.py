import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


@pytest.fixture(scope="session")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").cache()


#: Nulls, empty and very long texts, ties and repeated rows; column names that operators use themselves.
ODD_TEXTS = [None, "", " ", "\n\n", "a", "one two three four", "one two three four five six", "one two three four five six",
             "ÄÖÜ ß é", "12345 !!!", "\x00nul\x00", "x" * 30_000, "word " * 20_000, "日本語のテキスト", "a  b\t\tc \r\n d"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", 1.5, "x", 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [(6, ODD_TEXTS[6], "en", 1.5, "x", 7), (None, "one two three four five six", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, token string, n long").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score double, token string, n long")
