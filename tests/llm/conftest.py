import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """documents with nulls, empty and very long texts, repeated rows, and clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(0, "alpha beta gamma\ndelta epsilon", "en", "s0", 30, "x"), (1, None, None, None, None, None),
            (2, "", "en", "", 0, "x"), (3, long, "en", "s0", len(long), "x"), (4, long, "en", "s1", len(long), None),
            (None, "no id at all here", "en", "s0", 17, "x"), (0, "alpha beta gamma\ndelta epsilon", "en", "s0", 30, "x"),
            (5, "  \n \t ", "en", "s0", 6, "x"), (6, "x" * 50_000, "en", "s0", 50_000, "x"),
            (7, "tie tie tie", "en", "s0", 11, "x"), (8, "tie tie tie", "en", "s0", 11, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
