import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and columns with clashing names."""
    long = " ".join(f"w{i % 977} q{i}" for i in range(30000))
    copy = "a passage of text that is long enough to be found again in some other document, as it stands here"
    rows = [
        (1, copy, "en"), (2, "before it " + copy + " after it", None), (2, "before it " + copy + " after it", None),
        (3, "", "en"), (4, None, "en"), (None, copy, "de"), (5, long, "en"), (6, long + " the end", "en"),
        (7, "   \n\t ", "fr"), (8, "É́tude 漢字 ﬁ <|endoftext|> it's 12 x" + "y" * 700, "en"), (None, None, None), (9, copy.upper(), "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.selectExpr("doc_id", "text", "lang", "lang as key", "doc_id as fp", "text as x", "lang as block", "doc_id as node", "lang as bucket")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
