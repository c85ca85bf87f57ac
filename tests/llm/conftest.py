import pytest

pytest.importorskip("storyloom.llm")

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty, short and very long texts, repeated rows, and columns named like results."""
    long = " ".join(f"word{i % 977} the of and" for i in range(60_000))
    base = " ".join(f"tok{i}" for i in range(200))
    near = base.replace("tok50 ", "other ")
    data = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3), (5, base, "en", None, 9), (6, near, "de", "c", 9), (7, base, None, "a", 9), (8, long, "en", "a", 9), (None, "no id here", "fr", "b", 1), (9, "🙂 ünï <|im_end|> \\ \x1c", "fr", "c", 1)]
    df = spark.createDataFrame(data, DOCS)
    for c in ("size", "n_words", "shard", "score", "lang_pred", "sequence_id", "class_id"):
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
