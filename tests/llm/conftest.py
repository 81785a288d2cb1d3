import pytest

pytest.importorskip("facetlens.llm")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, a very long one, ties, repeated rows, clashing extra columns, a null id."""
    rows = [
        (0, None, "x"), (1, "", "x"), (2, "   \n\t ", None), (3, "one", "y"), (3, "one", "y"), (4, "one", "z"),
        (5, "Don't  stop <|endoftext|> now, we'll see...", "z"), (6, "日本語 テキスト。　été ñandú \x85 x", "z"),
        (7, "lorem ipsum dolor sit amet " * 20_000, "long"), (8, "!!! ??? ### $$$", "y"), (None, "no id here at all", "y"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, start string")
