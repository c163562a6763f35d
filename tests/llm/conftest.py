import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """doc_id, text and columns that clash with what operators use inside; nulls, empty and long texts, ties and repeated rows."""
    words = "the harbour wall of a small town was built with stone and it is the oldest part that we have seen in this country for years".split()
    base = " ".join(words * 6)
    near = base.replace("oldest", "newest", 1)
    rows = [
        (1, base, "x"), (2, base, "y"), (3, near, None), (4, "", "z"), (5, None, "z"), (6, "one two", "q"), (7, "ONE  two", "q"), (8, "word " * 20000, "q"),
        (9, "Released under the MIT License.\nunrelated other things here and there", "q"), (10, "你好，世界。再见", None), (11, "\n\t  \n", "q"), (6, "one two", "q"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, n string").withColumnRenamed("n", "key").selectExpr("*", "1 AS rank", "'c' AS component_id", "0 AS ids")
