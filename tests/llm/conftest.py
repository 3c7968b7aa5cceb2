import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"w{i % 700} tail" for i in range(30_000))
    rows = [(i, f"the cat number {i % 7} sat on\tthe  mat {'x' * (i % 5)}", "en", "src0") for i in range(60)]
    rows += [(100, None, "en", "src1"), (101, "", None, "src1"), (102, "   ", "en", None), (103, long, "en", "src0"),
             (104, long + " ", "en", "src0"), (None, "no id here", "fr", "src2"), (105, "Le chat est là", "fr", "src2"),
             (105, "Le chat est là", "fr", "src2"), (106, "one two　 three <|endoftext|>", "fr", "src2"),
             (107, "12 34 !!", "fr", "src0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # columns that share names with results and with intermediate tables
    return df.selectExpr("*", "1 as n_chars", "'q' as shard", "2 as length", "3 as print", "4 as key", "5 as tokens",
                         "6 as epoch", "7 as score", "8 as size", "9 as row").repartition(3)


@pytest.fixture(scope="session")
def plain(documents):
    return [tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()]
