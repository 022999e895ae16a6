import pytest

TEXT = "The quick brown fox jumps over the lazy dog while seven wizards mix strange potions in old iron pots"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, ties, and extra
    columns whose names the operators use themselves."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [
        (1, TEXT, "en", "a"), (2, TEXT, "en", "a"), (2, TEXT, "en", "a"), (3, "", "en", "b"), (4, None, None, None), (None, TEXT + " more", "en", "b"), (None, None, None, "a"),
        (5, " \t\n ", "en", None), (6, long, "en", "c"), (7, "x" * 20_000, "en", "c"), (8, "né <s> </s> <|endoftext|> ▁ \x00 日本語 Σ", "de", "c"), (9, "# * $ % \r\n\r\n# * $ %  ", "en", "a"),
    ]
    extra = [(*r, 1, 2.0, "z", 0, 7) for r in rows]
    names = "doc_id long, text string, lang string, source string, size int, score double, h string, shard int, n_tokens int"
    return spark.createDataFrame(extra, names)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
