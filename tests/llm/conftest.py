import pytest


@pytest.fixture(scope="session")
def docs_folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts and sources, empty and blank texts, repeated rows and ids, ties, a very long text, columns that clash
    with the operators' own."""
    long_text = " ".join(f"word{i % 997} next{i % 83}" for i in range(40_000))
    same = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    rows = [
        (1, same, "en", "a"), (2, same, "en", "a"), (2, same, "en", "a"), (3, same + " today", "en", None), (4, None, None, None), (5, "", "de", "b"),
        (6, " \n\t ", "fr", "b"), (7, "1 2 3 !!", "en", ""), (8, long_text, "en", "a"), (9, long_text + " end", "de", "a"), (None, same, "en", "c"),
        (None, "nur ein Satz", "de", "c"), (10, "mail me at jo@ex.org or +1 (588) 555-1833 from 10.0.0.1 card 4111 1111 1111 1111", "en", "é"), (11, "x" * 300_000, "en", "é"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    clash = ["size", "target", "taken", "shard", "slot", "score", "spans", "lang_pred", "n_email", "component_id", "offset", "length", "piece", "rank", "block", "fp"]
    return df.selectExpr("*", *[f"cast(1 as int) as {c}" for c in clash])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
