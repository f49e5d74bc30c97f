import pytest

#: Columns that operators use inside, with contents that would spoil them.
CLASHES = ("block", "bucket", "kind", "payload", "hash", "id", "pos", "slots", "range", "tail", "label", "key", "set_id", "score", "u", "size", "rank", "bin", "cut", "target", "toxic", "word", "sign", "tokenizer", "host", "path", "kept", "items", "level", "weight", "digest", "_id", "_found")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, blanks, repeats, one very long text, ties, odd characters; columns with clashing names."""
    base = "the idiot and the clown of the house went to the market with a basket of apples and a very long list of things"
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, " \t\n ", "en", "b"),
        (6, "one", "en", None), (7, "x " * 20_000, "en", "a"), (8, f"start {passage} end", "en", "c"), (9, f"other {passage} tail", "de", "c"),
        (10, "Ünï¢ødé \U0001f600 ẞ ﷽ " * 10, "fr", "a"), (10, "same id, other text", "fr", "a"), (11, base, "en", "a"), (11, base, "en", "a"),
        (None, "a text without an id, but with words enough", None, "d"), (None, None, None, None), (12, "a" * 500, "en", "a"), (13, "b" + "a" * 500, "en", "a"),
    ]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
