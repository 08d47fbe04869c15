import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, blank and very long texts, repeated rows, ties, many languages."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    base = [f"The quick brown fox number {i} jumps over the lazy dog and then it walks {i * 7} miles home, said line {i}." for i in range(40)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(base)]
    rows += [
        (100, "", "en", "s0", 0), (101, None, None, None, None), (102, "   \n\t ", "de", "s1", 6), (103, long, "en", "s0", len(long)), (104, "one", "fr", None, 3),
        (105, "Élève naïve œuvre 日本語 😀 ß \u0085x y", "fr", "s2", 30), (106, base[0], "en", "s3", len(base[0])), (107, base[0] + " again", "en", "s3", 0),
        (108, "a b a b a b c\na b a b a b c\n\n### $$$", "en", "s1", 9), (None, "no id at all here", "en", "s2", 3), (3, base[3], "en", "s3", len(base[3])), (3, base[3], "en", "s3", len(base[3])),
    ]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns that bear the operators' own names."""
    from pyspark.sql import functions as F

    names = ["size", "words", "t", "row", "fp", "spans", "h", "source_size", "taken", "kept", "score", "bits", "n", "u", "v", "part", "shard", "ids", "y", "x", "bucket", "number", "copies", "anchor"]
    return docs.withColumns({k: F.lit("extra") for k in names})
