import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox password=hunter2hunter2 jumps over it all day long", "en", "a", 5, 0, "x"),
        (1, "The quick brown fox password=hunter2hunter2 jumps over it all day long", "en", "a", 5, 0, "x"),
        (2, "", "en", None, 0, 1, "y"), (3, None, None, "b", None, 2, None), (None, "no id here but words anyway", "de", "b", 3, 3, "z"),
        (4, long, "en", "b", len(long), 4, "l"), (5, "  \t\n", "fr", "c", 4, 5, "s"), (6, "Çà et là — naïve façade 日本語 \U0001f600!", "fr", "c", 9, 6, "u"),
        (4, "same id, other text", "en", "b", 1, 7, "d"), (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hits long, row string").repartition(3)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
