import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, cls string, n string, key string, digest string, rank string, name string, bucket string"


def frame(spark, rows):
    """Documents of (doc_id, text) with further columns, some named like columns inside the operators."""
    return spark.createDataFrame([(i, t, "en", "src%d" % ((i or 0) % 3), len(t or ""), *"abcdefgh") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    long = " ".join("word%d" % (i * i % 977) for i in range(20_000))
    text = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark green forest today"
    return [
        (1, text), (2, text), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "Two WORDS"), (8, long), (9, long + " end"), (10, text + " ok"),
        (10, text + " ok"), (None, "no id here"), (11, "ünï çödé ßß – x 中文 \x0b\x1c"), (12, "a" * 30_000),
    ]


@pytest.fixture()
def edges(spark, edge_rows):
    return frame(spark, edge_rows)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)], "doc_id long, quality int, toxic int")
