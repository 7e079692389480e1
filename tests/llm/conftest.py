import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, n string, c string, g string, h string, entity string, norm string, kind string, lead string, made string, place string, size string, piece string, bucket string, maybe string, part string, words string"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that break things: null keys and texts, empty and very long texts, repeated rows, white space only, columns with inner names."""
    long = "alpha beta gamma delta epsilon zeta eta theta. " * 6000
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (None, "a row without a key but with a text of some words."), (4, long), (5, "one"), (6, "two words"), (6, "two words"),
        (7, "same text here for all of these rows, mail ann.b@corp.example.org now."), (8, "same text here for all of these rows, mail ann.b@corp.example.org now."),
        (8, "same text here for all of these rows, mail ann.b@corp.example.org now."), (9, "éß中文 \U0001f600 \u0000x"), (10, "12345 67890 !!! ???"), (None, None),
    ]
    return spark.createDataFrame([(i, t, "en" if t else None, None, None, *["x"] * 18) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


