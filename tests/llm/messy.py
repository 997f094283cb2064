import pytest

#: Nulls, empty and blank texts, copies, near copies, ties and clashing names.
LONG = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, None, "en", "src/a.env", 0),
    (2, "", "en", None, 0),
    (3, " \t\n", None, "b", 3),
    (4, "one two", "en", "b", 7),
    (5, "One\nTwo", "en", "b", 7),
    (6, LONG, "en", "b", None),
    (7, LONG + " tail", "en", "b", 1),
    (8, LONG.replace("w30", "x"), "en", "b", 1),
    (9, LONG, "en", "b", 1),
    (9, LONG, "en", "b", 1),
    (10, 'Here token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ends. Licensed under the Apache License, Version 2.0.', "en", "x/test.py", 1),
    (11, "naïve Ünïcode ß 日本語 <|endoftext|> [INST] \\ </s> " * 3, "de", "b", 1),
    (None, "a null id", "en", "b", 1),
    (12, "word " * 30_000, "en", "b", 150_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """The messy table, with extra columns whose names clash with those that
    operators make."""
    extra = ", digest string, score double, kept boolean, row_id long, component string"
    return spark.createDataFrame([(*r, "d", 0.5, True, 7, "c") for r in ROWS], SCHEMA + extra).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
