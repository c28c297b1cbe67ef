import pytest
from pyspark.sql import functions as F

#: Nulls, empty and blank texts, ties, repeats, a null id and a very long text.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away into the dark green wood", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "de", "b", 4),
    (5, "word", "en", "b", 4),
    (6, "Zwei Wörter", "de", None, 11),
    (7, "The quick brown fox jumps over the lazy dog and runs far away into the dark green wood", "en", "c", 10),
    (8, "the QUICK brown fox jumps over the lazy dog and runs far away into the dark green wood", "en", "c", 10),
    (9, "All rights reserved. " + "long text goes on " * 20000, "en", "a", 360021),
    (9, "All rights reserved. " + "long text goes on " * 20000, "en", "a", 360021),
    (None, "no id here at all", "en", "a", 17),
    (10, "é" * 3000 + " \U0001f600 token = \"0123456789abcdef0123456789abcdef01234567\" end", "xx", "d", 3060),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns whose names the operators use themselves.
CLASHES = ["size", "score", "hash", "count", "key", "range", "spans", "base", "c0", "text_", "selected", "component_id", "taken", "words", "ranks", "run"]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    return awkward.select("*", *[F.lit(1).alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 1, 0), (5, 0, 1), (9, 1, 0), (2, 0, 0), (None, 1, 1), (8, None, None), (6, 0, 1)], "doc_id bigint, quality int, toxic int")
