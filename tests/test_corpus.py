import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import corpus as C
from tests.conftest import one


def test_candidate_text(spark):
    rows = spark.createDataFrame([("T", "x"), ("  ", "y"), (None, "z")], "t string, x string")
    assert one(rows, C.candidate_text(F.col("t"), F.col("x"))) == [("Title: T\nx",), ("y",), ("z",)]


def test_passage_problems(spark):
    rows = spark.createDataFrame([("a_1", "2010-02-03", 2010, "x"), ("a", "2009-02-03", 2010, " "), (None, None, None, None)], "i string, d string, y int, t string")
    got = [r[0] for r in rows.select(C.passage_problems(F.col("i"), F.col("d").cast("date"), F.col("y"), F.col("t"), (2009, 2011))).collect()]
    assert got == [[], ["bad_id", "day_of_other_year", "no_text"], ["bad_id", "year_outside", "day_of_other_year", "no_text"]]


def test_merge_snapshots(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert one(C.merge_snapshots([a, b], ("k",)), "k", "v", "snapshots", "agree") == [(1, "x", [0], True), (2, "y", [0, 1], False), (3, "w", [1], True)]


def test_model_slots(spark):
    rows = spark.createDataFrame([("a b",), (None,)], "t string")
    vectors = [r[0] for r in rows.select(C.batch_encoder(C.hashed_encoder(8))("t")).collect()]
    assert abs(np.linalg.norm(vectors[0]) - 1) < 1e-6 and not any(vectors[1])
    assert [r[0] for r in rows.select(C.batch_generator(lambda p: [x.upper() for x in p])("t")).collect()] == ["A B", ""]
