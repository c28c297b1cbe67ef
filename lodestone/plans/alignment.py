"""Queries that put children back into their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import alignment as A

from .common import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# A document in three overlapping children; every seventh is periodic, so that its middle has several places, and every eleventh has a damaged middle.
_PARENT = "CASE WHEN doc_id % 7 = 0 THEN repeat(substr(text, 1, 3), 40) ELSE text END"
_CHILDREN = """SELECT doc_id, parent, substr(parent, 1, length(parent) // 2) AS a, substr(parent, length(parent) // 3, length(parent) // 3 + 2) || CASE WHEN doc_id % 11 = 0 THEN '~' ELSE '' END AS b, substr(parent, length(parent) // 2 + 1) AS c"""


@query(
    f"""WITH d AS (SELECT doc_id, {_PARENT} AS parent FROM documents WHERE length(text) >= 12), k AS ({_CHILDREN} FROM d),
w AS (SELECT doc_id, regexp_replace(parent, '[\\s\\x{{00A0}}\\x{{2028}}]', '', 'g') AS p, regexp_replace(a, '[\\s\\x{{00A0}}\\x{{2028}}]', '', 'g') AS a, regexp_replace(b, '[\\s\\x{{00A0}}\\x{{2028}}]', '', 'g') AS b, regexp_replace(c, '[\\s\\x{{00A0}}\\x{{2028}}]', '', 'g') AS c FROM k),
x AS (SELECT *, CASE WHEN a = '' OR b = '' OR c = '' OR length(b) > length(p) THEN [] ELSE list_filter(range(1, length(a) + 1), lambda s: s < length(p) - length(c) AND s + length(b) >= length(p) - length(c) AND p[s + 1:s + length(b)] = b) END AS spots FROM w)
SELECT doc_id, CASE len(spots) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS state, CAST(CASE WHEN len(spots) = 1 THEN spots[1] END AS INT) AS middle FROM x"""
)
def child_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the children of every document in their parent, if there is one way to place them all."""
    d = read(spark, sf_dir, "documents").where("length(text) >= 12")
    n = F.expr("length(parent)")
    d = d.select("doc_id", F.expr(_PARENT).alias("parent"))
    part = lambda start, length: F.substring("parent", start, length)
    half, third = F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int")
    middle = F.concat(part(third, third + 2), F.when(F.col("doc_id") % 11 == 0, "~").otherwise(""))
    found = A.alignment(F.col("parent"), F.array(part(F.lit(1), half), middle, part(half + 1, n)))
    d = d.select("doc_id", found.alias("v"))
    return d.select("doc_id", "v.state", F.get("v.starts", F.lit(1)).alias("middle"))


@query(
    """WITH d AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN repeat(substr(text, 1, 4), 20) ELSE substr(text, 1, 400) END, '') AS t FROM documents), h AS (SELECT doc_id, substr(t, 1, length(t) * 2 // 3) AS l, substr(t, length(t) // 3 + 1) AS r FROM d),
o AS (SELECT doc_id, list_filter(range(3, least(length(l), length(r)) + 1), lambda n: right(l, CAST(n AS INT)) = left(r, CAST(n AS INT))) AS ns FROM h)
SELECT doc_id, CAST(list_max(ns) AS INT) AS length, CAST(len(ns) AS INT) AS n FROM o"""
)
def stitched_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how far a document's two overlapping parts reach into each other, and in how many ways."""
    t = F.coalesce(F.when(F.col("doc_id") % 5 == 0, F.repeat(F.substring("text", 1, 4), F.lit(20))).otherwise(F.substring("text", 1, 400)), F.lit(""))
    d = read(spark, sf_dir, "documents").select("doc_id", t.alias("t")).withColumn("n", F.length("t"))
    left, right = F.substring("t", F.lit(1), F.floor(F.col("n") * 2 / 3).cast("int")), F.substring("t", F.floor(F.col("n") / 3).cast("int") + 1, F.col("n"))
    return d.select("doc_id", A.overlap(left, right, 3).alias("v")).select("doc_id", "v.length", "v.n")
