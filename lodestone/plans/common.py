"""How the engine's concepts lie on the test tables, and helpers of the queries.

Every document is a candidate in the pool of one benchmark item (the item that its id leaves as remainder), so
pools cover the whole corpus. A document's time is the start of 2024 and its id modulo 365 days, a question's the
start of July 2024 and its id in days; times are epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import importable

DAY = 86400
#: 2024-01-01 and 2024-07-01, in UTC.
CORPUS_START, QUESTION_START = 1704067200, 1719792000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query, question_ts)."""
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("query"), (F.lit(QUESTION_START) + F.col("item_id") * DAY).alias("question_ts"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, idx, text, ts): idx is the document's id. The number of items, one row, goes to every task."""
    n = read(spark, sf_dir, "benchmark").agg(F.count("*").alias("_n"))
    d = read(spark, sf_dir, "documents").join(F.broadcast(n))
    return d.select(F.pmod("doc_id", "_n").alias("qid"), F.col("doc_id").alias("idx"), "text", (F.lit(CORPUS_START) + F.pmod("doc_id", F.lit(365)) * DAY).alias("ts"))


#: The same in SQL, as CTEs q and p.
POOL_SQL = f"""q AS (SELECT item_id AS qid, text AS query, {QUESTION_START} + item_id * {DAY} AS question_ts FROM benchmark),
p AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS qid, doc_id AS idx, text, {CORPUS_START} + (doc_id % 365) * {DAY} AS ts FROM documents)"""


def normal_sql(x: str) -> str:
    """SQL of the answer tokens of x, as a list."""
    punctuation = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    return rf"list_filter(regexp_split_to_array(translate(lower(coalesce({x}, '')), '{punctuation}', ''), '[ \t\n\x0B\f\r]+'), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


def entities_sql(x: str) -> str:
    """SQL that decodes the entities which the test pages have."""
    for entity, by in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{by}')"
    return x


#: SQL of a page's title.
TITLE_SQL = f"""nullif(trim(regexp_replace({entities_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')), '')"""
