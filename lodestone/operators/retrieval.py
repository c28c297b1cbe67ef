"""Rankers over pools of candidates, their fusion and comparison.

A pool is a long table (qid, idx, text): one row a candidate, keyed by (qid, idx), never by text. Scores of all
pools are computed together; a pool's rows meet only in aggregates by (qid, term) that combine on the map side, so
neither a long document nor a large pool is gathered in one place before the ranking window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rank constant of reciprocal rank fusion, and the depth at which each list is cut.
RRF_K, RRF_DEPTH = 60, 20


def terms(pool: DataFrame) -> DataFrame:
    """(qid, idx, term, dl) for every space-parted token of every candidate, with the number of the candidate's tokens."""
    # the number of tokens is told before they are exploded: beside explode, texts would be split again for every token
    split = pool.select("qid", "idx", T.space_split("text").alias("tokens")).withColumn("dl", F.size("tokens"))
    return split.select("qid", "idx", "dl", F.explode("tokens").alias("term"))


def document_frequencies(pool: DataFrame) -> DataFrame:
    """(qid, term, df): a candidate's distinct tokens are told in its own row, and counts combine on the map side."""
    return pool.select("qid", F.explode(F.array_distinct(T.space_split("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("df"))


def corpus_stats(pool: DataFrame) -> DataFrame:
    """(qid, n_docs, n_tokens, avgdl, vocabulary) of each pool."""
    length = pool.groupBy("qid").agg(F.count("*").alias("n_docs"), F.sum(F.size(T.space_split("text"))).alias("n_tokens"))
    words = document_frequencies(pool).groupBy("qid").agg(F.count("*").alias("vocabulary"))
    return length.join(words, "qid").select("qid", "n_docs", "n_tokens", (F.col("n_tokens") / F.col("n_docs")).alias("avgdl"), "vocabulary")


def inverse_frequencies(pool: DataFrame, asked: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(qid, term, query_count, df, idf, avgdl) of the asked terms (qid, term, query_count) that a pool has.

    The Okapi idf within the pool; a negative one becomes epsilon times the mean over all of the pool's terms.
    """
    n = pool.groupBy("qid").agg(F.count("*").alias("n"), F.avg(F.size(T.space_split("text"))).alias("avgdl"))
    raw = document_frequencies(pool).join(n, "qid").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("qid").agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(asked, ["qid", "term"]).join(mean, "qid").select("qid", "term", "query_count", "df", idf.alias("idf"), "avgdl")


def bm25_terms(pool: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(qid, idx, term, query_count, tf, df, idf, contribution) for each query term that a candidate has.

    queries is (qid, query); a token that a query repeats counts again each time. Only tokens that the pool's query asks for
    leave the task that reads a candidate, counted: queries are few, and Spark broadcasts their terms if they are small.
    """
    asked = queries.select("qid", F.explode(T.space_split("query")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("query_count"))
    hits = terms(pool).join(asked.select("qid", "term"), ["qid", "term"]).groupBy("qid", "idx", "term", "dl").agg(F.count("*").alias("tf"))
    hits = hits.join(inverse_frequencies(pool, asked, epsilon), ["qid", "term"])
    saturation = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.select("qid", "idx", "term", "query_count", "tf", "df", "idf", (F.col("query_count") * F.col("idf") * saturation).alias("contribution"))


def bm25(pool: DataFrame, queries: DataFrame, **settings: float) -> DataFrame:
    """(qid, idx, score) of every candidate whose pool has a query; one without a common term scores 0."""
    sums = bm25_terms(pool, queries, **settings).groupBy("qid", "idx").agg(F.sum("contribution").alias("score"))
    asked = pool.join(queries.select("qid"), "qid", "left_semi").select("qid", "idx")
    return asked.join(sums, ["qid", "idx"], "left").select("qid", "idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean_pool(vectors: Column, mask: Column, width: int) -> Column:
    """The mean of the token vectors whose mask is 1, element by element; null if there is none."""
    kept = F.transform(F.filter(F.zip_with(vectors, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda x: x["m"] == 1), lambda x: x["v"])
    return F.when(
        F.size(kept) > 0, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.size(kept))
    )


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Add rank, from 1: by score to nine digits, highest first, then by idx; cut at k."""
    w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "idx")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def rank_view(scores: DataFrame) -> DataFrame:
    """Add rank, and whether another candidate of the pool has the same score."""
    ties = Window.partitionBy("qid", F.round("score", 9))
    return ranked(scores).withColumn("tied", F.count("*").over(ties) > 1)


def fuse(first: DataFrame, second: DataFrame, k: int | None = 5, depth: int = RRF_DEPTH, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings: (qid, idx, score, rank).

    Equal sums go by the rank in the first list, then by the rank in the second.
    """
    a = first.where(F.col("rank") <= depth).select("qid", "idx", F.col("rank").alias("a"))
    b = second.where(F.col("rank") <= depth).select("qid", "idx", F.col("rank").alias("b"))
    both = a.join(b, ["qid", "idx"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", part("a") + part("b"))
    w = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), F.coalesce("a", 1000 + F.col("b")))
    out = both.select("qid", "idx", "score", F.row_number().over(w).alias("rank"))
    return out if k is None else out.where(F.col("rank") <= k)


def lexical_score(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the query's tokens in the text."""
    return F.round(T.overlap(T.alnum_tokens(query), T.alnum_tokens(text)), 9)


def rerank(rows: DataFrame, pool: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_score, k: int | None = None) -> DataFrame:
    """Order a ranking anew by scorer(query, text), stable: equal scores keep their order. (qid, idx, score, rank)."""
    with_text = rows.select("qid", "idx", F.col("rank").alias("before")).join(pool, ["qid", "idx"]).join(queries, "qid")
    scored = with_text.select("qid", "idx", "before", scorer(F.col("query"), F.col("text")).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "before")
    out = scored.select("qid", "idx", "score", F.row_number().over(w).alias("rank"))
    return out if k is None else out.where(F.col("rank") <= k)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, idx, score_delta, rank_delta): null where a candidate is in one ranking only."""
    b, a = before.select("qid", "idx", F.col("score").alias("s0"), F.col("rank").alias("r0")), after.select("qid", "idx", F.col("score").alias("s1"), F.col("rank").alias("r1"))
    return a.join(b, ["qid", "idx"], "full_outer").select("qid", "idx", (F.col("s1") - F.col("s0")).alias("score_delta"), (F.col("r1") - F.col("r0")).alias("rank_delta"))
