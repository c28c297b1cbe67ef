"""Queries of rankers, fusion, relevance and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import metrics as M
from lodestone.operators import retrieval as R

from .common import POOL_SQL, normal_sql, pool, questions, read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TF = f"""WITH {POOL_SQL},
t AS (SELECT qid, idx, unnest(string_split(text, ' ')) AS term FROM p),
tf AS (SELECT qid, idx, term, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT qid, idx, len(string_split(text, ' ')) AS dl FROM p),
st AS (SELECT qid, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY qid),
df AS (SELECT qid, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT qid, term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df JOIN st USING (qid)),
idf AS (SELECT qid, term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY qid) ELSE raw END AS idf FROM raw),
qt AS (SELECT qid, unnest(string_split(query, ' ')) AS term FROM q),
qc AS (SELECT qid, term, count(*) AS query_count FROM qt GROUP BY ALL),
h AS (SELECT qid, idx, term, query_count, tf, df, idf, query_count * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS contribution
      FROM tf JOIN qc USING (qid, term) JOIN idf USING (qid, term) JOIN dl USING (qid, idx) JOIN st USING (qid)),
s AS (SELECT p.qid, p.idx, coalesce(sum(contribution), 0) AS score FROM p LEFT JOIN h USING (qid, idx) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, idx) AS rank FROM s)"""


@query(f"{_TF} SELECT qid, idx, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every question by BM25."""
    scores = R.bm25(pool(spark, sf_dir), questions(spark, sf_dir))
    return R.ranked(scores, 5).withColumn("score", F.round("score", 6))


@query(f"{_TF} SELECT qid, idx, term, query_count, tf, df, round(idf, 6) AS idf, round(contribution, 6) AS contribution FROM h")
def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every query term adds to a candidate's score."""
    out = R.bm25_terms(pool(spark, sf_dir), questions(spark, sf_dir))
    return out.withColumns({"idf": F.round("idf", 6), "contribution": F.round("contribution", 6)})


@query(f"{_TF} SELECT qid, st.n AS n_docs, n_tokens, round(avgdl, 6) AS avgdl, vocabulary FROM st JOIN (SELECT qid, sum(dl)::BIGINT AS n_tokens FROM dl GROUP BY qid) USING (qid) JOIN (SELECT qid, count(*) AS vocabulary FROM df GROUP BY qid) USING (qid)")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, lengths and vocabulary of every pool."""
    return R.corpus_stats(pool(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"{_TF} SELECT qid, idx, round(score, 6) AS score, rank, count(*) OVER (PARTITION BY qid, round(score, 9)) > 1 AS tied FROM r")
def rank_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's rank and whether its score is tied."""
    return R.rank_view(R.bm25(pool(spark, sf_dir), questions(spark, sf_dir))).withColumn("score", F.round("score", 6))


_ALNUM = "list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(lower({x}), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> ''), lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda t: length(t) >= 3))"
_OVERLAP = (
    f"o AS (SELECT p.qid, p.idx, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) * 1.0::DOUBLE / len(a) END AS overlap FROM "
    f"(SELECT qid, {_ALNUM.format(x='query')} AS a FROM q) x JOIN (SELECT qid, idx, {_ALNUM.format(x='text')} AS b FROM p) p USING (qid)),\n"
    "l AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(overlap, 9) DESC, idx) AS rank FROM o)"
)


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pool(spark, sf_dir).join(questions(spark, sf_dir), "qid")
    return both.select("qid", "idx", T.overlap(T.alnum_tokens("query"), T.alnum_tokens("text")).alias("score"))


@query(f"WITH {POOL_SQL}, {_OVERLAP} SELECT qid, idx, round(overlap, 6) AS score, rank FROM l WHERE rank <= 5")
def overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the share of the question's tokens that they have."""
    return R.ranked(_overlaps(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


_FUSED = f"""{_TF}, {_OVERLAP},
f AS (SELECT qid, idx, a.rank AS a, b.rank AS b, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score
      FROM (SELECT * FROM r WHERE rank <= 20) a FULL JOIN (SELECT * FROM l WHERE rank <= 20) b USING (qid, idx)),
u AS (SELECT qid, idx, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, coalesce(a, 1000 + b)) AS rank FROM f)"""


@query(f"{_FUSED} SELECT qid, idx, round(score, 9) AS score, rank FROM u WHERE rank <= 5")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and the overlap ranker, fused by reciprocal ranks."""
    p, q = pool(spark, sf_dir), questions(spark, sf_dir)
    return R.fuse(R.ranked(R.bm25(p, q)), R.ranked(_overlaps(spark, sf_dir))).withColumn("score", F.round("score", 9))


@query(f"{_FUSED}, v AS (SELECT u.qid, u.idx, u.rank AS before, round(o.overlap, 9) AS score FROM u JOIN o USING (qid, idx)) SELECT qid, idx, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM v")
def rerank_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused lists, ordered anew by a scorer that sees question and text."""
    p, q = pool(spark, sf_dir), questions(spark, sf_dir)
    fused = R.fuse(R.ranked(R.bm25(p, q)), R.ranked(_overlaps(spark, sf_dir)), k=None)
    return R.rerank(fused, p, q.select("qid", "query"))


@query(f"{_TF}, {_OVERLAP} SELECT qid, idx, round(l.overlap - r.score, 6) AS score_delta, CAST(l.rank - r.rank AS INT) AS rank_delta FROM r FULL JOIN l USING (qid, idx)")
def rank_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How scores and ranks move from one ranker to the other."""
    out = R.compare(R.ranked(R.bm25(pool(spark, sf_dir), questions(spark, sf_dir))), R.ranked(_overlaps(spark, sf_dir)))
    return out.withColumn("score_delta", F.round("score_delta", 6))


_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


@query(
    f"""WITH v AS (SELECT label AS qid, vec_id AS idx, embedding, min(vec_id) OVER (PARTITION BY label) AS first FROM embeddings),
s AS (SELECT v.qid, v.idx, {_DOT.format(a="v.embedding", b="w.embedding")} AS score FROM v JOIN v w ON w.qid = v.qid AND w.idx = w.first WHERE v.idx <> v.first),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, idx) AS rank FROM s) SELECT qid, idx, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""
)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every label, the first vector asks and all others are its pool; best by inner product."""
    v = read(spark, sf_dir, "embeddings")
    first = v.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    asked = v.join(first, ["label", "vec_id"]).select("label", F.col("vec_id").alias("asker"), F.col("embedding").alias("query"))
    scores = v.join(F.broadcast(asked), "label").where("vec_id <> asker")  # one row a label
    return R.ranked(scores.select(F.col("label").alias("qid"), F.col("vec_id").alias("idx"), R.dot(F.col("embedding"), F.col("query")).alias("score")), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, round(sqrt({_DOT.format(a='embedding', b='embedding')}), 6) AS norm, CAST(len(embedding) AS INT) AS width FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every vector."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(R.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("width"))


# --- relevance and answers -------------------------------------------------------------------------------

_RELEVANT = f"""g AS (SELECT p.qid, p.idx, p.ts, q.question_ts, {normal_sql("p.text")} AS have, {normal_sql("q.query")} AS need FROM p JOIN q USING (qid)),
rel AS (SELECT *, CASE WHEN len(need) > 0 AND len(list_intersect(list_distinct(need), have)) = len(list_distinct(need)) THEN 1 ELSE 0 END AS by_tokens,
        CASE WHEN len(need) > 0 AND contains(' ' || array_to_string(have, ' ') || ' ', ' ' || array_to_string(need, ' ') || ' ') THEN 1 ELSE 0 END AS by_phrase FROM g)"""


def _relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, idx, ts, question_ts, by_tokens, by_phrase): each question's own text is its gold answer."""
    both = pool(spark, sf_dir).join(questions(spark, sf_dir), "qid")
    golds = F.array("query")
    return both.select("qid", "idx", "ts", "question_ts", M.relevant_by_tokens(golds, F.col("text")).alias("by_tokens"), M.relevant_by_phrase(golds, F.col("text")).alias("by_phrase"))


@query(f"WITH {POOL_SQL}, {_RELEVANT} SELECT qid, idx, by_tokens, by_phrase FROM rel")
def relevance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each candidate holds its question's answer, by tokens and by phrase."""
    return _relevance(spark, sf_dir).select("qid", "idx", "by_tokens", "by_phrase")


_TURNS = """t AS (SELECT conv_id, turn, role, text AS prediction, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations)"""


@query(
    f"""WITH {_TURNS}, n AS (SELECT conv_id, turn, {normal_sql("prediction")} AS p, {normal_sql("gold")} AS g FROM t WHERE role = 'assistant' AND gold IS NOT NULL),
x AS (SELECT conv_id, turn, tok, count(*) AS c FROM (SELECT conv_id, turn, unnest(p) AS tok FROM n) GROUP BY ALL),
y AS (SELECT conv_id, turn, tok, count(*) AS c FROM (SELECT conv_id, turn, unnest(g) AS tok FROM n) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(x.c, y.c)) AS shared FROM x JOIN y USING (conv_id, turn, tok) GROUP BY ALL)
SELECT n.conv_id, n.turn, CASE WHEN array_to_string(p, ' ') = array_to_string(g, ' ') THEN 1 ELSE 0 END AS em,
  round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CASE WHEN len(p) = len(g) THEN 1.0 ELSE 0.0 END WHEN shared IS NULL THEN 0.0 ELSE 2.0::DOUBLE * shared / (len(p) + len(g)) END, 6)::DOUBLE AS f1
FROM n LEFT JOIN s USING (conv_id, turn)"""
)
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2: every assistant turn against the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = read(spark, sf_dir, "conversations").withColumn("gold", F.lag("text").over(w)).where("role = 'assistant' AND gold IS NOT NULL")
    golds = F.array("gold")
    return t.select("conv_id", "turn", M.exact_match(F.col("text"), golds).alias("em"), F.round(M.best_f1(F.col("text"), golds), 6).alias("f1"))


_RANKED = f"{_TF}, {_RELEVANT}, m AS (SELECT rel.qid, rel.idx, r.rank, by_tokens AS relevant, rel.ts <= rel.question_ts AS valid FROM rel JOIN r USING (qid, idx))"
_METRICS = """k AS (SELECT qid, sum(relevant) AS n, sum(CASE WHEN rank <= 5 THEN relevant ELSE 0 END) AS hits, sum(CASE WHEN rank <= 5 AND relevant = 1 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg,
  avg(CASE WHEN rank <= 5 AND valid IS NOT NULL THEN CASE WHEN valid THEN 0 ELSE 1 END END) AS violating, sum(CASE WHEN relevant = 1 AND valid THEN 1 ELSE 0 END) AS good, sum(CASE WHEN rank <= 5 AND relevant = 1 AND valid THEN 1 ELSE 0 END) AS good_hits FROM m GROUP BY qid),
e AS (SELECT qid, CASE WHEN n > 0 THEN hits * 1.0::DOUBLE / n END AS recall, CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, CAST(least(5, greatest(n, 1)) AS BIGINT) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END AS ndcg,
  violating, CASE WHEN good > 0 THEN good_hits * 1.0::DOUBLE / good END AS valid_recall FROM k)"""


def _question_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = pool(spark, sf_dir), questions(spark, sf_dir)
    rel = _relevance(spark, sf_dir).select("qid", "idx", F.col("by_tokens").alias("relevant"), (F.col("ts") <= F.col("question_ts")).alias("valid"))
    return M.ranking_metrics(rel.join(R.ranked(R.bm25(p, q)).select("qid", "idx", "rank"), ["qid", "idx"]))


@query(f"{_RANKED}, {_METRICS} SELECT qid, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(violating, 6) AS violating, round(valid_recall, 6) AS valid_recall FROM e")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 to M6, M8: recall, nDCG and the time metrics of every question's ranking; undefined ones are null."""
    names = ("recall", "ndcg", "violating", "valid_recall")
    return _question_metrics(spark, sf_dir).select("qid", *[F.round(m, 6).alias(m) for m in names])


@query(
    f"{_RANKED}, {_METRICS} SELECT count(*) AS n, round(avg(recall), 6) AS avg_recall, count(recall) AS n_defined_recall, round(avg(ndcg), 6) AS avg_ndcg, count(ndcg) AS n_defined_ndcg, "
    "round(avg(violating), 6) AS avg_violating, count(violating) AS n_defined_violating, round(avg(valid_recall), 6) AS avg_valid_recall, count(valid_recall) AS n_defined_valid_recall FROM e"
)
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: means over the questions for which a metric is defined."""
    return M.summarize(_question_metrics(spark, sf_dir), ("recall", "ndcg", "violating", "valid_recall"))


@query(
    f"""WITH {POOL_SQL}, {_RELEVANT} SELECT qid, question_ts, count(*) AS used, CAST(CASE WHEN count(*) FILTER (ts IS NULL) > 0 THEN NULL ELSE max(by_phrase) * CAST(bool_and(ts <= question_ts) AS INT) END AS INT) AS accuracy FROM rel GROUP BY ALL"""
)
def time_valid_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: whether a question's pool holds the answer and all of it is valid in time."""
    rel = _relevance(spark, sf_dir)
    g = rel.groupBy("qid", "question_ts").agg(F.count("*").alias("used"), F.max("by_phrase").alias("em"), F.count_if(F.col("ts").isNull()).alias("unknown"), F.bool_and(F.col("ts") <= F.col("question_ts")).alias("valid"))
    return g.select("qid", "question_ts", "used", M.time_valid_accuracy(F.col("em"), F.col("question_ts"), F.col("unknown"), F.col("valid")).alias("accuracy"))


@query(f"WITH d AS (SELECT doc_id, lang, {normal_sql('text')} AS t FROM documents) SELECT doc_id, md5(array_to_string(t, ' ')) AS normal_md5, CAST(len(t) AS INT) AS n_tokens FROM d")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of every document, as a digest, and its tokens."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_answer("text").cast("binary")).alias("normal_md5"), F.size(T.answer_tokens("text")).alias("n_tokens"))


@query(
    f"""WITH {_TURNS}, n AS (SELECT conv_id, turn, role, len({normal_sql("prediction")}) AS n FROM t) SELECT role, count(*) AS n, round(avg(n), 6) AS avg_tokens, count(n) AS n_defined_tokens FROM n GROUP BY role"""
)
def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: a summary for each label of the rows."""
    c = read(spark, sf_dir, "conversations").select("role", F.size(T.answer_tokens("text")).alias("tokens"))
    return M.summarize(c, ("tokens",), ("role",))
