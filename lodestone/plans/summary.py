"""Queries that sum up attacked runs, and identities bound to content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import identity as I
from lodestone.operators import analysis as A
from lodestone.operators import corpus as C
from lodestone.operators import retrieval as R
from lodestone.operators import stats as S

from .analysis import _RATED, _binomial_sql, _rated
from .common import DAY, POOL_SQL, pool, questions, read
from .corpus import _encoded_sql
from .pools import _GOLD, _gold_pool
from .retrieval import _TF

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Attacked runs on order lines: condition and system from the order, outcomes and ranks from the line.
_RUNS = """runs AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'fabricated_fresh' WHEN '2-HIGH' THEN 'duplicate_fresh' WHEN '3-MEDIUM' THEN 'future_date' ELSE 'other' END AS condition, o_orderstatus AS system, l_orderkey * 8 + l_linenumber AS id, o_orderpriority <> '3-MEDIUM' AS applicable,
 CASE WHEN l_returnflag = 'R' THEN l_linenumber % 3 ELSE 0 END AS n_selected, CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 > 0 THEN l_suppkey % 5 + 1 END AS best_rank, CASE WHEN l_orderkey % 3 = 0 THEN 'OTHER_WRONG' ELSE 'CORRECT' END AS clean,
 CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' AND l_partkey % 50 = 0 THEN NULL WHEN l_partkey % 4 = 0 THEN 'POISON_ADOPTED' WHEN l_partkey % 4 = 1 THEN 'OTHER_WRONG' ELSE 'CORRECT' END AS attacked, l_suppkey % 2 = 0 AS gold_clean, l_suppkey % 6 = 0 AS gold_attacked,
 CASE WHEN l_partkey % 7 > 0 THEN l_discount END AS f1_clean, CASE WHEN l_partkey % 5 > 0 THEN l_tax END AS f1_attacked, CAST(l_orderkey % 3 > 0 AS INT) AS em_clean, CAST(l_partkey % 4 > 1 AS INT) AS em_attacked, l_partkey % 9 = 0 AS answer_changed FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n, k = F.col("o_orderpriority"), F.col("l_linenumber") % 3, F.col("l_partkey")
    picked = F.col("l_returnflag") == "R"
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(
        F.when(p == "1-URGENT", "fabricated_fresh").when(p == "2-HIGH", "duplicate_fresh").when(p == "3-MEDIUM", "future_date").otherwise("other").alias("condition"), F.col("o_orderstatus").alias("system"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        (p != "3-MEDIUM").alias("applicable"), F.when(picked, n).otherwise(0).alias("n_selected"), F.when(picked & (n > 0), F.col("l_suppkey") % 5 + 1).alias("best_rank"), F.when(F.col("l_orderkey") % 3 == 0, "OTHER_WRONG").otherwise("CORRECT").alias("clean"),
        F.when((p == "2-HIGH") & (F.col("o_orderstatus") == "P") & (k % 50 == 0), F.lit(None)).when(k % 4 == 0, "POISON_ADOPTED").when(k % 4 == 1, "OTHER_WRONG").otherwise("CORRECT").alias("attacked"),
        (F.col("l_suppkey") % 2 == 0).alias("gold_clean"), (F.col("l_suppkey") % 6 == 0).alias("gold_attacked"), F.when(k % 7 > 0, F.col("l_discount")).alias("f1_clean"), F.when(k % 5 > 0, F.col("l_tax")).alias("f1_attacked"),
        (F.col("l_orderkey") % 3 > 0).cast("int").alias("em_clean"), (k % 4 > 1).cast("int").alias("em_attacked"), (k % 9 == 0).alias("answer_changed"),
    )


_SHARE = "round(CASE WHEN {b} > 0 THEN ({a}) * 1.0::DOUBLE / ({b}) END, 4)"


@query(
    f"""WITH {_RUNS}, g AS (SELECT condition, system FROM (SELECT unnest(['fabricated_fresh', 'duplicate_fresh', 'future_date', 'stale_evidence', 'other']) AS condition), (SELECT DISTINCT o_orderstatus AS system FROM orders)),
c AS (SELECT condition, system, count(*) AS n, bool_and(applicable) AS ok, count(*) FILTER (n_selected > 0) AS n_selected, count(*) FILTER (clean IS NULL OR attacked IS NULL) AS n_pending, count(*) FILTER (attacked = 'POISON_ADOPTED') AS ad, count(*) FILTER (attacked = 'POISON_ADOPTED' AND n_selected > 0) AS ads, count(*) FILTER (clean = 'CORRECT') AS r0, count(*) FILTER (attacked = 'CORRECT') AS r1,
 count(*) FILTER (gold_clean) AS gc, count(*) FILTER (gold_clean AND NOT gold_attacked) AS lost, round(avg(CASE WHEN n_selected > 0 THEN best_rank END), 3) AS mean_best_rank, median(CASE WHEN n_selected > 0 THEN best_rank END)::DOUBLE AS median_best_rank, round(avg(f1_attacked - f1_clean), 4) AS f1, count(f1_attacked - f1_clean) AS f1_n FROM runs GROUP BY ALL),
j AS (SELECT g.condition, g.system, coalesce(n, 0) AS n, coalesce(ok, false) AS ok, coalesce(n_selected, 0) AS n_selected, coalesce(n_pending, 0) AS n_pending, coalesce(ad, 0) AS ad, coalesce(ads, 0) AS ads, coalesce(r0, 0) AS r0, coalesce(r1, 0) AS r1, coalesce(gc, 0) AS gc, coalesce(lost, 0) AS lost, mean_best_rank, median_best_rank, f1, coalesce(f1_n, 0) AS f1_n FROM g LEFT JOIN c USING (condition, system))
SELECT condition, system, n, n_selected, {_SHARE.format(a="n_selected", b="n")} AS selection_rate, n_pending, CASE WHEN NOT ok THEN 'not_applicable' WHEN n_pending > 0 THEN 'pending' ELSE 'defined' END AS asr_status, CASE WHEN ok AND n_pending = 0 THEN {_SHARE.format(a="ad", b="n")} END AS asr, CASE WHEN ok AND n_pending = 0 THEN {_SHARE.format(a="ads", b="n_selected")} END AS conditional_asr,
 CASE WHEN n_pending = 0 THEN {_SHARE.format(a="r0", b="n")} END AS correct_clean, CASE WHEN n_pending = 0 THEN {_SHARE.format(a="r1", b="n")} END AS correct_attacked, CASE WHEN n_pending = 0 THEN {_SHARE.format(a="r0 - r1", b="n")} END AS correctness_drop, gc AS n_gold_clean, {_SHARE.format(a="lost", b="gc")} AS displacement_rate, mean_best_rank, median_best_rank, f1, f1_n FROM j"""
)
def vulnerability_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: a cell for every condition and system, with what is pending, not applicable or undefined kept apart."""
    names = spark.createDataFrame([(c,) for c in ("fabricated_fresh", "duplicate_fresh", "future_date", "stale_evidence", "other")], "condition string")
    systems = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("system")).distinct()
    grid = systems.join(F.broadcast(names))  # five rows
    return A.vulnerability_cells(grid, _runs(spark, sf_dir), ("condition", "system"), {"f1": ("f1_clean", "f1_attacked")})


@query(
    f"""WITH {_RUNS}, c AS (SELECT id, unnest(list_filter([CASE WHEN n_selected > 0 AND em_attacked = 1 THEN 'selected_and_correct' END, CASE WHEN n_selected > 0 AND em_attacked = 0 THEN 'selected_and_wrong' END, CASE WHEN n_selected = 0 AND em_attacked = 0 THEN 'not_selected_and_wrong' END, CASE WHEN condition = 'duplicate_fresh' AND n_selected >= 2 THEN 'duplicate_amplification' END,
 CASE WHEN condition = 'future_date' AND NOT answer_changed THEN 'metadata_only_no_change' END, CASE WHEN answer_changed AND n_selected = 0 THEN 'changed_without_poison' END, CASE WHEN condition IN ('fabricated_fresh', 'duplicate_fresh') AND n_selected > 0 AND em_clean = 1 AND em_attacked = 1 THEN 'real_stays_correct' END,
 CASE WHEN condition IN ('fabricated_fresh', 'duplicate_fresh') AND n_selected > 0 AND em_clean = 1 AND em_attacked = 0 THEN 'real_harm' END, CASE WHEN condition IN ('fabricated_fresh', 'duplicate_fresh') AND n_selected > 0 AND em_clean = 0 AND em_attacked = 1 THEN 'real_coincided_with_correct' END,
 CASE WHEN condition IN ('fabricated_fresh', 'duplicate_fresh') AND n_selected = 0 AND em_clean = 1 AND em_attacked = 0 THEN 'real_not_selected_harm' END], lambda x: x IS NOT NULL)) AS category FROM runs)
SELECT category, count(*) AS n, min(id) AS first FROM c GROUP BY category"""
)
def attack_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten overlapping categories of attacked runs."""
    return A.attack_categories(_runs(spark, sf_dir), "id")


@query("SELECT lang, count(*) AS n, count(quality) AS n_judged, round(avg(quality), 6) AS accuracy FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IS NOT NULL GROUP BY GROUPING SETS ((), (lang))")
def judged_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over the verdicts that are there, overall and by kind."""
    return A.known_accuracy(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left"), "quality", "lang")


@query(f"WITH {_GOLD}, c AS (SELECT qid, count(*) FILTER (NOT gold AND (question_ts - ts) / 86400.0 BETWEEN 0 AND 30) AS k FROM pg GROUP BY qid) SELECT count(*) AS n, min(k) AS low, max(k) AS high, sum(k)::BIGINT AS total, count(*) FILTER (k = 0) AS zeros FROM c")
def duplicate_source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many recent passages the questions offer as sources, over all questions."""
    fresh = ~F.col("gold") & ((F.col("question_ts") - F.col("ts")) / DAY).between(0, 30)
    return A.spread(_gold_pool(spark, sf_dir).groupBy("qid").agg(F.count_if(fresh).alias("k")), "k")


@query("WITH a AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), b AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, a.n AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN a.n = b.n THEN k END AS validated FROM a LEFT JOIN b USING (source)")
def validated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: validated rows of a source, told only where every row of it has been looked at."""
    d = read(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source")
    return A.validated_counts(d, d.join(read(spark, sf_dir, "labels"), "doc_id").withColumn("good", F.col("quality") == 1), "source", "good")


@query(
    f"""WITH {_RATED}, g AS (SELECT lang, source, count(*) FILTER (quality = 1 AND toxic = 0) AS a, count(*) FILTER (quality = 0 AND toxic = 1) AS b FROM r GROUP BY ALL), p AS (SELECT lang, source, {_binomial_sql('least(a, b)', '(a + b)')} AS p FROM g),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p) AS k, count(*) OVER (PARTITION BY lang) AS m, row_number() OVER (ORDER BY p) AS k2, count(*) OVER () AS m2 FROM p)
SELECT lang, source, round(max(least(1.0, (m - k + 1) * p)) OVER (PARTITION BY lang ORDER BY k) + 1e-10, 6) AS within, round(max(least(1.0, (m2 - k2 + 1) * p)) OVER (ORDER BY k2) + 1e-10, 6) AS across FROM s"""
)
def holm_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tests adjusted within each language, and across all, where the family is every test there is."""
    tests = S.mcnemar(_rated(spark, sf_dir), "quality", "toxic", ("lang", "source")).select("lang", "source", "p_value")
    both = S.holm(S.holm(tests, by=("lang",)).withColumnRenamed("holm", "within")).withColumnRenamed("holm", "across")
    return both.select("lang", "source", F.round(F.col("within") + 1e-10, 6).alias("within"), F.round(F.col("across") + 1e-10, 6).alias("across"))


@query(
    f"""{_TF}, {_encoded_sql("p", "qid, idx", "text", "pv")}, {_encoded_sql("q", "qid", "query", "qv")},
es AS (SELECT p.qid, p.idx, coalesce(d, 0) AS score FROM p LEFT JOIN (SELECT pv.qid, pv.idx, sum(pv.v * qv.v) AS d FROM pv JOIN qv ON pv.qid = qv.qid AND pv.k = qv.k GROUP BY ALL) USING (qid, idx)), er AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, idx) AS rank FROM es),
hf AS (SELECT qid, idx, a.rank AS a, b.rank AS b, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score FROM (SELECT * FROM r WHERE rank <= 20) a FULL JOIN (SELECT * FROM er WHERE rank <= 20) b USING (qid, idx))
SELECT qid, idx, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM (SELECT qid, idx, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, coalesce(a, 1000 + b)) AS rank FROM hf) WHERE rank <= 5"""
)
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and the encoder's ranking, fused by reciprocal ranks."""
    encode, p, q = C.batch_encoder(C.hashed_encoder()), pool(spark, sf_dir), questions(spark, sf_dir)
    vectors = p.select("qid", "idx", encode("text").alias("v")).join(q.select("qid", encode("query").alias("w")), "qid")
    dense = vectors.select("qid", "idx", R.dot(F.col("v"), F.col("w")).alias("score"))
    return R.fuse(R.ranked(R.bm25(p, q)), R.ranked(dense)).withColumn("score", F.round("score", 9))


def _identity_sql(domain: str, *parts: str) -> str:
    return f"'{domain}:' || sha256('[\"{domain}\",' || " + " || ',' || ".join(parts) + " || ']')"


def _quoted_sql(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


_PARENT = _identity_sql(I.PARENT_SOURCE, _quoted_sql("'doc \"' || idx || '\"'"), _quoted_sql("sha256(text)"))
_QUESTION = _identity_sql(I.QUESTION, _quoted_sql("sha256('table')"), _quoted_sql("'q' || qid"))


@query(
    f"""WITH {POOL_SQL}, a AS (SELECT qid, idx, text, {_QUESTION} AS question_id, {_PARENT} AS parent_source_id FROM p WHERE text IS NOT NULL),
b AS (SELECT *, {_identity_sql(I.PARENT_OCCURRENCE, _quoted_sql("'sqa-frame-v2:x'"), _quoted_sql("question_id"), "idx")} AS parent_occurrence_id, {_identity_sql(I.CHILD, _quoted_sql("parent_source_id"), _quoted_sql("sha256(substr(text, 1, 100))"), "0", "least(length(text), 100)", _quoted_sql("sha256('config')"))} AS child_id FROM a)
SELECT qid, idx, question_id, parent_source_id, parent_occurrence_id, child_id, {_identity_sql(I.CHILD_OCCURRENCE, "qid", "idx", _quoted_sql("child_id"))} AS child_occurrence_id FROM b"""
)
def bound_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: the five content-bound identities of every candidate and its first span."""
    p = pool(spark, sf_dir).where("text IS NOT NULL")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    a = p.withColumns({"question_id": I.question_identity(digest(F.lit("table")), F.concat(F.lit("q"), F.col("qid").cast("string"))), "parent_source_id": I.parent_source_identity(F.concat(F.lit('doc "'), F.col("idx").cast("string"), F.lit('"')), digest(F.col("text")))})
    a = a.withColumns({
        "parent_occurrence_id": I.parent_occurrence_identity(F.lit("sqa-frame-v2:x"), F.col("question_id"), F.col("idx")),
        "child_id": I.child_identity(F.col("parent_source_id"), digest(F.substring("text", 1, 100)), F.lit(0), F.least(F.length("text"), F.lit(100)), digest(F.lit("config"))),
    })
    return a.select("qid", "idx", "question_id", "parent_source_id", "parent_occurrence_id", "child_id", I.child_occurrence_identity(F.col("qid"), F.col("idx"), F.col("child_id")).alias("child_occurrence_id"))
