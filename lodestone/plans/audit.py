"""Queries of audits, eligibility, multi-table joins and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import temporal as D
from lodestone.functions import text as T
from lodestone.operators import audit as A
from lodestone.operators import pools as B
from lodestone.operators import stats as S

from .common import POOL_SQL, pool, questions, read
from .pools import _GOLD, _STALE, _gold_pool, _topical
from .retrieval import _TF, bm25_topk

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(
    f"""WITH {_GOLD}, {_STALE}, r AS (SELECT qid, count(*) AS candidates, count(*) FILTER (gold) AS gold, count(*) FILTER (NOT gold AND age BETWEEN 0 AND 30) AS fresh, count(*) FILTER (NOT gold AND age >= 30) AS old, count(*) FILTER (NOT gold AND reviewed AND age >= 30 AND overlap > 0) AS stale, list(idx ORDER BY idx) FILTER (NOT gold AND age >= 30) AS ids FROM so GROUP BY qid)
SELECT qid, candidates, gold, fresh, old, stale, coalesce(ids[:5], []) AS examples FROM r"""
)
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pool offers to the perturbations, with its first five old passages."""
    p = _gold_pool(spark, sf_dir).withColumns({"overlap": _topical(), "age": D.age_days(F.col("ts"), F.col("question_ts"))})
    free, old = ~F.col("gold"), ~F.col("gold") & (F.col("age") >= 30)
    # the five smallest ids: one more window instead of a list of all
    first = p.where(old).withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("idx"))).where("k <= 5").groupBy("qid").agg(F.array_sort(F.collect_list("idx")).alias("examples"))
    g = p.groupBy("qid").agg(
        F.count("*").alias("candidates"), F.count_if("gold").alias("gold"), F.count_if(free & F.col("age").between(0, 30)).alias("fresh"), F.count_if(old).alias("old"),
        F.count_if(old & F.col("reviewed") & (F.col("overlap") > 0)).alias("stale"),
    )
    return g.join(first, "qid", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<bigint>")))


@query(
    """WITH r AS (SELECT source, count(*) AS n, count(*) FILTER (toxic IS NULL) AS unlabelled, count(*) FILTER (quality = 1) AS good, bool_and(coalesce(quality, 1) = 1) AS all_good, list(DISTINCT lang ORDER BY lang) AS langs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source, n, unlabelled, good, all_good, langs, list_filter([CASE WHEN unlabelled > 0 THEN 'unlabelled' END, CASE WHEN NOT all_good THEN 'poor_rows' END, CASE WHEN len(langs) > 3 THEN 'mixed_languages' END], lambda x: x IS NOT NULL) AS issues FROM r"""
)
def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roll-up of several tables by source, with all issues that it has."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    g = d.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("toxic").isNull()).alias("unlabelled"), F.count_if(F.col("quality") == 1).alias("good"),
        F.bool_and(F.coalesce("quality", F.lit(1)) == 1).alias("all_good"), F.array_sort(F.collect_set("lang")).alias("langs"),
    )
    rules = {"unlabelled": F.col("unlabelled") > 0, "poor_rows": ~F.col("all_good"), "mixed_languages": F.size("langs") > 3}
    return g.withColumn("issues", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))


@query(
    """WITH t AS (SELECT r_name, n_name, c_custkey, o_orderkey, l_linenumber, s_suppkey, l_extendedprice * (1 - l_discount) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT r_name, n_name, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT s_suppkey) AS n_suppliers, round(sum(revenue), 2) AS revenue FROM t GROUP BY ALL"""
)
def four_way_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of keyed joins; the small tables are fixed dimensions and Spark broadcasts them by their size."""
    t = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.groupBy("r_name", "n_name").agg(F.count("*").alias("n_lines"), F.countDistinct("o_orderkey").alias("n_orders"), F.countDistinct("s_suppkey").alias("n_suppliers"), F.round(F.sum(revenue), 2).alias("revenue"))


@query(
    """WITH a AS (SELECT md5(text) AS k, count(*) AS x FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT md5(text) AS k, count(*) AS y FROM documents WHERE lang <> 'en' OR source = 'src0' GROUP BY 1)
SELECT k AS "key", CASE WHEN x IS NULL THEN 'only_right' WHEN y IS NULL THEN 'only_left' WHEN x > 1 THEN 'repeated_left' WHEN y > 1 THEN 'repeated_right' END AS problem FROM a FULL JOIN b USING (k) WHERE x IS NULL OR y IS NULL OR x > 1 OR y > 1"""
)
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two tables that are not one to one."""
    d = read(spark, sf_dir, "documents").withColumn("key", F.md5(F.col("text").cast("binary")))
    return A.one_to_one(d.where("lang = 'en'"), d.where("lang <> 'en' OR source = 'src0'"), "key")


@query('WITH r AS (SELECT conv_id, turn + 1 AS rank, coalesce(lag(turn + 1) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS "before" FROM conversations WHERE role <> \'assistant\') SELECT conv_id, rank, "before" FROM r WHERE rank <> "before" + 1')
def rank_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that are not in sequence."""
    r = read(spark, sf_dir, "conversations").where("role <> 'assistant'").select("conv_id", (F.col("turn") + 1).alias("rank"))
    return A.rank_gaps(r, ("conv_id",), "rank")


@query("SELECT source, count(*) AS n, count(quality) AS defined FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING count(quality) > 0 AND count(quality) < count(*)")
def undefined_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that are undefined in some systems only."""
    return A.undefined_patterns(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left"), "lang", "source", "quality")


@query(
    """WITH g AS (SELECT lang, source, avg(quality) AS m FROM labels JOIN documents USING (doc_id) GROUP BY ALL), s AS (SELECT lang, count(m) AS n, count(DISTINCT m) AS d, round(avg(m), 6) AS estimate FROM g GROUP BY lang)
SELECT lang, n, estimate, CASE WHEN n = 0 THEN 'NOT_ESTIMABLE' WHEN n < 2 THEN 'NOT_ESTIMABLE_SINGLE_QUESTION' WHEN d = 1 THEN 'DEGENERATE_EMPIRICAL_DISTRIBUTION' WHEN n < 20 THEN 'SMALL_CLUSTER_COUNT' ELSE 'APPROXIMATE' END AS status FROM s"""
)
def cluster_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over clusters, and what a bootstrap of them can say. The bootstrap itself (I3): cluster_bounds."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    g = rows.groupBy("lang", "source").agg(F.avg("quality").alias("m")).groupBy("lang").agg(F.count("m").alias("n"), F.countDistinct("m").alias("d"), F.round(F.avg("m"), 6).alias("estimate"))
    return g.select("lang", "n", "estimate", A.cluster_status(F.col("n"), F.col("d")).alias("status"))


@query()
def cluster_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over clusters with bounds from 2,000 draws of whole clusters."""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    g = rows.groupBy("lang", "source").agg(F.avg("quality").alias("m"))
    status = g.groupBy("lang").agg(A.cluster_status(F.count("m"), F.countDistinct("m")).alias("status"))
    return S.cluster_bounds(g, "m", ("lang",)).join(status, "lang")


@query(
    """WITH c AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, max(length(text)) AS longest FROM conversations GROUP BY conv_id)
SELECT turns, count(*) AS n, sum(answers)::BIGINT AS answers, CAST(max(longest) AS INT) AS longest, round(avg(answers * 1.0::DOUBLE / turns), 6) AS share FROM c GROUP BY turns"""
)
def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of counts."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max(F.length("text")).alias("longest"))
    return c.groupBy("turns").agg(F.count("*").alias("n"), F.sum("answers").alias("answers"), F.max("longest").alias("longest"), F.round(F.avg(F.col("answers") / F.col("turns")), 6).alias("share"))


@query(
    """WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders), p AS (SELECT f.o_custkey, count(*) AS pairs, avg(f.o_totalprice - o.o_totalprice) AS d FROM a f JOIN a o ON f.o_custkey = o.o_custkey AND f.o_orderstatus = 'F' AND o.o_orderstatus = 'O' GROUP BY f.o_custkey)
SELECT o_custkey, pairs, round(d + 1e-7, 4) AS delta FROM p"""
)
def control_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one condition paired with the control of the same key."""
    of = lambda status: F.when(F.col("o_orderstatus") == status, F.col("o_totalprice"))
    # the mean of all differences is the difference of the means, so no pairs are made
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count(of("F")) * F.count(of("O"))).alias("pairs"), (F.avg(of("F")) - F.avg(of("O"))).alias("d"))
    return g.where("pairs > 0").select("o_custkey", "pairs", F.round(F.col("d") + 1e-7, 4).alias("delta"))


@query(
    f"""WITH {POOL_SQL}, x AS (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY idx) AS rank FROM p), t AS (SELECT qid, list(idx ORDER BY rank) AS shown FROM x GROUP BY qid), h AS (SELECT qid, unnest(shown) AS idx, unnest(range(1, len(shown) + 1)) AS rank FROM t)
SELECT h.qid, h.idx, CAST(h.rank AS INT) AS rank, l.quality FROM h LEFT JOIN labels l ON l.doc_id = h.idx"""
)
def hits_to_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of retrieved ids, taken apart by position and joined to what is known of them."""
    x = pool(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("idx")))
    shown = x.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "idx"))), lambda s: s["idx"]).alias("shown"))
    hits = shown.select("qid", F.posexplode("shown").alias("p", "idx")).select("qid", "idx", (F.col("p") + 1).alias("rank"))
    return hits.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality"), "idx", "left")


@query(f"{_TF} SELECT r.qid, r.idx, CAST(rank AS INT) AS rank, l.quality FROM r LEFT JOIN labels l ON l.doc_id = r.idx WHERE rank <= 5")
def ranked_hits_to_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists that BM25 retrieves, taken apart by position and joined to what is known of them."""
    shown = bm25_topk(spark, sf_dir).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "idx"))), lambda s: s["idx"]).alias("shown"))
    hits = shown.select("qid", F.posexplode("shown").alias("p", "idx")).select("qid", "idx", (F.col("p") + 1).alias("rank"))
    return hits.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality"), "idx", "left")


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
SELECT o_orderkey, o_orderpriority, CASE WHEN place <= 150 THEN 'priority' ELSE 'reserve' END AS queue FROM o"""
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue within each stratum, its first 150 rows with priority."""
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, sf_dir, "orders")
    first = o.withColumn("place", F.row_number().over(w)).where("place <= 150").select("o_orderkey", F.lit("priority").alias("queue"))  # tasks keep 150 rows a stratum
    return o.join(first, "o_orderkey", "left").select("o_orderkey", "o_orderpriority", F.coalesce("queue", F.lit("reserve")).alias("queue"))


@query("""SELECT p_brand, count(*) AS items, count(DISTINCT p_type) AS kinds, CAST(count(DISTINCT p_type) * 4 * 3 * 6 AS BIGINT) AS runs, round(sum(p_size) * 0.5 / 1024, 6)::DOUBLE AS gib FROM part GROUP BY p_brand""")
def workload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs and memory that a plan of conditions, counts and systems asks for."""
    g = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("items"), F.countDistinct("p_type").alias("kinds"), F.sum("p_size").alias("s"))
    return g.select("p_brand", "items", "kinds", (F.col("kinds") * 4 * 3 * 6).alias("runs"), F.round(F.col("s") * 0.5 / 1024, 6).alias("gib"))


@query("""SELECT event_id, event_type, coalesce(CASE WHEN event_type = 'logout' THEN NULL ELSE event_type END, 'clean') AS condition, CASE event_type WHEN 'purchase' THEN 'freshness' WHEN 'view' THEN 'neutral' ELSE 'other' END AS factor FROM events""")
def condition_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their condition, clean by default, and the factor level it stands for."""
    e = read(spark, sf_dir, "events")
    condition = F.coalesce(F.when(F.col("event_type") != "logout", F.col("event_type")), F.lit("clean"))
    return e.select("event_id", "event_type", condition.alias("condition"), F.when(F.col("event_type") == "purchase", "freshness").when(F.col("event_type") == "view", "neutral").otherwise("other").alias("factor"))


_LINES = """l AS (SELECT doc_id, k, length(line) AS n, CASE WHEN k % 5 = 3 THEN 1 ELSE 0 END AS cut FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)),
sp AS (SELECT doc_id, k, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - n - 1 AS b, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - cut AS e FROM l)"""


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_spans, sum(CASE WHEN k % 5 = 3 THEN 1 ELSE 0 END) = 0 AS covered FROM sp GROUP BY doc_id")
def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: whether the spans of a document's lines cover it; every fifth line's span is cut short by its line end."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines")).select("doc_id", F.posexplode("lines").alias("k", "line"), F.aggregate("lines", F.lit(0), lambda s, x: s + F.length(x) + 1).alias("n"))
    end = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    spans = d.select("doc_id", "n", (end - F.length("line") - 1).alias("begin"), (end - F.when(F.col("k") % 5 == 3, 1).otherwise(0)).alias("end"))
    return B.span_coverage(spans, ("doc_id",), "n")


@query(
    """WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words, length(text) AS n FROM documents)
SELECT doc_id, CAST(n AS INT) AS n, n <= 1500 AND words <= 320 AS one_span, true AS whole FROM w"""
)
def span_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span chunks of every document: one where its characters and words fit, and all of them without a gap or an excess."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), A.span_chunks(F.col("text")).alias("s"))
    last = F.element_at("s", -1)["end"]
    steps = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s") - 1), lambda x, y: (y["begin"] <= x["end"]) & (y["begin"] > x["begin"]))
    sound = F.forall("s", lambda x: x["end"] - x["begin"] <= 1500) & F.forall(steps, lambda x: x) & (F.element_at("s", 1)["begin"] == 0) & (last == F.col("n"))
    return d.select("doc_id", "n", (F.size("s") == 1).alias("one_span"), sound.alias("whole"))


@query(f"WITH {POOL_SQL} SELECT qid, idx, md5('Context:' || chr(10) || substr(text, 1, 1500) || chr(10) || chr(10) || 'Question: ' || query || chr(10) || 'Answer:') AS prompt_md5 FROM p JOIN q USING (qid)")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every question with each of its candidates, as a digest."""
    both = pool(spark, sf_dir).join(questions(spark, sf_dir), "qid")
    return both.select("qid", "idx", F.md5(T.prompt(F.array(T.truncate("text")), F.col("query")).cast("binary")).alias("prompt_md5"))
