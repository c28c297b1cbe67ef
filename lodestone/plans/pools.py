"""Queries over time, pools, chunks and perturbations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import temporal as D
from lodestone.functions import text as T
from lodestone.operators import perturb as P
from lodestone.operators import pools as B
from lodestone.operators import retrieval as R
from lodestone.operators import temporal as E

from .common import CORPUS_START, DAY, POOL_SQL, pool, questions, read
from .retrieval import _ALNUM, _TF

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {POOL_SQL} SELECT qid, idx, ts <= question_ts AS valid, round((question_ts - ts) / 86400.0, 6)::DOUBLE AS age_days, CASE WHEN ts // 86400 < question_ts // 86400 THEN 'PRIOR' WHEN ts // 86400 > question_ts // 86400 THEN 'FUTURE' ELSE 'SAME_DATE_UNCERTAIN' END AS chronology FROM p JOIN q USING (qid)")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity, age and chronology of every candidate."""
    both = pool(spark, sf_dir).join(questions(spark, sf_dir), "qid")
    return both.select("qid", "idx", D.time_valid(F.col("ts"), F.col("question_ts")).alias("valid"), F.round(D.age_days(F.col("ts"), F.col("question_ts")), 6).alias("age_days"), D.chronology(F.col("ts"), F.col("question_ts")).alias("chronology"))


@query(
    f"""WITH {POOL_SQL}, k AS (SELECT qid, greatest(1, CAST(ceil(abs((ts - question_ts) / 86400.0) / 7) AS INT)) AS k FROM p JOIN q USING (qid)),
c AS (SELECT qid, k, count(*) AS c FROM k WHERE k <= 8 GROUP BY ALL), s AS (SELECT qid, k, CAST(sum(c) OVER (PARTITION BY qid ORDER BY k) AS BIGINT) AS n FROM c)
SELECT qid, CAST(coalesce(min(k) FILTER (n >= 5), 8) * 7 AS INT) AS radius, coalesce(min(n) FILTER (n >= 5), max(n)) AS n FROM s GROUP BY qid"""
)
def adaptive_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date window that widens by weeks until it holds five candidates."""
    both = pool(spark, sf_dir).join(questions(spark, sf_dir), "qid")
    return E.widening_window(both, (F.col("ts") - F.col("question_ts")) / DAY, need=5)


_ORDERS = "o AS (SELECT o_custkey, CAST(epoch(o_orderdate) AS BIGINT) AS start, CAST(epoch(o_orderdate) AS BIGINT) + 56 * 86400 AS e, o_orderkey FROM orders)"
_ISLANDS = f"""{_ORDERS},
m AS (SELECT *, CASE WHEN max(e) OVER w IS NULL OR start > max(e) OVER w THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY o_custkey ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m),
i AS (SELECT o_custkey, island, min(start) AS start, max(e) AS e, count(*) AS n FROM s GROUP BY ALL)"""


def _seconds(c: str) -> Column:
    """Epoch seconds as the SQL of islands takes them, rounded and a half to the even second."""
    return F.rint(F.unix_micros(F.col(c).cast("timestamp")) / 1e6).cast("bigint")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    start = _seconds("o_orderdate")
    return o.select("o_custkey", start.alias("start"), (start + 56 * DAY).alias("end"))


@query(f'WITH {_ISLANDS} SELECT o_custkey, island, start, e AS "end", n FROM i')
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention windows of 56 days after each order, merged by customer."""
    return E.merge_intervals(_intervals(spark, sf_dir), ("o_custkey",))


@query(
    f"""WITH {_ISLANDS}, l AS (SELECT l_orderkey, l_linenumber, o_custkey, CAST(epoch(l_shipdate) AS BIGINT) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l.o_custkey, count(*) AS n_kept FROM l JOIN i ON i.o_custkey = l.o_custkey AND l.ts BETWEEN i.start AND i.e GROUP BY l.o_custkey"""
)
def interval_union_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that were shipped within a retention window of their customer."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), _seconds("l_shipdate").alias("ts")).join(o, "o_orderkey")
    merged = E.merge_intervals(_intervals(spark, sf_dir), ("o_custkey",))
    return E.within(lines, merged, "ts", ("o_custkey",)).groupBy("o_custkey").agg(F.count("*").alias("n_kept"))


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type, value FROM events), l AS (SELECT * FROM e WHERE event_type = 'purchase'), r AS (SELECT user_id, us, max(value) AS value FROM e WHERE event_type <> 'purchase' GROUP BY ALL)
SELECT l.user_id, l.event_id, round(r.value, 6) AS evidence, r.us AS evidence_us FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us >= r.us"""
)
def asof_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, §2.14: for each purchase, the user's latest other event that is not later."""
    e = read(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "us")
    right = e.where("event_type <> 'purchase'").groupBy("user_id", "us").agg(F.max("value").alias("value"))
    return E.as_of(left, right, "user_id", "us", "value").select("user_id", "event_id", F.round("value", 6).alias("evidence"), F.col("us_as_of").alias("evidence_us"))


@query(
    """WITH w AS (SELECT o_orderkey, o_orderdate - INTERVAL 56 DAY AS a, least(o_orderdate + INTERVAL 56 DAY, max(o_orderdate) OVER ()) AS z FROM orders)
SELECT o_orderkey, range(year(a), year(z) + 1) AS requested, list_filter(range(year(a), year(z) + 1), lambda y: y BETWEEN 1993 AND 1997) AS configured, list_filter(range(year(a), year(z) + 1), lambda y: y NOT BETWEEN 1993 AND 1997) AS outside FROM w"""
)
def coverage_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years that each window asks for, and which of them archives are configured for."""
    o = read(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderdate").alias("last"))
    w = o.join(F.broadcast(last)).select("o_orderkey", (F.col("o_orderdate") - F.expr("INTERVAL 56 DAY")).alias("a"), F.least(F.col("o_orderdate") + F.expr("INTERVAL 56 DAY"), F.col("last")).alias("z"))
    asked, inside, outside = E.years_covered(F.col("a"), F.col("z"), (1993, 1997))
    return w.select("o_orderkey", *[c.cast("array<bigint>").alias(n) for c, n in ((asked, "requested"), (inside, "configured"), (outside, "outside"))])


@query(
    """WITH s AS (SELECT *, CASE WHEN turn = lag(turn) OVER w + 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM s)
SELECT conv_id, role, run, min(turn) AS first_turn, count(*) AS n FROM r GROUP BY ALL"""
)
def run_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of adjacent turns of one speaker."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    breaks = ~F.coalesce(F.col("turn") == F.lag("turn").over(w) + 1, F.lit(False))
    marked = read(spark, sf_dir, "conversations").withColumn("new", breaks)
    return E.runs(marked, ("conv_id", "role"), "turn", F.col("new")).groupBy("conv_id", "role", "run").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


# --- pools -----------------------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT d.doc_id, d.source, sha2 FROM (SELECT doc_id, source, sha256('distractors|' || doc_id) AS sha2 FROM documents) d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha2, doc_id) AS draw FROM d) SELECT source, doc_id, draw FROM r WHERE draw <= 20"""
)
def distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source, 20 documents that no label calls good, in hash order."""
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    rest = read(spark, sf_dir, "documents").select("doc_id", "source").join(good, "doc_id", "left_anti")
    return B.sample(rest, 20, ("source",), "distractors", "doc_id").select("source", "doc_id", "draw")


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda t: t <> '')"
_CHUNKS = f"""c AS (SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n FROM documents),
st AS (SELECT doc_id, n, CASE WHEN n <= 320 THEN [0] ELSE list_transform(range(0, CAST(ceil((n - 320) / 256.0) AS BIGINT) + 1), lambda i: i * 256) END AS starts FROM c),
sm AS (SELECT doc_id, n, CASE WHEN len(starts) > 1 AND n - starts[-1] < 64 THEN starts[:-2] ELSE starts END AS starts FROM st),
ch AS (SELECT doc_id, n, len(starts) AS k, unnest(starts) AS b, unnest(range(len(starts))) AS no FROM sm),
cc AS (SELECT doc_id, n AS n_tokens, no AS chunk_no, b AS "begin", CASE WHEN no = k - 1 THEN n ELSE least(n, b + 320) END AS "end" FROM ch)"""


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chunks(read(spark, sf_dir, "documents").select("doc_id", "text"), T.blank_split("text"))


@query(f'WITH {_CHUNKS} SELECT doc_id, CAST(n_tokens AS INT) AS n_tokens, CAST(chunk_no AS INT) AS chunk_no, CAST("begin" AS INT) AS "begin", CAST("end" AS INT) AS "end" FROM cc')
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping token windows of every document."""
    return _chunked(spark, sf_dir).select("doc_id", "n_tokens", "chunk_no", "begin", "end")


@query(f"""WITH {_CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, round(avg("end" - "begin"), 6) AS avg_tokens, CAST(max("end" - "begin") AS INT) AS max_tokens FROM cc""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks, and how long."""
    size = F.col("end") - F.col("begin")
    return _chunked(spark, sf_dir).agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(size), 6).alias("avg_tokens"), F.max(size).alias("max_tokens"))


@query(
    f"""WITH {_CHUNKS}, k AS (SELECT * FROM cc WHERE NOT (doc_id % 3 = 0 AND chunk_no = 1)), o AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k)
SELECT doc_id, count(*) AS n_spans, count(*) FILTER ("begin" > coalesce(reach, 0)) = 0 AND max("end") >= max(n_tokens) AS covered FROM o GROUP BY doc_id"""
)
def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: whether chunks cover their document, where every third document lacks its second chunk."""
    return B.span_coverage(_chunked(spark, sf_dir).where("NOT (doc_id % 3 = 0 AND chunk_no = 1)"), ("doc_id",), "n_tokens")


@query(
    f"""WITH {POOL_SQL}, g AS (SELECT p.qid, count(*) AS n, count(l.quality) FILTER (l.quality = 1) AS n_gold, count(*) FILTER (p.text = '') AS n_empty FROM p LEFT JOIN labels l ON l.doc_id = p.idx GROUP BY p.qid),
v AS (SELECT qid, unnest(list_filter([CASE WHEN n <> 20 THEN 'size' END, CASE WHEN n_gold = 0 THEN 'no_gold' END, CASE WHEN n_gold > 8 THEN 'gold_over_cap' END, CASE WHEN n_empty > 0 THEN 'empty_text' END], lambda x: x IS NOT NULL)) AS violation FROM g) SELECT qid, violation FROM v"""
)
def pool_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every check that a question's pool fails, with its name."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality")
    g = pool(spark, sf_dir).join(labels, "idx", "left").groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_gold"), F.count_if(F.col("text") == "").alias("n_empty"))
    return B.violations(g, {"size": F.col("n") == 20, "no_gold": F.col("n_gold") > 0, "gold_over_cap": F.col("n_gold") <= 8, "empty_text": F.col("n_empty") == 0}, ("qid",))


# --- perturbations ---------------------------------------------------------------------------------------

_GOLD = f"""{POOL_SQL}, pg AS (SELECT p.qid, p.idx, p.text, p.ts, q.query, q.question_ts, coalesce(l.quality = 1, false) AS gold, coalesce(l.toxic = 0, false) AS reviewed FROM p JOIN q USING (qid) LEFT JOIN labels l ON l.doc_id = p.idx)"""


def _gold_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality", "toxic")
    both = pool(spark, sf_dir).join(questions(spark, sf_dir), "qid").join(labels, "idx", "left")
    return both.select("qid", "idx", "text", "ts", "query", "question_ts", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("gold"), F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("reviewed"))


def _slots_sql(count: int, free: str, name: str = "sl") -> str:
    return f"""{name} AS (SELECT qid, idx, slot FROM (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY sha256('seed|' || qid || '|' || idx), idx) AS slot, count(*) OVER (PARTITION BY qid) AS n FROM {free}) WHERE n >= {count} AND slot <= {count})"""


@query(f"WITH {_GOLD}, {_slots_sql(5, '(SELECT * FROM pg WHERE NOT gold)')} SELECT qid, idx, CAST(slot AS INT) AS slot FROM sl")
def nested_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of five poisons; the first one and two are those of the smaller counts."""
    return P.slots(_gold_pool(spark, sf_dir), "seed", 5).select("qid", "idx", "slot")


@query(f"WITH {_GOLD}, {_slots_sql(2, '(SELECT * FROM pg WHERE NOT gold)')} SELECT pg.qid, pg.idx, CASE WHEN slot IS NULL THEN ts ELSE greatest(ts, question_ts) + 7 * 86400 END AS ts, slot IS NOT NULL AS changed FROM pg LEFT JOIN sl USING (qid, idx)")
def attack_future_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slots of every pool, dated after the question."""
    return P.future_date(_gold_pool(spark, sf_dir), "seed", 2).select("qid", "idx", "ts", "changed")


def _copy_sql(source: str, shift: int) -> str:
    return f"""src AS (SELECT qid, idx AS source_idx, text AS new_text, ts - {shift} AS new_ts FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sha256('seed|' || qid || '|' || idx), idx) AS draw FROM {source}) WHERE draw = 1),
{_slots_sql(2, '(SELECT pg.qid, pg.idx FROM pg JOIN src USING (qid) WHERE NOT gold AND idx <> source_idx)')}
SELECT pg.qid, pg.idx, md5(CASE WHEN slot IS NULL THEN text ELSE new_text END) AS text_md5, CASE WHEN slot IS NULL THEN ts ELSE new_ts END AS ts, slot IS NOT NULL AS changed FROM pg LEFT JOIN sl USING (qid, idx) LEFT JOIN src USING (qid)"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("qid", "idx", F.md5(F.col("text").cast("binary")).alias("text_md5"), "ts", "changed")


@query(f"WITH {_GOLD}, {_copy_sql('(SELECT * FROM pg WHERE gold)', 30 * DAY)}")
def attack_wrong_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slots hold a gold text that is dated 30 days too early."""
    return _shown(P.wrong_date(_gold_pool(spark, sf_dir), "seed", 2))


@query(f"WITH {_GOLD}, {_copy_sql('(SELECT * FROM pg WHERE NOT gold AND (question_ts - ts) / 86400.0 BETWEEN 0 AND 30)', 0)}")
def attack_duplicate_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slots hold a recent passage again."""
    return _shown(P.duplicate_fresh(_gold_pool(spark, sf_dir), "seed", 2))


_STALE = f"""so AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(qt, dt)) * 1.0::DOUBLE / len(qt) END AS overlap, (question_ts - ts) / 86400.0::DOUBLE AS age FROM (SELECT *, {_ALNUM.format(x='query')} AS qt, {_ALNUM.format(x='text')} AS dt FROM pg)),
sk AS (SELECT *, max(overlap) OVER (PARTITION BY qid) AS best FROM so WHERE NOT gold AND reviewed AND age >= 30 AND overlap > 0),
ss AS (SELECT * FROM sk WHERE overlap >= greatest(0.01, best - 0.05))"""


def _topical():
    return T.overlap(T.alnum_tokens("query"), T.alnum_tokens("text"))


@query(f"WITH {_GOLD}, {_STALE} SELECT qid, idx, round(overlap, 6) AS overlap, round(age, 6) AS age FROM ss")
def stale_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: reviewed old passages on the question's topic, close to the best overlap."""
    return P.stale_sources(_gold_pool(spark, sf_dir), _topical()).select("qid", "idx", F.round("overlap", 6).alias("overlap"), F.round("age", 6).alias("age"))


@query(f"WITH {_GOLD}, {_STALE}, {_copy_sql('ss', 0)}")
def attack_stale_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: two slots hold a stale passage again."""
    return _shown(P.stale_evidence(_gold_pool(spark, sf_dir), _topical(), "seed", 2))


@query(
    f"""WITH {_GOLD}, {_slots_sql(1, '(SELECT * FROM pg WHERE NOT gold)')}
SELECT pg.qid, pg.idx, md5(CASE WHEN slot IS NULL THEN text ELSE 'Claim ' || pg.qid END) AS text_md5, CASE WHEN slot IS NULL THEN ts ELSE question_ts - 86400 END AS ts, slot IS NOT NULL AS changed FROM pg LEFT JOIN sl USING (qid, idx)"""
)
def attack_fabricated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slot holds the question's payload."""
    payloads = questions(spark, sf_dir).select("qid", F.concat(F.lit("Claim "), F.col("qid").cast("string")).alias("payload_text"), (F.col("question_ts") - DAY).alias("payload_ts"))
    return _shown(P.fabricated_fresh(_gold_pool(spark, sf_dir), payloads, "seed", 1))


@query(
    f"""WITH {_GOLD}, {_slots_sql(2, '(SELECT * FROM pg WHERE NOT gold)')}, a AS (SELECT pg.qid, pg.idx, gold, CASE WHEN slot IS NULL THEN ts ELSE greatest(ts, question_ts) + 7 * 86400 END AS ts FROM pg LEFT JOIN sl USING (qid, idx))
SELECT a.qid, a.idx, 'date' AS difference, a.gold FROM a JOIN pg ON a.qid = pg.qid AND a.idx = pg.idx WHERE a.ts <> pg.ts"""
)
def pool_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the clean pools and those with future dates: dates of slots that are no gold."""
    clean = _gold_pool(spark, sf_dir)
    return P.differences(clean, P.future_date(clean, "seed", 2))


def _effects_sql() -> str:
    """What each perturbation does to the pools, found by applying it: whether any text or date changed, and any passage is there twice."""
    gold, fresh = "(SELECT * FROM pg WHERE gold)", "(SELECT * FROM pg WHERE NOT gold AND (question_ts - ts) / 86400.0 BETWEEN 0 AND 30)"
    change = "SELECT '{0}' AS condition, coalesce(bool_or({1}), false) AS text_changed, coalesce(bool_or({2}), false) AS date_changed FROM ({3})"
    copied = lambda source, shift: f"SELECT pg.text, pg.ts, CASE WHEN slot IS NULL THEN text ELSE new_text END AS t1, CASE WHEN slot IS NULL THEN ts ELSE new_ts END AS s1 FROM pg LEFT JOIN sl USING (qid, idx) LEFT JOIN src USING (qid)"
    parts = []
    for name, source, shift in (("correct_content_wrong_date", gold, 30 * DAY), ("duplicate_fresh", fresh, 0), ("stale_evidence", "ss", 0)):
        tables = _copy_sql(source, shift).split("SELECT pg.qid, pg.idx, md5(")[0].strip().rstrip(",")
        parts.append(f"SELECT * FROM (WITH {tables} {change.format(name, 'text <> t1', 'ts <> s1', copied(source, shift))})")
    parts.append(f"SELECT * FROM (WITH {_slots_sql(2, '(SELECT * FROM pg WHERE NOT gold)')} {change.format('future_date', 'false', 'ts <> s1', 'SELECT ts, CASE WHEN slot IS NULL THEN ts ELSE greatest(ts, question_ts) + 7 * 86400 END AS s1 FROM pg LEFT JOIN sl USING (qid, idx)')})")
    claim = "SELECT text, ts, CASE WHEN slot IS NULL THEN text ELSE 'Claim ' || pg.qid END AS t1, CASE WHEN slot IS NULL THEN ts ELSE question_ts - 86400 END AS s1 FROM pg LEFT JOIN sl USING (qid, idx)"
    parts.append(f"SELECT * FROM (WITH {_slots_sql(2, '(SELECT * FROM pg WHERE NOT gold)')} {change.format('fabricated_fresh', 'text <> t1', 'ts <> s1', claim)})")
    return " UNION ALL ".join(parts)


@query(
    f"""WITH {_GOLD}, {_STALE}, e AS ({_effects_sql()}), v(condition, needs_text, shifts_date, copies, visible) AS (VALUES ('future_date', false, true, false, false), ('correct_content_wrong_date', false, true, false, true), ('duplicate_fresh', true, false, true, true), ('stale_evidence', true, false, false, true), ('fabricated_fresh', true, true, false, true))
SELECT v.*, text_changed, date_changed, visible OR NOT text_changed AS as_specified FROM v JOIN e USING (condition)"""
)
def attack_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conditions with what they need and do, and what applying each of them to the pools is found to change."""
    clean = _gold_pool(spark, sf_dir)
    payloads = questions(spark, sf_dir).select("qid", F.concat(F.lit("Claim "), F.col("qid").cast("string")).alias("payload_text"), (F.col("question_ts") - DAY).alias("payload_ts"))
    applied = {
        "future_date": P.future_date(clean, "seed", 2), "correct_content_wrong_date": P.wrong_date(clean, "seed", 2), "duplicate_fresh": P.duplicate_fresh(clean, "seed", 2),
        "stale_evidence": P.stale_evidence(clean, _topical(), "seed", 2), "fabricated_fresh": P.fabricated_fresh(clean, payloads, "seed", 2),
    }
    before = clean.select("qid", "idx", F.col("text").alias("t0"), F.col("ts").alias("s0"))
    found = None
    for name, after in applied.items():
        any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
        e = after.join(before, ["qid", "idx"]).agg(any_of(F.col("text") != F.col("t0")).alias("text_changed"), any_of(F.col("ts") != F.col("s0")).alias("date_changed")).withColumn("condition", F.lit(name))
        found = e if found is None else found.unionByName(e)
    spec = spark.createDataFrame(list(P.SPECS), "condition string, needs_text boolean, shifts_date boolean, copies boolean, visible boolean")
    return spec.join(found, "condition").withColumn("as_specified", F.col("visible") | ~F.col("text_changed"))


@query(
    """WITH l AS (SELECT (i & 1) = 1 AS newer, (i & 2) = 2 AS fresh, (i & 4) = 4 AS first FROM range(8) t(i)), q AS (SELECT item_id AS qid, length(text) AS n FROM benchmark)
SELECT qid, CASE WHEN newer THEN 'incorrect_newer' ELSE 'correct_newer' END || '/' || CASE WHEN fresh THEN 'freshness' ELSE 'neutral' END || '/' || CASE WHEN first THEN 'incorrect_first' ELSE 'correct_first' END AS cell,
 CAST(CASE WHEN fresh THEN 9 ELSE 8 END + n AS INT) AS body_end, CASE WHEN fresh THEN 9 ELSE 8 END + n <= 300 AS complete FROM q, l"""
)
def factorial_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight cells of three factors for every question, and whether a body fits its cap."""
    two = lambda n: spark.range(2).select((F.col("id") == 1).alias(n))
    cells = F.broadcast(two("newer").join(two("fresh")).join(two("first")))  # eight rows
    name = F.concat_ws("/", F.when(F.col("newer"), "incorrect_newer").otherwise("correct_newer"), F.when(F.col("fresh"), "freshness").otherwise("neutral"), F.when(F.col("first"), "incorrect_first").otherwise("correct_first"))
    body = F.concat(F.when(F.col("fresh"), "Updated: ").otherwise("Passage:"), F.col("query"))
    return questions(spark, sf_dir).join(cells).select("qid", name.alias("cell"), F.length(body).alias("body_end"), (F.length(body) <= 300).alias("complete"))


@query(
    f"""{_TF}, c AS (SELECT r.qid, r.idx, rank, least(length(text), 1500) AS n FROM r JOIN p USING (qid, idx) WHERE rank <= 5), u AS (SELECT *, sum(n + 2) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) - 2 AS used FROM c)
SELECT qid, idx, CAST(rank AS INT) AS rank, CAST(used AS BIGINT) AS used, used <= 4000 AS survives FROM u"""
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the five best passages survive the caps on a passage and on the whole context."""
    w, p = Window.partitionBy("qid").orderBy("rank"), pool(spark, sf_dir)
    c = R.ranked(R.bm25(p, questions(spark, sf_dir)), 5).join(p, ["qid", "idx"]).withColumn("n", F.length(T.truncate("text")))
    return c.withColumn("used", F.sum(F.col("n") + 2).over(w) - 2).select("qid", "idx", "rank", "used", (F.col("used") <= 4000).alias("survives"))
