"""Queries of pool building, ingestion, admissibility, and what became of perturbations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import web as U
from lodestone.operators import build as B
from lodestone.operators import perturb as P
from lodestone.operators import temporal as E

from .checks import _key_sql
from .common import CORPUS_START, DAY, POOL_SQL, pool, questions, read
from .pools import _GOLD, _gold_pool

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_MINED = f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({{x}}), '[^a-z0-9\\s]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: length(t) >= 3 AND t NOT IN {T.MINING_STOPWORDS}))"
_FORM = r"array_to_string(list_filter(regexp_split_to_array(translate(replace(lower({x}), 'ß', 'ss'), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '[ \t\n\x0B\f\r]+'), lambda t: t <> ''), ' ')"


@query(
    f"""WITH {POOL_SQL}, a AS (SELECT qid, question_ts, unnest({_MINED.format(x="split_part(query, '.', 1)")}) AS tok, 1 AS q FROM q), e AS (SELECT qid, question_ts, unnest({_MINED.format(x="substr(query, strpos(query, '.') + 1)")}) AS tok, 1 AS e FROM q),
w AS (SELECT qid, question_ts, tok, coalesce(q, 0) AS q, coalesce(e, 0) AS e FROM a FULL JOIN e USING (qid, question_ts, tok)), tt AS MATERIALIZED (SELECT idx AS id, ts, md5({_FORM.format(x="text")}) AS same, {_MINED.format(x="text")} AS toks FROM p), t AS (SELECT id, ts, same, unnest(toks) AS tok FROM tt),
h AS (SELECT qid, id, same, sum(q)::BIGINT AS question_overlap, sum(e)::BIGINT AS evidence_overlap, (sum(q) + 2 * sum(e))::BIGINT AS score FROM t JOIN w USING (tok) WHERE question_ts - ts >= 30 * 86400 GROUP BY qid, id, same HAVING sum(q) + 2 * sum(e) >= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, same ORDER BY score DESC, evidence_overlap DESC, question_overlap DESC, id) AS copy FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, evidence_overlap DESC, question_overlap DESC, id) AS rank FROM o WHERE copy = 1)
SELECT qid, id, question_overlap, evidence_overlap, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""
)
def source_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents, the five for each question that are old and share most with it and its evidence.

    An item's first sentence stands for the question, what follows for its evidence.
    """
    q = questions(spark, sf_dir)
    p = pool(spark, sf_dir).select(F.col("idx").alias("id"), "text", "ts")
    said = [T.mining_tokens(c, T.MINING_STOPWORDS) for c in (F.split_part("query", F.lit("."), F.lit(1)), F.expr("substr(query, instr(query, '.') + 1)"), F.col("text"))]
    return B.mine_sources(q, p, *said)


@query(
    f"""WITH {_GOLD}, s AS (SELECT qid, idx, gold, qid % 3 > 0 AS validated FROM pg UNION ALL SELECT qid, -1 - qid, true, true FROM q)
SELECT s.qid, row_number() OVER (PARTITION BY s.qid ORDER BY sha256('assemble|' || s.qid || '|' || s.idx), s.idx) - 1 AS position, s.idx, gold AND validated AS is_source FROM s JOIN p ON p.idx = s.idx"""
)
def assembled_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B2: pools put together from specified ids and the texts that were found, in hash order."""
    specs = _gold_pool(spark, sf_dir).select("qid", "idx", "gold", (F.col("qid") % 3 > 0).alias("validated"))
    specs = specs.unionByName(questions(spark, sf_dir).select("qid", (-1 - F.col("qid")).alias("idx"), F.lit(True).alias("gold"), F.lit(True).alias("validated")))
    return B.assemble(specs, pool(spark, sf_dir).drop("qid"), "assemble").select("qid", F.col("position").cast("bigint").alias("position"), "idx", "is_source")


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM benchmark), e AS (SELECT page_id, {_key_sql("url")} AS k FROM pages WHERE html LIKE '%<body%' AND coalesce(html, '') <> ''), c AS (SELECT DISTINCT x.page_id % n AS qid, e.page_id AS idx FROM pages x, n JOIN e ON e.k = {_key_sql("x.url")} WHERE x.url IS NOT NULL AND e.k <> ''),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY idx) AS k FROM c) WHERE k <= 8), m AS (SELECT qid, least(count(*), 8) AS n FROM c GROUP BY qid), s AS (SELECT page_id AS idx, row_number() OVER (ORDER BY sha256('fill|' || page_id), page_id) - 1 AS place FROM e), z AS (SELECT count(*) AS total FROM s),
h AS (SELECT qid, n, ('0x' || substr(sha256('fill|question|' || qid), 1, 15))::BIGINT % total AS start FROM m, z),
r AS (SELECT h.qid, s.idx, n, row_number() OVER (PARTITION BY h.qid ORDER BY (s.place - start + total) % total) AS draw FROM h, s, z WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.qid = h.qid AND c.idx = s.idx))
SELECT qid, idx, true AS is_source FROM f UNION ALL SELECT qid, idx, false FROM r WHERE draw <= 20 - n"""
)
def cited_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of the fetched pages that a question cites, filled up to twenty with pages that it does not cite."""
    p, n = read(spark, sf_dir, "pages"), read(spark, sf_dir, "benchmark").agg(F.count("*").alias("_n"))
    evidence = p.where("html LIKE '%<body%' AND coalesce(html, '') <> ''").select(F.col("page_id").alias("idx"), U.url_pool_key(F.col("url")).alias("k"))
    cited = p.where("url IS NOT NULL").join(F.broadcast(n)).select(F.pmod("page_id", "_n").alias("qid"), U.url_pool_key(F.col("url")).alias("k")).join(evidence.where("k <> ''"), "k").select("qid", "idx").distinct()
    return B.fill_pools(cited, evidence.select("idx"), 20, 8, "fill")


_SPANS = f"w AS (SELECT {CORPUS_START} + (i * 37 % 365) * {DAY} AS s, {CORPUS_START} + (i * 37 % 365 + 9) * {DAY} AS e FROM range(20) t(i))"


@query(
    rf"""WITH {POOL_SQL}, {_SPANS}, k AS (SELECT idx, text FROM p WHERE EXISTS (SELECT 1 FROM w WHERE ts BETWEEN s AND e)),
x AS (SELECT idx, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 80) AS ps FROM k), y AS (SELECT idx, unnest(ps) AS passage, unnest(range(len(ps))) AS no FROM x)
SELECT idx, CAST(no AS INT) AS passage_no, idx || '#' || no AS passage_id, md5(passage) AS passage_md5 FROM y"""
)
def evidence_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of documents whose date lies in any of the wanted windows, which are merged first."""
    i = F.col("id") * 37 % 365
    spans = spark.range(20).select((F.lit(CORPUS_START) + i * DAY).alias("start"), (F.lit(CORPUS_START) + (i + 9) * DAY).alias("end"))
    inside = E.within(pool(spark, sf_dir).select("idx", "text", "ts"), E.merge_intervals(spans).select("start", "end"), "ts")
    return B.extract_passages(inside, "idx", "text").select("idx", "passage_no", "passage_id", F.md5(F.col("passage").cast("binary")).alias("passage_md5"))


@query(
    """WITH l AS (SELECT o_orderkey AS line, o_orderkey // 2 AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE 'same' END AS v, o_orderkey % 31 AS bad FROM orders), k AS (SELECT *, CASE WHEN bad = 1 THEN NULL WHEN bad = 2 THEN NULL WHEN bad = 3 THEN NULL ELSE id || '|' || v END AS variant FROM l),
f AS (SELECT variant, min(line) AS first FROM k WHERE variant IS NOT NULL GROUP BY variant), c AS (SELECT id, min(variant) <> max(variant) AS conflict FROM k WHERE variant IS NOT NULL GROUP BY id)
SELECT line, CASE WHEN k.variant IS NOT NULL THEN k.id END AS id, CASE WHEN k.variant IS NULL THEN 'INVALID' WHEN line <> first THEN 'DUPLICATE' WHEN conflict THEN 'CONFLICT' ELSE 'INDEXED' END AS status FROM k LEFT JOIN f USING (variant) LEFT JOIN c ON c.id = k.id AND k.variant IS NOT NULL"""
)
def index_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines, some broken, short of a field or with one too many: what an index takes in."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(k.alias("line"), F.floor(k / 2).alias("id"), F.when(k % 5 == 0, F.col("o_orderstatus")).otherwise("same").alias("v"), (k % 31).alias("bad"))
    whole = F.to_json(F.struct("id", "v"))
    value = F.when(F.col("bad") == 1, F.concat(whole, F.lit("}x{"))).when(F.col("bad") == 2, F.to_json(F.struct("id"))).when(F.col("bad") == 3, F.to_json(F.struct("id", "v", "bad"))).otherwise(whole)
    return B.ingest(o.select("line", F.when(F.col("bad") == 1, F.substring(whole, 2, 100)).otherwise(value).alias("value")), "id bigint, v string", "id").select("line", "id", "status")


@query(
    f"""WITH {_GOLD}, d AS (SELECT md5(text) AS m, count(*) AS copies FROM documents GROUP BY 1), j AS (SELECT pg.qid, pg.idx, l.quality, l.toxic, d.copies, pg.ts > pg.question_ts AS late, g.page_id FROM pg LEFT JOIN labels l ON l.doc_id = pg.idx LEFT JOIN d ON d.m = md5(pg.text) LEFT JOIN pages g ON g.page_id = pg.idx),
r AS (SELECT qid, idx, list_filter([CASE WHEN late THEN 'after_the_question' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'poor' END], lambda x: x IS NOT NULL) AS b, list_filter([CASE WHEN quality IS NULL THEN 'unrated' END, CASE WHEN copies > 1 THEN 'copied' END, CASE WHEN page_id IS NULL THEN 'no_page' END], lambda x: x IS NOT NULL) AS d FROM j)
SELECT qid, idx, CASE WHEN len(b) > 0 THEN 'BLOCKED' WHEN len(d) > 0 THEN 'NEEDS_REVIEW' ELSE 'ADMISSIBLE' END AS status, list_concat(b, d) AS reasons FROM r"""
)
def admissibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every question, judged by all that the tables know of it."""
    p = _gold_pool(spark, sf_dir).select("qid", "idx", F.md5(F.col("text").cast("binary")).alias("m"), "ts", "question_ts")
    l = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), "quality", "toxic")
    copies = read(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("m")).agg(F.count("*").alias("copies"))
    j = p.join(l, "idx", "left").join(copies, "m", "left").join(read(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), F.lit(True).alias("page")), "idx", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return B.admissibility(
        j, ("qid", "idx"), {"after_the_question": F.col("ts") > F.col("question_ts"), "toxic": no(F.col("toxic") == 1), "poor": no(F.col("quality") == 0)},
        {"unrated": F.col("quality").isNull(), "copied": no(F.col("copies") > 1), "no_page": F.col("page").isNull()},
    )


_ADAPT = f"""{_GOLD}, a AS (SELECT CASE WHEN idx % 19 = 0 THEN qid + 1 ELSE qid END AS qid, idx, CASE WHEN idx % 7 = 0 THEN sha256(text || ' ') ELSE sha256(text) END AS h, CASE WHEN idx % 11 > 0 THEN gold END AS supported FROM pg),
j AS (SELECT a.*, p.text, CASE WHEN p.text IS NULL THEN 'unknown_candidate' WHEN sha256(p.text) <> h THEN 'text_differs' WHEN supported IS NULL THEN 'not_adjudicated' END AS problem FROM a LEFT JOIN p ON p.qid = a.qid AND p.idx = a.idx)"""


def _adapted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _gold_pool(spark, sf_dir)
    text = F.when(F.col("idx") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    a = p.select(F.when(F.col("idx") % 19 == 0, F.col("qid") + 1).otherwise(F.col("qid")).alias("qid"), "idx", F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.when(F.col("idx") % 11 > 0, F.col("gold")).alias("supported"))
    return B.adapt(a, p)


@query(f"WITH {_ADAPT} SELECT qid, idx, sha256(text) AS text_sha256, supported AS is_source_document FROM j WHERE problem IS NULL")
def adapted_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjudicated candidates as a runner's pool, each with the text that was judged."""
    return _adapted(spark, sf_dir)[0].select("qid", "idx", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "is_source_document")


@query(f"WITH {_ADAPT} SELECT qid, idx, problem FROM j WHERE problem IS NOT NULL")
def adapter_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjudications of another text, of no candidate, or without a verdict."""
    return _adapted(spark, sf_dir)[1]


@query(
    """WITH d AS (SELECT source, lang, doc_id, sha256('top|' || doc_id) AS o, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('top|' || doc_id), doc_id) AS draw FROM documents), f AS (SELECT * FROM d WHERE draw <= 2), m AS (SELECT *, row_number() OVER (ORDER BY o, doc_id) AS place FROM d WHERE draw > 2)
SELECT source, lang, doc_id, draw, false AS top_up FROM f UNION ALL SELECT source, lang, doc_id, draw, true FROM m WHERE place <= greatest(0, 100 - (SELECT count(*) FROM f))"""
)
def topped_up_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: two documents of every source and language, and others to make up 100."""
    return B.topped_up(read(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ("source", "lang"), 2, 100, "top", "doc_id").select("source", "lang", "doc_id", "draw", "top_up")


_DECIDED = f"""f AS (SELECT o_orderkey AS id, o_orderpriority AS stratum, o_orderkey % 3 = 0 AS is_priority, o_orderkey % 40 > 0 AS in_scope, o_orderkey % 4 <> 1 AS admissible, CASE o_orderkey % 7 WHEN 0 THEN 'CONFIRMED_RECORDED_DEVELOPMENT_ACTIVITY' WHEN 1 THEN 'POSSIBLE_EXPOSURE' WHEN 2 THEN NULL ELSE 'NO_RECORDED_EXPOSURE' END AS exposure,
o_orderkey % 2 = 0 AS attested, o_orderkey % 9 > 0 AS separated, CASE o_orderkey % 5 WHEN 0 THEN 'OUTCOME_DRIVEN_TUNING' WHEN 1 THEN NULL ELSE 'CONSTRUCTION_REVIEW_ONLY' END AS purpose FROM orders),
d AS (SELECT *, 'A_STRICT' AS policy, CASE WHEN NOT in_scope THEN 'EXCLUDE' WHEN exposure = 'NO_RECORDED_EXPOSURE' THEN 'PASS_PROPOSED_POLICY_ONLY' ELSE 'EXCLUDE' END AS decision, CASE WHEN NOT in_scope THEN 'OUT_OF_SCOPE' WHEN exposure = 'NO_RECORDED_EXPOSURE' THEN 'NO_RECORDED_EXPOSURE' ELSE 'RECORDED_POSSIBLE_OR_UNKNOWN_EXPOSURE' END AS reason FROM f
UNION ALL SELECT *, 'B_CONFIRMED_ONLY', CASE WHEN NOT in_scope THEN 'EXCLUDE' WHEN exposure = 'CONFIRMED_RECORDED_DEVELOPMENT_ACTIVITY' THEN 'EXCLUDE' WHEN exposure = 'NO_RECORDED_EXPOSURE' THEN 'PASS_PROPOSED_POLICY_ONLY' ELSE 'HOLD' END, CASE WHEN NOT in_scope THEN 'OUT_OF_SCOPE' WHEN exposure = 'CONFIRMED_RECORDED_DEVELOPMENT_ACTIVITY' THEN 'CONFIRMED_ACTIVITY' WHEN exposure = 'NO_RECORDED_EXPOSURE' THEN 'NO_RECORDED_EXPOSURE' ELSE 'POSSIBLE_OR_UNKNOWN_EXPOSURE' END FROM f
UNION ALL SELECT *, 'C_GOVERNED_PURPOSE', CASE WHEN NOT in_scope OR attested AND purpose = 'OUTCOME_DRIVEN_TUNING' THEN 'EXCLUDE' WHEN attested AND separated AND purpose = 'CONSTRUCTION_REVIEW_ONLY' THEN 'PASS_PROPOSED_POLICY_ONLY' ELSE 'HOLD' END, CASE WHEN NOT in_scope THEN 'OUT_OF_SCOPE' WHEN attested AND purpose = 'OUTCOME_DRIVEN_TUNING' THEN 'OUTCOME_DRIVEN_TUNING' WHEN attested AND separated AND purpose = 'CONSTRUCTION_REVIEW_ONLY' THEN 'GOVERNED_CONSTRUCTION_ONLY' ELSE 'PURPOSE_UNKNOWN' END FROM f)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("stratum"), (k % 3 == 0).alias("is_priority"), (k % 40 > 0).alias("in_scope"), (k % 4 != 1).alias("admissible"),
        F.when(k % 7 == 0, "CONFIRMED_RECORDED_DEVELOPMENT_ACTIVITY").when(k % 7 == 1, "POSSIBLE_EXPOSURE").when(k % 7 > 2, "NO_RECORDED_EXPOSURE").alias("exposure"), (k % 2 == 0).alias("attested"), (k % 9 > 0).alias("separated"),
        F.when(k % 5 == 0, "OUTCOME_DRIVEN_TUNING").when(k % 5 > 1, "CONSTRUCTION_REVIEW_ONLY").alias("purpose"),
    )
    return B.policy_decisions(rows)


@query(f"WITH {_DECIDED} SELECT policy, decision, reason, count(*) AS n FROM d GROUP BY ALL")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: what three policies of exposure decide, and why."""
    return _decided(spark, sf_dir).groupBy("policy", "decision", "reason").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_DECIDED}, c AS (SELECT d.*, kase, CASE WHEN kase = 'as_recorded' THEN decision = 'PASS_PROPOSED_POLICY_ONLY' AND admissible ELSE decision <> 'EXCLUDE' END AS passes FROM d, (SELECT unnest(['as_recorded', 'holds_cleared']) AS kase)),
b AS (SELECT policy, kase, stratum, id, row_number() OVER (PARTITION BY policy, kase, stratum ORDER BY id) AS slot FROM c WHERE is_priority AND NOT passes), r AS (SELECT policy, kase, stratum, id, row_number() OVER (PARTITION BY policy, kase, stratum ORDER BY id) AS slot FROM c WHERE NOT is_priority AND passes)
SELECT policy, kase AS "case", stratum, CAST(slot AS INT) AS slot, b.id AS blocked_id, r.id AS replacement_id FROM b LEFT JOIN r USING (policy, kase, stratum, slot)"""
)
def replacement_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replacements that each policy would make, as recorded and with all holds cleared."""
    return B.simulate_replacements(_decided(spark, sf_dir), "id", "stratum", "id")


# --- perturbations -----------------------------------------------------------------------------------------------

_FRESH = "src AS (SELECT qid, idx AS source_idx FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sha256('seed|' || qid || '|' || idx), idx) AS draw FROM pg WHERE NOT gold AND (question_ts - ts) / 86400.0 BETWEEN 0 AND 30) WHERE draw = 1)"


def _fresh_source(clean: DataFrame) -> DataFrame:
    return P.pick(clean.where(~F.col("gold") & ((F.col("question_ts") - F.col("ts")) / DAY).between(0, 30)), "seed")


@query(
    f"""WITH {_GOLD}, {_FRESH}, fr AS (SELECT 'future_date' AS condition, qid, idx FROM pg WHERE NOT gold AND reviewed UNION ALL SELECT 'duplicate_fresh', qid, idx FROM pg JOIN src USING (qid) WHERE NOT gold AND reviewed AND idx <> source_idx),
dr AS (SELECT *, row_number() OVER (PARTITION BY condition, qid ORDER BY sha256('seed|' || qid || '|' || idx), idx) AS slot FROM fr), li AS (SELECT condition, qid, list(idx ORDER BY slot) AS ids FROM dr WHERE slot <= 5 GROUP BY ALL),
g AS (SELECT condition, qid, requested, coalesce(ids, []) AS ids FROM (SELECT qid, unnest(['future_date', 'duplicate_fresh']) AS condition FROM q) CROSS JOIN (SELECT unnest([1, 2, 5]) AS requested) LEFT JOIN li USING (condition, qid))
SELECT condition, qid, requested, len(ids) >= requested AS applied, CASE WHEN len(ids) = 0 THEN 'no_eligible_target' WHEN len(ids) < requested THEN 'insufficient_distinct_targets' END AS reason, CASE WHEN len(ids) >= requested THEN ids[:requested] ELSE [] END AS targets FROM g"""
)
def attack_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every question, condition and count, whether poisons could be placed, where, or why not; slots are free where a label calls them harmless."""
    clean = _gold_pool(spark, sf_dir)
    free, q = clean.where("gold OR reviewed"), questions(spark, sf_dir)
    one = B.outcomes(free, q, "seed").withColumn("condition", F.lit("future_date"))
    return one.unionByName(B.outcomes(free, q, "seed", source=_fresh_source(clean)).withColumn("condition", F.lit("duplicate_fresh")))


@query(
    f"""WITH {_GOLD}, sl AS (SELECT * FROM (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY sha256('seed|' || qid || '|' || idx), idx) AS slot, count(*) OVER (PARTITION BY qid) AS n FROM pg WHERE NOT gold AND reviewed) WHERE n >= 2 AND slot <= 2), ok AS (SELECT DISTINCT qid FROM sl)
SELECT pg.qid, pg.idx, CASE WHEN slot IS NULL THEN ts ELSE greatest(ts, question_ts) + 7 * 86400 END AS ts, slot IS NOT NULL AS changed FROM pg JOIN ok USING (qid) LEFT JOIN sl USING (qid, idx) WHERE gold OR reviewed"""
)
def generated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacked pools of the questions whose pools could be attacked; the others are left out."""
    clean = _gold_pool(spark, sf_dir).where("gold OR reviewed")
    return B.generate(P.future_date(clean, "seed", 2), skip_ineligible=True).select("qid", "idx", "ts", "changed")


_CASES = f"""{_GOLD}, sl AS (SELECT * FROM (SELECT qid, idx, row_number() OVER (PARTITION BY qid ORDER BY sha256('seed|' || qid || '|' || idx), idx) AS slot, count(*) OVER (PARTITION BY qid) AS n FROM pg WHERE NOT gold) WHERE n >= 2 AND slot <= 2),
lo AS (SELECT qid, min(idx) AS low, min(CASE WHEN gold THEN idx END) AS gold_low FROM pg GROUP BY qid),
att AS (SELECT pg.qid, pg.idx, gold, CASE WHEN qid % 5 = 2 AND idx = gold_low THEN text || '!' WHEN qid % 5 = 3 AND slot = 1 THEN '' ELSE text END AS text, CASE WHEN slot IS NOT NULL AND NOT (qid % 5 = 4 AND slot = 2) THEN greatest(ts, question_ts) + 7 * 86400 ELSE ts END AS ts FROM pg JOIN lo USING (qid) LEFT JOIN sl USING (qid, idx) WHERE NOT (qid % 5 = 1 AND idx = low)),
b AS (SELECT coalesce(pg.qid, att.qid) AS qid, pg.text AS ct, pg.ts AS cs, pg.gold AS cg, att.text AS a_t, att.ts AS a_s, pg.question_ts AS qt, pg.idx IS NOT NULL AS had, att.idx IS NOT NULL AS has, sl.idx IS NOT NULL AS hit FROM pg FULL JOIN att ON pg.qid = att.qid AND pg.idx = att.idx LEFT JOIN sl ON sl.qid = pg.qid AND sl.idx = pg.idx),
g AS (SELECT qid, count(*) FILTER (had) = count(*) FILTER (has) AS candidate_count_preserved, count(*) FILTER (had <> has) = 0 AS ids_unchanged, count(*) FILTER (cg AND (NOT has OR a_t <> ct OR a_s <> cs)) = 0 AS gold_unchanged, count(*) FILTER (hit) = 2 AS poison_count_correct, count(*) FILTER (hit AND cg) = 0 AS targets_are_no_gold,
count(*) FILTER (had AND has AND (a_t <> ct OR a_s <> cs) AND NOT hit) = 0 AS only_targets_changed, count(*) FILTER (hit AND NOT coalesce(a_t = ct, false)) = 0 AS text_unchanged, count(*) FILTER (hit AND NOT coalesce(a_s > cs AND a_s > {CORPUS_START}, false)) = 0 AS date_after FROM b GROUP BY qid)"""


@query(f"""WITH {_CASES} UNPIVOT g ON candidate_count_preserved, ids_unchanged, gold_unchanged, poison_count_correct, targets_are_no_gold, only_targets_changed, text_unchanged, date_after INTO NAME "check" VALUE passed""")
def case_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks of attacked pools; some pools lose a candidate, a gold text, a target's text or a target's date."""
    clean = _gold_pool(spark, sf_dir)
    attacked, q = P.future_date(clean, "seed", 2), F.col("qid") % 5
    targets = P.slots(clean, "seed", 2).select("qid", "idx", "slot")
    low = clean.groupBy("qid").agg(F.min("idx").alias("low"), F.min(F.when(F.col("gold"), F.col("idx"))).alias("gold_low"))
    bad = attacked.join(low, "qid").join(targets, ["qid", "idx"], "left").join(clean.select("qid", "idx", F.col("ts").alias("before")), ["qid", "idx"])
    text = F.when((q == 2) & (F.col("idx") == F.col("gold_low")), F.concat("text", F.lit("!"))).when((q == 3) & (F.col("slot") == 1), "").otherwise(F.col("text"))
    bad = bad.where(~((q == 1) & (F.col("idx") == F.col("low")))).withColumns({"text": text, "ts": F.when((q == 4) & (F.col("slot") == 2), F.col("before")).otherwise(F.col("ts"))})
    effect = {"text_unchanged": F.col("a.text") == F.col("c.text"), "date_after": (F.col("a.ts") > F.col("c.ts")) & (F.col("a.ts") > CORPUS_START)}
    return B.case_checks(clean, bad.select("qid", "idx", "text", "ts", "gold"), targets, 2, effect)


@query(
    r"""WITH c AS (SELECT item_id AS qid, text AS correct, reverse(text) AS claim FROM benchmark)
SELECT qid, 'clean' AS condition, 'correct' AS role, md5(correct) AS text_md5 FROM c UNION ALL SELECT qid, 'neutral_poison', 'correct', md5(correct) FROM c UNION ALL SELECT qid, 'neutral_poison', 'poison', md5(claim) FROM c
UNION ALL SELECT qid, 'freshness_poison', 'correct', md5(correct) FROM c UNION ALL SELECT qid, 'freshness_poison', 'poison', md5('Latest update:' || chr(10) || claim) FROM c"""
)
def smoke_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question clean, with a neutral poison, and with one that claims to be fresh."""
    return B.smoke_set(questions(spark, sf_dir), F.col("query"), F.reverse("query")).select("qid", "condition", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))
