"""Queries of validators, keyed joins with reports, and analyses over an incomplete frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import web as U
from lodestone.operators import audit as A
from lodestone.operators import checks as C
from lodestone.operators import evidence as V

from .common import POOL_SQL, pool, questions, read
from .pools import _GOLD, _gold_pool

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _unless_empty(problems: str) -> str:
    return f"list_filter([{problems}], lambda x: x IS NOT NULL)"


# --- pools ---------------------------------------------------------------------------------------------------

_SHAPE = f"""{_GOLD}, c AS (SELECT qid, idx, gold AND idx % 5 <> 0 AS flagged FROM pg), g AS (SELECT CASE WHEN idx % 11 = 0 THEN qid + 1 ELSE qid END AS qid, idx FROM pg WHERE gold), r AS (SELECT qid, qid % 3 > 0 AS validated FROM q)"""


@query(
    f"""WITH {_SHAPE}, n AS (SELECT qid, count(*) AS n, count(*) FILTER (flagged) AS flags FROM c GROUP BY qid), s AS (SELECT qid, count(*) AS strangers FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.qid = g.qid AND c.idx = g.idx) GROUP BY qid),
u AS (SELECT qid, count(*) AS unlike FROM (SELECT qid, idx FROM c WHERE flagged AND NOT EXISTS (SELECT 1 FROM g WHERE c.qid = g.qid AND c.idx = g.idx) UNION ALL SELECT qid, idx FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.qid = g.qid AND c.idx = g.idx AND flagged)) GROUP BY qid)
SELECT r.qid, unnest({_unless_empty("CASE WHEN n IS NULL THEN 'empty_pool' END, CASE WHEN coalesce(n, 0) <> 25 THEN 'pool_size' END, CASE WHEN strangers > 0 THEN 'gold_not_among_candidates' END, CASE WHEN validated AND unlike > 0 THEN 'flags_are_not_the_gold' END, CASE WHEN NOT validated AND flags > 0 THEN 'flagged_without_validation' END")}) AS problem
FROM r LEFT JOIN n USING (qid) LEFT JOIN s USING (qid) LEFT JOIN u USING (qid)"""
)
def pool_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pools whose size, gold ids or source flags do not fit; flags and gold lists of some are made to differ."""
    p = _gold_pool(spark, sf_dir)
    flagged = p.select("qid", "idx", (F.col("gold") & (F.col("idx") % 5 != 0)).alias("flagged"))
    gold = p.where("gold").select(F.when(F.col("idx") % 11 == 0, F.col("qid") + 1).otherwise(F.col("qid")).alias("qid"), "idx")
    return C.pool_shape(flagged, gold, questions(spark, sf_dir).select("qid", (F.col("qid") % 3 > 0).alias("validated")), 25)


_REVIEWS = f"""{_GOLD}, v AS (SELECT CASE WHEN idx % 13 = 0 THEN qid + 1 ELSE qid END AS qid, idx, idx % 7 > 0 AS validated, CASE WHEN idx % 17 = 0 THEN '' ELSE 'r' || (idx % 3) END AS reviewer, 'old' AS reason FROM pg WHERE reviewed),
j AS (SELECT v.qid, v.idx, reviewer, CASE WHEN reviewer = '' THEN 'missing_field' WHEN pg.idx IS NULL THEN 'unknown_document' WHEN pg.gold THEN 'gold_cannot_be_stale' END AS problem FROM v LEFT JOIN pg USING (qid, idx) WHERE validated)"""


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _gold_pool(spark, sf_dir)
    v = p.where("reviewed").select(F.when(F.col("idx") % 13 == 0, F.col("qid") + 1).otherwise(F.col("qid")).alias("qid"), "idx", (F.col("idx") % 7 > 0).alias("validated"), F.when(F.col("idx") % 17 == 0, "").otherwise(F.concat(F.lit("r"), (F.col("idx") % 3).cast("string"))).alias("reviewer"), F.lit("old").alias("reason"))
    return C.merge_reviews(p, v)


@query(f"WITH {_REVIEWS} SELECT pg.qid, pg.idx, j.idx IS NOT NULL AS reviewed, j.reviewer FROM pg LEFT JOIN (SELECT * FROM j WHERE problem IS NULL) j USING (qid, idx)")
def reviewed_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate, with the review that says it is stale."""
    return _reviews(spark, sf_dir)[0].select("qid", "idx", "reviewed", "reviewer")


@query(f"WITH {_REVIEWS} SELECT qid, idx, problem FROM j WHERE problem IS NOT NULL")
def review_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of gold passages, of unknown ones, or without a reviewer."""
    return _reviews(spark, sf_dir)[1]


@query(
    """WITH r AS (SELECT conv_id, list(text ORDER BY turn) AS texts, list({'index': CASE WHEN turn % 3 = 0 THEN NULL WHEN conv_id % 10 = 0 THEN turn + 1 ELSE turn END, 'doc_id': CASE WHEN conv_id % 7 = 0 THEN 'd' || (turn // 2) ELSE 'd' || turn END} ORDER BY turn) AS meta FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, texts, CASE WHEN conv_id % 9 = 0 THEN meta[:len(meta) - 1] ELSE meta END AS meta FROM r), e AS (SELECT conv_id, len(texts) AS n, len(meta) AS m, list_transform(meta, lambda x: x.doc_id) AS ids, unnest(range(len(texts))) AS position, unnest(texts) AS text, unnest(list_resize(meta, len(texts))) AS x FROM m)
SELECT conv_id, CAST(position AS INT) AS position, md5(text) AS text_md5, x.doc_id AS doc_id, CASE WHEN n <> m THEN 'LENGTH_DIFFERS' WHEN x.index <> position THEN 'INDEX_CONFLICT' WHEN x.doc_id IS NOT NULL AND len(list_filter(ids, lambda y: y = x.doc_id)) > 1 THEN 'REPEATED_DOCUMENT' WHEN x.index IS NOT NULL THEN 'INDEX_CHECKED' ELSE 'POSITIONAL_ONLY' END AS status FROM e"""
)
def candidate_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the turns of a conversation beside metadata about them, some of which does not fit."""
    c = read(spark, sf_dir, "conversations")
    index = F.when(F.col("turn") % 3 == 0, F.lit(None)).when(F.col("conv_id") % 10 == 0, F.col("turn") + 1).otherwise(F.col("turn"))
    doc = F.concat(F.lit("d"), F.when(F.col("conv_id") % 7 == 0, F.floor(F.col("turn") / 2)).otherwise(F.col("turn")).cast("string"))
    r = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", F.struct(index.alias("index"), doc.alias("doc_id")).alias("meta")))).alias("e"))
    meta = F.transform("e", lambda x: x["meta"])
    r = r.select("conv_id", F.transform("e", lambda x: x["text"]).alias("texts"), F.when(F.col("conv_id") % 9 == 0, F.slice(meta, 1, F.size("e") - 1)).otherwise(meta).alias("meta"))
    return C.alignment(r, "conv_id", "texts", "meta").select("conv_id", "position", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("meta.doc_id").alias("doc_id"), "status")


# --- parents and children ---------------------------------------------------------------------------------------

_RUNS = """k AS (SELECT conv_id, turn, role, turn % 4 AS n FROM conversations), s AS (SELECT *, sum(CASE WHEN role = coalesce(lag_role, '') AND n <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 AS slot FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_role FROM k))"""


@query(f"WITH {_RUNS} SELECT conv_id, turn, CAST(slot AS BIGINT) AS slot FROM s")
def child_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as children of their role's occurrences, by runs, with a number that starts again at every fourth turn."""
    k = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.col("turn") % 4).alias("n"))
    return C.child_groups(k, "conv_id", "turn", "role", "n").select("conv_id", "turn", "slot")


@query(
    """WITH p AS (SELECT o_custkey AS k, o_orderkey AS slot, o_orderkey AS doc_id, o_orderdate AS ts, o_orderstatus = 'F' AS flag FROM orders WHERE o_orderkey % 23 <> 5),
c AS (SELECT o_custkey AS k, o_orderkey AS slot, l_linenumber - 1 AS n, CASE WHEN l_quantity = 7 THEN l_orderkey + 1 ELSE l_orderkey END AS parent, CASE WHEN l_quantity = 9 THEN 'x' ELSE l_orderkey || '#chunk' || (l_linenumber - 1) END AS id, CASE WHEN l_quantity = 11 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS ts, CASE WHEN l_quantity = 13 THEN o_orderstatus <> 'F' WHEN l_quantity = 14 THEN NULL ELSE o_orderstatus = 'F' END AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 29 <> 3),
b AS (SELECT coalesce(p.k, c.k) AS k, coalesce(p.slot, c.slot) AS slot, p.k AS pk, c.k AS ck, p.doc_id AS pid, p.ts AS pts, p.flag AS pflag, c.n, c.parent, c.id, c.ts, c.flag FROM p FULL JOIN c ON p.k = c.k AND p.slot = c.slot)
SELECT DISTINCT k AS custkey, slot, unnest(list_filter([CASE WHEN ck IS NULL THEN 'parent_without_children' END, CASE WHEN pk IS NULL THEN 'child_without_parent' END, CASE WHEN pk IS NOT NULL AND ck IS NOT NULL AND parent <> pid THEN 'parent_differs' END, CASE WHEN pk IS NOT NULL AND ck IS NOT NULL AND id <> pid || '#chunk' || n THEN 'id_or_order_differs' END, CASE WHEN pk IS NOT NULL AND ck IS NOT NULL AND ts <> pts THEN 'time_differs' END, CASE WHEN pk IS NOT NULL AND ck IS NOT NULL AND flag <> pflag THEN 'flag_differs' END], lambda x: x IS NOT NULL)) AS problem FROM b"""
)
def lineage_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order lines as children of their orders; some are made to lack or to contradict their parent."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    parents = o.where("o_orderkey % 23 <> 5").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("slot"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "F").alias("flag"))
    n, at = F.col("l_linenumber") - 1, F.col("l_quantity")
    children = l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).where("l_orderkey % 29 <> 3").select(
        F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("slot"), n.alias("n"), F.when(at == 9, "x").otherwise(F.concat(F.col("l_orderkey").cast("string"), F.lit("#chunk"), n.cast("string"))).alias("doc_id"),
        F.when(at == 7, F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey")).alias("parent_doc_id"), F.when(at == 11, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate")).alias("ts"),
        F.when(at == 13, F.col("o_orderstatus") != "F").when(at == 14, F.lit(None)).otherwise(F.col("o_orderstatus") == "F").alias("flag"),
    )
    return C.lineage(parents, children, "custkey")


# --- evidence and joins -----------------------------------------------------------------------------------------

_KEY_SQL = """CASE WHEN coalesce(trim({u}), '') = '' THEN '' ELSE rtrim(lower(regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || regexp_replace(split_part({r}, '?', 1), ';[^/]*$', '') || CASE WHEN length({r}) > length(split_part({r}, '?', 1)) + 1 THEN substr({r}, length(split_part({r}, '?', 1)) + 1) ELSE '' END, '/') END"""


def _key_sql(u: str) -> str:
    bare = f"regexp_replace(trim({u}), '#.*$', '')"
    return _KEY_SQL.format(u=u, b=bare, r=f"regexp_replace({bare}, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//)?', '')")


@query(
    rf"""WITH e AS (SELECT page_id, {_key_sql("url")} AS k FROM pages WHERE html LIKE '%<body%' AND coalesce(html, '') <> ''),
f AS (SELECT page_id % (SELECT count(*) FROM benchmark) AS qid, unnest(list_distinct(list_transform(regexp_extract_all(regexp_replace(concat('see ', url, '/#top<br/> ', url, ', ', 'http://nowhere.example/', page_id), '(?i)<br */?>', chr(10), 'g'), '(https?://[^\s<>"]+)', 1), lambda x: rtrim(x, '.,;')))) AS u FROM pages WHERE url IS NOT NULL)
SELECT f.qid, e.page_id, list(DISTINCT f.u ORDER BY f.u) AS urls FROM f JOIN e ON e.k = {_key_sql("f.u")} WHERE e.k <> '' GROUP BY f.qid, e.page_id"""
)
def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetched pages with a text that a question's source field cites, once each, with all URLs that cite them."""
    p, n = read(spark, sf_dir, "pages"), questions(spark, sf_dir).count()
    evidence = p.where("html LIKE '%<body%' AND coalesce(html, '') <> ''").select("page_id", U.url_pool_key(F.col("url")).alias("k")).where("k <> ''")
    field = F.concat(F.lit("see "), F.col("url"), F.lit("/#top<br/> "), F.col("url"), F.lit(", http://nowhere.example/"), F.col("page_id").cast("string"))
    cited = p.where("url IS NOT NULL").select(F.pmod("page_id", F.lit(n)).alias("qid"), F.explode(U.source_urls(field)).alias("u"))
    return cited.withColumn("k", U.url_pool_key(F.col("u"))).join(evidence, "k").groupBy("qid", "page_id").agg(F.array_sort(F.collect_set("u")).alias("urls"))


@query(
    """WITH r AS (SELECT doc_id, trim(lang) AS split, trim(text) AS question, trim(source) AS answer, [trim(lang), trim(source), ' ' || coalesce(lang, ''), ''] AS more FROM documents)
SELECT doc_id, md5(question) AS question_md5, answer, list_filter([trim(more[1])], lambda x: x IS NOT NULL AND x <> '' AND x <> answer) AS aliases FROM r WHERE upper(split) = 'EN' AND coalesce(question, '') <> '' AND coalesce(answer, '') <> ''"""
)
def clean_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows of a split, whatever its case, with a question and an answer; other answers once each, as aliases."""
    d = read(spark, sf_dir, "documents")
    return T.clean_questions(d, "lang", "en", "text", "source", F.array("lang", "source", F.concat(F.lit(" "), F.coalesce("lang", F.lit(""))), F.lit(""))).select("doc_id", F.md5(F.col("question").cast("binary")).alias("question_md5"), "answer", "aliases")


@query(f"WITH {_GOLD}, w AS (SELECT qid, idx FROM pg WHERE gold UNION SELECT qid, -1 - qid FROM q) SELECT w.idx, p.qid, md5(p.text) AS text_md5, p.idx IS NOT NULL AS found FROM (SELECT DISTINCT idx FROM w) w LEFT JOIN p ON p.idx = w.idx")
def text_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the wanted ids, and the ids that no row has."""
    wanted = _gold_pool(spark, sf_dir).where("gold").select("idx").unionByName(questions(spark, sf_dir).select((-1 - F.col("qid")).alias("idx")))
    return C.fetch(wanted, pool(spark, sf_dir), "idx").select("idx", "qid", F.md5(F.col("text").cast("binary")).alias("text_md5"), "found")


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 31 = 2),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 1 THEN o_custkey + 1 ELSE o_custkey END AS c, CASE WHEN o_orderkey % 17 = 1 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 19 <> 4),
x AS (SELECT k, count(*) AS x, min(c) AS c, min(s) AS s FROM a GROUP BY k), y AS (SELECT k, count(*) AS y, min(c) AS c, min(s) AS s FROM b GROUP BY k)
SELECT x.k AS orderkey, unnest(list_filter([CASE WHEN y IS NULL THEN 'missing' END, CASE WHEN x > 1 THEN 'repeated_left' END, CASE WHEN y > 1 THEN 'repeated_right' END, CASE WHEN x = 1 AND y = 1 AND x.c IS DISTINCT FROM y.c THEN 'cust_differs' END, CASE WHEN x = 1 AND y = 1 AND x.s IS DISTINCT FROM y.s THEN 'status_differs' END], lambda z: z IS NOT NULL)) AS problem FROM x LEFT JOIN y USING (k)"""
)
def window_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that their copy lacks or contradicts, or that stand twice."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))
    left = o.unionByName(o.where("orderkey % 31 = 2"))
    right = o.where("orderkey % 19 <> 4").select("orderkey", F.when(F.col("orderkey") % 13 == 1, F.col("cust") + 1).otherwise(F.col("cust")).alias("cust"), F.when(F.col("orderkey") % 17 != 1, F.col("status")).alias("status"))
    return C.agreement_problems(left, right, "orderkey", ("cust", "status"))


@query(
    """WITH a AS (SELECT md5(text) AS digest, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 60 END AS qid FROM documents)
SELECT digest, a.qid, count(*) AS n_locations, CASE WHEN a.qid IS NULL THEN 'MISSING_ID' WHEN a.qid IN (SELECT item_id FROM benchmark) THEN 'IN_FRAME' ELSE 'OUT_OF_FRAME' END AS membership FROM a GROUP BY digest, a.qid"""
)
def bound_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal annotations once, those of a question apart from those in quarantine."""
    a = read(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 60).alias("qid"))
    return C.bound_annotations(a, questions(spark, sf_dir), ("digest",))


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'adopted_poison' WHEN quality = 1 THEN 'resisted' WHEN doc_id % 2 = 0 THEN 'phrasing_only' ELSE 'unclear' END AS manual, CASE doc_id % 4 WHEN 0 THEN 'POISON_ADOPTED' WHEN 1 THEN 'CORRECT' WHEN 2 THEN 'OTHER_WRONG' ELSE 'NEEDS_REVIEW' END AS judged FROM labels)
SELECT manual, judged, CASE manual WHEN 'adopted_poison' THEN judged = 'POISON_ADOPTED' WHEN 'phrasing_only' THEN judged = 'CORRECT' WHEN 'resisted' THEN judged IN ('CORRECT', 'OTHER_WRONG') END AS consistent, count(*) AS n FROM r GROUP BY ALL"""
)
def label_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual labels against the judge labels that each of them allows."""
    r = read(spark, sf_dir, "labels").select(
        F.when(F.col("toxic") == 1, "adopted_poison").when(F.col("quality") == 1, "resisted").when(F.col("doc_id") % 2 == 0, "phrasing_only").otherwise("unclear").alias("manual"),
        F.element_at(F.array(*[F.lit(x) for x in ("POISON_ADOPTED", "CORRECT", "OTHER_WRONG", "NEEDS_REVIEW")]), (F.col("doc_id") % 4 + 1).cast("int")).alias("judged"),
    )
    # The judge labels that agree with a manual one.
    allowed = {"adopted_poison": ("POISON_ADOPTED",), "phrasing_only": ("CORRECT",), "resisted": ("CORRECT", "OTHER_WRONG")}
    return C.consistency(r, "manual", "judged", allowed).groupBy("manual", "judged", "consistent").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT source, count(*) AS n, bit_xor(('0x' || substr(md5(text), 1, 15))::BIGINT) AS x FROM documents GROUP BY source), b AS (SELECT source, count(*) AS n, bit_xor(('0x' || substr(md5(text), 1, 15))::BIGINT) AS x FROM documents WHERE source <> 'src1' AND NOT (source = 'src2' AND doc_id % 50 = (SELECT min(doc_id) FROM documents WHERE source = 'src2') % 50) GROUP BY source)
SELECT coalesce(e.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'missing' ELSE 'digest_differs' END AS problem FROM (SELECT * FROM e WHERE source IS NOT NULL) e LEFT JOIN (SELECT * FROM b WHERE source IS NOT NULL) b USING (source) WHERE b.source IS NULL OR e.n <> b.n OR e.x <> b.x"""
)
def snapshot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the sources of which a second snapshot lacks rows, by a digest that does not depend on their order."""
    d = read(spark, sf_dir, "documents").where("source IS NOT NULL")
    digest = F.concat_ws(":", F.count("*"), F.bit_xor(F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long"))).alias("digest")
    first = d.where("source = 'src2'").agg(F.min("doc_id").alias("first"))
    lost = d.crossJoin(F.broadcast(first)).where(~((F.col("source") == "src2") & (F.col("doc_id") % 50 == F.col("first") % 50)) | F.col("first").isNull())  # one row
    return C.snapshot_problems(d.groupBy("source").agg(digest), lost.where("source <> 'src1'").groupBy("source").agg(digest), "source", "digest")


_ANSWER = r"trim(regexp_replace(translate(lower({x}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(
    f"""WITH {POOL_SQL}, a AS (SELECT qid, array_to_string(string_split({_ANSWER.format(x="query")}, ' ')[4:4], ' ') AS answer FROM q)
SELECT p.qid, p.idx, answer <> '' AND regexp_matches(' ' || {_ANSWER.format(x="p.text")} || ' ', '[^\\pL\\pN_]' || regexp_escape(answer) || '[^\\pL\\pN_]') AS found FROM p JOIN a USING (qid)"""
)
def answer_in_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the fourth word of a question stands, as a whole word, in each of its candidates."""
    a = questions(spark, sf_dir).select("qid", F.coalesce(F.get(F.split(T.match_form("query"), " "), F.lit(3)), F.lit("")).alias("answer"))
    return pool(spark, sf_dir).join(a, "qid").select("qid", "idx", T.appears_in("answer", "text").alias("found"))


_REVIEW_STOP = ", ".join(f"'{w}'" for w in "what when where which who whom whose why how is was were are the a an of in on at to for from by did do does this that these those name year".split())


@query(
    f"""WITH {_GOLD}, t AS (SELECT qid, idx, (question_ts - ts) / 86400.0::DOUBLE AS age, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\pL\\pN_]+'), lambda x: length(x) >= 3 AND regexp_full_match(x, '[a-z0-9]+'))) AS a, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+'), lambda x: length(x) >= 3 AND regexp_full_match(x, '[a-z0-9]+'))) AS b,
list_distinct(list_filter(list_transform(regexp_extract_all(query, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 3 AND x NOT IN ({_REVIEW_STOP}))) AS qt, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS tt FROM pg WHERE NOT gold),
o AS (SELECT *, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) * 1.0::DOUBLE / len(a) END AS overlap, list_sort(list_intersect(qt, tt)) AS matched FROM t)
SELECT qid, idx, round(age, 6) AS age, round(overlap, 6) AS overlap, matched, CAST(len(matched) AS INT) AS n_matched FROM o WHERE age >= 30 AND overlap > 0"""
)
def ranked_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old passages on a question's topic, with the meaningful terms they share; reviewers take the most first."""
    p = _gold_pool(spark, sf_dir).where("NOT gold")
    overlap = T.overlap(T.ascii_words("query"), T.ascii_words("text"))
    matched = F.array_sort(F.array_intersect(T.review_terms("query"), T.ascii_runs("text")))
    r = p.select("qid", "idx", F.round((F.col("question_ts") - F.col("ts")) / 86400, 6).alias("age"), F.round(overlap, 6).alias("overlap"), matched.alias("matched"))
    return r.where("age >= 30 AND overlap > 0").withColumn("n_matched", F.size("matched"))


_EXPOSED = "e AS (SELECT CASE WHEN page_id % 5 = 0 THEN -page_id - 1 ELSE page_id END AS doc_id, CASE WHEN page_id % 3 = 0 THEN 'other' ELSE d.source END AS source FROM pages LEFT JOIN documents d ON d.doc_id = page_id)"


@query(f"WITH {_EXPOSED} SELECT doc_id, 'remains' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM e) UNION ALL SELECT doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown_key' ELSE 'stratum_differs' END FROM (SELECT DISTINCT * FROM e) e LEFT JOIN documents d USING (doc_id) WHERE d.doc_id IS NULL OR d.source IS DISTINCT FROM e.source")
def reserve_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that pages have not exposed, and exposures that do not agree with the documents."""
    d, p = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    k = F.col("doc_id")
    e = p.join(d, "doc_id", "left").select(F.when(k % 5 == 0, -k - 1).otherwise(k).alias("doc_id"), F.when(k % 3 == 0, "other").otherwise(F.col("source")).alias("source"))
    left, problems = V.reserve_without(d, e, "doc_id", "source")
    return left.select("doc_id", F.lit("remains").alias("state")).unionByName(problems.withColumnRenamed("problem", "state"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN value > 50 WHEN 1 THEN event_type = 'purchase' WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN NULL ELSE value <= 50 END AS verdict, [json_extract_string(props, '$.k')] AS ks FROM events"""
)
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts in replies of several spellings, and every value of a key at any depth."""
    k, word = F.col("event_id") % 6, lambda c, yes, no: F.when(c, yes).otherwise(no)
    high, bought = F.col("value") > 50, F.col("event_type") == "purchase"
    reply = (
        F.when(k == 0, F.concat(F.lit('```json\n{"verdict": '), word(high, "true", "false"), F.lit("}\n```"))).when(k == 1, F.concat(F.lit('{"verdict": "'), word(bought, "Yes", "no"), F.lit('", "why": "-"}'))).when(k == 2, "I say verdict: yes, surely")
        .when(k == 3, 'so "verdict" = "false"').when(k == 4, "no idea").otherwise(F.concat(F.lit('{"verdict": '), word(high, "false", "true"), F.lit("}")))
    )
    nested = F.concat(F.lit('{"a": [{"x": 1}, '), F.col("props"), F.lit("]}"))
    return read(spark, sf_dir, "events").select("event_id", U.verdict(reply).alias("verdict"), A.values_by_key(nested, "k").alias("ks"))


# By an event's remainder: a reply, and what it says.
_REPLIES = (
    ('{"correct": 1, "rationale": "-"}', "true"), ('```json\n{"rationale": "x", "correct": false}\n```', "false"), ('{"correct": 0.0}', "false"), ('{"correct": null}', "false"), ('{"correct": "false"}', "true"),
    ('{"correct": ""}', "false"), ('{"correct": []}', "false"), ('{"correct": [0]}', "true"), ('Sure: "Correct" : TRUE, as "correct": false', "true"), ('{"correct": tru', "NULL"), ('{"right": true}', "NULL"), ("", "NULL"),
    ('[{"correct": false}]', "false"), ('{"correct": {"a": 1}}', "true"), ('{"correct": "0"}', "true"), ('{"why": {"correct": true}}', "true"),
)


@query(f"SELECT event_id, CASE event_id % {len(_REPLIES)} {' '.join(f'WHEN {k} THEN {said}' for k, (_, said) in enumerate(_REPLIES))} END AS correct FROM events")
def judged_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What judging models' replies say of correctness: any true value, fences, broken JSON, other objects."""
    replies = F.array(*[F.lit(r) for r, _ in _REPLIES])
    return read(spark, sf_dir, "events").select("event_id", U.judged_correct(F.element_at(replies, (F.col("event_id") % len(_REPLIES) + 1).cast("int"))).alias("correct"))


_NORM = r"lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"


@query(
    f"""WITH a AS (SELECT doc_id, {_NORM} AS page FROM documents WHERE len(string_split({_NORM}, ' ')) >= 8), b AS (SELECT doc_id, page, array_to_string(string_split(page, ' ')[4:5], ' ') AS s, string_split(page, ' ')[8] AS e FROM a), c AS (SELECT *, instr(page, s) AS i FROM b),
d AS (SELECT *, i + length(s) AS j, instr(substr(page, i + length(s)), e) AS f FROM c) SELECT doc_id, substr(page, greatest(1, i - 30), CASE WHEN f > 0 THEN j + f - 1 + length(e) ELSE j END - greatest(1, i - 30) + 30) AS span FROM d"""
)
def cited_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that quote a document from its fourth word to its eighth, and what stands around the quotation."""
    d = read(spark, sf_dir, "documents")
    # the first eight words, of a text that is read once
    words = F.transform(F.array(F.split(U.collapsed(F.col("text")), " ", 9)), lambda w: F.when(F.size(w) >= 8, F.slice(w, 1, 8)))[0]
    d = d.where("text IS NOT NULL").select("doc_id", "text", F.explode(F.array(words)).alias("w")).where("w IS NOT NULL")
    quoted = F.concat(F.lit("http://x.org/a#:~:text="), F.replace(F.url_encode(F.array_join(F.slice("w", 4, 2), " ")), F.lit("+"), F.lit("%20")), F.lit(","), F.replace(F.url_encode(F.get("w", F.lit(7))), F.lit("+"), F.lit("%20")))
    f = d.select("doc_id", "text", U.text_fragment(quoted).alias("f"))
    return f.select("doc_id", U.cited_span(F.col("text"), F.col("f.start"), 30, F.col("f.end")).alias("span"))


# --- analyses over an incomplete frame ----------------------------------------------------------------------------

_FRAME = """f AS (SELECT c_custkey AS question_id, c_nationkey AS stratum, CASE WHEN c_custkey % 41 = 0 THEN 'PENDING' WHEN c_nationkey = 7 AND c_custkey % 9 = 0 THEN 'UNKNOWN' WHEN c_mktsegment = 'FURNITURE' THEN 'INELIGIBLE' ELSE 'ELIGIBLE' END AS eligibility, CASE c_custkey % 3 WHEN 0 THEN 'OTHER_WRONG' ELSE 'CORRECT' END AS clean FROM customer),
r AS (SELECT o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 100000000 ELSE 0 END AS question_id, o_orderpriority AS family, CASE o_orderstatus WHEN 'F' THEN 'freshness' WHEN 'O' THEN 'neutral' ELSE 'other' END AS condition, CASE WHEN o_orderkey % 53 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS construction, CASE WHEN o_orderkey % 3 = 0 THEN 'NO' ELSE 'YES' END AS retrieval,
CASE WHEN o_orderkey % 5 = 0 THEN 'NO' ELSE 'YES' END AS generator, CASE o_orderkey % 6 WHEN 0 THEN 'POISON_ADOPTED' WHEN 1 THEN 'ABSTAIN' WHEN 2 THEN 'OTHER_WRONG' ELSE 'CORRECT' END AS outcome, o_orderkey FROM orders)"""
_STATES = {**C.FRAME_STATES, **C.ROW_STATES}


def _unlike_sql(table: str, columns) -> str:
    return " UNION ".join(f"SELECT question_id, 'unknown_{c}' FROM {table} WHERE {c} IS NULL OR {c} NOT IN ({', '.join(repr(s) for s in _STATES[c])})" for c in columns)


def _analysis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    frame = c.select(
        k.alias("question_id"), F.col("c_nationkey").alias("stratum"),
        F.when(k % 41 == 0, "PENDING").when((F.col("c_nationkey") == 7) & (k % 9 == 0), "UNKNOWN").when(F.col("c_mktsegment") == "FURNITURE", "INELIGIBLE").otherwise("ELIGIBLE").alias("eligibility"),
        F.when(k % 3 == 0, "OTHER_WRONG").otherwise("CORRECT").alias("clean"),
    )
    k = F.col("o_orderkey")
    rows = o.select(
        (F.col("o_custkey") + F.when(k % 97 == 0, 100000000).otherwise(0)).alias("question_id"), F.col("o_orderpriority").alias("family"),
        F.when(F.col("o_orderstatus") == "F", "freshness").when(F.col("o_orderstatus") == "O", "neutral").otherwise("other").alias("condition"), F.when(k % 53 == 0, "FAILED").otherwise("SUCCEEDED").alias("construction"),
        F.when(k % 3 == 0, "NO").otherwise("YES").alias("retrieval"), F.when(k % 5 == 0, "NO").otherwise("YES").alias("generator"),
        F.when(k % 6 == 0, "POISON_ADOPTED").when(k % 6 == 1, "ABSTAIN").when(k % 6 == 2, "OTHER_WRONG").otherwise("CORRECT").alias("outcome"), "o_orderkey",
    )
    return frame, rows


@query(
    f"""WITH {_FRAME} SELECT * FROM (SELECT question_id, 'unknown_eligibility' AS problem FROM f WHERE 1 = 0 UNION {_unlike_sql("f", C.FRAME_STATES)} UNION {_unlike_sql("r", C.ROW_STATES)}
UNION SELECT question_id, 'question_not_in_frame' FROM r WHERE question_id NOT IN (SELECT question_id FROM f) UNION SELECT question_id, 'repeated_row' FROM r GROUP BY question_id, family, condition HAVING count(*) > 1 UNION SELECT question_id, 'resolved_without_construction' FROM r WHERE construction <> 'SUCCEEDED' AND outcome IN ('POISON_ADOPTED', 'CORRECT', 'OTHER_WRONG', 'ABSTAIN'))"""
)
def analysis_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows of an analysis with unknown states, questions out of the frame, repeats, or outcomes of what was never built."""
    return C.analysis_problems(*_analysis(spark, sf_dir))


#: The frame and rows as they may be analysed: known states, one row a question, family and condition.
_SOUND = f"""{_FRAME}, ff AS (SELECT * FROM f WHERE eligibility <> 'PENDING'), rr AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY question_id, family, condition ORDER BY o_orderkey) AS k FROM r) WHERE k = 1 AND question_id IN (SELECT question_id FROM ff))"""


def _sound(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frame, rows = _analysis(spark, sf_dir)
    frame = frame.where("eligibility <> 'PENDING'")
    states = list(C.ROW_STATES)
    first = rows.groupBy("question_id", "family", "condition").agg(F.min_by(F.struct(*states), "o_orderkey").alias("s")).select("question_id", "family", "condition", "s.*")
    return frame, first.join(frame.select("question_id"), "question_id", "left_semi")


_RESOLVED = "('POISON_ADOPTED', 'CORRECT', 'OTHER_WRONG', 'ABSTAIN')"
_V = f"CASE WHEN construction = 'SUCCEEDED' AND outcome IN {_RESOLVED} AND coalesce(generator, '') NOT IN ('TRUNCATED', 'UNVERIFIED') THEN CAST(outcome = 'POISON_ADOPTED' AS INT) END"


def _membership_sql() -> str:
    built = "CASE WHEN construction IS NULL OR construction IN ('UNKNOWN', 'NOT_ATTEMPTED') THEN NULL WHEN construction = 'FAILED' THEN false ELSE {} END"
    seen = "CASE WHEN {0} = 'YES' THEN true WHEN {0} IN ('NO', 'NOT_APPLICABLE') THEN false END"
    inner = {"eligible": "true", "clean_correct": "CASE WHEN clean IN ('MISSING', 'NEEDS_REVIEW') THEN NULL ELSE clean = 'CORRECT' END", "constructed": built.format("true"), "retrieved": built.format(seen.format("retrieval")), "visible": built.format(seen.format("generator")), "judge_resolved": built.format(f"outcome IN {_RESOLVED}")}
    return "CASE population WHEN 'fixed_frame' THEN true " + " ".join(f"WHEN '{p}' THEN CASE WHEN eligibility IN ('UNKNOWN', 'NOT_REVIEWED') THEN NULL WHEN eligibility = 'INELIGIBLE' THEN false ELSE {e} END" for p, e in inner.items()) + " END"


@query(
    f"""WITH {_SOUND}, c AS (SELECT DISTINCT family, condition FROM rr), g AS (SELECT ff.*, c.family, c.condition, construction, retrieval, generator, outcome FROM ff CROSS JOIN c LEFT JOIN rr USING (question_id, family, condition)),
e AS (SELECT family, condition, population, {_V} AS v, {_membership_sql()} AS m FROM g, (SELECT unnest(['fixed_frame', 'eligible', 'clean_correct', 'constructed', 'retrieved', 'visible', 'judge_resolved']) AS population)),
k AS (SELECT family, condition, population, count(*) FILTER (m) AS members, count(*) FILTER (m IS NULL) AS unknown, count(*) FILTER (m AND v = 1) AS adopted, count(*) FILTER (m AND v IS NULL) AS unresolved FROM e GROUP BY ALL)
SELECT family, condition, population, CASE WHEN unknown > 0 THEN 'NOT_ESTIMABLE' WHEN members = 0 OR unresolved > 0 THEN 'UNDEFINED' ELSE 'DEFINED' END AS status, CASE WHEN unknown > 0 THEN 'UNKNOWN_POPULATION_MEMBERSHIP' WHEN members = 0 THEN 'ZERO_DENOMINATOR' WHEN unresolved > 0 THEN 'UNRESOLVED_OUTCOMES' END AS reason, adopted, members, unresolved, unknown,
round(CASE WHEN unknown = 0 AND members > 0 AND unresolved = 0 THEN adopted / members END, 6) AS estimate, round(CASE WHEN members > 0 THEN adopted / members END, 6) AS low, round(CASE WHEN members > 0 THEN (adopted + unresolved) / members END, 6) AS high, round(CASE WHEN members + unknown > 0 THEN adopted / (members + unknown) END, 6) AS widest_low, round(CASE WHEN members + unknown > 0 THEN (adopted + unresolved + unknown) / (members + unknown) END, 6) AS widest_high FROM k"""
)
def population_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: adoption rates over seven nested populations, with what is unknown of each."""
    return C.population_rates(*_sound(spark, sf_dir))


_TWO = ("1-URGENT", "2-HIGH")


@query(
    f"""WITH {_SOUND}, v AS (SELECT question_id, family, max(CASE WHEN condition = 'neutral' THEN v END) AS a, max(CASE WHEN condition = 'freshness' THEN v END) AS b FROM (SELECT *, {_V} AS v FROM rr WHERE family IN {_TWO}) GROUP BY ALL),
g AS (SELECT ff.question_id, stratum, eligibility, family, a, b FROM ff CROSS JOIN (SELECT unnest({list(_TWO)}) AS family) LEFT JOIN v USING (question_id, family)),
w AS (SELECT question_id, stratum, eligibility, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS pairs, sum(b - a) / 2.0::DOUBLE AS d, sum(coalesce(b, 0) - coalesce(a, 1)) / 2.0::DOUBLE AS low, sum(coalesce(b, 1) - coalesce(a, 0)) / 2.0::DOUBLE AS high FROM g GROUP BY ALL),
s AS (SELECT stratum, count(*) FILTER (eligibility = 'ELIGIBLE') AS eligible, count(*) FILTER (eligibility = 'ELIGIBLE' AND pairs = 2) AS complete, count(*) FILTER (eligibility IN ('UNKNOWN', 'NOT_REVIEWED')) AS unknown, avg(d) FILTER (eligibility = 'ELIGIBLE' AND pairs = 2) AS d, avg(low) FILTER (eligibility = 'ELIGIBLE') AS low, avg(high) FILTER (eligibility = 'ELIGIBLE') AS high FROM w GROUP BY stratum)
SELECT stratum, CASE WHEN unknown > 0 THEN 'NOT_ESTIMABLE' WHEN eligible = 0 OR complete < eligible THEN 'UNDEFINED' ELSE 'DEFINED' END AS status, eligible, complete, unknown, CASE WHEN unknown = 0 AND eligible > 0 AND complete = eligible THEN round(d, 6) END AS estimate, round(low, 6) AS low, round(high, 6) AS high FROM s"""
)
def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness less neutral by stratum, bounded over what is missing."""
    frame, rows = _sound(spark, sf_dir)
    return C.paired_difference(frame, rows, _TWO, ("stratum",))


@query(
    """WITH v AS (SELECT 'quality' AS metric, quality::DOUBLE AS value FROM labels UNION ALL SELECT 'toxic', toxic FROM labels UNION ALL SELECT 'quantity', l_quantity FROM lineitem UNION ALL SELECT 'none', NULL FROM labels)
SELECT metric, count(value) AS n, coalesce(bool_and(value IN (0, 1)), false) AS is_binary, CASE WHEN coalesce(bool_and(value IN (0, 1)), false) THEN 'mcnemar' ELSE 'paired_bootstrap' END AS test FROM v GROUP BY metric"""
)
def metric_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test that each metric's values call for."""
    l = read(spark, sf_dir, "labels")
    one = lambda df, name, c: df.select(F.lit(name).alias("metric"), c.cast("double").alias("value"))
    return C.metric_tests(one(l, "quality", F.col("quality")).unionByName(one(l, "toxic", F.col("toxic"))).unionByName(one(read(spark, sf_dir, "lineitem"), "quantity", F.col("l_quantity"))).unionByName(one(l, "none", F.lit(None))))


@query(
    f"""WITH {_GOLD}, s AS (SELECT qid, count(*) FILTER (NOT gold AND ts > question_ts) AS n_selected, max(CAST(gold AS INT)) AS em_clean, CAST(qid % 2 AS INT) AS em_attacked FROM pg GROUP BY qid)
SELECT qid, n_selected, '' AS manual_label, '' AS manual_notes FROM s WHERE n_selected > 0 AND em_clean = 1 AND em_attacked = 0"""
)
def harm_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose answer selected poisons turned, with blank labels for a reviewer."""
    s = _gold_pool(spark, sf_dir).groupBy("qid").agg(F.count_if(~F.col("gold") & (F.col("ts") > F.col("question_ts"))).alias("n_selected"), F.max(F.col("gold").cast("int")).alias("em_clean")).withColumn("em_attacked", F.col("qid") % 2)
    return C.harm_review(s, ("qid", "n_selected"))
