"""Queries of claim keys. Customers stand for questions, orders for answers; faults are planted by remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import claims as K

from .common import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Of a question: what is right, what is false, and of every answer's remainder by 12 what it says.
_SAYS = (
    ("''", "OTHER_WRONG", "empty_answer"),
    ("'I do not know.'", "OTHER_WRONG", "pure_abstention"),
    ("'It is ' || s || '.'", "CORRECT", "endorsed_reviewed_gold"),
    ("'it  IS ' || lower(w)", "POISON_ADOPTED", "endorsed_reviewed_false"),
    ("'It is ' || s || '. It is ' || w || '.'", "NEEDS_REVIEW", "mixed_gold_and_false"),
    ("'The report says \"It is ' || w || '\". ' || s || '!'", "CORRECT", "endorsed_reviewed_gold"),
    ("'the source STATES “It is ' || w || '”.'", "NEEDS_REVIEW", "attribution_without_resolved_endorsement"),
    ("'It is ' || s || '?'", "NEEDS_REVIEW", "unrecognized_or_unresolved_assertion"),
    ("'It costs 3 * 4.'", "NEEDS_REVIEW", "unsupported_mathematical_notation"),
    ("'Perhaps it is ' || s || '; ' || s", "NEEDS_REVIEW", "unrecognized_or_unresolved_assertion"),
    ("'The passage claims \"It is ' || w || '\". It is ' || w || '.'", "NEEDS_REVIEW", "attribution_without_resolved_endorsement"),
    ("s || chr(10) || 'It is ' || s", "CORRECT", "endorsed_reviewed_gold"),
)
# Of every customer's remainder by 17 its key's faults, in order; 13 has no key.
_FAULTS = {
    0: "mismatch:question_id;unapproved_or_stale_key", 1: "mismatch:question_hash;unapproved_or_stale_key", 2: "mismatch:primary_gold_hash", 3: "mismatch:aliases_hash", 4: "mismatch:source_id;mismatch:source_hash",
    5: "unsupported_key_schema", 6: "unapproved_or_stale_key", 7: "unapproved_or_stale_key", 8: "ambiguous_key", 9: "incomplete_key", 10: "invalid_polarity", 11: "missing_expressions", 12: "alias_or_gold_collision",
}
_WRONG = {"BUILDING": "MACHINERY", "MACHINERY": "FURNITURE", "FURNITURE": "HOUSEHOLD", "HOUSEHOLD": "AUTOMOBILE", "AUTOMOBILE": "BUILDING"}


def _case(pairs, of: str) -> str:
    return f"CASE {of} {' '.join(f'WHEN {k} THEN {v}' for k, v in pairs)} END"


_EXPECTED = f"""WITH x AS (SELECT o_orderkey, o_orderkey % 12 AS a, CASE WHEN o_custkey % 17 = 13 THEN NULL ELSE coalesce({_case([(k, f"'{v}'") for k, v in _FAULTS.items()], "o_custkey % 17")}, '') END AS faults, c_custkey IS NOT NULL AS there FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, CASE WHEN a IN (0, 1) THEN 'OTHER_WRONG' WHEN a = 8 OR faults IS NULL OR faults <> '' THEN 'NEEDS_REVIEW' ELSE {_case([(k, f"'{label}'") for k, (_, label, _) in enumerate(_SAYS)], "a")} END AS label,
CASE WHEN a IN (0, 1, 8) THEN {_case([(k, f"'{_SAYS[k][2]}'") for k in (0, 1, 8)], "a")} WHEN faults IS NULL THEN 'missing_claim_key' WHEN faults <> '' THEN 'invalid_claim_key:' || faults ELSE {_case([(k, f"'{reason}'") for k, (_, _, reason) in enumerate(_SAYS)], "a")} END AS reason FROM x WHERE there"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": "k", "c_mktsegment": "s", "c_name": "name"})
    wrong = F.create_map(*[F.lit(x) for pair in _WRONG.items() for x in pair])
    return c.select("k", "s", wrong[F.col("s")].alias("w"), F.concat(F.lit("Which segment has "), F.col("name"), F.lit("?")).alias("question"), F.concat(F.lit("About "), F.col("name")).alias("source_text"), (F.col("k") % 17).alias("f"))


def _context(of: Column) -> dict[str, Column]:
    return {
        "question_id": F.concat(F.lit("q"), of), "question": F.col("question"), "primary_gold": F.concat(F.lit("It is "), F.col("s")), "aliases": F.array("s", F.lower("s")),
        "source_id": F.concat(F.lit("d"), of), "source_text": F.col("source_text"),
    }


@query(_EXPECTED)
def claim_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers judged by claim keys that are bound to an approval manifest; every fault of a key and every outcome."""
    q, f = _questions(spark, sf_dir), F.col("f")
    context = _context(F.col("k"))
    put = lambda fault, value, fine: F.when(f == fault, value).otherwise(fine)
    false = F.concat(F.lit("It is "), F.col("w"))
    keys = q.where("f <> 13").select(
        F.concat(F.lit("key"), F.col("k")).alias("key_id"), put(0, F.lit("q0-"), context["question_id"]).alias("question_id"), K.text_hash(put(1, F.lit("?"), F.col("question"))).alias("question_hash"),
        K.text_hash(put(2, F.col("s"), context["primary_gold"])).alias("primary_gold_hash"), K.list_hash(put(3, F.array("s"), context["aliases"])).alias("aliases_hash"), put(4, F.lit("d-"), context["source_id"]).alias("source_id"),
        K.text_hash(put(4, F.lit(""), F.col("source_text"))).alias("source_hash"), F.lit("customer").alias("subject"), F.lit("segment").alias("relation"), F.col("w").alias("false_state"), F.lit(None).cast("string").alias("units"),
        put(10, F.lit("maybe"), F.lit("positive")).alias("polarity"), F.array().cast("array<string>").alias("temporal_qualifiers"),
        F.when(f == 11, F.array(F.lit("It is “5×”"))).when(f == 12, F.array(false, F.lower("s"))).otherwise(F.array(false)).alias("false_expressions"), F.array(context["primary_gold"], F.col("s")).alias("gold_expressions"),
        put(9, F.lit(" "), F.lit("review 1")).alias("provenance"), put(6, F.lit("draft"), F.lit("approved")).alias("approval_status"), F.lit("A. Reviewer").alias("reviewer"),
        put(5, F.lit("claim_key_v1"), F.lit("claim_key_v2")).alias("schema_version"), (f == 8).alias("ambiguous"), f.alias("f"),
    )
    # approvals are of the key as it was seen: 0 and 1 have changed since, 7 was approved under another digest
    seen = keys.select("key_id", F.when(f.isin(0, 1, 7), F.sha2(F.col("key_id"), 256)).otherwise(K.key_digest()).alias("digest"))
    says = F.expr(_case([(k, text.replace("chr(10)", "char(10)")) for k, (text, _, _) in enumerate(_SAYS)], "o_orderkey % 12"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k")).join(q, "k")
    answers = o.select(F.col("o_orderkey").alias("answer_id"), says.alias("answer"), F.when(f != 13, F.concat(F.lit("key"), F.col("k"))).alias("key_id"), *[c.alias(n) for n, c in context.items()])
    return K.judge_answers(answers, keys.drop("f"), seen).select(F.col("answer_id").alias("o_orderkey"), "label", "reason")
