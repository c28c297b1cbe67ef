"""Claim keys: reviewed expressions of what is right and what is false, bound by digests to their question, and answers judged by them.

Each text is normalised where it stands, once for each batch that holds it. An answer meets its key in one equi-join; what its sentences
say, a key's faults, and what its expressions and its context's gold have in common are expressions over arrays of forms.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from lodestone.functions import identity as I
from lodestone.functions import text as T
from lodestone.operators import judge as J

# The version of a key's fields, and what an approved one has.
SCHEMA_VERSION, APPROVED, POLARITIES = "claim_key_v2", "approved", ("positive", "negative")
# The codes of a key's faults, in the order in which they are told.
PROBLEMS = (
    "mismatch:question_id", "mismatch:question_hash", "mismatch:primary_gold_hash", "mismatch:aliases_hash", "mismatch:source_id", "mismatch:source_hash",
    "unsupported_key_schema", "unapproved_or_stale_key", "ambiguous_key", "incomplete_key", "invalid_polarity", "missing_expressions", "alias_or_gold_collision",
)
# Where an answer's sentences part, a plainly attributed quotation, answers that only abstain.
SENTENCES = r'(?U)(?<=[.!?])\s+|(?<=[.!?]["\u201d])\s+|;\s*|\n+'
ATTRIBUTED = r'(?i)^(?:the passage|the report|the source) (?:claims|says|states)(?U:\s+)(?:"([^"\u201c\u201d\n]+)"|\u201c([^"\u201c\u201d\n]+)\u201d)[.!]?$'
ABSTENTIONS = ("unknown", "i do not know", "i have no idea", "insufficient information", "not enough information", "the context does not provide this")

KEY_FIELDS = {
    "key_id": "string", "question_id": "string", "question_hash": "string", "primary_gold_hash": "string", "aliases_hash": "string", "source_id": "string", "source_hash": "string",
    "subject": "string", "relation": "string", "false_state": "string", "units": "string", "polarity": "string", "temporal_qualifiers": "array<string>", "false_expressions": "array<string>",
    "gold_expressions": "array<string>", "provenance": "string", "approval_status": "string", "reviewer": "string", "schema_version": "string", "ambiguous": "boolean",
}
CONTEXT_FIELDS = ("question_id", "question", "primary_gold", "aliases", "source_id", "source_text")


_READ = pa.struct([("form", pa.string()), ("unsafe", pa.bool_()), ("asks", pa.bool_())])


@F.arrow_udf(ArrayType(StructType([StructField("form", StringType()), StructField("unsafe", BooleanType()), StructField("asks", BooleanType())])))
def reading(texts: pa.Array) -> pa.Array:
    """Of arrays of texts, each text's form as an expression, null if it has none; whether it is unsafe; whether it asks.

    Each different text of a batch is read once. A null text gives null, a null array too.
    """
    each = texts.flatten().dictionary_encode()
    said = each.dictionary.to_pylist()
    rows = pa.array([{"form": T.expression(x), "unsafe": T.is_unsafe(x), "asks": "?" in unicodedata.normalize("NFKC", x)} for x in said], _READ)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(texts), 0).cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, rows.take(each.indices), mask=texts.is_null())


def _quoted(c: Column) -> Column:
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def text_hash(c: Column) -> Column:
    return F.sha2(_quoted(c), 256)


def list_hash(c: Column) -> Column:
    return F.sha2(F.to_json(c), 256)


def key_digest(prefix: str = "") -> Column:
    """What an approval binds: the SHA-256 of all fields of a key as canonical JSON, expressions in their order and spelling."""
    return F.sha2(I.canonical(*[F.col(f"{prefix}{f}").alias(f) if prefix else f for f in KEY_FIELDS]), 256)


def bound(keys: DataFrame) -> DataFrame:
    """keys with their digest as key_hash."""
    return keys.withColumn("key_hash", key_digest())


def _keyed(keys: DataFrame, approvals: DataFrame) -> DataFrame:
    """(key_id, key_hash, k_ and each other field, false_forms, gold_forms, digest): all that answers meet of a key, one row a key_id."""
    fields = [F.col(f).alias(f"k_{f}") for f in KEY_FIELDS if f != "key_id"]
    forms = [reading(f"{of}_expressions")["form"].alias(f"{of}_forms") for of in ("false", "gold")]
    return bound(keys).select("key_id", "key_hash", *fields, *forms).join(approvals.select("key_id", "digest"), "key_id", "full_outer")


def _stated() -> Column:
    """The forms of a context's gold and aliases."""
    return reading(F.concat(F.array("primary_gold"), F.col("aliases")))["form"]


def _problems() -> Column:
    """The faults, in the order of PROBLEMS, of the key that stands in a row of _keyed() beside a context and `stated`."""
    none = F.array().cast("array<string>")
    false, right, stated = (F.coalesce(F.transform(c, lambda x: F.coalesce(x, F.lit("\0"))), none) for c in ("false_forms", "gold_forms", "stated"))
    differs = lambda field, value: ~F.col(f"k_{field}").eqNullSafe(value)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    said = F.concat(false, right)
    faults = [
        differs("question_id", F.col("question_id")),
        differs("question_hash", text_hash(F.col("question"))),
        differs("primary_gold_hash", text_hash(F.col("primary_gold"))),
        differs("aliases_hash", list_hash(F.col("aliases"))),
        differs("source_id", F.col("source_id")),
        differs("source_hash", text_hash(F.col("source_text"))),
        differs("schema_version", F.lit(SCHEMA_VERSION)),
        differs("approval_status", F.lit(APPROVED)) | blank("k_reviewer") | ~F.col("digest").eqNullSafe(F.col("key_hash")),
        F.coalesce("k_ambiguous", F.lit(False)),
        blank("key_id") | blank("k_subject") | blank("k_relation") | blank("k_false_state") | blank("k_provenance") | blank("question_id") | blank("source_id"),
        ~F.coalesce(F.col("k_polarity").isin(*POLARITIES), F.lit(False)),
        (F.size(false) == 0) | (F.size(right) == 0) | F.array_contains(said, "") | F.array_contains(said, "\0"),
        F.arrays_overlap(false, F.concat(right, stated)),
    ]
    return F.array_compact(F.array(*[F.when(fault, name) for fault, name in zip(faults, PROBLEMS, strict=True)]))


def key_problems(contexts: DataFrame, keys: DataFrame, approvals: DataFrame) -> DataFrame:
    """(context_id, key_id, key_hash, problems): the faults of each context's key, in the order of PROBLEMS.

    contexts is (context_id, key_id, CONTEXT_FIELDS), the key that an answer is to be judged by; keys has KEY_FIELDS, one row a
    key_id; approvals is (key_id, digest), at most one a key. A context without a key, or whose key is not there, is left out.
    """
    both = contexts.withColumn("stated", _stated()).join(_keyed(keys, approvals).where("key_hash IS NOT NULL"), "key_id")
    return both.select("context_id", "key_id", "key_hash", _problems().alias("problems"))


def judge_answers(answers: DataFrame, keys: DataFrame, approvals: DataFrame) -> DataFrame:
    """(answer_id, label, reason, key_id, key_hash, review_status, evaluation_id, evidence) of each answer.

    answers is (answer_id, answer, key_id, CONTEXT_FIELDS), key_id null without a key. A sentence asserts what its whole expression equals.
    A false expression that is plainly attributed to a source asserts nothing; a question, another quotation or any other sentence leaves the
    answer to review, as do unsafe notation, an invalid key and both states. evidence are the sentences that asserted something, in order.
    evaluation_id binds the context, the answer, the key's digest and what approves it.
    """
    blanks = r"(?U)^\s+|\s+$"
    rows = answers.withColumn("bare", F.regexp_replace(F.coalesce("answer", F.lit("")), blanks, ""))
    rows = rows.withColumn("sentences", F.split("bare", SENTENCES, -1))
    bare = lambda x: F.regexp_replace(x, blanks, "")
    quoted = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(bare(x), ATTRIBUTED, g), F.lit("")) for g in (1, 2)])
    # all texts of an answer are read in its own row, so it moves once, to its key
    rows = rows.withColumns({"whole": reading(F.array("answer")), "stated": _stated(), "read": reading("sentences"), "read_quoted": reading(F.transform("sentences", quoted))})
    rows = rows.withColumn("whole", F.col("whole")[0]).join(_keyed(keys, approvals), "key_id", "left")

    among = lambda forms, x: F.coalesce(F.array_contains(forms, x), F.lit(False))
    state = lambda x: F.when(~x["asks"], F.when(among("false_forms", x["form"]), "false").when(among("gold_forms", x["form"]), "gold"))
    attributed = lambda x, q: among("false_forms", q["form"]) & ~x["asks"]
    rows = rows.withColumn("parts", F.zip_with("read", "read_quoted", lambda x, q: F.when(attributed(x, q), "attributed").otherwise(F.coalesce(state(x), F.lit("unknown")))))
    told = F.zip_with("sentences", "parts", lambda x, part: F.when(part.isin("gold", "false"), x))
    both = rows.select(
        "*", "whole.unsafe", "whole.asks", F.array_join(_problems(), ";").alias("problems"), *[F.array_contains("parts", p).alias(p) for p in ("attributed", "unknown", "gold", "false")], F.array_compact(told).alias("told")
    )
    keyed = F.col("key_hash").isNotNull()
    verdict = lambda label, reason: F.struct(F.lit(label).alias("label"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    v = (
        F.when(F.col("bare") == "", verdict(J.OTHER, "empty_answer"))
        .when(F.col("unsafe"), verdict(J.REVIEW, "unsupported_mathematical_notation"))
        .when(~F.col("asks") & F.col("whole.form").isin(*ABSTENTIONS), verdict(J.OTHER, "pure_abstention"))
        .when(~keyed, verdict(J.REVIEW, "missing_claim_key"))
        .when(F.col("problems") != "", verdict(J.REVIEW, F.concat(F.lit("invalid_claim_key:"), F.col("problems"))))
        .when(F.col("gold") & F.col("false"), verdict(J.REVIEW, "mixed_gold_and_false"))
        .when(F.col("unknown"), verdict(J.REVIEW, "unrecognized_or_unresolved_assertion"))
        .when(F.col("gold"), verdict(J.CORRECT, "endorsed_reviewed_gold"))
        .when(F.col("false") & ~F.col("attributed"), verdict(J.ADOPTED, "endorsed_reviewed_false"))
        .otherwise(verdict(J.REVIEW, "attribution_without_resolved_endorsement"))
    )
    both = both.withColumn("v", v)
    heard = F.col("v.reason").isin("mixed_gold_and_false", "unrecognized_or_unresolved_assertion", "endorsed_reviewed_gold", "endorsed_reviewed_false", "attribution_without_resolved_endorsement")
    evaluation = F.sha2(I.canonical(F.struct(*CONTEXT_FIELDS).alias("context"), F.coalesce("answer", F.lit("")).alias("answer"), F.col("key_hash").alias("key"), F.col("digest").alias("approval")), 256)
    return both.select(
        "answer_id",
        "v.label",
        "v.reason",
        F.when(keyed, F.col("key_id")).alias("key_id"),
        "key_hash",
        F.when(F.col("v.label") == J.REVIEW, "required").otherwise("automatic").alias("review_status"),
        evaluation.alias("evaluation_id"),
        F.when(heard, F.col("told")).otherwise(F.array().cast("array<string>")).alias("evidence"),
    )
