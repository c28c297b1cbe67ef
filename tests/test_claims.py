"""Claim keys as joins against the row-wise rule, and the faults of keys."""

import hashlib
import itertools
import json

from pyspark.sql import functions as F

from lodestone.operators import audit as A
from lodestone.operators import claims as K

CONTEXT = {"question_id": "q", "question": "Is it \"red\"?", "primary_gold": "it is red", "aliases": ["red"], "source_id": "d", "source_text": "é\n"}


def _hash(x):
    return hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _key(**changes):
    return {
        "key_id": "k", "question_id": "q", "question_hash": _hash(CONTEXT["question"]), "primary_gold_hash": _hash("it is red"), "aliases_hash": _hash(["red"]), "source_id": "d", "source_hash": _hash("é\n"),
        "subject": "s", "relation": "r", "false_state": "f", "units": None, "polarity": "positive", "temporal_qualifiers": [], "false_expressions": ["It is BLUE"], "gold_expressions": ["it is red"],
        "provenance": "p", "approval_status": "approved", "reviewer": "me", "schema_version": "claim_key_v2", "ambiguous": False,
    } | changes


def _frames(spark, keys, answers):
    schema = ", ".join(f"{k} {t}" for k, t in K.KEY_FIELDS.items())
    keys = spark.createDataFrame([tuple(k[f] for f in K.KEY_FIELDS) for k in keys], schema)
    context = [F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in CONTEXT.items()]
    return keys, spark.createDataFrame(answers, "answer_id int, answer string, key_id string").select("*", *context)


def test_digest_is_of_canonical_json(spark):
    keys, _ = _frames(spark, [_key()], [])
    assert K.bound(keys).first().key_hash == _hash(_key())


def test_answers_as_the_row_wise_rule_has_them(spark):
    pieces = ["It is red.", "it is BLUE", "red?", 'The report says "It is blue".', "the source claims “it is red”.", "maybe", 'He said "no".', "", "3*4", "unknown", "It isn't blue;"]
    texts = [sep.join(p) for n in (1, 2, 3) for sep in (" ", "\n") for p in itertools.product(pieces, repeat=n) if n < 3 or sep == " "] + [None, "  ", "Insufficient information.", "I do not know?"]
    keys, answers = _frames(spark, [_key()], [(i, t, "k") for i, t in enumerate(texts)] + [(-1, "it is red", None), (-2, "it is red", "unheard of")])
    approvals = K.bound(keys).select("key_id", F.col("key_hash").alias("digest"))
    rows = {r.answer_id: r for r in K.judge_answers(answers, keys, approvals).collect()}
    assert len(rows) == len(texts) + 2
    for i, t in enumerate(texts):
        assert (rows[i].label, rows[i].reason) == A.claim_verdict(t, ["it is red"], ["It is BLUE"]), t
    assert rows[-1].reason == rows[-2].reason == "missing_claim_key" and rows[-1].key_id is None
    both = next(i for i, t in enumerate(texts) if t == "It is red. it is BLUE")
    assert rows[both].evidence == ["It is red.", "it is BLUE"] and rows[both].review_status == "required"
    assert len({r.evaluation_id for r in rows.values()}) == len({(t or "", True) for t in texts}) + 1


def test_every_fault_of_a_key(spark):
    cases = {
        "mismatch:question_id": {"question_id": "other"}, "mismatch:question_hash": {"question_hash": ""}, "mismatch:primary_gold_hash": {"primary_gold_hash": ""}, "mismatch:aliases_hash": {"aliases_hash": _hash("red")},
        "mismatch:source_id": {"source_id": "e"}, "mismatch:source_hash": {"source_hash": _hash("é")}, "unsupported_key_schema": {"schema_version": "2"}, "unapproved_or_stale_key": {"reviewer": " "},
        "ambiguous_key": {"ambiguous": True}, "incomplete_key": {"relation": ""}, "invalid_polarity": {"polarity": "both"}, "missing_expressions": {"gold_expressions": []}, "alias_or_gold_collision": {"false_expressions": ["RED!"]},
    }
    assert list(cases) == list(K.PROBLEMS)
    made = [_key(key_id=name, **change) for name, change in cases.items()] + [_key(), _key(key_id="stale"), _key(key_id="odd", false_expressions=["1²", ""])]
    keys, answers = _frames(spark, made, [(i, "it is red", k["key_id"]) for i, k in enumerate(made)])
    approvals = K.bound(keys).select("key_id", F.when(F.col("key_id") == "stale", "x").otherwise(F.col("key_hash")).alias("digest")).where("key_id <> 'gone'")
    got = {r.key_id: r.problems for r in K.key_problems(answers.withColumnRenamed("answer_id", "context_id"), keys, approvals).collect()}
    assert got == {name: [name] for name in cases} | {"k": [], "stale": ["unapproved_or_stale_key"], "odd": ["missing_expressions"]}


def test_answers_move_once_to_their_keys(spark):
    """Texts, sentences and golds went through joins of their own, and a frequent sentence to one task."""
    keys, answers = _frames(spark, [_key()], [(1, "it is red", "k")])
    plan = K.judge_answers(answers, keys, K.bound(keys).select("key_id", F.col("key_hash").alias("digest")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("Aggregate ") == 0


def test_reading_arrays_with_nulls(spark):
    rows = spark.createDataFrame([(1, ["a?", None, "a?"]), (2, None), (3, []), (4, ["5×", "B"])], "i int, x array<string>").coalesce(1)
    got = {r.i: r.y and [x and tuple(x) for x in r.y] for r in rows.select("i", K.reading("x").alias("y")).where("i > 0").collect()}
    assert got == {1: [("a", False, True), None, ("a", False, True)], 2: None, 3: [], 4: [(None, True, False), ("b", False, False)]}
