import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import audit as A
from lodestone.operators import judge as J
from tests.conftest import one


def value(spark, column, row, schema):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("text", ["", "short", "word " * 900, "x" * 4000, "a  b\n" * 1000, "é" * 1600 + " tail"])
def test_span_chunks_cover_and_fit(spark, text):
    spans = [(s.begin, s.end) for s in value(spark, A.span_chunks(F.col("t")), (text,), "t string")]
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:]))
    assert all(e - b <= 1500 and len(text[b:e].split()) <= 320 for b, e in spans)


def test_alignment_and_stitching(spark):
    place = lambda p, c: value(spark, A.place_children(F.col("p"), F.col("c")), (p, c), "p string, c array<string>")
    assert [tuple(x) for x in place("ab cd ef", ["abcd", "cdef"])] == [(0, 5), (3, 8)]
    assert place("aaaaa", ["aaa", "aa", "aa"]) is None and place("abc", ["ab"]) is None and place("abc", []) is None
    join = lambda a, b: value(spark, A.stitch(F.col("a"), F.col("b")), (a, b), "a string, b string")
    assert join("hello wor", "world") == 3 and join("abab", "abx") is None or join("abab", "abx") == 2
    assert join("aaa", "aab") is None and join("x", "y") is None
    assert value(spark, A.diff_spans(F.col("a"), F.col("b")), ("abc", "axc"), "a string, b string") == ["replace:1:2:1:2"]


def test_alignment_of_repeated_text(spark):
    """One complete way among millions of partial ones, and four ways."""
    place = lambda p, c: value(spark, A.place_children(F.col("p"), F.col("c")), (p, c), "p string, c array<string>")
    assert [tuple(x) for x in place("a" * 100, ["a" * 20] * 5)] == [(20 * i, 20 * i + 20) for i in range(5)] and place("a" * 99, ["a" * 20] * 5) is None


def test_loose_fields(spark):
    f = lambda c, s: value(spark, c(F.col("s")), (s,), "s string")
    assert f(A.string_list, '["a"]') == ["a"] and f(A.string_list, "['a', 'b']") == ["a", "b"] and f(A.string_list, "[1]") is None and f(A.string_list, None) is None
    assert f(lambda c: A.values_by_key(c, "k"), '{"a":{"k":"x"},"b":[{"k":2}]}') == ["x", "2"] and f(lambda c: A.values_by_key(c, "k"), "{") == []
    assert [f(T.has_quotation, s) for s in ("it's fine", 'he said "no"', "«oui»", "12′", "＂wide＂", None)] == [False, True, True, True, True, False]
    unsafe = ("½ cup", "2^3", "3 - 5", "1e5", "$5", "1,000", "3 to 5", "5 x 3", "４２", "²", "3–5", "a\u00adb", "+ 5", "5+", ".5", "1.2.3", "5 é")
    assert [s for s in unsafe if not f(T.unsafe_expression, s)] == []
    assert [s for s in ("42 people", "-3.5 degrees", "+7", "well-known", "é alone", "", None) if f(T.unsafe_expression, s)] == []
    assert [f(T.expression_normalize, s) for s in ("The Cat  sat.", "-3.5 Degrees", "“x”", "1,000", "", None)] == ["the cat sat", "-3.5 degrees", None, None, "", None]


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert one(A.one_to_one(a, b, "k"), "k", "problem") == [(2, "repeated_left"), (3, "only_right"), (None, "null_key")]


@pytest.mark.parametrize(
    ("answer", "label", "reason"),
    [
        ("It is red. ", "CORRECT", "endorsed_reviewed_gold"), ("It is blue.", "POISON_ADOPTED", "endorsed_reviewed_false"), ("It is red. It is blue.", "NEEDS_REVIEW", "mixed_gold_and_false"),
        ("", "OTHER_WRONG", "empty_answer"), (" ", "OTHER_WRONG", "empty_answer"), (None, "OTHER_WRONG", "empty_answer"), ("I do not know.", "OTHER_WRONG", "pure_abstention"), ("Unknown?", "NEEDS_REVIEW", "unrecognized_or_unresolved_assertion"),
        ("It is red. Maybe.", "NEEDS_REVIEW", "unrecognized_or_unresolved_assertion"), ("Is it red?", "NEEDS_REVIEW", "unrecognized_or_unresolved_assertion"), ("It is red; 3 to 5.", "NEEDS_REVIEW", "unsupported_mathematical_notation"),
        ('The passage claims "it is blue". It is red.', "CORRECT", "endorsed_reviewed_gold"), ('The report says “It is BLUE”.', "NEEDS_REVIEW", "attribution_without_resolved_endorsement"),
        ('The passage claims "it is red".', "NEEDS_REVIEW", "unrecognized_or_unresolved_assertion"), ('The source says "it is blue". It is blue.', "NEEDS_REVIEW", "attribution_without_resolved_endorsement"),
        ("It is ４２.", "NEEDS_REVIEW", "unsupported_mathematical_notation"), ("Ｉｔ is red", "CORRECT", "endorsed_reviewed_gold"),
    ],
)
def test_claim_verdict(answer, label, reason):
    assert A.claim_verdict(answer, ["it is red"], ["It is BLUE"]) == (label, reason)


def test_claim_judge(spark):
    answers = spark.createDataFrame([(1, "It is red."), (2, "It is blue."), (3, "It is red."), (4, None)], "q int, a string")
    claims = spark.createDataFrame([(q, e, s) for q in (1, 2, 4) for e, s in (("it is red", "gold"), ("It is BLUE", "poison"))], "q int, expression string, state string")
    assert one(A.judge_claims(answers, ("q",), "a", claims), "q", "label", "reason") == [
        (1, "CORRECT", "endorsed_reviewed_gold"), (2, "POISON_ADOPTED", "endorsed_reviewed_false"), (3, "NEEDS_REVIEW", "missing_claim_key"), (4, "OTHER_WRONG", "empty_answer"),
    ]


def test_rule_judge_reads_compatible_forms(spark):
    rows = spark.createDataFrame([("how many", "42", "７", "４２"), ("how many", "42", "７", "7")], "q string, g string, p string, a string")
    assert [(r.label, r.reason) for r in J.judge(rows, "q", "g", "p", "a").orderBy("reason").collect()] == [("CORRECT", "matches_gold"), ("POISON_ADOPTED", "matches_poison")]


def test_snapshots_and_hits_leave_nothing_out(spark):
    from lodestone.plans import audit, corpus, retrieval
    from lodestone.plans.common import read
    from tests.conftest import SMALL

    ids = {r.doc_id for r in read(spark, SMALL, "documents").select("doc_id").collect()}
    assert {r.doc_id for r in corpus.snapshot_merge_all(spark, SMALL).collect()} == ids
    want = {(r.qid, r.idx, r["rank"]) for r in retrieval.bm25_topk(spark, SMALL).collect()}
    assert {(r.qid, r.idx, r["rank"]) for r in audit.ranked_hits_to_candidates(spark, SMALL).collect()} == want
