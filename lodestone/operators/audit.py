"""Audits: spans and alignments of texts, eligibility, rank order, joins that must be one to one, and claim matching."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata
from ast import literal_eval
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lodestone.functions import text as T
from lodestone.operators import judge as J

_SPAN = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())])


# --- spans -----------------------------------------------------------------------------------------------


def span_chunks(text: Column, tokens: int = 320, chars: int = 1500, overlap: int = 200) -> Column:
    """Spans (begin, end) of code points that cover the text: at most `tokens` blank-parted tokens and `chars` characters.

    A span ends behind a blank where it can, in the middle of a word longer than the limit where it must. The
    next one starts `overlap` characters earlier, at a word's start, as long as that is progress.
    """

    def one(s: str | None) -> list[dict]:
        s, out, at = s or "", [], 0
        while at < len(s) or not out:
            end, n, in_word = at, 0, False
            while end < len(s) and end - at < chars:
                blank = s[end].isspace()
                if not blank and not in_word:
                    if n == tokens:
                        break
                    n += 1
                in_word, end = not blank, end + 1
            if end < len(s) and not s[end - 1].isspace() and not s[end].isspace():
                back = next((i for i in range(end, at, -1) if s[i - 1].isspace()), at)
                end = back if back > at else end
            out.append({"begin": at, "end": end})
            if end >= len(s):
                break
            start = next((i for i in range(max(at + 1, end - overlap), end) if s[i - 1].isspace() and not s[i].isspace()), end)
            at = start if start > at else end
        return out

    return F.pandas_udf(lambda s: s.map(one), ArrayType(_SPAN))(text)


def diff_spans(a: Column, b: Column) -> Column:
    """The stretches in which two texts differ, as `tag:a0:a1:b0:b1`."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[f"{t}:{i}:{j}:{k}:{m}" for t, i, j, k, m in difflib.SequenceMatcher(None, p or "", q or "", autojunk=False).get_opcodes() if t != "equal"] for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(run, ArrayType(StringType()))(a, b)


def place_children(parent: Column, children: Column) -> Column:
    """Where each child stands in the parent, in order and without blanks counting, if there is exactly one way; else null."""

    def one(p: str | None, kids) -> list[dict] | None:
        at = [i for i, c in enumerate(p or "") if not c.isspace()]
        bare = "".join((p or "")[i] for i in at)
        lengths: list[int] = []
        levels: list[list[tuple[int, int, int]]] = []  # of each child, (start, ways to it up to two, a place before it)
        size = 0
        for k in kids if kids is not None else []:
            k = "".join((k or "").split())
            found = [i for i in range(len(bare) - len(k) + 1) if bare.startswith(k, i)] if k else []
            if not levels:
                level = [(i, 1, 0) for i in found if i == 0]
            else:
                starts, sums = [i for i, _, _ in levels[-1]], [0, *accumulate(n for _, n, _ in levels[-1])]
                level = []
                for i in found:  # the child before it starts earlier and leaves no gap
                    low, high = bisect_left(starts, i - size), bisect_left(starts, i)
                    if low < high:
                        level.append((i, min(2, sums[high] - sums[low]), low))
            levels.append(level)
            size = len(k)
            lengths.append(size)
        last = [x for x, (i, n, _) in enumerate(levels[-1]) if i + size == len(bare) and n == 1] if levels else []
        if not last:
            return None
        spans, x = [], last[0]
        for level, length in zip(reversed(levels), reversed(lengths), strict=True):
            i, _, before = level[x]
            spans.append({"begin": at[i], "end": at[i + length - 1] + 1})
            x = before
        return spans[::-1]

    return F.pandas_udf(lambda p, k: pd.Series([one(x, y) for x, y in zip(p, k, strict=True)]), ArrayType(_SPAN))(parent, children)


def stitch(left: Column, right: Column, least: int = 1) -> Column:
    """The length of the only overlap of `least` or more that ends left and starts right; null if there are none or several."""

    def one(a: str | None, b: str | None) -> int | None:
        a, b = a or "", b or ""
        ok = [n for n in range(least, min(len(a), len(b)) + 1) if a.endswith(b[:n])]
        return ok[0] if len(ok) == 1 else None

    return F.pandas_udf(lambda x, y: pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32"), IntegerType())(left, right)


# --- loose fields ----------------------------------------------------------------------------------------


def string_list(s: Column) -> Column:
    """A list of strings that is spelled as JSON or as a Python literal; null if it is neither."""

    def one(x: str | None) -> list[str] | None:
        for read in (json.loads, literal_eval):
            try:
                v = read(x or "")
            except (ValueError, SyntaxError):
                continue
            if isinstance(v, list) and all(isinstance(y, str) for y in v):
                return v
        return None

    return F.pandas_udf(lambda s: s.map(one), ArrayType(StringType()))(s)


def values_by_key(s: Column, key: str) -> Column:
    """Every value of a key at any depth of a JSON text, as text, in order; of a text that is no JSON, none."""

    def one(x: str | None) -> list[str]:
        out: list[str] = []

        def walk(v):
            if isinstance(v, dict):
                for k, w in v.items():
                    if k == key:
                        out.append(w if isinstance(w, str) else json.dumps(w))
                    walk(w)
            elif isinstance(v, list):
                for w in v:
                    walk(w)

        try:
            walk(json.loads(x or "null"))
        except ValueError:
            return []
        return out

    return F.pandas_udf(lambda s: s.map(one), ArrayType(StringType()))(s)


# --- joins that must hold ----------------------------------------------------------------------------------


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys that one side lacks, or that a side has more than once, or that are null."""
    a, b = left.groupBy(key).agg(F.count("*").alias("x")), right.groupBy(key).agg(F.count("*").alias("y"))
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    k = F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}"))
    problem = F.when(k.isNull(), "null_key").when(F.col("x").isNull(), "only_right").when(F.col("y").isNull(), "only_left").when(F.col("x") > 1, "repeated_left").when(F.col("y") > 1, "repeated_right")
    return both.select(k.alias(key), problem.alias("problem")).where("problem IS NOT NULL")


def rank_gaps(rows: DataFrame, by: tuple[str, ...], rank: str) -> DataFrame:
    """Rows whose rank is not one more than the one before, or, for the first, not 1."""
    w = Window.partitionBy(*by).orderBy(rank)
    return rows.withColumn("before", F.coalesce(F.lag(rank).over(w), F.lit(0))).where(F.col(rank) != F.col("before") + 1).select(*by, rank, "before")


def undefined_patterns(rows: DataFrame, system: str, question: str, metric: str) -> DataFrame:
    """Questions for which a metric is null in some systems but not in all."""
    g = rows.groupBy(question).agg(F.count("*").alias("n"), F.count(metric).alias("defined"))
    return g.where((F.col("defined") > 0) & (F.col("defined") < F.col("n")))


def cluster_status(n: Column, distinct: Column) -> Column:
    """What a bootstrap over n question means can say."""
    # The names of the states.
    return F.when(n == 0, "NOT_ESTIMABLE").when(n < 2, "NOT_ESTIMABLE_SINGLE_QUESTION").when(distinct == 1, "DEGENERATE_EMPIRICAL_DISTRIBUTION").when(n < 20, "SMALL_CLUSTER_COUNT").otherwise("APPROXIMATE")


# --- claims ------------------------------------------------------------------------------------------------


# Where an answer's sentences part, a plainly attributed quotation, answers that only abstain.
_SENTENCES = re.compile(r'(?<=[.!?])\s+|(?<=[.!?]["\u201d])\s+|;\s*|\n+')
_ATTRIBUTED = re.compile(r'(?:the passage|the report|the source) (?:claims|says|states)\s+(?:"([^"\u201c\u201d\n]+)"|\u201c([^"\u201c\u201d\n]+)\u201d)[.!]?', re.I)
_PURE_ABSTENTIONS = {"unknown", "i do not know", "i have no idea", "insufficient information", "not enough information", "the context does not provide this"}


def claim_verdict(answer: str | None, gold: list[str] | None, false: list[str] | None) -> tuple[str, str]:
    """(label, reason) of an answer by whole sentences against the reviewed gold and false expressions; None: there is no key.

    A sentence asserts what its expression equals. A false expression that is plainly attributed to a source asserts nothing;
    a question, another quotation or any other sentence leaves the answer to review, as do unsafe notation and both states.
    """
    answer = answer or ""
    if not answer.strip():
        return J.OTHER, "empty_answer"
    if T.is_unsafe(answer):
        return J.REVIEW, "unsupported_mathematical_notation"
    asks = lambda x: "?" in unicodedata.normalize("NFKC", x)
    if not asks(answer) and T.expression(answer) in _PURE_ABSTENTIONS:
        return J.OTHER, "pure_abstention"
    if gold is None and false is None:
        return J.REVIEW, "missing_claim_key"
    known = {T.expression(x): "gold" for x in gold if x is not None} if gold is not None else {}
    known |= {T.expression(x): "false" for x in false if x is not None} if false is not None else {}
    known.pop(None, None)
    states: set[str | None] = set()  # None: a sentence that asserts neither
    attributed = False
    for sentence in _SENTENCES.split(answer.strip()):
        quoted = _ATTRIBUTED.fullmatch(sentence.strip())
        said = quoted and (quoted[1] or quoted[2])
        if not asks(sentence) and said and known.get(T.expression(said)) == "false":
            attributed = True
        else:
            states.add(None if asks(sentence) else known.get(T.expression(sentence)))
    if {"gold", "false"} <= states:
        return J.REVIEW, "mixed_gold_and_false"
    if None in states:
        return J.REVIEW, "unrecognized_or_unresolved_assertion"
    if states == {"gold"}:
        return J.CORRECT, "endorsed_reviewed_gold"
    if states == {"false"} and not attributed:
        return J.ADOPTED, "endorsed_reviewed_false"
    return J.REVIEW, "attribution_without_resolved_endorsement"


def judge_claims(answers: DataFrame, key: tuple[str, ...], answer: str, claims: DataFrame) -> DataFrame:
    """(key, label, reason) of answers by claim_verdict(): claims is (key, expression, state), state gold or poison.

    The expressions of a key are a reviewed handful, so they travel as two lists beside its answer.
    """
    lists = claims.groupBy(*key).agg(*[F.collect_list(F.when(F.col("state") == s, F.col("expression"))).alias(f"_{s}") for s in ("gold", "poison")])
    verdict = F.pandas_udf(lambda a, g, p: pd.DataFrame([claim_verdict(*x) for x in zip(a, g, p, strict=True)], columns=["label", "reason"]), "label string, reason string")
    both = answers.join(lists, list(key), "left").select(*key, verdict(F.col(answer), "_gold", "_poison").alias("v"))
    return both.select(*key, "v.label", "v.reason")
