"""Answer and ranking metrics. A metric that is undefined is null, never 0, and is left out of means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T


def relevant_by_tokens(golds: Column, candidate: Column) -> Column:
    """1 if all tokens of some gold answer, in any order, are tokens of the candidate; golds without tokens count for nothing."""
    have = T.answer_tokens(candidate)

    def within(g):
        need = T.answer_tokens(g)
        return (F.size(need) > 0) & (F.size(F.array_except(need, have)) == 0)

    return F.coalesce(F.exists(golds, within), F.lit(False)).cast("int")


def relevant_by_phrase(golds: Column, candidate: Column) -> Column:
    """1 if some gold answer stands in the candidate as a run of whole words."""
    text = T.normalize_answer(candidate)
    return F.coalesce(F.exists(golds, lambda g: T.contains_phrase(text, T.normalize_answer(g))), F.lit(False)).cast("int")


def exact_match(prediction: Column, golds: Column) -> Column:
    """1 if the prediction equals some gold answer in normal form."""
    p = T.normalize_answer(prediction)
    return F.coalesce(F.exists(golds, lambda g: T.normalize_answer(g) == p), F.lit(False)).cast("int")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the two token bags; 1 if both are empty, 0 if one is."""
    p, g = T.answer_tokens(prediction), T.answer_tokens(gold)

    def runs(tokens):
        """Distinct tokens with their counts, from one sort, so a long answer costs n log n."""
        return F.aggregate(
            F.array_sort(tokens),
            F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.expr("CAST(array() AS array<string>)").alias("out")),
            lambda acc, t: F.struct(
                t.alias("last"),
                F.when(acc["last"] == t, acc["n"] + 1).otherwise(1).alias("n"),
                F.concat(acc["out"], F.array(F.concat(t, F.lit("\u0001"), F.when(acc["last"] == t, acc["n"] + 1).otherwise(1).cast("string")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    # the k-th copy of a token is an element of its own, so the bags meet as sets
    shared = F.size(F.array_intersect(runs(p), runs(g)))
    return (
        F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double"))
        .when(shared == 0, F.lit(0.0))
        .otherwise(2.0 * shared / (F.size(p) + F.size(g)))
    )


def best_f1(prediction: Column, golds: Column) -> Column:
    """The highest token F1 over the gold answers."""
    return F.array_max(F.transform(golds, lambda g: token_f1(prediction, g)))


def ranking_metrics(rows: DataFrame, k: int = 5, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Of rows (qid, rank, relevant, valid), a row a question: recall, ndcg, violating, valid_recall, all at k.

    relevant is 0 or 1, valid tells whether the evidence is not later than the question (null: unknown). rank is
    null for candidates that were not ranked. violating is the share of the known top k that is not valid.
    """
    top, rel = F.coalesce(F.col("rank") <= k, F.lit(False)), F.coalesce(F.col("relevant"), F.lit(0))
    good = (rel == 1) & F.coalesce(F.col("valid"), F.lit(False))
    gain = F.when(top & (rel == 1), F.lit(1.0) / F.log2(F.col("rank") + 1)).otherwise(0.0)
    out = rows.groupBy(*by).agg(
        F.sum(rel).alias("n_relevant"),
        F.sum(F.when(top, rel).otherwise(0)).alias("hits"),
        F.sum(gain).alias("dcg"),
        F.avg(F.when(top & F.col("valid").isNotNull(), (~F.col("valid")).cast("int"))).alias("violating"),
        F.sum(good.cast("int")).alias("n_good"),
        F.sum((top & good).cast("int")).alias("good_hits"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(F.col("n_relevant"), F.lit(1))).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return out.select(
        *by,
        F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).alias("recall"),
        F.when(F.col("n_relevant") > 0, F.col("dcg") / ideal).alias("ndcg"),
        "violating",
        F.when(F.col("n_good") > 0, F.col("good_hits") / F.col("n_good")).alias("valid_recall"),
    )


def time_valid_accuracy(em: Column, question_time: Column, n_unknown: Column, all_valid: Column) -> Column:
    """1 if the answer matches and all used evidence is valid; null without a question time or with unknown evidence.

    all_valid is null where no evidence was used, and the accuracy then 0.
    """
    return F.when(question_time.isNotNull() & (n_unknown == 0), em * F.coalesce(all_valid, F.lit(False)).cast("int"))


def summarize(rows: DataFrame, metrics: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Means over the defined values of each metric, how many are defined, and n; by groups if they are given."""
    aggs = [F.count("*").alias("n")]
    for m in metrics:
        aggs += [F.round(F.avg(m), 6).alias(f"avg_{m}"), F.count(m).alias(f"n_defined_{m}")]
    return (rows.groupBy(*by) if by else rows).agg(*aggs)
