"""Perturbations of pools: which slots change, and what they change to.

Slots are drawn in the order of a hash over (seed, question, slot), never gold ones, so the slots of a smaller
count are the first of a larger one whatever order the candidates come in. A copying perturbation has one source
for all its slots and never overwrites it. A question with too few slots, or without a source, keeps its pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import identity as I
from lodestone.functions import temporal as D

DAY = 86400
COUNTS = (1, 2, 5)

# Condition, needs a text, shifts a date, copies a passage, changes what a reader sees.
SPECS = (
    ("clean", False, False, False, False),
    ("stale_evidence", True, False, False, True),
    ("fabricated_fresh", True, True, False, True),
    ("future_date", False, True, False, False),
    ("duplicate_fresh", True, False, True, True),
    ("correct_content_wrong_date", False, True, False, True),
)


def slots(pool: DataFrame, seed: str, count: int, source: DataFrame | None = None) -> DataFrame:
    """(qid, idx, slot): the first `count` slots of each question's order; none of a question that has fewer.

    pool is (qid, idx, gold, ..); source, if there is one, is (qid, source_idx), and only its questions count.
    """
    free = pool.where(~F.col("gold")).select("qid", "idx")
    if source is not None:
        free = free.join(source.select("qid", "source_idx"), "qid").where("idx <> source_idx").drop("source_idx")
    w = Window.partitionBy("qid").orderBy(I.hash_order(seed, F.col("qid"), F.col("idx")), "idx")
    n = F.count("*").over(Window.partitionBy("qid"))
    return free.withColumns({"slot": F.row_number().over(w), "n": n}).where((F.col("n") >= count) & (F.col("slot") <= count)).drop("n")


def pick(rows: DataFrame, seed: str) -> DataFrame:
    """One of each question's rows (qid, idx), by hash: (qid, source_idx)."""
    w = Window.partitionBy("qid").orderBy(I.hash_order(seed, F.col("qid"), F.col("idx")), "idx")
    return rows.withColumn("draw", F.row_number().over(w)).where("draw = 1").select("qid", F.col("idx").alias("source_idx"))


def _replace(pool: DataFrame, chosen: DataFrame, **columns: Column) -> DataFrame:
    """pool with the chosen rows' columns replaced, and whether a row was."""
    hit = F.col("slot").isNotNull()
    out = pool.join(chosen, ["qid", "idx"], "left")
    return out.select("qid", "idx", "gold", *[F.when(hit, columns[c]).otherwise(F.col(c)).alias(c) for c in columns], *[c for c in ("text", "ts") if c not in columns], hit.alias("changed"))


def future_date(pool: DataFrame, seed: str, count: int = 1, days: int = 7) -> DataFrame:
    """Slots' dates move past both their own and the question's; a slot without a date is not drawn."""
    chosen = slots(pool.where("ts IS NOT NULL AND question_ts IS NOT NULL"), seed, count).select("qid", "idx", "slot")
    return _replace(pool, chosen, ts=D.pushed_into_future(F.col("ts"), F.col("question_ts"), days))


def _copied(pool: DataFrame, source: DataFrame, seed: str, count: int, shift: int = 0) -> DataFrame:
    texts = source.join(pool.select("qid", F.col("idx").alias("source_idx"), F.col("text").alias("new_text"), F.col("ts").alias("new_ts")), ["qid", "source_idx"])
    chosen = slots(pool, seed, count, source).join(texts, "qid").select("qid", "idx", "slot", "new_text", "new_ts")
    return _replace(pool, chosen, text=F.col("new_text"), ts=F.col("new_ts") - shift)


def wrong_date(pool: DataFrame, seed: str, count: int = 1, days: int = 30) -> DataFrame:
    """Slots get a gold passage's text, dated `days` earlier; with 0 days they are the duplicate control."""
    return _copied(pool, pick(pool.where("gold AND ts IS NOT NULL"), seed), seed, count, days * DAY)


def duplicate_fresh(pool: DataFrame, seed: str, count: int = 1, most_days: int = 30) -> DataFrame:
    """Slots get the text of a passage that is no gold and at most `most_days` older than the question."""
    age = D.age_days(F.col("ts"), F.col("question_ts"))
    return _copied(pool, pick(pool.where(~F.col("gold") & age.between(0, most_days)), seed), seed, count)


def stale_sources(pool: DataFrame, overlap: Column, least_days: int = 30, band: float = 0.05) -> DataFrame:
    """Reviewed passages that are no gold, old enough and on the topic, within `band` of the best overlap.

    pool has the boolean column reviewed. (qid, idx, overlap, age).
    """
    aged = pool.withColumns({"overlap": overlap, "age": D.age_days(F.col("ts"), F.col("question_ts"))})
    ok = aged.where(~F.col("gold") & F.col("reviewed") & (F.col("age") >= least_days) & (F.col("overlap") > 0))
    best = F.max("overlap").over(Window.partitionBy("qid"))
    return ok.withColumn("best", best).where(F.col("overlap") >= F.greatest(F.lit(0.01), F.col("best") - band)).select("qid", "idx", "overlap", "age")


def stale_evidence(pool: DataFrame, overlap: Column, seed: str, count: int = 1) -> DataFrame:
    return _copied(pool, pick(stale_sources(pool, overlap), seed), seed, count)


def fabricated_fresh(pool: DataFrame, payloads: DataFrame, seed: str, count: int = 1) -> DataFrame:
    """Slots get the question's payload (qid, payload_text, payload_ts); questions without one stay."""
    given = payloads.where("payload_ts IS NOT NULL AND payload_text IS NOT NULL")
    chosen = slots(pool, seed, count).join(given, "qid").select("qid", "idx", "slot", "payload_text", "payload_ts")
    return _replace(pool, chosen, text=F.col("payload_text"), ts=F.col("payload_ts"))


def differences(clean: DataFrame, attacked: DataFrame) -> DataFrame:
    """One row for each candidate that is not the same in both pools: which side lacks it, or what changed."""
    c = clean.select("qid", "idx", F.col("text").alias("t0"), F.col("ts").alias("s0"), F.col("gold").alias("g0"))
    a = attacked.select("qid", "idx", F.col("text").alias("t1"), F.col("ts").alias("s1"), F.col("gold").alias("g1"))
    both = c.join(a, ["qid", "idx"], "full_outer")
    kind = (
        F.when(F.col("g1").isNull(), "missing").when(F.col("g0").isNull(), "added").when(F.col("g0") != F.col("g1"), "gold_changed")
        .when(~F.col("t0").eqNullSafe(F.col("t1")) & ~F.col("s0").eqNullSafe(F.col("s1")), "text_and_date")
        .when(~F.col("t0").eqNullSafe(F.col("t1")), "text").when(~F.col("s0").eqNullSafe(F.col("s1")), "date")
    )
    return both.select("qid", "idx", kind.alias("difference"), F.coalesce("g0", "g1").alias("gold")).where("difference IS NOT NULL")
