"""Corpus-scale steps: strict passages, lexical audits, child relevance, snapshots, and the slots for models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from lodestone.functions import text as T
from lodestone.operators import evidence as E
from lodestone.operators import metrics as M


def candidate_text(title: Column, text: Column) -> Column:
    """The text under its title, if it has one."""
    return F.when(F.coalesce(F.trim(title), F.lit("")) != "", F.concat(F.lit("Title: "), F.trim(title), F.lit("\n"), text)).otherwise(text)


def passage_problems(id_: Column, day: Column, year: Column, text: Column, years: tuple[int, int]) -> Column:
    """All that is wrong with a passage: its id's form, a year outside the archive's, a day of another year, no text."""
    rules = {
        "bad_id": ~F.coalesce(id_.rlike(r"^.+_\d+$"), F.lit(False)),
        "year_outside": ~F.coalesce(year.between(*years), F.lit(False)),
        "day_of_other_year": ~F.coalesce(F.year(day) == year, F.lit(False)),
        "no_text": F.coalesce(F.trim(text), F.lit("")) == "",
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def problem_counts(rows: DataFrame, problems: str, example: str) -> DataFrame:
    """(problem, n, first): how often each occurs, and the smallest example."""
    return rows.select(example, F.explode(problems).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"), F.min(example).alias("first"))


def lexical_audit(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(only in a, only in b, in both): the distinct normal tokens of two texts, sorted."""
    x, y = F.array_distinct(T.answer_tokens(a)), F.array_distinct(T.answer_tokens(b))
    return F.array_sort(F.array_except(x, y)), F.array_sort(F.array_except(y, x)), F.array_sort(F.array_intersect(x, y))


def child_relevance(golds: Column, child: Column, parent_gold: Column, cap: int = 1500) -> list[Column]:
    """Whether a child holds the answer in full and within the cap, and whether the cap cuts a word or the answer."""
    full, seen = M.relevant_by_phrase(golds, child), M.relevant_by_phrase(golds, T.truncate(child, cap))
    splits = (F.length(child) > cap) & F.substring(child, cap, 2).rlike(r"^\w\w$")
    role = F.when(parent_gold & (full == 1), "answer").when(parent_gold, "gold_parent").when(full == 1, "stray_answer").otherwise("distractor")
    return [full.alias("full_match"), seen.alias("seen_match"), F.coalesce(splits, F.lit(False)).alias("cap_splits_word"), role.alias("role")]


def merge_snapshots(snapshots: list[DataFrame], key: tuple[str, ...]) -> DataFrame:
    """Rows of several snapshots, each key once with the snapshots that have it, and whether their rows agree."""
    tagged = None
    for i, s in enumerate(snapshots):
        part = s.withColumn("_s", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    rest = [c for c in snapshots[0].columns if c not in key]
    return tagged.groupBy(*key).agg(
        F.min_by(F.struct(*rest), "_s").alias("_r"), F.array_sort(F.collect_set("_s")).alias("snapshots"), (F.countDistinct(F.xxhash64(*rest)) == 1).alias("agree")
    ).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest], "snapshots", "agree")


def remapped(parents: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Several snapshots' parents and children under ids that hold across them: (parents with new_id and new_replica_of, children with new_parent).

    parents is (snapshot, id, replica_of, ..), ids unique in a snapshot; children is (snapshot, parent, ..). New ids are dense, from 1, in the order of
    snapshots, replicas behind what they may replicate, then old ids; they are dealt by ranges and offsets, so they do not depend on partitioning. A reference to what its snapshot
    does not hold is null: orphans stay, and can be told.
    """
    order = F.struct("snapshot", F.col("replica_of").isNotNull().alias("late"), "id")
    dense = E.numbered(parents.withColumns({"_order": order, "_all": F.lit(0)}), "_all", "_order", "new_id").drop("_order", "_all")
    named = lambda df, ref, name: df.join(dense.select("snapshot", F.col("id").alias(ref), F.col("new_id").alias(name)), ["snapshot", ref], "left").select(*df.columns, name)
    return named(dense, "replica_of", "new_replica_of"), named(children, "parent", "new_parent")


def gold_capped(rows: DataFrame, by: str, gold: str, order: str, most: int = 19) -> DataFrame:
    """Rows of groups, of the gold ones the first `most` in order."""
    w = Window.partitionBy(by, gold).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where(~F.col(gold) | (F.col("_k") <= most)).drop("_k")


def batch_encoder(encode: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """A slot for a text encoder: encode maps texts to a matrix, a row each; it is set up once a task."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encode(texts.fillna("").tolist()).astype(np.float32)))

    return run


def hashed_encoder(width: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in that needs no model: signed counts of hashed tokens, of unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                out[i, h % width] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def batch_generator(generate: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """A slot for a text generator or a judging model: prompts to replies, a batch at a time."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(generate(prompts.fillna("").tolist()))

    return run
