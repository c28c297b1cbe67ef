"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, and the mix, one after the other.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes it as Parquet in the shared folder and
the next stage reads it. All but the last give the columns of documents; the last gives one row a document with
the words that the mix takes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, ngram_join, quality, secrets
from lodestone.llm.common import staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects. Ratings are learned from the documents that came in."""
    model = quality.Model(docs, table(spark, sf_dir, "labels"))
    return model.score(docs).where("selected").select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five-word shingles, Jaccard 0.8 or more) the document of the smallest id.

    Documents without words are in no group and stay; so do rows without an id. Of rows that repeat an id and a text,
    the first in the order of their columns stays; different texts of one id all stay, or go with their group.
    """
    found = staged(ngram_join.join(docs, percent=80, n=5, count_links=False), "near")
    gone = found.where("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = found.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("row")).select(*[F.col(f"row.`{c}`") for c in docs.columns])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mask."""
    return secrets.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document with its size and the words that the mix takes of it; none are left out."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
]

#: The classifier and the latent search have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
