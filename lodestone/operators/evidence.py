"""Identity of evidence: occurrences, variants, aliases, and what follows for a ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import shared_dir


def alias_groups(occurrences: DataFrame, alias: str, variant: str) -> DataFrame:
    """(alias, n_occurrences, n_variants, n_extra, conflict): one alias of several variants is a conflict.

    n_extra counts exact duplicates: occurrences beyond the first of their variant.
    """
    g = occurrences.groupBy(alias).agg(F.count("*").alias("n_occurrences"), F.countDistinct(variant).alias("n_variants"))
    return g.withColumns({"n_extra": F.col("n_occurrences") - F.col("n_variants"), "conflict": F.col("n_variants") > 1})


def recovery_status(found: Column, expected: Column, conflicts: Column) -> Column:
    return (
        F.when(found == 0, "MISSING").when(conflicts > 0, "CONFLICT").when(found < expected, "PARTIAL").otherwise("RECOVERED")
    )


def last_write(rows: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key, columns as they were; equal orders leave an arbitrary one of equal rows."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do. A null key is never done."""
    return todo.join(done.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def numbered(rows: DataFrame, by: str, order: str, name: str = "slot") -> DataFrame:
    """rows with their number, from 1, in the order within their group, without a group in one task.

    Rows are dealt by ranges of (by, order) and written so, as ranges are drawn from a sample; each range numbers its own
    rows, and the rows of the ranges before it, one sum a range and group, are added.
    """
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/lodestone/numbered-{uuid.uuid4().hex}"
    rows.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id()).write.parquet(at)
    dealt = spark.read.parquet(at)
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(by, "_range").agg(F.count("*").alias("_n")).select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(by, "_range").orderBy(order)))
    both = own.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    return both.select(*rows.columns, (F.col("_own") + F.col("_before")).cast("int").alias(name))


def replace_blocked(priority: DataFrame, reserve: DataFrame, stratum: str, rank: str) -> DataFrame:
    """(stratum, slot, blocked_id, replacement_id): the k-th blocked row gets the k-th reserve that passes.

    priority has (id, blocked), reserve has (id, passes); both are ranked within their stratum. A blocked row
    without a reserve left has a null replacement.
    """
    b = numbered(priority.where("blocked"), stratum, rank).select(stratum, "slot", F.col("id").alias("blocked_id"))
    r = numbered(reserve.where("passes"), stratum, rank).select(stratum, "slot", F.col("id").alias("replacement_id"))
    return b.join(r, [stratum, "slot"], "left")


def reserve_without(reserve: DataFrame, exposed: DataFrame, key: str, stratum: str) -> tuple[DataFrame, DataFrame]:
    """(the reserve's rows that were not exposed, (key, problem)): both have key and stratum.

    Problems are exposed keys that the reserve does not have (unknown_key) or has in another stratum (stratum_differs).
    """
    known = exposed.select(key, F.col(stratum).alias("_s")).distinct().join(reserve.select(key, F.col(stratum).alias("_r"), F.lit(True).alias("_in")).distinct(), key, "left")
    problem = F.when(F.col("_in").isNull(), "unknown_key").when(~F.col("_s").eqNullSafe(F.col("_r")), "stratum_differs")
    return remaining(reserve, exposed, key), known.select(key, problem.alias("problem")).where("problem IS NOT NULL")
