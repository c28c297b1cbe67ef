"""Joins and windows over time: merged intervals, as-of, date windows that widen, coverage and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def merge_intervals(rows: DataFrame, by: tuple[str, ...] = (), touch: int = 0) -> DataFrame:
    """(by, island, start, end, n): closed intervals that overlap, or lie within `touch` of each other, become one.

    Rows without a start come last and count in the last island; where a key has no others, each is its own.
    """
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach + touch), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def within(rows: DataFrame, intervals: DataFrame, at: str, key: tuple[str, ...] = (), width: int = 30 * DAY) -> DataFrame:
    """The rows whose time lies in some closed interval (with equal key): an equi-join on buckets of `width`.

    An interval meets the buckets it covers, so its length, not the number of intervals, sets what a row is
    compared with. Merge the intervals first, else a row comes once for each that holds it.
    """
    spread = intervals.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    r = rows.withColumn("bucket", F.floor(F.col(at) / width))
    return r.join(spread, [*key, "bucket"]).where(F.col(at).between(F.col("start"), F.col("end"))).drop("bucket")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the `value` and time of the last right row of the same key that is not later; null if there is none.

    Both sides go through one window by key and time instead of a range join.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).withColumn("_at", F.lit(None).cast(right.schema[at].dataType))
    b = right.select(key, at, F.col(value).alias("_value"), F.col(at).alias("_at")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumns({"_value": F.last("_value", ignorenulls=True).over(w), "_at": F.last("_at", ignorenulls=True).over(w)})
    return both.where("_side = 1").drop("_side").withColumnRenamed("_value", value).withColumnRenamed("_at", f"{at}_as_of")


def widening_window(pairs: DataFrame, days_apart: Column, need: int, step: int = 7, most: int = 8, by: str = "qid") -> DataFrame:
    """(by, radius, n): the smallest multiple of `step` days within which a group has `need` rows, at most most * step.

    One pass: rows are counted by step, then summed over the steps; no radius is tried in turn.
    """
    stepped = pairs.withColumn("k", F.greatest(F.lit(1), F.ceil(F.abs(days_apart) / step)).cast("int")).where(F.col("k") <= most)
    counts = stepped.groupBy(by, "k").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("n", F.sum("c").over(upto))
    return summed.groupBy(by).agg(
        (F.coalesce(F.min(F.when(F.col("n") >= need, F.col("k"))), F.lit(most)) * step).alias("radius"), F.coalesce(F.min(F.when(F.col("n") >= need, F.col("n"))), F.max("n")).alias("n")
    )


def years_covered(start: Column, end: Column, configured: tuple[int, int]) -> tuple[Column, Column, Column]:
    """(requested, configured, outside): the years of a window, split by whether an archive is configured for them."""
    asked = F.sequence(F.year(start), F.year(end))
    inside = lambda y: y.between(*configured)
    return asked, F.filter(asked, inside), F.filter(asked, lambda y: ~inside(y))


def runs(rows: DataFrame, by: tuple[str, ...], order: str, breaks: Column) -> DataFrame:
    """Number the runs of rows in order: a run starts where `breaks` is true (over the window's columns)."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("run", F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def clip(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """A closed interval cut to the half-open [low, high), in whole seconds: an end on the bound moves inside."""
    return F.greatest(start, low), F.when(end >= high, high - 1).otherwise(end)
