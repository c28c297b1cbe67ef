"""Building, chunking and checking pools of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import identity as I


def sample(rows: DataFrame, n: int, by: tuple[str, ...], seed: str, *key: str) -> DataFrame:
    """n rows of each group in the order of a hash; all of a smaller group. Samples of one seed are nested."""
    w = Window.partitionBy(*by).orderBy(I.hash_order(seed, *[F.col(k) for k in key]), *key)
    return rows.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n)


def chunk_starts(n: Column, window: int = 320, step: int = 256) -> Column:
    """Where windows of `window` tokens start: every `step`, until one reaches the end; a last one that would add
    nothing new is left out."""
    return F.when(n <= window, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.ceil((n - window) / step).cast("int")), lambda i: i * step))


def chunks(rows: DataFrame, tokens: Column, window: int = 320, step: int = 256, least: int = 64) -> DataFrame:
    """Rows by chunk: chunk_no, begin, end (token positions, end exclusive).

    A last window of fewer than `least` tokens joins the one before it.
    """
    cut = rows.withColumn("n_tokens", F.size(tokens)).withColumn("starts", chunk_starts(F.col("n_tokens"), window, step))
    last = F.element_at("starts", -1)
    merged = (F.size("starts") > 1) & (F.col("n_tokens") - last < least)
    cut = cut.withColumn("starts", F.when(merged, F.slice("starts", F.lit(1), F.size("starts") - 1)).otherwise(F.col("starts")))
    out = cut.select(*rows.columns, "n_tokens", F.size("starts").alias("n_chunks"), F.posexplode("starts").alias("chunk_no", "begin"))
    return out.withColumn("end", F.when(F.col("chunk_no") == F.col("n_chunks") - 1, F.col("n_tokens")).otherwise(F.least(F.col("n_tokens"), F.col("begin") + window)))


def span_coverage(spans: DataFrame, by: tuple[str, ...], length: str) -> DataFrame:
    """Of spans (by, begin, end, length), one row a group: whether they cover 0..length without a gap."""
    w = Window.partitionBy(*by).orderBy("begin", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("gap", F.col("begin") > F.coalesce(reach, F.lit(0)))
    return marked.groupBy(*by).agg(F.count("*").alias("n_spans"), ((F.count_if(F.col("gap")) == 0) & (F.max("end") >= F.max(length))).alias("covered"))


def violations(rows: DataFrame, checks: dict[str, Column], key: tuple[str, ...]) -> DataFrame:
    """(key, violation): one row for each check that fails; a check that is null counts as failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return rows.select(*key, F.explode(failed).alias("violation"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows in which two tables differ, as multisets; empty if a replay gave the same."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
