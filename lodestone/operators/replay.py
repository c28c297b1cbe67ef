"""Whether a derived table still is what its sources give: trees of multiset digests over ranges of keys.

A table is kept with its rows in ranges of hashed keys, 2 ** FAN_BITS for each level of the tree to the power of its levels, each a folder, and the digests of these: the number of
rows and the sums of two hashes of whole rows, which neither order nor partitioning changes, but a row that is lost, changed or there twice does. The sums
of 2 ** FAN_BITS ranges are a node of the next level, up to one root. Two tables are compared from their roots down, below nodes that differ
only, and rows are read again of the ranges that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels below the root, and bits of a range's number for each.
LEVELS, FAN_BITS = 3, 4


def range_of(key: tuple[str, ...], levels: int = LEVELS) -> Column:
    """The range of a key: a hash's low bits, so that keys of any distribution fill ranges alike."""
    return F.xxhash64(F.lit("range"), *key).bitwiseAND((1 << levels * FAN_BITS) - 1).alias("_range")


def _digest() -> list[Column]:
    return [F.sum("rows").alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b")]


def keep(df: DataFrame, key: tuple[str, ...], path: str, levels: int = LEVELS) -> None:
    """Write df by ranges under path/rows and its digests under path/digests; the latter are last, and without them there is no table."""
    columns = sorted(df.columns)
    ranged = df.select(*columns, range_of(key, levels))
    ranged.repartition("_range").write.partitionBy("_range").parquet(f"{path}/rows")
    leaves(df, key, levels).write.parquet(f"{path}/digests")


def leaves(df: DataFrame, key: tuple[str, ...], levels: int = LEVELS) -> DataFrame:
    """(range, rows, a, b): the digest of each range that has rows."""
    columns = sorted(df.columns)
    whole = df.select(range_of(key, levels).alias("range"), F.lit(1).alias("rows"), *[F.xxhash64(F.lit(s), *columns).cast("decimal(20,0)").alias(s) for s in "ab"])
    return whole.groupBy("range").agg(*_digest())


def differing(expected: DataFrame, found: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(range): ranges whose digests differ, looked for from the roots down. Both are leaves(), or what keep() has written of them."""
    at = None
    for level in range(levels + 1):
        node = F.shiftright("range", (levels - level) * FAN_BITS).alias("node")
        a, b = (df.groupBy(node).agg(*_digest()) for df in (expected, found))
        if at is not None:
            below = at.select(F.col("node").alias("above"))
            a, b = (x.withColumn("above", F.shiftright("node", FAN_BITS)).join(below, "above", "left_semi").drop("above") for x in (a, b))
        same = F.struct("rows", "a", "b")
        both = a.select("node", same.alias("x")).join(b.select("node", same.alias("y")), "node", "full_outer")
        at = both.where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
        if level == 0 and at.isEmpty():
            break
    return at.select(F.col("node").alias("range"))


def replay(kept: str, derived: DataFrame, key: tuple[str, ...], levels: int = LEVELS) -> DataFrame:
    """(key, problem, expected, found) of the keys whose rows in the table kept at a path are not those that were derived again.

    lost: no row of the key is kept; unexpected: none was derived; doubled: equal rows are kept more often, or less, than they were derived; changed: they
    differ. levels is that of keep(). expected and found are the numbers of rows. The kept table is read only in the ranges that differ, which the scan's partition filter shows.
    """
    spark = derived.sparkSession
    own, stated = (spark.createDataFrame(x.toArrow()) for x in (leaves(derived, key, levels), spark.read.parquet(f"{kept}/digests")))  # a row a range, so that each is made once
    columns = sorted(derived.columns)
    ranges = [r["range"] for r in differing(own, stated, levels).collect()]
    again = derived.select(*columns, range_of(key, levels))
    stored = spark.read.schema(again.schema).parquet(f"{kept}/rows").where(F.col("_range").isin(ranges))
    again = again.where(F.col("_range").isin(ranges))
    count = lambda df, side: df.groupBy(*key, F.xxhash64(F.lit("a"), *columns).alias("h"), F.xxhash64(F.lit("b"), *columns).alias("g")).agg(F.count("*").alias("n")).withColumn("side", F.lit(side))
    rows = count(again, 0).unionByName(count(stored, 1))
    each = rows.groupBy(*key, "h", "g").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("y"))
    sums = each.groupBy(*key).agg(F.sum("x").alias("expected"), F.sum("y").alias("found"), F.max(F.col("x") != F.col("y")).alias("differs"), F.max((F.col("x") == 0) | (F.col("y") == 0)).alias("other"))
    problem = F.when(F.col("found") == 0, "lost").when(F.col("expected") == 0, "unexpected").when(F.col("other"), "changed").otherwise("doubled")
    return sums.where("differs").select(*key, problem.alias("problem"), "expected", "found")
