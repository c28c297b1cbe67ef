"""Mixing sources to target weights by hash-random keys, range order and distributed prefix sums.

Every document gets a 60-bit random key from the MD5 of its id. The key's domain is cut into equal ranges;
sizes are summed by source and range, and a window over those few sums gives each range its starting offset
in its source. A source's budget then falls into one range: ranges before it are taken whole, ranges behind
it not at all, and only the rows of that one range are sorted to find the exact cut. The document at the cut
is taken in part, so a source gives its budget to the word. A target above a source's size is met by whole
epochs and a cut in the last one.

All of it is DataFrame code. Only (id, source, size) leave the scan; the largest sort holds
1 / 2**key_bits of the largest source. Sums and offsets of ranges are written before the documents are joined
with them, which keeps each plan short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, id_hash, staged, whole

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
KEY_BITS = 12


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Of (source, source_size), one row a source, make (source, source_size, target).

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all sizes. A target
    stops at max_epochs times its source's size; the excess is shared by weight among the others until none
    is above. That end state has one level: with sources by cap / weight ascending, the first k stand at
    their cap and the rest at weight * level, so windows over the sources find it without a loop.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (
        s.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        # the level if exactly the sources before this one stand at their cap
        .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("fits"), F.struct("cap_before", "level"))).over(every)["level"]
    return s.withColumn("share", level).select(
        "source", "source_size", F.round(F.least(F.col("cap"), F.coalesce(F.col("share") * F.col("weight"), F.col("cap"))), 6).alias("target")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix",
    key_bits: int = KEY_BITS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row for each row of docs.

    taken counts the words that the mix takes from a document, repeats included: each whole epoch takes
    size, the last epoch takes documents in key order up to the source's budget, round(target). A null or
    empty text has size 0 and taken 0. Null sources form one source, the last. Rows with the same id and
    text get equal keys and are taken one after the other; their order among themselves changes nothing.
    An empty table gives an empty result. Other columns of docs are not read.
    """
    rows = staged(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(whole()).alias("size")).withColumn("key", id_hash(seed, "doc_id")), "mix"
    )
    width = 1 << (60 - key_bits)
    rows = rows.withColumn("range", F.floor(F.col("key") / F.lit(float(width))).cast("long"))
    # both are small tables; written, they stand once in what the driver plans, not in each of the two ways to take a document
    ranges = staged(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "ranges")
    wants = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    r, w = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).alias("r"), wants.alias("w")
    r = (
        r.join(w, F.col("r.source").eqNullSafe(F.col("w.source")))
        .select("r.source", "range", "range_size", "start", "source_size", "target")
        .withColumn("budget", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("start"))
    )
    r = staged(r, "starts").alias("r")
    d = (
        rows.alias("d")
        .join(r, F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.range") == F.col("r.range")))
        .select("doc_id", "d.source", "size", "source_size", "target", "epochs", "rest", "range_size", "key", "d.range")
    )
    at_cut = (F.col("rest") > 0) & (F.col("rest") < F.col("range_size"))
    upto = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = d.where(at_cut).withColumn("last", F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.coalesce(F.sum("size").over(upto), F.lit(0)))))
    clear = d.where(~at_cut).withColumn("last", F.when(F.col("rest") > 0, F.col("size")).otherwise(0))
    return clear.unionByName(cut).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last")).cast("long").alias("taken")
    )


#: The same rows by windows over whole sources, in DuckDB.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight,
             3.0::DOUBLE * source_size AS cap FROM s),
x AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before,
             CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS all_weight FROM w
      WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cap_before) / (all_weight - weight_before) AS level FROM x),
v AS (SELECT level AS share FROM l WHERE level * weight <= cap ORDER BY cap_before, level LIMIT 1),
t AS (SELECT source, source_size, round(least(cap, coalesce(share * weight, cap)), 6) AS target
      FROM l LEFT JOIN v ON true),
g AS (SELECT t.*, CAST(round(target) AS BIGINT) AS budget,
             CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.epochs, g.budget - g.epochs * g.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, rest - start)) AS BIGINT) AS taken FROM p
"""
