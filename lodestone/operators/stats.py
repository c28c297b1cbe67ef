"""Paired statistics: exact and resampled tests, agreement, multiplicity and factorial effects.

Resampling uses an index both Spark and SQL can compute: draw j of resample b takes row
(b * 7919 + j * 104729 + b * j * 31 + seed) mod n. It is the estimator that counts, not a generator's stream. For
resamples from numpy's generator, see bootstrap_numpy and resampled.

That index is linear in j, so a draw over a number of rows prime to its factor takes every row once, and its mean is the
mean of the rows. Bounds and p-values of the bootstrap itself come from drawn_means, whose index is mixed and which SQL
can compute too, and from resampled; their draws are independent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestone.operators.evidence import numbered


def binomial_two_sided(k: Column, n: Column) -> Column:
    """min(1, 2 P(X <= k)) for n fair coins; 1 for n = 0. Terms are built up from one another, in logarithms."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")),
        F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum")),
        lambda a, i: F.struct((a["log"] + F.log((n - i + 1) / i)).alias("log"), (a["sum"] + F.when(i <= k, F.exp(a["log"] + F.log((n - i + 1) / i))).otherwise(0.0)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * terms))


def mcnemar(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n_10, n_01, n_discordant, p_value) of paired 0/1 outcomes, exactly."""
    g = (pairs.groupBy(*by) if by else pairs).agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("n_10"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("n_01"))
    n = F.col("n_10") + F.col("n_01")
    return g.withColumns({"n_discordant": n, "p_value": binomial_two_sided(F.least("n_10", "n_01"), n)})


def agreement(pairs: DataFrame, a: str, b: str) -> list[Column]:
    """Aggregates of two 0/1 raters: n, agreement, kappa (null if chance agrees fully), and who is more lenient."""
    x, y = F.col(a), F.col(b)
    po, pa, pb = F.avg((x == y).cast("int")), F.avg(x), F.avg(y)
    pe = pa * pb + (1 - pa) * (1 - pb)
    return [
        F.count("*").alias("n"), F.round(po, 6).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"),
        F.count_if((x == 0) & (y == 1)).alias("lenient"), F.count_if((x == 1) & (y == 0)).alias("strict"),
    ]


def holm(tests: DataFrame, p: str = "p_value", by: tuple[str, ...] = ()) -> DataFrame:
    """Add holm: step-down adjusted p-values within each family."""
    w = Window.partitionBy(*by).orderBy(p)
    m = F.count("*").over(Window.partitionBy(*by))
    step = tests.withColumns({"_r": F.row_number().over(w), "_m": m}).withColumn("_s", F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p)))
    return step.withColumn("holm", F.max("_s").over(Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))).drop("_r", "_m", "_s")


@F.pandas_udf(LongType())
def _gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.gcd(a.to_numpy(), b.to_numpy()))


def resample_means(rows: DataFrame, value: str, by: tuple[str, ...], order: tuple[str, ...], draws: int, seed: int = 42) -> DataFrame:
    """(by, b, mean): means of `draws` resamples of each group's values, paired if the value is a difference.

    A resample is drawn over the group's positions. Draw j of resample b takes position (start + j * step) mod n, so the n draws take
    every position that leaves start as its remainder by m, the greatest common divisor of step and n, and each m times. A group's
    resamples thus need the sums of at most one class of positions each, and no row is repeated for them.
    """
    draw = rows.sparkSession.range(draws).select(F.col("id").alias("b"))  # draws is a parameter
    start, step = F.col("b") * 7919 + seed, F.col("b") * 31 + 104729
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    plan = sizes.join(F.broadcast(draw)).select(*by, "n", "b", start.alias("start"), _gcd(step, F.col("n")).alias("m")).withColumn("r", F.pmod("start", "m")).drop("start")
    wanted = plan.groupBy(*by, "m").agg(F.collect_set("r").alias("rs")).groupBy(*by).agg(F.collect_list(F.struct("m", "rs")).alias("classes"))
    at = numbered(rows.select(F.struct(*by).alias("_group"), F.struct(*order).alias("_at"), F.col(value).alias("v")), "_group", "_at", "i").select("_group.*", "v", (F.col("i").cast("bigint") - 1).alias("i"))
    held = F.filter("classes", lambda c: F.array_contains(c.rs, F.pmod(F.col("i"), c.m)))
    each = at.join(F.broadcast(wanted), list(by)).select(*by, "v", "i", F.explode(F.transform(held, lambda c: c.m)).alias("m"))  # a row a group, of at most `draws` classes
    sums = each.groupBy(*by, "m", F.pmod("i", "m").alias("r")).agg(F.sum("v").alias("v"))
    return plan.join(sums, [*by, "m", "r"]).select(*by, "b", (F.col("m") * F.col("v") / F.col("n")).alias("mean"))


def mixed(x: np.ndarray) -> np.ndarray:
    """32 bits made of 32, one to one, so that near numbers get far ones."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x21F0AAAD)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0xD35A2D97)
    return x ^ (x >> np.uint32(15))


def mixed_sql(rows: str, keep: str) -> str:
    """SQL of the columns `keep` and x of rows, x mixed. The second factor is that of mixed() less 2**32, so products are BIGINTs."""
    for shift, factor in ((16, 0x21F0AAAD), (15, 0xD35A2D97 - (1 << 32))):
        rows = f"(SELECT {keep}, (xor(x >> {shift}, x) * {factor}) & 4294967295 AS x FROM {rows})"
    return f"(SELECT {keep}, xor(x >> 15, x) AS x FROM {rows})"


def drawn_means_sql(draws: int, seed: int = 42) -> str:
    """CTEs of drawn_means over a CTE v(g, id, v): pos, bs, js, k and m(g, b, mean)."""
    return f"""pos AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v, id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM v),
bs AS {mixed_sql(f"(SELECT b, b + {seed} AS x FROM range({draws}) r(b))", "b")},
js AS {mixed_sql("(SELECT g, n, i AS x FROM pos)", "g, n")},
k AS (SELECT g, b, (x * n) >> 32 AS i FROM {mixed_sql("(SELECT g, n, b, (js.x + bs.x) & 4294967295 AS x FROM js, bs)", "g, n, b")}),
m AS (SELECT k.g, k.b, sum(v) / max(n) AS mean FROM k JOIN pos ON pos.g = k.g AND pos.i = k.i GROUP BY ALL)"""


#: Of drawn_means: resamples and draws of each that a task makes at a time, and draws that it holds at once.
DRAWN = (100, 1 << 20, 1 << 15)


def drawn_means(rows: DataFrame, value: str, by: tuple[str, ...], draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(by, b, mean): means of `draws` independent resamples of each group's n rows, with replacement; the same as SQL's.

    Draw j of resample b takes position h * n // 2**32 of the group's rows, least values first and null ones last, where h is the mixed sum
    of mixed b + seed and mixed j. Each of the n draws of each resample is made. A position of rows in the order of values gives a value by
    the places where values change, so only equal rows' numbers travel: tasks take a block of resamples and of draws at a time, and keep
    a sum a resample. A null counts in n only; a resample of nulls has none. Groups have fewer than 2**31 rows.
    """
    each, many, slots = DRAWN
    counts = rows.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    groups = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("v").isNull().alias("none"), "v", "c"))).alias("steps"), F.sum("c").alias("n"))
    blocks = -(-draws // each)
    block = F.broadcast(rows.sparkSession.range(blocks).select(F.col("id").alias("block")))  # draws is a parameter
    pieces = groups.withColumn("start", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / many)))).join(block).repartition(blocks)

    def drawn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(batch.num_rows):
                piece = batch.slice(at, 1)
                steps, n, start, block = (piece.column(c)[0].as_py() for c in ("steps", "n", "start", "block"))
                v, known = np.array([s["v"] or 0.0 for s in steps]), np.array([not s["none"] for s in steps])
                upto = np.cumsum([s["c"] for s in steps], dtype=np.uint64)[:-1]
                edges = (((upto << np.uint64(32)) + np.uint64(n - 1)) // np.uint64(n)).astype(np.uint32)
                b = np.arange(block * each, min(draws, (block + 1) * each), dtype=np.int64)
                times = np.zeros((len(b), len(v)), np.int64)
                for first in range(start * many, min(n, (start + 1) * many), slots):
                    j = mixed(np.arange(first, min(n, (start + 1) * many, first + slots), dtype=np.uint32))
                    for r, x in enumerate(mixed((b + seed).astype(np.uint32))):
                        h = mixed(j + x)
                        if len(v) <= 32:
                            times[r] += np.diff([0, *(np.count_nonzero(h < e) for e in edges), len(h)])
                        else:
                            times[r] += np.bincount(np.searchsorted(edges, h, "right"), minlength=len(v))
                out = piece.take(pa.array(np.zeros(len(b), np.int64)))
                yield pa.record_batch([*[out.column(c) for c in by], out.column("n"), pa.array(b), pa.array(times @ v), pa.array(times @ known)], names=[*by, "n", "b", "total", "known"])

    kinds = dict(rows.dtypes)
    sums = pieces.mapInArrow(drawn, ", ".join([*(f"{c} {kinds[c]}" for c in by), "n bigint, b bigint, total double, known bigint"]))
    means = sums.groupBy(*by, "b").agg(F.sum("total").alias("total"), F.sum("known").alias("known"), F.max("n").alias("n"))
    return means.select(*by, "b", F.when(F.col("known") > 0, F.col("total") / F.col("n")).alias("mean"))


def percentile_bounds(means: DataFrame, by: tuple[str, ...], draws: int, level: float = 0.95) -> DataFrame:
    """(by, low, high): the order statistics int(a/2 B) and int((1-a/2) B) - 1, from 0, without interpolation; null means come last."""
    a = 1 - level
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("mean"))
    r = means.withColumn("r", F.row_number().over(w) - 1)
    return r.groupBy(*by).agg(F.max(F.when(F.col("r") == int(a / 2 * draws), F.col("mean"))).alias("low"), F.max(F.when(F.col("r") == int((1 - a / 2) * draws) - 1, F.col("mean"))).alias("high"))


def bootstrap_numpy(rows: DataFrame, value: str, by: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(by, estimate, low, high): mean and linear-interpolated 95 % bounds with numpy's generator, a task a group."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["v"].dropna().to_numpy())
        if not len(x):
            return pd.DataFrame({by: [key[0]], "estimate": [None], "low": [None], "high": [None]})
        g = np.random.default_rng(seed)
        means = np.array([x[g.integers(0, len(x), len(x))].mean() for _ in range(draws)])
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({by: [key[0]], "estimate": [x.mean()], "low": [low], "high": [high]})

    kind = dict(rows.dtypes)[by]
    return rows.select(by, F.col(value).cast("double").alias("v")).groupBy(by).applyInPandas(one, f"{by} {kind}, estimate double, low double, high double")


def mean_of(times: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The mean of each draw: times has a row a draw and a column a distinct row of values."""
    return times @ v / times.sum(axis=1)


def resampled(rows: DataFrame, values: tuple[str, ...], by: tuple[str, ...], draws: int = 10_000, seed: int = 42, statistic=mean_of) -> DataFrame:
    """(by, b, stat): the statistic of `draws` independent resamples of each group's rows, with replacement.

    Rows with equal values are counted first, and a resample is one multinomial draw over the counts, so it costs
    the distinct rows of a group. Every block of 1,000 draws is a task with its own generator, and draws in slices of
    bounded memory. Values that are paired are drawn together; rows with a null value are left out. A statistic
    that a draw does not define is NaN.
    """
    each, slots = 1000, 2_000_000
    spark = rows.sparkSession
    v = [f"_v{k}" for k in range(len(values))]
    known = rows.select(*by, *[F.col(c).cast("double").alias(n) for c, n in zip(values, v)]).dropna(subset=v)
    counts = known.groupBy(*by, *v).agg(F.count("*").alias("_n"))
    blocks = F.broadcast(spark.range(-(-draws // each)).select(F.col("id").alias("_block")))  # draws is a parameter

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(v)
        block, n = int(pdf["_block"].iloc[0]), pdf["_n"].to_numpy()
        g, own = np.random.default_rng([seed, block]), min(each, draws - block * each)
        x = [pdf[c].to_numpy() for c in v]
        step = max(1, slots // len(n))
        stat = np.concatenate([statistic(g.multinomial(n.sum(), n / n.sum(), min(step, own - k)), *x) for k in range(0, own, step)])
        out = pd.DataFrame({"b": block * each + np.arange(own), "stat": stat})
        return out.assign(**{c: pdf[c].iloc[0] for c in by})[[*by, "b", "stat"]]

    kinds = dict(rows.dtypes)
    return counts.join(blocks).groupBy(*by, "_block").applyInPandas(one, ", ".join([*(f"{c} {kinds[c]}" for c in by), "b bigint, stat double"]))


def kappa_of(times: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cohen's kappa of two 0/1 raters in each draw, NaN where chance agrees fully."""
    n = times.sum(axis=1)
    po, pa, pb = times @ (x == y) / n, times @ x / n, times @ y / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    return np.divide(po - pe, 1 - pe, out=np.full(len(n), np.nan), where=pe < 1)


def kappa_bounds(pairs: DataFrame, a: str, b: str, by: tuple[str, ...], draws: int = 2000, seed: int = 0) -> DataFrame:
    """(by, kappa, low, high): kappa and its bootstrap interval, the order statistics int(0.025 m) and int(0.975 m) - 1
    from 0 of the m draws that define it; null where none does."""
    k = resampled(pairs, (a, b), by, draws, seed, kappa_of).where(~F.isnan("stat"))
    k = k.withColumns({"r": F.row_number().over(Window.partitionBy(*by).orderBy("stat")) - 1, "m": F.count("*").over(Window.partitionBy(*by))})
    at = [F.max(F.when(F.col("r") == place, F.col("stat"))).alias(c) for c, place in (("low", F.floor(F.col("m") * 0.025)), ("high", F.floor(F.col("m") * 0.975) - 1))]
    known = pairs.dropna(subset=[a, b])
    return known.groupBy(*by).agg(*agreement(known, a, b)[:3]).drop("agreement").join(k.groupBy(*by).agg(*at), list(by), "left")


def cluster_bounds(clusters: DataFrame, value: str, by: tuple[str, ...], draws: int = 2000, seed: int = 42) -> DataFrame:
    """(by, n, estimate, low, high): the mean over clusters, a row each, and its 95 % bootstrap bounds, interpolated
    between order statistics; bounds are null for fewer than two clusters."""
    g = clusters.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("estimate"))
    bounds = resampled(clusters, (value,), by, draws, seed).groupBy(*by).agg(F.percentile("stat", 0.025).alias("low"), F.percentile("stat", 0.975).alias("high"))
    return g.join(bounds, list(by), "left").withColumns({c: F.when(F.col("n") >= 2, F.col(c)) for c in ("low", "high")})


def sign_flip(rows: DataFrame, value: str, by: tuple[str, ...], order: tuple[str, ...], most: int = 16) -> DataFrame:
    """(by, n, p_value): the exact two-sided sign-flip test over all 2**n sign vectors; null for more than `most` values."""
    spark = rows.sparkSession
    w = Window.partitionBy(*by).orderBy(*order)
    at = rows.select(*by, F.col(value).alias("v"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    small = at.where(F.col("n") <= most)
    target = small.groupBy(*by).agg(F.abs(F.sum("v")).alias("target"))
    signs = F.broadcast(spark.range(1 << most).select(F.col("id").alias("s")))  # a fixed 2**most rows
    flipped = small.join(signs, F.col("s") < F.shiftleft(F.lit(1).cast("bigint"), 0) * F.pow(F.lit(2), F.col("n")))
    sums = flipped.groupBy(*by, "s").agg(F.sum(F.when(F.expr("(s >> CAST(i AS INT)) & 1") == 1, F.col("v")).otherwise(-F.col("v"))).alias("t"))
    p = sums.join(target, list(by)).groupBy(*by).agg(F.avg((F.abs("t") >= F.col("target") - 1e-12).cast("int")).alias("p_value"))
    return at.groupBy(*by).agg(F.max("n").alias("n")).join(p, list(by), "left")


#: Up to so many nonzero differences, the signed-rank test is exact.
EXACT_RANKS = 50


def _exact_signed_rank(ranks: list[int], w: float) -> float | None:
    """The two-sided p-value of the lesser rank sum w over all signs; ranks are doubled, so that mean ranks are whole."""
    if not ranks:
        return None
    ways = np.zeros(sum(ranks) + 1)
    ways[0] = 1
    for r in ranks:
        ways[r:] = (ways[r:] + ways[:-r]) / 2
        ways[:r] /= 2
    return float(min(1.0, 2 * ways[: round(2 * w) + 1].sum()))


def _normal_two_sided(z: float) -> float | None:
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


def wilcoxon(pairs: DataFrame, difference: str, by: tuple[str, ...]) -> DataFrame:
    """(by, n, w, z, p_value): the signed-rank statistic of the nonzero differences, ties at mean ranks, and its normal score.

    z carries the correction for ties. The two-sided p_value is exact over all signs of the ranks for up to EXACT_RANKS
    differences, else that of z. All are null where all differences are zero.
    """
    d = pairs.where(F.col(difference) != 0).withColumn("a", F.abs(difference))
    size = F.count("*").over(Window.partitionBy(*by, "a"))
    d = d.withColumn("r", F.rank().over(Window.partitionBy(*by).orderBy("a")) + (size - 1) / 2).withColumn("t", size * size - 1)
    few = F.count("*").over(Window.partitionBy(*by)) <= EXACT_RANKS
    d = d.withColumn("doubled", F.when(few, (2 * F.col("r")).cast("int")))
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col(difference) > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col(difference) < 0, F.col("r")).otherwise(0.0)).alias("down"), F.sum("t").alias("ties"), F.collect_list("doubled").alias("ranks"))
    n, w = F.col("n"), F.least("up", "down")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return pairs.select(*by).distinct().join(g.select(*by, "n", w.alias("w"), z.alias("z"), F.coalesce(F.udf(_exact_signed_rank, "double")("ranks", w), F.udf(_normal_two_sided, "double")(z)).alias("p_value")), list(by), "left")


def factorial_effects(cells: DataFrame, question: str, factors: tuple[str, str, str], value: str) -> DataFrame:
    """(effect, estimate): seven contrasts of 2 x 2 x 2 cells with levels -1 and 1, within questions first.

    A contrast of k factors is the sum of the product of their levels and the value, over 2**(3 - k).
    """
    contrasts = []
    for bits in range(1, 8):
        names = [f for i, f in enumerate(factors) if bits >> i & 1]
        product = F.lit(1.0)
        for n in names:
            product = product * F.col(n)
        contrasts.append(F.struct(F.lit(":".join(names)).alias("effect"), (product / 2 ** (3 - len(names))).alias("weight")))
    per = cells.select(question, value, F.explode(F.array(*contrasts)).alias("c")).groupBy(question, "c.effect").agg(F.sum(F.col("c.weight") * F.col(value)).alias("contrast"))
    return per.groupBy("effect").agg(F.avg("contrast").alias("estimate"))
