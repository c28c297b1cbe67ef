"""Queries of statistics and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import stats as S

from .common import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _binomial_sql(k: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: exp(lgamma({n} + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma({n} - i + 1.0::DOUBLE) - {n} * ln(2.0::DOUBLE))))) END"


_RATED = "r AS (SELECT d.lang, d.source, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")


@query(f"WITH {_RATED}, g AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 0) AS n_10, count(*) FILTER (quality = 0 AND toxic = 1) AS n_01 FROM r GROUP BY lang) SELECT lang, n_10, n_01, n_10 + n_01 AS n_discordant, round({_binomial_sql('least(n_10, n_01)', '(n_10 + n_01)')} + 1e-10, 6) AS p_value FROM g")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two labels as paired outcomes, by language."""
    return S.mcnemar(_rated(spark, sf_dir), "quality", "toxic", ("lang",)).withColumn("p_value", F.round(F.col("p_value") + 1e-10, 6))


@query(
    f"""WITH {_RATED}, g AS (SELECT lang, source, count(*) AS n, avg(CASE WHEN quality = toxic THEN 1 ELSE 0 END) AS po, avg(quality) AS a, avg(toxic) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS lenient, count(*) FILTER (quality = 1 AND toxic = 0) AS strict FROM r GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT lang, source, n, round(po, 6) AS agreement, round(CASE WHEN a * b + (1 - a) * (1 - b) < 1 THEN (po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) END, 6) AS kappa, lenient, strict FROM g"""
)
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement and kappa overall, by language and by source, in one pass."""
    r = _rated(spark, sf_dir)
    return r.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(*S.agreement(r, "quality", "toxic"))


@query(
    f"""WITH {_RATED}, g AS (SELECT lang, source, count(*) FILTER (quality = 1 AND toxic = 0) AS a, count(*) FILTER (quality = 0 AND toxic = 1) AS b FROM r GROUP BY ALL), p AS (SELECT lang, source, {_binomial_sql('least(a, b)', '(a + b)')} AS p FROM g),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p) AS k, count(*) OVER (PARTITION BY lang) AS m FROM p)
SELECT lang, source, round(p + 1e-10, 6) AS p_value, round(max(least(1.0, (m - k + 1) * p)) OVER (PARTITION BY lang ORDER BY k) + 1e-10, 6) AS holm FROM s"""
)
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests of all sources, adjusted within each language."""
    tests = S.mcnemar(_rated(spark, sf_dir), "quality", "toxic", ("lang", "source")).select("lang", "source", "p_value")
    return S.holm(tests, by=("lang",)).withColumns({"p_value": F.round(F.col("p_value") + 1e-10, 6), "holm": F.round(F.col("holm") + 1e-10, 6)})


_INDEX = "(b * 7919 + j * 104729 + b * j * 31 + 42) % n"
_BOOT = """pos AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM v),
k AS (SELECT g, b, """ + _INDEX + """ AS i FROM (SELECT g, n, i AS j FROM pos), range({draws}) x(b)),
m AS (SELECT k.g, k.b, sum(v) / max(n) AS mean FROM k JOIN pos ON pos.g = k.g AND pos.i = k.i GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY mean) - 1 AS r FROM m)"""


@query(
    f"""WITH v AS (SELECT lang AS g, doc_id AS id, quality * 1.0::DOUBLE AS v FROM labels JOIN documents USING (doc_id)), {S.drawn_means_sql(10_000)},
z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY mean) - 1 AS r FROM m)
SELECT g AS lang, round(e.estimate, 6) AS estimate, round(max(mean) FILTER (r = 250), 6) AS low, round(max(mean) FILTER (r = 9749), 6) AS high FROM z JOIN (SELECT g, avg(v) AS estimate FROM v GROUP BY g) e USING (g) GROUP BY ALL"""
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the share of good documents, by language, from 10,000 independent draws that SQL can make."""
    v = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("v", F.col("quality").cast("double"))
    bounds = S.percentile_bounds(S.drawn_means(v, "v", ("lang",), 10_000), ("lang",), 10_000)
    return v.groupBy("lang").agg(F.avg("v").alias("estimate")).join(bounds, "lang").select("lang", *[F.round(c, 6).alias(c) for c in ("estimate", "low", "high")])


@query(
    f"""WITH v AS (SELECT lang AS g, doc_id AS id, (quality - toxic) * 1.0::DOUBLE AS v FROM labels JOIN documents USING (doc_id)), {_BOOT.format(draws=200)}
SELECT g AS lang, round(e.d, 6) AS mean_diff, round(max(mean) FILTER (r = 5), 6) AS low, round(max(mean) FILTER (r = 194), 6) AS high, round(least(1.0, 2 * least(avg(CASE WHEN mean <= 0 THEN 1 ELSE 0 END), avg(CASE WHEN mean >= 0 THEN 1 ELSE 0 END))), 6) AS p_value
FROM z JOIN (SELECT g, avg(v) AS d FROM v GROUP BY g) e USING (g) GROUP BY ALL"""
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 in 200 draws that SQL can make: the paired difference of the two labels, by language. In 10,000: paired_bootstrap_test."""
    v = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("v", (F.col("quality") - F.col("toxic")).cast("double"))
    means = S.resample_means(v, "v", ("lang",), ("doc_id",), 200)
    p = means.groupBy("lang").agg(F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("mean") <= 0).cast("int")), F.avg((F.col("mean") >= 0).cast("int")))).alias("p_value"))
    out = v.groupBy("lang").agg(F.avg("v").alias("mean_diff")).join(S.percentile_bounds(means, ("lang",), 200), "lang").join(p, "lang")
    return out.select("lang", *[F.round(c, 6).alias(c) for c in ("mean_diff", "low", "high", "p_value")])


@query()
def bootstrap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile bootstrap bounds of the share of good documents, by language, from 10,000 independent draws."""
    r = _rated(spark, sf_dir)
    means = S.resampled(r, ("quality",), ("lang",)).withColumnRenamed("stat", "mean")
    return r.groupBy("lang").agg(F.count("quality").alias("n"), F.avg("quality").alias("estimate")).join(S.percentile_bounds(means, ("lang",), 10_000), "lang", "left")


@query()
def paired_bootstrap_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: the paired difference of the two labels, its bounds and p-value, by language, from 10,000 independent draws."""
    r = _rated(spark, sf_dir).withColumn("d", F.col("quality") - F.col("toxic"))
    means = S.resampled(r, ("d",), ("lang",)).withColumnRenamed("stat", "mean")
    p = means.groupBy("lang").agg(F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("mean") <= 0).cast("int")), F.avg((F.col("mean") >= 0).cast("int")))).alias("p_value"))
    return r.groupBy("lang").agg(F.avg("d").alias("mean_diff")).join(S.percentile_bounds(means, ("lang",), 10_000), "lang", "left").join(p, "lang", "left")


_NATIONS = "v AS (SELECT n_regionkey AS g, n_nationkey AS id, avg(c_acctbal) - 4500 AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, nation, d): by how much the mean balance of a nation's customers differs from 4500."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_acctbal")
    return c.join(n, "n_nationkey").groupBy(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation")).agg((F.avg("c_acctbal") - 4500).alias("d"))


@query(
    f"""WITH {_NATIONS}, pos AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM v), t AS (SELECT g, abs(sum(v)) AS target FROM v GROUP BY g),
f AS (SELECT g, s, sum(CASE WHEN (s >> i) & 1 = 1 THEN v ELSE -v END) AS x FROM pos JOIN range(65536) r(s) ON s < pow(2, n) WHERE n <= 16 GROUP BY ALL)
SELECT t.g AS region, m.n, round(avg(CASE WHEN abs(x) >= target - 1e-12 THEN 1 ELSE 0 END), 6) AS p_value FROM t JOIN (SELECT g, max(n) AS n FROM pos GROUP BY g) m USING (g) LEFT JOIN f USING (g) GROUP BY ALL"""
)
def sign_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sign-flip tests over nations, by region."""
    return S.sign_flip(_nations(spark, sf_dir), "d", ("region",), ("nation",)).withColumn("p_value", F.round("p_value", 6))


@query(
    f"""WITH {_NATIONS}, r AS (SELECT g, v, rank() OVER (PARTITION BY g ORDER BY abs(v)) + (count(*) OVER (PARTITION BY g, abs(v)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY g, abs(v)) AS c FROM v WHERE v <> 0),
s AS (SELECT g, count(*) AS n, least(sum(CASE WHEN v > 0 THEN r ELSE 0 END), sum(CASE WHEN v < 0 THEN r ELSE 0 END)) AS w, sum(c * c - 1) AS t FROM r GROUP BY g)
SELECT g AS region, n, round(w, 6) AS w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - t / 48.0), 6) AS z FROM s"""
)
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed ranks of the nations' differences, by region. Their p-values (I8): wilcoxon_test."""
    return S.wilcoxon(_nations(spark, sf_dir), "d", ("region",)).select("region", "n", F.round("w", 6).alias("w"), F.round("z", 6).alias("z"))


@query()
def wilcoxon_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: the signed-rank test of the nations' differences, by region, exact for small groups."""
    return S.wilcoxon(_nations(spark, sf_dir), "d", ("region",)).select("region", "n", "w", "p_value")


@query()
def kappa_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa of the two labels and its bootstrap interval, by language."""
    return S.kappa_bounds(_rated(spark, sf_dir), "quality", "toxic", ("lang",))


_FACTORS = "x AS (SELECT l_suppkey AS q, CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END AS returned, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS open, CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END AS large, avg(l_discount) AS y FROM lineitem GROUP BY ALL)"


@query(
    f"""WITH {_FACTORS}, e(effect, r, o, l, k) AS (VALUES ('returned',1,0,0,1),('open',0,1,0,1),('large',0,0,1,1),('returned:open',1,1,0,2),('returned:large',1,0,1,2),('open:large',0,1,1,2),('returned:open:large',1,1,1,3)),
p AS (SELECT q, effect, sum(CASE WHEN r = 1 THEN returned ELSE 1 END * CASE WHEN o = 1 THEN open ELSE 1 END * CASE WHEN l = 1 THEN large ELSE 1 END * y / pow(2, 3 - k)) AS c FROM x, e GROUP BY ALL) SELECT effect, round(avg(c), 6) AS estimate FROM p GROUP BY effect"""
)
def factorial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven effects of three factors on the mean discount, within suppliers."""
    level = lambda c: F.when(c, 1).otherwise(-1)
    cells = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", level(F.col("l_returnflag") == "R").alias("returned"), level(F.col("l_linestatus") == "O").alias("open"), level(F.col("l_quantity") > 25).alias("large")).agg(F.avg("l_discount").alias("y"))
    return S.factorial_effects(cells, "l_suppkey", ("returned", "open", "large"), "y").withColumn("estimate", F.round("estimate", 6))


@query(
    """WITH g AS (SELECT event_type, count(*) AS slots, count(*) FILTER (value > 50) AS high, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (value > 50) AS high_users, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type)
SELECT *, round(high * 1.0::DOUBLE / slots, 6) AS rate FROM g"""
)
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots, rates and affected users by type of event."""
    high = F.col("value") > 50
    g = read(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("slots"), F.count_if(high).alias("high"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(high, F.col("user_id"))).alias("high_users"),
        F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.median("value"), 6).alias("median_value"), F.round(F.percentile("value", 0.9), 6).alias("p90"),
    )
    return g.withColumn("rate", F.round(F.col("high") / F.col("slots"), 6))


@query("SELECT user_id, " + ", ".join(f"CAST(count(*) FILTER (event_type = '{t}') AS BIGINT) AS {t}" for t in ("click", "purchase", "view", "search", "logout")) + " FROM events GROUP BY user_id")
def system_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by types of event, 0 where there is none."""
    types = ["click", "purchase", "view", "search", "logout"]
    return read(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", types).count().fillna(0, types)


_GRID = "e AS (SELECT o_orderpriority AS condition, o_orderstatus AS system, l_returnflag, l_quantity, l_discount, l_tax FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query(
    f"""WITH {_GRID}, c AS (SELECT DISTINCT o_orderpriority AS condition FROM orders), s AS (SELECT DISTINCT o_orderstatus AS system FROM orders), k(poison_count) AS (VALUES (1), (2), (5)),
j AS (SELECT c.condition, s.system, k.poison_count, e.* EXCLUDE (condition, system) FROM c, s, k LEFT JOIN e ON e.condition = c.condition AND e.system = s.system AND e.l_quantity <= k.poison_count)
SELECT condition, system, poison_count, count(l_quantity) AS n, round(count(*) FILTER (l_returnflag = 'R') * 1.0::DOUBLE / nullif(count(l_quantity), 0), 6) AS selection_rate,
 round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount END), 6) AS mean_selected, round(median(CASE WHEN l_returnflag = 'R' THEN l_discount END), 6) AS median_selected, round(avg(l_tax - l_discount), 6) AS delta, count(l_tax) AS delta_n_defined FROM j GROUP BY ALL"""
)
def vulnerability_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell for every condition, system and count, with rates that are null where nothing was selected."""
    o = read(spark, sf_dir, "orders")
    rows = read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("system"), "l_returnflag", "l_quantity", "l_discount", "l_tax")
    counts = F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))).alias("poison_count")
    # the grid's rows are the few values of its dimensions
    grid = o.select(F.col("o_orderpriority").alias("condition")).distinct().join(F.broadcast(o.select(F.col("o_orderstatus").alias("system")).distinct())).select("condition", "system", counts)
    selected = F.col("l_returnflag") == "R"
    # one pass over the rows: each counts in every cell whose bound it meets
    met = rows.where("l_quantity <= 5").withColumn("poison_count", F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(5)), lambda k: k >= F.col("l_quantity"))))
    cells = met.groupBy("condition", "system", "poison_count").agg(
        F.count("*").alias("n"), F.count_if(selected).alias("k"), F.round(F.avg(F.when(selected, F.col("l_discount"))), 6).alias("mean_selected"),
        F.round(F.median(F.when(selected, F.col("l_discount"))), 6).alias("median_selected"), F.round(F.avg(F.col("l_tax") - F.col("l_discount")), 6).alias("delta"), F.count("l_tax").alias("delta_n_defined"),
    )
    full = grid.join(cells, ["condition", "system", "poison_count"], "left").fillna(0, ["n", "delta_n_defined"])
    return full.withColumn("selection_rate", F.round(F.when(F.col("n") > 0, F.col("k") / F.col("n")), 6)).drop("k")


@query(
    """WITH r AS (SELECT l_suppkey, l_returnflag, l_quantity, l_orderkey, l_linenumber FROM lineitem), u AS (SELECT DISTINCT l_suppkey, l_returnflag FROM r)
SELECT l_suppkey, string_agg(l_returnflag, ';' ORDER BY l_returnflag) AS systems, count(*) AS n_systems FROM u GROUP BY l_suppkey"""
)
def pooled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which systems retrieved an item, as one ordered list."""
    r = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("s"))
    return r.select("l_suppkey", F.array_join("s", ";").alias("systems"), F.size("s").cast("bigint").alias("n_systems"))


@query(
    """WITH t AS (SELECT doc_id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)), c AS (SELECT doc_id, unnest(list_filter([CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN quality = 1 AND toxic = 1 THEN 'good_but_toxic' END], lambda x: x IS NOT NULL)) AS category FROM t)
SELECT category, count(*) AS n, min(doc_id) AS first_doc FROM c GROUP BY category"""
)
def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping categories with their counts and first examples."""
    t = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rules = {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "long": F.col("n_chars") > 5000, "short": F.col("n_chars") < 100, "good_but_toxic": (F.col("quality") == 1) & (F.col("toxic") == 1)}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return t.select("doc_id", F.explode(found).alias("category")).groupBy("category").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    """WITH t AS (SELECT d.doc_id, quality, CASE WHEN d.doc_id % 7 = 0 THEN 'UNKNOWN' WHEN d.doc_id % 5 = 0 THEN 'INELIGIBLE' ELSE 'ELIGIBLE' END AS eligibility, d.source FROM documents d LEFT JOIN labels l USING (doc_id)),
g AS (SELECT source, count(*) FILTER (eligibility = 'ELIGIBLE') AS n, count(*) FILTER (eligibility = 'ELIGIBLE' AND quality = 1) AS k, count(*) FILTER (eligibility = 'ELIGIBLE' AND quality IS NULL) AS missing, count(*) FILTER (eligibility = 'UNKNOWN') AS unknown FROM t GROUP BY source)
SELECT source, n, k, missing, unknown, CASE WHEN unknown > 0 THEN 'NOT_ESTIMABLE' WHEN n = 0 OR missing > 0 THEN 'UNDEFINED' ELSE 'DEFINED' END AS status, round(CASE WHEN n > 0 THEN k * 1.0::DOUBLE / n END, 6) AS low, round(CASE WHEN n > 0 THEN (k + missing) * 1.0::DOUBLE / n END, 6) AS high,
 round(k * 1.0::DOUBLE / (n + unknown), 6) AS low_unknown, round((k + missing + unknown) * 1.0::DOUBLE / (n + unknown), 6) AS high_unknown FROM g"""
)
def population_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with unknown membership and missing outcomes kept apart, and the bounds they leave."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    member = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("doc_id") % 5 != 0)
    t = d.withColumn("member", member.cast("boolean"))
    g = t.groupBy("source").agg(F.count_if("member").alias("n"), F.count_if(F.col("member") & (F.col("quality") == 1)).alias("k"), F.count_if(F.col("member") & F.col("quality").isNull()).alias("missing"), F.count_if(F.col("member").isNull()).alias("unknown"))
    n, k, missing, unknown = (F.col(c) for c in ("n", "k", "missing", "unknown"))
    some = lambda c: F.round(F.when(n > 0, c / n), 6)
    status = F.when(unknown > 0, "NOT_ESTIMABLE").when((n == 0) | (missing > 0), "UNDEFINED").otherwise("DEFINED")
    return g.withColumns({"status": status, "low": some(k), "high": some(k + missing), "low_unknown": F.round(k / (n + unknown), 6), "high_unknown": F.round((k + missing + unknown) / (n + unknown), 6)})


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: a summary table with its totals."""
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT o_orderpriority AS system, o_custkey AS qid, avg(o_totalprice) AS v FROM orders GROUP BY ALL), p AS (SELECT a.system AS a, b.system AS b, a.v - b.v AS d FROM s a JOIN s b ON a.qid = b.qid AND a.system < b.system)
SELECT a, b, count(*) AS n, round(avg(d), 4) AS mean_diff, count(*) FILTER (d > 0) AS a_better FROM p GROUP BY ALL"""
)
def system_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of systems over the questions that both have."""
    s = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("system"), F.col("o_custkey").alias("qid")).agg(F.avg("o_totalprice").alias("v"))
    a, b = s.select("qid", F.col("system").alias("a"), F.col("v").alias("va")), s.select("qid", F.col("system").alias("b"), F.col("v").alias("vb"))
    return a.join(b, "qid").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg(F.col("va") - F.col("vb")), 4).alias("mean_diff"), F.count_if(F.col("va") > F.col("vb")).alias("a_better"))


@query("SELECT o_custkey, min(g) AS min_gap, CAST(count(*) FILTER (g <= 7) AS BIGINT) AS within_week FROM (SELECT o_custkey, abs(CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400) AS BIGINT)) AS g FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY o_custkey")
def date_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest gap in whole days, and how many lie within a week."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    g = read(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("o_custkey", F.abs(F.floor((seconds("l_shipdate") - seconds("o_orderdate")) / 86400)).alias("g"))
    return g.groupBy("o_custkey").agg(F.min("g").alias("min_gap"), F.count_if(F.col("g") <= 7).alias("within_week"))
