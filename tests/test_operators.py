import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import evidence as V
from lodestone.operators import judge as J
from lodestone.operators import metrics as M
from lodestone.operators import perturb as P
from lodestone.operators import pools as B
from lodestone.operators import retrieval as R
from lodestone.operators import stats as S
from lodestone.operators import temporal as E
from tests.conftest import SMALL, one


def cell(spark, column, row, schema):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("gold", "text", "label"),
    [("Cook", "the cook said", 1), ("Cook", "cookies", 0), ("Cook", "Cookson", 0), ("New York", "in New York now", 1), ("New York", "New Yorker", 0), ("", "x", 0), (None, "x", 0)],
)
def test_relevance(spark, gold, text, label):
    for f in (M.relevant_by_tokens, M.relevant_by_phrase):
        assert cell(spark, f(F.array("g"), F.col("t")), (gold, text), "g string, t string") == label


@pytest.mark.parametrize(
    ("p", "g", "em", "f1"), [("The cat", "cat", 1, 1.0), ("a b b", "b b c", 0, 0.8), ("", "", 1, 1.0), ("", "x", 0, 0.0), ("x y", "z", 0, 0.0), (None, "x", 0, 0.0)]
)
def test_answer_scores(spark, p, g, em, f1):
    got = cell(spark, F.struct(M.exact_match(F.col("p"), F.array("g")), M.best_f1(F.col("p"), F.array("g"))), (p, g), "p string, g string")
    assert (got[0], round(got[1], 6)) == (em, f1)


def test_ranking_metrics_undefined(spark):
    rows = [(1, 1, 0, True), (1, 2, 0, None), (2, 1, 1, True), (2, 2, 0, False), (2, None, 1, None), (3, 1, 1, None)]
    got = {r.qid: r for r in M.ranking_metrics(spark.createDataFrame(rows, "qid int, rank int, relevant int, valid boolean"), 2).collect()}
    assert got[1].recall is None and got[1].ndcg is None and got[1].violating == 0
    assert got[2].recall == 0.5 and got[2].violating == 0.5 and got[2].valid_recall == 1.0
    assert round(got[2].ndcg, 6) == round(1 / (1 + 1 / 1.584962500721156), 6)
    assert got[3].violating is None and got[3].valid_recall is None and got[3].recall == 1.0


def test_time_valid_accuracy(spark):
    f = M.time_valid_accuracy(F.col("em"), F.col("q"), F.col("u"), F.col("v"))
    for row, want in [((1, 5, 0, True), 1), ((1, 5, 0, None), 0), ((1, 5, 1, True), None), ((1, None, 0, True), None), ((0, 5, 0, True), 0)]:
        assert cell(spark, f, row, "em int, q int, u int, v boolean") == want


def test_bm25_ties_and_zero_scores(spark):
    pool = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c d"), (1, 2, "c d"), (2, 0, "z")], "qid int, idx int, text string")
    got = one(R.ranked(R.bm25(pool, spark.createDataFrame([(1, "a")], "qid int, query string")), 3), "idx", "rank")
    assert got == [(0, 1), (1, 2), (2, 3)]


def test_rrf_keeps_duplicates_apart(spark):
    a = spark.createDataFrame([(1, 0, 1), (1, 2, 2)], "qid int, idx int, rank int")
    b = spark.createDataFrame([(1, 2, 1), (1, 5, 2)], "qid int, idx int, rank int")
    assert one(R.fuse(a, b), "rank", "idx") == [(1, 2), (2, 0), (3, 5)]


def test_vectors(spark):
    assert cell(spark, R.dot(F.col("a"), F.col("b")), ([1.0, 2.0], [3.0, 4.0]), "a array<float>, b array<float>") == 11.0
    assert cell(spark, R.mean_pool(F.col("a"), F.col("m"), 2), ([[1.0, 3.0], [3.0, 5.0], [9.0, 9.0]], [1, 1, 0]), "a array<array<double>>, m array<int>") == [2.0, 4.0]


@pytest.fixture
def odd_orders(tmp_path):
    """A folder with orders and lines whose times are null or not whole seconds; no two orders of a customer tie, but null ones."""
    import duckdb

    con = duckdb.connect()
    day = "TIMESTAMP '2020-01-01' + to_days(CAST({0} AS INT)) + to_microseconds({1})"
    order = day.format("k % 10 * 28", "CASE WHEN k % 20 = 10 THEN 1500000 WHEN k % 20 = 9 THEN 600000 WHEN k % 2 = 1 THEN 500000 ELSE 499999 END")
    con.execute(f"COPY (SELECT k AS o_orderkey, CASE WHEN k // 10 <> 3 THEN k // 10 % 30 END AS o_custkey, CASE WHEN k % 10 <> 4 AND k // 10 <> 8 AND k < 300 THEN {order} END AS o_orderdate FROM range(320) r(k)) TO '{tmp_path}/orders.parquet'")
    line = day.format("k % 30 * 14 + 56", "k % 7 * 500000")
    con.execute(f"COPY (SELECT k // 3 AS l_orderkey, CAST(k % 3 AS INT) AS l_linenumber, CASE WHEN k % 11 <> 0 THEN {line} END AS l_shipdate FROM range(960) r(k)) TO '{tmp_path}/lineitem.parquet'")
    return str(tmp_path)


def test_interval_merge_with_odd_times(spark, odd_orders):
    """Orders without a date come last, and seconds are rounded, as the SQL has them."""
    from lodestone.parity import compare
    from lodestone.plans import pools

    ok, what = compare(pools.interval_merge(spark, odd_orders), pools.ORACLES["interval_merge"], odd_orders)
    assert ok, what


def test_interval_union_filter_with_odd_times(spark, odd_orders):
    from lodestone.parity import compare
    from lodestone.plans import pools

    ok, what = compare(pools.interval_union_filter(spark, odd_orders), pools.ORACLES["interval_union_filter"], odd_orders)
    assert ok, what


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 4, 9), (1, 10, 12), (1, 2, 3)], "k int, start int, end int")
    assert one(E.merge_intervals(rows, ("k",)), "start", "end", "n") == [(1, 9, 3), (10, 12, 1)]
    points = spark.createDataFrame([(1, 9), (1, 13), (1, 10), (2, 1)], "k int, t int")
    assert one(E.within(points, E.merge_intervals(rows, ("k",)), "t", ("k",), 4), "t") == [(10,), (9,)]


def test_as_of(spark):
    left, right = spark.createDataFrame([(1, 10), (1, 3), (2, 5)], "k int, t int"), spark.createDataFrame([(1, 5, "a"), (1, 10, "b")], "k int, t int, v string")
    assert one(E.as_of(left, right, "k", "t", "v"), "k", "t", "v") == [(1, 10, "b"), (1, 3, None), (2, 5, None)]


def test_widening(spark):
    pairs = spark.createDataFrame([(1, d) for d in (0.0, 3.0, -8.0, 20.0)] + [(2, 99.0), (2, 1.0)], "qid int, d double")
    assert one(E.widening_window(pairs, F.col("d"), 3), "qid", "radius", "n") == [(1, 14, 3), (2, 56, 1)]


@pytest.mark.parametrize(("n", "starts"), [(0, [0]), (320, [0]), (321, [0, 256]), (576, [0, 256]), (577, [0, 256, 512])])
def test_chunk_starts(spark, n, starts):
    assert cell(spark, B.chunk_starts(F.col("n")), (n,), "n int") == starts


def test_span_coverage(spark):
    spans = spark.createDataFrame([(1, 0, 5, 9), (1, 4, 9, 9), (2, 0, 3, 9), (2, 4, 9, 9)], "d int, begin int, end int, n int")
    assert one(B.span_coverage(spans, ("d",), "n"), "d", "covered") == [(1, True), (2, False)]


def _pool(spark, n=12):
    rows = [(q, i, f"text {q} {i}", 1000000 - i * 86400, 1000000, i < 2) for q in range(3) for i in range(n)]
    return spark.createDataFrame(rows, "qid int, idx int, text string, ts bigint, question_ts bigint, gold boolean")


def test_slots_are_nested_and_order_free(spark):
    pool = _pool(spark)
    by = {n: {(r.qid, r.idx) for r in P.slots(pool.orderBy(F.rand(n)), "s", n).collect()} for n in P.COUNTS}
    assert by[1] < by[2] < by[5] and len(by[5]) == 15
    assert not by[5] & {(q, i) for q in range(3) for i in range(2)}
    assert P.slots(_pool(spark, 6), "s", 5).count() == 0  # four free slots are too few


def test_perturbations_change_only_their_slots(spark):
    pool = _pool(spark)
    for attacked in (P.future_date(pool, "s", 2), P.wrong_date(pool, "s", 2), P.duplicate_fresh(pool, "s", 2)):
        rows = P.differences(pool, attacked).collect()
        assert len({(r.qid, r.idx) for r in rows}) <= 6 and not any(r.gold for r in rows) and attacked.count() == pool.count()
    control, shifted = P.wrong_date(pool, "s", 2, days=0), P.wrong_date(pool, "s", 2, days=30)
    assert one(control.where("changed"), "qid", "idx", "text") == one(shifted.where("changed"), "qid", "idx", "text")


def test_holm(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p_value double")
    assert [(t, round(p, 6)) for t, p in one(S.holm(tests), "t", "holm")] == [("a", 0.03), ("b", 0.06), ("c", 0.06)]


def test_sign_flip_and_wilcoxon(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate((1.0, 1.0, 0.0, -1.0))], "g int, i int, d double")
    assert one(S.sign_flip(d, "d", ("g",), ("i",)), "n", "p_value") == [(4, 1.0)]
    assert one(S.wilcoxon(d, "d", ("g",)), "n", "w") == [(3, 2.0)]
    assert one(S.wilcoxon(d.withColumn("d", F.lit(0.0)), "d", ("g",)), "w") == [(None,)]


def test_mcnemar_exact(spark):
    pairs = spark.createDataFrame([(1, 0)] * 6 + [(0, 1)] + [(1, 1)] * 3, "a int, b int")
    assert round(S.mcnemar(pairs, "a", "b").first().p_value, 6) == 0.125
    assert S.mcnemar(pairs.where("a = b"), "a", "b").first().p_value == 1.0


def test_factorial_date_only(spark):
    cells = spark.createDataFrame([(q, *x, float(x[0] == 1)) for q in range(2) for x in itertools.product((-1, 1), repeat=3)], "q int, date int, header int, order int, y double")
    got = dict(one(S.factorial_effects(cells, "q", ("date", "header", "order"), "y"), "effect", "estimate"))
    assert got["date"] == 1.0 and all(v == 0 for k, v in got.items() if k != "date") and len(got) == 7


def test_bootstrap_numpy(spark):
    rows = spark.createDataFrame([("a", float(i % 2)) for i in range(40)] + [("b", None)], "g string, v double")
    got = {r.g: r for r in S.bootstrap_numpy(rows, "v", "g", 400).collect()}
    assert got["a"].estimate == 0.5 and 0.25 < got["a"].low < 0.5 < got["a"].high < 0.75 and got["b"].estimate is None


def test_resampled(spark):
    """10,000 draws whose spread is that of the binomial distribution, whatever the partitions."""
    rows = spark.createDataFrame([("a", float(i < 303)) for i in range(1009)] + [("b", 2.0), ("b", None)], "g string, v double")
    means = S.resampled(rows, ("v",), ("g",)).withColumnRenamed("stat", "mean").cache()
    a = [r.mean for r in means.where("g = 'a'").collect()]
    share = 303 / 1009
    sd = (share * (1 - share) / 1009) ** 0.5
    assert len(a) == 10_000 and len(set(a)) > 50 and abs(sum(a) / 10_000 - share) < 0.05 * sd and abs((sum((x - share) ** 2 for x in a) / 10_000) ** 0.5 / sd - 1) < 0.04
    got = {r.g: r for r in S.percentile_bounds(means, ("g",), 10_000).collect()}
    assert abs(got["a"].low - (share - 1.96 * sd)) < 0.1 * sd and abs(got["a"].high - (share + 1.96 * sd)) < 0.1 * sd and got["b"].low == got["b"].high == 2
    again = S.resampled(rows.repartition(7), ("v",), ("g",)).where("g = 'a'").collect()
    assert sorted(r.stat for r in again) == sorted(a)


def test_bootstrap_has_all_draws(spark):
    from lodestone.plans import analysis

    rows = {r.lang: r for r in analysis.bootstrap_bounds(spark, SMALL).collect()}
    for r in rows.values():
        sd = (r.estimate * (1 - r.estimate) / r.n) ** 0.5
        assert r.low <= r.estimate <= r.high and (sd == 0 or 2.5 < (r.high - r.low) / sd < 5)
    assert all(0 <= r.p_value <= 1 and r.low <= r.mean_diff <= r.high for r in analysis.paired_bootstrap_test(spark, SMALL).collect())


def test_wilcoxon_p(spark):
    """Against all signs of the ranks, ties and zeros included; the normal tail beyond."""
    groups = {"a": [1.0, 2.0, 3.0, 4.0, -5.0, 6.0], "b": [1.0, -1.0, 2.0, 2.0, 3.0, 0.0, 4.0, -0.5], "c": [0.0, 0.0], "d": [float(i if i % 3 else -i) for i in range(1, 81)]}
    got = {r.g: r for r in S.wilcoxon(spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, d double"), "d", ("g",)).collect()}
    for g in "ab":
        x = [abs(v) for v in groups[g] if v]
        ranks = [sum(y < v for y in x) + (x.count(v) + 1) / 2 for v in x]
        sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(x))]
        assert abs(got[g].p_value - min(1, 2 * sum(t <= got[g].w for t in sums) / len(sums))) < 1e-12
    assert got["c"].p_value is None and abs(got["d"].p_value - math.erfc(abs(got["d"].z) / 2**0.5)) < 1e-12


def test_kappa_and_cluster_bounds(spark):
    pairs = [("a", int(i < 60), int(i < 50 or i >= 95)) for i in range(100)] + [("b", 1, 1)] * 3
    got = {r.g: r for r in S.kappa_bounds(spark.createDataFrame(pairs, "g string, x int, y int"), "x", "y", ("g",)).collect()}
    # large-sample standard error of kappa with po = 0.85, pe = 0.51
    se = (0.85 * 0.15 / 100) ** 0.5 / 0.49
    assert got["a"].low < got["a"].kappa < got["a"].high and 3 < (got["a"].high - got["a"].low) / se < 5 and got["b"].low is None
    clusters = [("a", float(i)) for i in range(30)] + [("b", 1.0), ("c", 2.0), ("c", 2.0)]
    got = {r.g: r for r in S.cluster_bounds(spark.createDataFrame(clusters, "g string, v double"), "v", ("g",)).collect()}
    se = (sum((i - 14.5) ** 2 for i in range(30)) / 30 / 30) ** 0.5
    assert got["a"].estimate == 14.5 and 3.6 < (got["a"].high - got["a"].low) / se < 4.2 and got["b"].low is None and got["c"].low == got["c"].high == 2


def test_alias_groups(spark):
    occ = spark.createDataFrame([("x", "v1")] * 3 + [("y", "v1"), ("y", "v2")], "alias string, variant string")
    assert one(V.alias_groups(occ, "alias", "variant"), "alias", "n_occurrences", "n_variants", "n_extra", "conflict") == [("x", 3, 1, 2, False), ("y", 2, 2, 0, True)]


def test_replace_blocked(spark):
    p = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("s", 3, True)], "s string, id int, blocked boolean")
    r = spark.createDataFrame([("s", 7, False), ("s", 8, True)], "s string, id int, passes boolean")
    assert one(V.replace_blocked(p, r, "s", "id"), "blocked_id", "replacement_id") == [(1, 8), (3, None)]


@pytest.mark.parametrize(
    ("gold", "poison", "answer", "label", "reason"),
    [
        ("42 people", "50 people", "It was forty two.", "CORRECT", "matches_gold"), ("42 people", "50 people", "fifty", "POISON_ADOPTED", "matches_poison"), ("42", "50", "42 or 50", "NEEDS_REVIEW", "matches_gold_and_poison"),
        ("42", "50", "no idea", "OTHER_WRONG", "abstention"), ("42", "50", "7", "OTHER_WRONG", "other_value"), ("42", "42", "42", "NEEDS_REVIEW", "key_underivable"), ("42", "50", "", "OTHER_WRONG", "empty_answer"),
        ("yes he will play", "he will not play", "she will not play", "POISON_ADOPTED", "matches_poison"), ("red car", "blue van", "a red car", "CORRECT", "matches_gold"), ("red car", "blue van", "green", "NEEDS_REVIEW", "no_key_match"),
        ("red car", None, "no idea", "OTHER_WRONG", "abstention"), ("the", None, "x", "NEEDS_REVIEW", "key_underivable"), (None, None, None, "NEEDS_REVIEW", "key_underivable"),
    ],
)
def test_judge(spark, gold, poison, answer, label, reason):
    rows = spark.createDataFrame([("which", gold, poison, answer)], "q string, g string, p string, a string")
    got = J.judge(rows, "q", "g", "p", "a").first()
    assert (got.label, got.reason) == (label, reason)


def test_violations_and_replay(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    assert one(B.violations(rows, {"small": F.col("v") < 9, "odd": F.col("v") == 4}, ("k",)), "k", "violation") == [(1, "odd"), (2, "odd"), (2, "small")]
    assert B.same_rows(rows, rows).count() == 0 and B.same_rows(rows, rows.limit(1)).count() == 1


def test_numbered_is_a_row_number(spark):
    """A hot group, a null one and small ones, over several ranges."""
    from lodestone.operators import evidence as V

    rows = [("hot" if i % 3 else None if i % 5 == 0 else f"g{i % 7}", i * 7919 % 5000) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, k int")
    got = sorted(((r.g or "", r.k, r.slot) for r in V.numbered(df, "g", "k").collect()))
    want = []
    for g in {g for g, _ in rows}:
        want += [(g or "", k, n) for n, k in enumerate(sorted(k for x, k in rows if x == g), 1)]
    assert got == sorted(want)


def _stages(spark):
    """(id, MB of memory that its tasks took) of this session's stages."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).peakExecutionMemory() / 1e6 for k in range(stages.size())}


def test_resample_means(spark):
    """Against every draw taken one by one; no step of the plan repeats the rows for the draws."""
    sizes = {"a": 1, "b": 60, "c": 104729, "d": 2310, "e": 97}
    rows = [(g, i, float((i * i + len(g)) % 7)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id bigint, v double").repartition(5)
    means = S.resample_means(df, "v", ("g",), ("id",), 40)
    got = {(r.g, r.b): r["mean"] for r in means.collect()}
    want = {}
    for g, n in sizes.items():
        v, j = np.array([x for k, _, x in rows if k == g]), np.arange(n)
        want |= {(g, b): v[(b * 7919 + j * 104729 + b * j * 31 + 42) % n].sum() / n for b in range(40)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    few = spark.createDataFrame([(g, i, float(i)) for g in "ab" for i in range(20_000)], "g string, id bigint, v double")
    before = _stages(spark)
    assert len(S.resample_means(few, "v", ("g",), ("id",), 200).collect()) == 400
    assert max(mb for stage, mb in _stages(spark).items() if stage not in before) < 300


@pytest.mark.parametrize("piece", [(100, 1 << 20, 1 << 15), (7, 64, 10)])
def test_drawn_means(spark, tmp_path, monkeypatch, piece):
    """Against each draw taken one by one, and SQL: groups of few and many values, of one row, and with nulls; pieces whole and cut."""
    import duckdb

    monkeypatch.setattr(S, "DRAWN", piece)
    mask = 2**32 - 1

    def mix(x):
        x = (x ^ x >> 16) * 0x21F0AAAD & mask
        x = (x ^ x >> 15) * 0xD35A2D97 & mask
        return x ^ x >> 15

    sizes = {"a": 1, "b": 60, "c": 700, "d": 65, "e": 3, "f": 1}
    value = {"a": lambda i: 2.5, "b": lambda i: float(i % 3), "c": lambda i: (i * i % 331) / 7, "d": lambda i: None if i % 4 else -1.0, "e": lambda i: None if i else 1.0, "f": lambda i: None}
    rows = [(g, i, value[g](i)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id bigint, v double").repartition(5)
    got = {(r.g, r.b): r["mean"] for r in S.drawn_means(df, "v", ("g",), 250).collect()}
    want = {}
    for g, n in sizes.items():
        v = sorted((x for k, _, x in rows if k == g), key=lambda x: (x is None, x or 0))
        for b in range(250):
            drawn = [v[mix(mix(b + 42) + mix(j) & mask) * n >> 32] for j in range(n)]
            want[g, b] = None if all(x is None for x in drawn) else sum(x for x in drawn if x is not None) / n
    same = lambda a, b: a is b is None or None not in (a, b) and abs(a - b) < 1e-9
    assert got.keys() == want.keys() and all(same(got[k], want[k]) for k in want)
    df.write.parquet(f"{tmp_path}/v")
    sql = duckdb.execute(f"WITH v AS (SELECT * FROM '{tmp_path}/v/*.parquet'), {S.drawn_means_sql(250)} SELECT g, b, mean FROM m").fetchall()
    assert len(sql) == len(want) and all(same(mean, want[g, b]) for g, b, mean in sql)


def test_percentile_bounds_with_a_null_mean(spark):
    means = spark.createDataFrame([("a", None), ("a", 2.0), ("a", 1.0)], "g string, mean double")
    assert one(S.percentile_bounds(means, ("g",), 3), "g", "low", "high") == [("a", 1.0, 2.0)]


def test_bootstrap_ci_draws_are_independent(spark):
    """Its bounds are those of independent draws: about as wide as the normal ones, and near those of numpy's generator."""
    from lodestone.plans import analysis

    other = {r.lang: r for r in analysis.bootstrap_bounds(spark, SMALL).collect()}
    found = analysis.bootstrap_ci(spark, SMALL).collect()
    assert {r.lang for r in found} == set(other)
    for r in found:
        n, p = other[r.lang].n, other[r.lang].estimate
        assert abs(r.low - other[r.lang].low) <= 1.01 / n and abs(r.high - other[r.lang].high) <= 1.01 / n
        assert abs((r.high - r.low) - 2 * 1.96 * math.sqrt(p * (1 - p) / n)) <= 2.01 / n


def test_mined_sources_against_plain_python(spark, monkeypatch):
    """Nulls, empty arrays, copies, ties at the fifth place; batches of a few cells, one and several blocks of questions. Tokens and pairs are not shuffled."""
    from lodestone.functions import text as T
    from lodestone.operators import build as B

    rng = random.Random(5)
    words = [f"ww{i}" for i in range(12)]
    some = lambda k: sorted(rng.sample(words, rng.randint(0, k)))
    q = [(i, 10_000_000 + i * B.DAY, some(4), some(6)) for i in range(7)] + [(7, None, words, words), (8, 10_000_000, None, ["ww1", "ww2"]), (9, 10_000_000, ["zz"], [])]
    p = [(i, " ".join(rng.sample(words, rng.randint(0, 8))), 10_000_000 - rng.choice([0, 29, 30, 31, 90]) * B.DAY) for i in range(300)]
    p += [(300, None, 0), (301, " ".join(words), None), (302, "ww1, ww2! ww3", 0), (303, "ww1 WW2 ww3", 0)]
    want = set()
    for qid, ts, a, e in q:
        seen, rows = set(), []
        for i, text, at in p:
            toks = set(re.sub(r"[^a-z0-9]", " ", (text or "").lower()).split())
            n, m = len(toks & set(a or [])), len(toks & set(e or []))
            if ts is not None and at is not None and ts - at >= 30 * B.DAY and n + 2 * m >= 3:
                rows.append((-(n + 2 * m), -m, -n, i, re.sub(r"[,!]", "", (text or "").lower())))
        for s, m, n, i, form in sorted(rows):
            if form not in seen and len(seen) < 5:
                seen.add(form)
                want.add((qid, i, -n, -m, -s, len(seen)))
    questions = spark.createDataFrame(q, "qid bigint, question_ts bigint, a array<string>, e array<string>")
    passages = spark.createDataFrame(p, "id bigint, text string, ts bigint").repartition(5)
    for block, cells in ((4096, 1 << 20), (4, 40)):
        monkeypatch.setattr(B, "MINED_QUESTIONS", block)
        monkeypatch.setattr(B, "MINED_CELLS", cells)
        got = B.mine_sources(questions, passages, F.col("a"), F.col("e"), T.mining_tokens("text"))
        assert {tuple(r) for r in got.collect()} == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Generate" not in plan
    none = B.mine_sources(questions.limit(0), passages, F.col("a"), F.col("e"), T.mining_tokens("text"))
    assert none.count() == 0
    twice = passages.where("id = 303").unionByName(passages.where("id IN (302, 303)"))
    got = B.mine_sources(questions.where("qid = 8"), twice, F.col("a"), F.col("e"), T.mining_tokens("text"))
    assert [tuple(r) for r in got.collect()] == [(8, 303, 0, 4, 8, 1)]
