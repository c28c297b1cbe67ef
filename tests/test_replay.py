"""Digest trees, snapshots under common ids, and pools that are filled."""

from pyspark.sql import functions as F

from lodestone.operators import build as B
from lodestone.operators import corpus as C
from lodestone.operators import replay as R
from tests.conftest import one


def test_only_differing_ranges_are_read(spark, tmp_path):
    """One row changed, one lost, one doubled: three keys are told, and at most three of the ranges are read."""
    rows = [(i, f"v{i % 7}", None if i % 3 else i / 2) for i in range(3000)] + [(5, "twin", 1.0)]
    df = spark.createDataFrame(rows, "k int, v string, x double")
    broken = [(i, v, x) for i, v, x in rows if i != 40] + [rows[70]]
    broken[99] = (100, "other", None)
    R.keep(spark.createDataFrame(broken, df.schema).repartition(5), ("k",), f"{tmp_path}/t", 2)
    found = R.replay(f"{tmp_path}/t", df, ("k",), 2)
    assert one(found, "k", "problem", "expected", "found") == [(100, "changed", 1, 1), (40, "lost", 1, 0), (70, "doubled", 1, 2)]
    ranges = R.differing(R.leaves(df, ("k",), 2), spark.read.parquet(f"{tmp_path}/t/digests"), 2)
    assert 1 <= ranges.count() <= 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan or "PartitionFilters: [_range" in plan
    R.keep(df.repartition(3), ("k",), f"{tmp_path}/same", 2)
    assert R.replay(f"{tmp_path}/same", df, ("k",), 2).count() == 0
    for part, lost in (("k = 1", 2999), ("false", 3000)):
        R.keep(df.where(part), ("k",), f"{tmp_path}/{lost}", 1)
        assert R.replay(f"{tmp_path}/{lost}", df, ("k",), 1).where("problem = 'lost'").count() == lost


def test_new_ids_do_not_depend_on_partitioning(spark):
    parents = spark.createDataFrame([(s, i, i - 1 if i % 4 == 0 else None) for s in range(3) for i in range(1, 60) if i != 7], "snapshot int, id int, replica_of int")
    children = spark.createDataFrame([(s, i, i * s) for s in range(4) for i in (1, 7, 59)], "snapshot int, parent int, line int")
    a, c = C.remapped(parents.repartition(7), children)
    b, _ = C.remapped(parents.coalesce(1), children)
    assert one(a, *a.columns) == one(b, *a.columns) and sorted(r.new_id for r in a.collect()) == list(range(1, 3 * 58 + 1))
    new = {(r.snapshot, r.id): r.new_id for r in a.collect()}
    assert all(r.new_replica_of == new.get((r.snapshot, r.replica_of)) for r in a.collect())
    assert {(r.snapshot, r.parent): r.new_parent for r in c.collect()} == {(s, i): new.get((s, i)) for s in range(4) for i in (1, 7, 59)}


def test_pools_are_full(spark):
    cited = spark.createDataFrame([(q, i) for q in range(6) for i in range(q * 5)] + [(9, 1)], "qid int, idx int")
    got = B.fill_pools(cited, spark.range(40).select(F.col("id").cast("int").alias("idx")), 12, 8, "s").collect()
    for q in (1, 2, 3, 4, 5, 9):
        mine, held = [r.idx for r in got if r.qid == q], {r.idx for r in cited.where(f"qid = {q}").collect()}
        assert len(mine) == len(set(mine)) == 12 and sum(r.is_source for r in got if r.qid == q) == min(8, len(held))
        assert all((r.idx in held) == r.is_source for r in got if r.qid == q)
    few = B.fill_pools(cited.where("qid = 1"), spark.range(7).select(F.col("id").cast("int").alias("idx")), 12, 8, "s").collect()
    assert sorted(r.idx for r in few) == [0, 1, 2, 3, 4, 5, 6]
