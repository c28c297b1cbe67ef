"""The stages of the pipeline, each against its own input."""

import corpus_pipeline as P
from lodestone.llm import decontaminate, ngram_join, quality, secrets
from lodestone.llm.components import components
from lodestone.llm.common import staged, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for name, stage in P.STAGES[:-1]:
        seen.append(staged(stage(spark, seen[-1], SF), name))
        assert seen[-1].columns == docs.columns
    given, good, single, clean, masked = seen
    model = quality.Model(given, table(spark, SF, "labels"))
    chosen = {r.doc_id for r in model.score(given.select("doc_id", "text")).where("selected").collect()}
    assert {r.doc_id for r in good.collect()} == chosen
    near = {r.doc_id: r.component_id for r in ngram_join.join(good, 80, 5).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, c in near.items() if i == c)
    leaks = {r.doc_id for r in decontaminate.find(single, table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaks
    before, after = {r.doc_id: r.text for r in clean.collect()}, {r.doc_id: r.text for r in masked.collect()}
    assert before.keys() == after.keys() and all(after[i] == t or "[SECRET]" in after[i] for i, t in before.items())
    mixed = P.STAGES[-1][1](spark, masked, SF).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(after)
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, P.run(spark, SF).collect()))


def test_repeated_ids_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0)], table(spark, SF, "documents").schema)
    assert P.near_duplicates_stage(spark, docs, SF).count() == 3


def test_the_mix_is_planned_in_short_steps(spark):
    """The sums and offsets of ranges are written first; planned twice with the documents, they took the driver's memory."""
    plan = P.mix_stage(spark, table(spark, SF, "documents"), SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("Aggregate [") == 0


def test_the_parser_keeps_little(spark, awkward):
    """What parsing the secrets' expressions leaves in the driver's heap is bounded by a setting of Spark's, where nothing else has set it."""
    for key in ("spark.sql.parser.manageParserCaches", "spark.sql.parser.parserDfaCacheFlushThreshold"):
        spark.conf.unset(key)
    secrets.find(awkward, "doc_id")
    assert spark.conf.get("spark.sql.parser.manageParserCaches") == "true"
    assert 0 < int(spark.conf.get("spark.sql.parser.parserDfaCacheFlushThreshold")) <= 1000


def test_components_take_few_jobs(spark):
    """Each stage that a step runs takes 5 MB of the driver's heap for a moment, so a step counts its edges once."""
    edges = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(40, 50), (60, 50), (70, 70), (None, 3)], "a bigint, b bigint")
    spark.sparkContext.setJobGroup("components", "")
    found = components(edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 80  # 92 when a step counted its edges three times
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(21)] + [(40, 40), (50, 40), (60, 40)]
