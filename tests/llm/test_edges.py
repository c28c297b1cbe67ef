"""Every operator over awkward rows, with clashing extra columns, and over an empty table."""

import pytest

from lodestone.llm import decontaminate, licenses, lm, mixing, mpeg, ngram_join, quality, secrets, toxicity, warc
from tests.llm.conftest import AWKWARD


def _benchmark(spark):
    return spark.createDataFrame([(0, "quick brown fox jumps over the lazy dog and runs far away"), (1, None), (2, ""), (3, "nothing that is here to be found by anyone at all today")], "item_id bigint, text string")


OPERATORS = {
    "op1": lambda spark, docs, labels: mpeg.digest(mpeg.encode(docs)),
    "op2": lambda spark, docs, labels: quality.score(docs, labels),
    "op4": lambda spark, docs, labels: ngram_join.join(docs),
    "op5": lambda spark, docs, labels: lm.score(docs),
    "op7": lambda spark, docs, labels: toxicity.score(docs, labels),
    "op8": lambda spark, docs, labels: secrets.scan(docs),
    "op9": lambda spark, docs, labels: mixing.mix(docs),
    "op10": lambda spark, docs, labels: licenses.scan(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_in_rows_out(spark, clashing, nothing, labels, name):
    run = OPERATORS[name]
    rows = run(spark, clashing, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((r[0] is None, r[0]) for r in AWKWARD)
    assert run(spark, nothing, labels).collect() == []
    assert len(run(spark, clashing, labels.limit(0)).collect()) == len(AWKWARD)


def test_op6(spark, clashing, nothing):
    rows = sorted((r.doc_id, r.item_id) for r in decontaminate.find(clashing, _benchmark(spark)).collect())
    assert rows == [(1, 0), (7, 0), (8, 0)]
    named = _benchmark(spark).selectExpr("concat('item ', item_id) AS item_id", "text")
    found = decontaminate.find(clashing.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text"), named).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [("1", "item 0"), ("7", "item 0"), ("8", "item 0")]
    assert decontaminate.find(nothing, _benchmark(spark)).collect() == []
    assert decontaminate.find(clashing, _benchmark(spark).limit(0)).collect() == []
    kept = decontaminate.clean(clashing, _benchmark(spark))
    assert kept.columns == clashing.columns and kept.count() == len(AWKWARD) - 3


def test_op3(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<title>T</title><p>x &amp; y"), (2, None, None), (1, "http://a.b/c", "<title>T</title><p>x &amp; y"), (None, "u", "")], "page_id bigint, url string, html string").selectExpr("*", "1 AS record", "2 AS id")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 8 and {r.record_type for r in rows} == {"metadata", "conversion"} and all(r.source_digests_hold for r in rows)
    assert warc.derive(warc.responses(pages.limit(0))).collect() == []
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"junk")), (3, bytearray(b"WARC/1.0\r\nWARC-Type: request\r\n\r\n"))], "id int, record binary")
    assert warc.derive(bad).collect() == []


def test_values_of_awkward_rows(spark, awkward, labels):
    near = {r.doc_id: r for r in ngram_join.join(awkward).collect()}
    assert [near[i].component_id for i in (1, 2, 3, 5, 7, 8, 9)] == [1, 2, 3, 5, 1, 1, 9]
    assert [near[i].n_shingles for i in (2, 3, 4, 5, 6)] == [0, 0, 0, 1, 1] and near[None].component_id is None
    found = {r.doc_id: r for r in licenses.scan(awkward).collect()}
    assert (found[9].base_labels, found[9].first_word, found[9].n_words, found[2].n_words, found[2].labels) == ("reserved", 0, 80003, 0, "")
    spans = {r.doc_id: r for r in secrets.scan(awkward).collect()}
    assert spans[10].spans == "assign:3003:3053,hex:3012:3052" or spans[10].spans.startswith("assign:3003:")
    mean = {r.doc_id: r for r in lm.score(awkward).collect()}
    assert mean[3].mean_log_score is None and mean[3].log_score == 0 and mean[9].n_words == 80003
    assert {r.doc_id: r.payload_bytes for r in mpeg.digest(mpeg.encode(awkward)).collect()}[2] == 64


def test_redaction_and_pipeline_columns(spark, clashing):
    out = secrets.redact(clashing)
    assert out.columns == clashing.columns and out.count() == len(AWKWARD)
    row = out.where("doc_id = 10").first()
    assert "0123456789abcdef" not in row.text and "[SECRET]" in row.text and row.n_chars == len(row.text)
    assert out.where("doc_id = 2").first().text is None
    plain = secrets.redact(clashing.select("doc_id", "text", "lang", "source", "n_chars"))
    assert plain.columns == ["doc_id", "text", "lang", "source", "n_chars"] and plain.where("doc_id = 1").first().n_chars == 10
