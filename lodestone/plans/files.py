"""Queries that write a table with a sink and read it back with its source, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import replay as R
from lodestone.sources import files as S
from lodestone.sources import split as P
from lodestone.sources.scratch import shared_dir

from .common import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")


_ROWS = "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents"


@query(_ROWS)
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as gzipped JSON lines and back."""
    d, at = read(spark, sf_dir, "documents"), _scratch(spark, "jsonl")
    S.write_jsonl(d, at, compress=True)
    return _shown(S.read_jsonl(spark, at, d.schema))


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as CSV with quoted line breaks and back; all columns come back as text."""
    c, at = read(spark, sf_dir, "conversations"), _scratch(spark, "csv")
    S.write_csv(c, at)
    r = S.read_csv(spark, at, {"conv_id", "turn", "role", "text"})
    kinds = dict(c.dtypes)
    return r.select(F.col("conv_id").cast(kinds["conv_id"]).alias("conv_id"), F.col("turn").cast(kinds["turn"]).alias("turn"), "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents WHERE text IS NOT NULL")
def marked_docs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of marked elements and back, without blanks around them."""
    d, at = read(spark, sf_dir, "documents").where("text IS NOT NULL"), _scratch(spark, "marked")
    d.select(F.concat(F.lit('<doc id="'), F.col("doc_id").cast("string"), F.lit('">\n'), F.col("text"), F.lit("\n</doc>")).alias("value")).write.text(at)
    r = S.read_marked_docs(spark, at)
    return r.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    """WITH l AS (SELECT source, doc_id, doc_id || '|' || coalesce(lang, '') AS line FROM documents), o AS (SELECT *, octet_length(encode(line)) + 1 AS n FROM l)
SELECT source, row_number() OVER w AS line, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", line AS "text" FROM o WINDOW w AS (PARTITION BY source ORDER BY doc_id)"""
)
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each source, its lines numbered and with their offsets by as many tasks as it has blocks."""
    d, at = read(spark, sf_dir, "documents"), _scratch(spark, "lines")
    lines = d.select("source", "doc_id", F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit(""))).alias("value"))
    lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(at)
    r = S.scan_lines(spark, f"{at}/source=*")
    source = F.regexp_extract("path", "/source=([^/]*)/", 1)
    return r.select(F.when(source != "__HIVE_DEFAULT_PARTITION__", source).alias("source"), "line", "offset", F.col("text").cast("string").alias("text"))


@query(_ROWS)
def package_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and labels as a package with a manifest of digests, which are verified when it is read."""
    d, l, at = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), _scratch(spark, "package")
    S.write_package({"documents": d, "labels": l}, at)
    return _shown(S.read_package(spark, at, {"documents": d.schema, "labels": l.schema})["documents"])


@query(
    """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'unparsed' WHEN lang IS NULL OR source IS NULL THEN 'missing' WHEN text = '' THEN 'empty' ELSE 'kept' END AS status, octet_length(encode(text)) AS n FROM documents)
SELECT status, count(*) AS n, min(doc_id) AS first FROM l GROUP BY status"""
)
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of JSON lines is read, parsed strictly and counted by what became of each line, with its first example."""
    d, at = read(spark, sf_dir, "documents"), _scratch(spark, "archive")
    whole = F.to_json(F.struct("doc_id", "text", "lang", "source"), {"ignoreNullFields": "false"})
    d.select(F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("\t"), F.when(F.col("doc_id") % 29 == 0, F.substring(whole, 1, 20)).otherwise(whole)).alias("value")).write.text(at)
    lines = S.scan_lines(spark, at).select(F.col("text").cast("string").alias("v"))
    r = lines.select(F.split_part("v", F.lit("\t"), F.lit(1)).cast("bigint").alias("doc_id"), F.from_json(F.expr("substring(v, instr(v, '\t') + 1)"), "doc_id bigint, text string, lang string, source string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull()
    status = F.when(bad, "unparsed").when(F.col("r.lang").isNull() | F.col("r.source").isNull(), "missing").when(F.col("r.text") == "", "empty").otherwise("kept")
    return r.select(status.alias("status"), "doc_id").groupBy("status").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(
    """WITH r AS (SELECT role, conv_id, turn, coalesce(text, '') AS t FROM conversations), n AS (SELECT *, length(t) - length(replace(t, chr(10), '')) + 1 AS n FROM r)
SELECT role, CAST(1 + sum(n) OVER (PARTITION BY role ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING) - n + 1 AS BIGINT) AS line, CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, md5(t) AS text_md5 FROM n"""
)
def csv_line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a CSV file a role, with line breaks in quotes; each record with the line that it starts on."""
    c, at = read(spark, sf_dir, "conversations"), _scratch(spark, "csv-lines")
    rows = c.repartition("role").sortWithinPartitions("role", "conv_id", "turn")
    rows.select("role", "conv_id", "turn", "text").write.partitionBy("role").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(at)
    r = P.read_csv_records(spark, f"{at}/role=*").where("line > 1")
    role = F.regexp_extract("path", "/role=([^/]*)/", 1)
    fields = F.col("fields")
    return r.select(F.when(role != "__HIVE_DEFAULT_PARTITION__", role).alias("role"), "line", fields[0].alias("conv_id"), fields[1].alias("turn"), F.md5(fields[2].cast("binary")).alias("text_md5"))


@query("SELECT CAST(doc_id // 40 AS VARCHAR) || '.jsonl' AS member, doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def zip_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines in members of ZIP archives, read by member."""
    d, at = read(spark, sf_dir, "documents"), _scratch(spark, "zip")
    d = d.select(F.concat(F.floor(F.col("doc_id") / 40).cast("string"), F.lit(".jsonl")).alias("member"), F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}).alias("line"))
    P.write_zip(d.repartition("member").sortWithinPartitions("member"), at, "member", "line")
    lines = P.read_zip_lines(spark, at, ".jsonl")
    r = lines.select("member", F.from_json("text", "doc_id bigint, text string, lang string, source string, n_chars bigint").alias("r"))
    return r.select("member", "r.*").withColumn("text_md5", F.md5(F.col("text").cast("binary"))).drop("text")


@query(
    """WITH d AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id), p AS (SELECT doc_id, n, CASE WHEN doc_id % 401 = 17 THEN 'changed' WHEN doc_id % 401 = 55 THEN 'lost' WHEN doc_id % 401 = 99 THEN 'doubled' END AS problem FROM d)
SELECT doc_id, problem, n AS expected, CASE problem WHEN 'lost' THEN 0 WHEN 'doubled' THEN 2 * n ELSE n END AS found FROM p WHERE problem IS NOT NULL"""
)
def replay_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a derived table that was kept, against what its source gives now: rows changed, lost and doubled since."""
    d, at = read(spark, sf_dir, "documents"), _scratch(spark, "replay")
    derived = d.select("doc_id", "lang", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))
    k = F.col("doc_id") % 401
    times = F.when(k == 55, 0).when(k == 99, 2).otherwise(1)
    kept = derived.withColumn("lang", F.when(k == 17, F.concat(F.coalesce("lang", F.lit("")), F.lit("?"))).otherwise(F.col("lang"))).withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).drop("copy")
    R.keep(kept, ("doc_id",), at, 2)
    return R.replay(at, derived, ("doc_id",), 2)
