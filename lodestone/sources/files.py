"""Files as evidence comes in them: JSON lines, CSV, ZIP members, marked-up streams, lines with offsets; and sinks."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Rows of a file of a package.
PACKAGE_ROWS = 10_000


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines, gzipped ones too, with a given schema. A line that is no such object raises; blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_lenient(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines): what a run that was cut off has written, and the lines that are not whole."""
    bad = "_corrupt_record"
    both = StructType([*schema.fields, StructField(bad, StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", both, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"), "value")
    return parsed.where(F.col(f"r.{bad}").isNull()).select(*[F.col(f"r.{f.name}") for f in schema.fields]), parsed.where(F.col(f"r.{bad}").isNotNull()).select(F.col("value").alias("line"))


def read_jsonl_resumed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of JSON lines that a run may have been cut off from: a file's last line may be torn, any other broken line raises."""
    bad = "_corrupt_record"
    both = StructType([*schema.fields, StructField(bad, StringType())])
    lines = scan_lines(spark, path).select("path", "line", F.col("text").cast("string").alias("v")).where(F.trim("v") != "")
    parsed = lines.select("path", "line", F.from_json("v", both, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    broken = parsed.where(F.col(f"r.{bad}").isNotNull()).select("path", "line")
    early = broken.join(lines.groupBy("path").agg(F.max("line").alias("last")), "path").where("line < last").orderBy("path", "line").first()
    if early:
        raise ValueError(f"line {early.line} of {early.path} is no whole record, and not the last")
    return parsed.where(F.col(f"r.{bad}").isNull()).select(*[F.col(f"r.{f.name}") for f in schema.fields])


def publish(df: DataFrame, path: str, write=None) -> None:
    """Write df beside its place (as JSON lines, or by write(df, path)) and move it there in one step; fails if the place is taken."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    place = hadoop.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place):
        raise FileExistsError(path)
    (write or write_jsonl)(df, beside)
    if fs.exists(place) or not fs.rename(hadoop.Path(beside), place):
        fs.delete(hadoop.Path(beside), True)
        raise FileExistsError(path)


def write_jsonl(df: DataFrame, path: str, compress: bool = False, most: int = 0) -> None:
    """One object a line, line feeds only; fails if the path is there, so nothing is overwritten. A file holds at most `most` rows, any number if that is 0."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", most).option("lineSep", "\n").option("ignoreNullFields", "false").option("compression", "gzip" if compress else "none").json(path)


def read_csv(spark: SparkSession, path: str, required: set[str]) -> DataFrame:
    """CSV with a header and quoted line breaks, all columns text, a byte order mark ignored; missing columns raise."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if missing := required - set(df.columns):
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_lines(spark: SparkSession, path: str, most: int = 16 << 20) -> DataFrame:
    """(path, artifact, line, offset, text): every line with its number from 1, byte offset and its file's SHA-256.

    Gzipped files are known by their first bytes; artifact is the digest of the file as it is stored. A line
    over `most` bytes raises. A file is read by one task.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest, at, rows = hashlib.sha256(data).hexdigest(), 0, []
                for number, line in enumerate(_plain(data).splitlines(keepends=True), 1):
                    if len(line) > most:
                        raise ValueError(f"line {number} of {path} has {len(line)} bytes")
                    rows.append((number, at, line.rstrip(b"\r\n")))
                    at += len(line)
                yield pa.record_batch(
                    [pa.array([path] * len(rows)), pa.array([digest] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
                    names=["path", "artifact", "line", "offset", "text"],
                )

    return _binary(spark, path).mapInArrow(run, "path string, artifact string, line bigint, offset bigint, text binary")


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, offset, text) of files of any size: what read_lines() gives, but for the digest, by many tasks a file.

    Lines end with line feeds. Each task numbers the lines of its stretch of a file; lines and bytes of the stretches before
    it, a row each, are summed over the file. Gzipped files cannot be split, and are a task each.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"), (F.octet_length("value") + 1).cast("bigint").alias("size")
    )
    within = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    blocks = blocks.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("bytes"))
    numbered = rows.withColumns({"k": F.count("*").over(within), "end": F.sum("size").over(within)})
    text = F.regexp_replace("text", "\r+$", "").cast("binary")
    return numbered.join(blocks, ["path", "block"]).select("path", (F.col("lines") + F.col("k")).alias("line"), (F.col("bytes") + F.col("end") - F.col("size")).alias("offset"), text.alias("text"))


def read_csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, fields): every CSV record, header included, with the line that it starts on, from 1."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rows, start = csv.reader(io.StringIO(_plain(data).decode("utf-8-sig"), newline="")), [], 1
                for fields in reader:
                    rows.append((start, fields))
                    start = reader.line_num + 1
                yield pa.record_batch([pa.array([path] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["path", "line", "fields"])

    return _binary(spark, path).mapInArrow(run, "path string, line bigint, fields array<string>")


def read_zip(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, member, content) of the members of ZIP files whose names end in `suffix`."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(suffix) and not n.endswith("/")):
                        yield pa.record_batch([pa.array([path]), pa.array([name]), pa.array([z.read(name)], pa.binary())], names=["path", "member", "content"])

    return _binary(spark, path).mapInArrow(run, "path string, member string, content binary")


def read_marked_docs(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc_id, text) of <doc id="..">..</doc> streams; an element that is not closed ends with the next or the file.

    The closing mark parts records, so a plain file of any size is split among tasks, and a task holds one element.
    """
    records = spark.read.option("lineSep", "</doc>").text(path).select(F.col("_metadata.file_path").alias("path"), F.explode(F.split("value", r"(?=<doc\b)")).alias("piece"))
    element = r'(?s)^<doc\b[^>]*\bid="([^"]*)"[^>]*>(.*)$'
    found = records.where(F.col("piece").rlike(element))
    return found.select("path", F.regexp_extract("piece", element, 1).alias("doc_id"), F.regexp_replace(F.regexp_extract("piece", element, 2), r"(?s)^\s+|\s+$", "").alias("text"))


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Shards in year=.. folders, gzipped JSON lines, with the year and the file of each row. No shards raise."""
    df = spark.read.schema(schema).option("basePath", path).json(f"{path}/year=*/*.jsonl*")
    return df.select("*", "_metadata.file_path")


def manifest(spark: SparkSession, path: str, crlf_as_lf: bool = False) -> DataFrame:
    """(path, bytes, sha256) of the files under a path."""
    content = F.col("content")
    if crlf_as_lf:
        content = F.encode(F.replace(F.decode(content, "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")
    return _binary(spark, path).select("path", F.octet_length("content").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two manifests: added, removed or changed."""
    b, a = before.select("path", F.col("sha256").alias("x")), after.select("path", F.col("sha256").alias("y"))
    kind = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed")
    return b.join(a, "path", "full_outer").select("path", kind.alias("change")).where("change IS NOT NULL")


def write_package(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines under path/name, and path/manifest with every file's digest, written last: without it there is no package.

    A digest takes a whole file in one task, so files hold at most PACKAGE_ROWS rows; only the digests come together.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write_jsonl(df, f"{path}/{name}", most=PACKAGE_ROWS)
    files = None
    for name in tables:
        one = manifest(spark, f"{path}/{name}/part-*").select(F.concat(F.lit(f"{name}/"), F.substring_index("path", "/", -1)).alias("file"), "bytes", "sha256")
        files = one if files is None else files.unionByName(one)
    write_jsonl(files.repartition(1), f"{path}/manifest")  # a coalesce would draw the digests into one task


def read_package(spark: SparkSession, path: str, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The tables of a package; ValueError if a file of it is missing, added or changed since it was written."""
    stated = read_jsonl(spark, f"{path}/manifest", StructType([StructField("file", StringType()), StructField("sha256", StringType())])).withColumnRenamed("file", "path")
    found = None
    for name in schemas:
        one = manifest(spark, f"{path}/{name}/part-*").select(F.concat(F.lit(f"{name}/"), F.substring_index("path", "/", -1)).alias("path"), "sha256")
        found = one if found is None else found.unionByName(one)
    wrong = changed(stated, found).orderBy("path").limit(5).collect()
    if wrong:
        raise ValueError(f"the package differs from its manifest: {[(r.path, r.change) for r in wrong]}")
    return {name: read_jsonl(spark, f"{path}/{name}", schema) for name, schema in schemas.items()}
