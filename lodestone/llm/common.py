"""Reading tables, the shared scratch folder, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import importable

#: A word of the contracts: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of a batch that goes to a Python worker. The default, 10,000 texts or pairs of texts of any length, is most of a
#: worker's memory; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: States that the SQL parser's caches may hold (Spark takes one for 10 kB); long expressions leave several thousand in the driver for good.
PARSER_STATES = 1000


def prepared(spark: SparkSession) -> None:
    """What operators need of a session: this package on the workers' path, batches of bounded size for these, and a parser that drops its caches."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parser.manageParserCaches", "true")
    spark.conf.set("spark.sql.parser.parserDfaCacheFlushThreshold", str(PARSER_STATES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: later jobs read the files, and a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(text: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_hash(seed: str, *cols: str) -> Column:
    """60 bits of MD5 over the seed and the columns, as a non-negative long; DuckDB computes the same."""
    parts = [F.lit(seed)] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


#: A key with more than one in so many rows is hot, if it has HOT_LEAST rows; so hot keys are fewer than HOT_KEYS.
HOT_KEYS, HOT_LEAST = 10_000, 256


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """left joined with right, which has at most one row for a key.

    Rows of left whose key is hot stay where they are: the fewer than HOT_KEYS rows that right has for hot keys are
    broadcast to them. All others meet by their key, and no task gets more than one in HOT_KEYS of left's rows
    for one key. left is read twice, so it should be a written table. total: left's rows, where they are known.
    """
    counts = left.groupBy(keys).count()
    total = left.count() if total is None else total
    hot = counts.where(F.col("count") > max(HOT_LEAST, total // HOT_KEYS)).select(keys).toArrow()
    if not hot.num_rows:
        return left.join(right, keys, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(hot))
    many = left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how)
    return many.unionByName(left.join(hot, keys, "left_anti").join(right, keys, how))
