"""Configurations: nested mappings from JSON or YAML, read on the driver, with paths that fail loudly."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, path: str) -> dict:
    """The mapping in a file that Spark can read. YAML needs the yaml package; JSON, which is YAML too, does not."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        out = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError(f"{path} is no JSON, and the yaml package is not there") from error
        out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ValueError(f"{path} holds no mapping")
    return out


def get(config: dict, path: str):
    """The value at a dotted path; KeyError with the part that is missing."""
    at = config
    for i, part in enumerate(path.split(".")):
        if not isinstance(at, dict) or part not in at:
            raise KeyError(f"no {'.'.join(path.split('.')[: i + 1])!r} in the configuration")
        at = at[part]
    return at


def flat(config: dict, before: str = "") -> Iterator[tuple[str, str]]:
    for key, value in config.items():
        path = f"{before}{key}"
        if isinstance(value, dict) and value:
            yield from flat(value, f"{path}.")
        else:
            yield path, json.dumps(value)


def table(spark: SparkSession, config: dict) -> DataFrame:
    """(path, value): every leaf with its dotted path, values as JSON; a configuration is a few rows."""
    return spark.createDataFrame(list(flat(config)), "path string, value string")
