"""Identities by domain-separated SHA-256: questions, evidence variants, occurrences and seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_seed(base: Column, key: Column, kind: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the three, joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", base.cast("string"), key.cast("string"), kind), 256), 1, 16)


def question_hash(question: Column) -> Column:
    return F.sha2(F.trim(question), 256)


def canonical(*columns: str | Column) -> Column:
    """Compact JSON with these fields in the order of their names; nulls are written."""
    named = sorted(columns, key=lambda c: c if isinstance(c, str) else c._jc.toString())
    return F.to_json(F.struct(*named), {"ignoreNullFields": "false"})


def variant_id(text: Column, timestamp: Column, *more: Column) -> Column:
    """One id for the same bytes, time spelling and further fields; a change of any makes another."""
    return F.sha2(F.concat_ws("\u0001", F.lit("variant"), F.sha2(text.cast("binary"), 256), F.coalesce(timestamp, F.lit("\u0000")), *more), 256)


def occurrence_id(artifact: Column, line: Column) -> Column:
    """One id for a place: an artifact's digest and a line of it, from 1."""
    return F.sha2(F.concat_ws("\u0001", F.lit("occurrence"), artifact, line.cast("string")), 256)


def hash_order(seed: str, *columns: Column) -> Column:
    """A hash by which rows are sampled: the same in any partitioning, and a smaller sample is part of a larger."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns]), 256)


# The domains of content-bound identities.
QUESTION, PARENT_SOURCE, PARENT_OCCURRENCE, CHILD, CHILD_OCCURRENCE = "sqa-q-v2", "sqa-parent-source-a9-v1", "sqa-po-v2", "sqa-child-a9-v1", "sqa-child-occurrence-a9-v1"


def domain_identity(domain: str, *parts: Column) -> Column:
    """domain:digest of the canonical JSON list of the domain and its parts; texts are quoted, whole numbers are not.

    Null where a part is null, so an identity never stands for something that is missing.
    """
    quoted = [F.when(F.typeof(p) == "string", _json_text(p)).otherwise(p.cast("string")) for p in parts]
    return F.concat(F.lit(f"{domain}:"), F.sha2(F.concat(F.lit(f'["{domain}",'), *[x for k, q in enumerate(quoted) for x in ([F.lit(",")] if k else []) + [q]], F.lit("]")), 256))


def _json_text(c: Column) -> Column:
    """A text as JSON writes it."""
    whole = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def question_identity(table_sha256: Column, question_id: Column) -> Column:
    return domain_identity(QUESTION, table_sha256, question_id.cast("string"))


def parent_source_identity(doc_id: Column, text_sha256: Column) -> Column:
    """Of an exact source id and an exact text, wherever they stand."""
    return domain_identity(PARENT_SOURCE, doc_id.cast("string"), text_sha256)


def parent_occurrence_identity(frame: Column, question: Column, slot: Column) -> Column:
    """Of a place in a question's pool."""
    return domain_identity(PARENT_OCCURRENCE, frame, question, slot.cast("bigint"))


def child_identity(parent_source: Column, text_sha256: Column, start: Column, end: Column, config_sha256: Column) -> Column:
    """Of a span of a source under a way of chunking, whatever question it is asked for."""
    return domain_identity(CHILD, parent_source, text_sha256, start.cast("bigint"), end.cast("bigint"), config_sha256)


def child_occurrence_identity(question_row: Column, slot: Column, child: Column) -> Column:
    return domain_identity(CHILD_OCCURRENCE, question_row.cast("bigint"), slot.cast("bigint"), child)
