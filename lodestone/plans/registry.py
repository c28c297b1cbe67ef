"""The queries of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

from . import alignment, analysis, audit, build, checks, claims, corpus, evidence, files, pools, retrieval, streams, summary

MODULES = (retrieval, pools, analysis, evidence, streams, audit, corpus, checks, build, files, summary, claims, alignment)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
