"""All queries of the study engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bank, calls, dedup_vector, documents, grading, interviews, maintenance, retrieval, review, stats, tags, transcripts

MODULES = (stats, review, grading, bank, dedup_vector, tags, retrieval, documents, transcripts, interviews, calls, maintenance)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in MODULES for name, query in m.R.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.R.oracles.items()}
