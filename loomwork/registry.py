"""Where queries register under their names, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.standin import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of ``Tables`` under its name, with its SQL."""

    def register(make: Callable[[Tables], DataFrame]):
        QUERIES[make.__name__] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            ORACLES[make.__name__] = sql
        return make

    return register


NODES = """nodes AS (SELECT d.doc_id AS id, source AS node_type, lang AS project, n_chars, split_part(text, chr(10), 1) AS target, text AS summary,
    CASE WHEN toxic IS NULL THEN 'draft' WHEN toxic = 1 THEN 'superseded' WHEN quality = 1 THEN 'active' ELSE 'stale' END AS status
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
