"""Registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgrain.plans import batch_queries, engine_queries, ledger_queries, logit_queries, run_queries

_MODULES = (batch_queries, logit_queries, ledger_queries, run_queries, engine_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private batches of the documents with their ids and sizes."""
    return batch_queries.batch_descriptors(spark, sf_dir)
