"""The registry of queries, with and without the training-data subpackage."""

from __future__ import annotations

import sys

import __spark_entry__ as registry
from eventweave.plans.registry import ORACLE, QUERIES


def test_core_queries_stand_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # there, but can't be imported
    assert set(registry.queries()) == set(QUERIES) and set(registry.oracle_sql()) == set(ORACLE)
    assert set(ORACLE) == set(QUERIES) and len(QUERIES) > 60


def test_entry_has_a_stable_schema(spark):
    assert [f.name for f in registry.entry(spark).schema] == ["query_id", "rank", "vec_id", "score"]
