"""The core queries stand without the training-data operators, and without what those import."""

import importlib
import sys

import __spark_entry__ as driver
from workload import oracles, queries as registry


def reloaded(monkeypatch, *missing):
    for name in [n for n in sys.modules if n in ("corpus_pipeline", "millwright.llm") or n.startswith("millwright.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    for name in missing:
        monkeypatch.setitem(sys.modules, name, None)  # importing it raises ImportError
    return importlib.reload(driver)


def test_core_queries_without_the_operators(monkeypatch):
    for missing in ("millwright.llm.queries", "public_tokenizers", "ahocorasick", "zstandard"):
        with monkeypatch.context() as patched:
            found = reloaded(patched, missing, "millwright.llm.queries")
            assert set(found.queries()) == set(registry.registered())
            assert set(found.oracle_sql()) == set(oracles.oracle_sql())
    importlib.reload(driver)


def test_a_missing_library_costs_only_the_operators(monkeypatch):
    with monkeypatch.context() as patched:
        found = reloaded(patched, "ahocorasick", "zstandard", "xxhash", "tokenizers")
        assert set(registry.registered()) <= set(found.queries())
        assert "pipeline" not in found.queries()
    importlib.reload(driver)
    assert set(registry.registered()) <= set(driver.queries())
