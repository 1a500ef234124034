"""The entry works without the optional operators, whatever of theirs is missing."""

from __future__ import annotations

import importlib
import sys

import pytest

import __spark_entry__ as entry
from tallyweave.plans import catalog


@pytest.mark.parametrize("blocked", ["xxhash", "sentencepiece", "numpy"])
def test_without_a_package(monkeypatch, blocked):
    for name in [m for m in sys.modules if m.startswith("tallyweave.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, blocked, None)
    importlib.reload(entry)
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)


def test_names():
    found = entry.queries()
    assert set(catalog.QUERIES) <= set(found) and set(entry.oracle_sql()) <= set(found)
