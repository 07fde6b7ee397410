"""The driver's entry point, with and without the llm subpackage."""

import builtins
import importlib
import sys


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_llm(monkeypatch):
    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("fieldstone.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", without)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries())
    sys.modules.pop("__spark_entry__")
