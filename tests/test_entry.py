"""The driver's entry file with and without the optional training-data operators."""

import builtins
import importlib
import sys

import pytest


@pytest.mark.parametrize("missing", ["fieldpulse.llm", "public_tokenizers"])
def test_other_queries_remain(monkeypatch, missing):
    import __spark_entry__ as entry

    gone = [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("fieldpulse.llm")]
    for name in gone:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name == missing or name.startswith(missing + "."):
            raise ModuleNotFoundError(f"No module named {name!r}")
        return real(name, *args, **kwargs)

    real_import = importlib.import_module
    monkeypatch.setattr(builtins, "__import__", refuse)
    monkeypatch.setattr(importlib, "import_module", lambda name, *a: refuse(name) if name.startswith(missing) else real_import(name, *a))
    names = set(entry.queries())
    assert len(names) >= 69 and not any(n.startswith("op") for n in names)
    # the pipeline needs no tokenizer
    assert ("pipeline" in names) == (missing == "public_tokenizers")
    assert set(entry.oracle_sql()) <= names
