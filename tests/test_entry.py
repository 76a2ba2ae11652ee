import sys

import __spark_entry__


def test_core_queries_without_what_the_subpackage_needs(monkeypatch):
    every = set(__spark_entry__.queries())
    for name in [m for m in sys.modules if m.startswith("sparkweft.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sparkweft.llm.queries", None)  # makes the import raise ImportError
    core = set(__spark_entry__.queries())
    assert "bm25_chunks" in core and core <= every and set(__spark_entry__.oracle_sql()) <= core
