import importlib
import sys


def test_entry_without_the_corpus_operators(monkeypatch):
    """The entry module imports, and keeps its other queries, where the llm subpackage is gone."""
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert "r5_bm25_topk" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    sys.modules.pop("__spark_entry__", None)


def test_flagship(spark):
    sys.modules.pop("__spark_entry__", None)
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).columns == ["prompt_id", "rank", "id", "score", "matched"]
