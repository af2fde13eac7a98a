"""The driver contract, and that nothing outside llm needs llm."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_types():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and all(map(callable, q.values())) and all(isinstance(s, str) for s in o.values())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["subject_id", "task_scope", "metric_id", "value"]


def test_the_query_that_stands_for_encoding_reads_a_table(spark):
    name = next(k for k in entry.queries() if k.startswith("p7_"))
    assert entry.queries()[name](spark, entry.SMOKE).inputFiles(), name


def test_core_does_not_import_llm():
    for p in (ROOT / "tallyloom").rglob("*.py"):
        if "llm" in p.relative_to(ROOT / "tallyloom").parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("tallyloom.llm" in n for n in names), p
