import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_is_registered_once_with_its_sql():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 90


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_training_data_folder_is_imported_by_the_entry_alone():
    for path in (ROOT / "tallymill").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "tallymill").parts[:1]:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
