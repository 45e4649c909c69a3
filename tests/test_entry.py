import ast
import pathlib

import __spark_entry__ as entry


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_training_operators_stand_alone():
    root = pathlib.Path(entry.__file__).parent
    for path in (root / "recollect").rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path
