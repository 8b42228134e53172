import ast
import pathlib

import __spark_entry__ as entry_points

ROOT = pathlib.Path(__file__).parents[2]


def test_all_are_registered():
    names = list(entry_points.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("tiffinlake/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n or "corpus_pipeline" in n for n in names), path
