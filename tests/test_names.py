"""No module gives one of its names a second meaning."""

import ast
import pathlib

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1] / "cuewright"


@pytest.mark.parametrize("path", sorted(p.relative_to(ROOT).as_posix() for p in ROOT.rglob("*.py") if "llm" not in p.parts))
def test_names_are_bound_once(path):
    seen: dict[str, int] = {}
    for node in ast.parse((ROOT / path).read_text()).body:
        if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            names = [node.name]
        elif isinstance(node, ast.Assign):
            names = [n.id for t in node.targets for n in ast.walk(t) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
        else:
            names = []
        for name in names:
            assert name not in seen, f"{name} in lines {seen[name]} and {node.lineno}"
            seen[name] = node.lineno
