"""No name of a module or class is defined twice: the second definition would silently take the first one's place."""

import ast
import pathlib

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
FILES = sorted(p for folder in ("annolith", "tests") for p in (ROOT / folder).rglob("*.py"))


@pytest.mark.parametrize("path", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_names_are_defined_once(path):
    for scope in ast.walk(ast.parse(path.read_text())):
        if isinstance(scope, (ast.Module, ast.ClassDef)):
            plain = [n for n in scope.body if isinstance(n, (ast.FunctionDef, ast.ClassDef)) and not any(getattr(d, "attr", "") in ("setter", "getter", "overload") for d in n.decorator_list)]
            names = [n.name for n in plain]
            assert len(names) == len(set(names))
