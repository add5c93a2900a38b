"""Names that modules and the bench take from the engine's modules exist, also where the line is reached late."""

import ast
import importlib
import importlib.util
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
FILES = sorted(p for p in [*ROOT.glob("canopy/**/*.py"), ROOT / "bench.py"] if "llm" not in p.parts)


@pytest.mark.parametrize("file", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_names(file):
    tree, modules = ast.parse(file.read_text()), {}
    for n in ast.walk(tree):
        if isinstance(n, ast.ImportFrom) and n.module and n.module.startswith("canopy"):
            source = importlib.import_module(n.module)
            for a in n.names:
                inner = f"{n.module}.{a.name}"
                if hasattr(source, "__path__") and importlib.util.find_spec(inner):
                    modules[a.asname or a.name] = importlib.import_module(inner)
                else:
                    assert hasattr(source, a.name), inner
    for n in ast.walk(tree):
        if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in modules:
            assert hasattr(modules[n.value.id], n.attr), (n.lineno, n.attr)
