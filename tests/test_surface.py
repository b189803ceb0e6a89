import ast
import importlib
import json
import sys

import pytest

from meshwright.plans import catalog
from meshwright.sources import capture_kit


def test_every_sql_has_its_query():
    assert set(catalog.sql()) <= set(catalog.queries())
    names = list(catalog.queries())
    assert len(names) == len(set(names)) and {"p1_found", "p2_found", "p3_found", "p5_found"} <= set(names)


def test_core_does_not_know_the_llm_subpackage():
    import meshwright
    from pathlib import Path

    for path in Path(meshwright.__file__).parent.rglob("*.py"):
        if path.parent.name == "llm":
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            named = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in named), path


def test_entry_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "meshwright.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "p1_found" in entry.queries() and "p4_found" not in entry.queries()
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)


def test_cli(capsys):
    from meshwright.__main__ import main

    assert main(["--list"]) == 0 and "find_stale" in capsys.readouterr().out
    assert main(["nonsense", "x"]) == 2
    assert main(["find_stale"]) == 1 and json.loads(capsys.readouterr().out)["ok"] is False


def test_capture_kit(tmp_path):
    (tmp_path / "x.py").write_text("")
    (tmp_path / "y.go").write_text("")
    found = capture_kit.detect_languages(tmp_path)
    assert found == ["python", "go"]
    written = capture_kit.write_kit(tmp_path / "kit", found)
    assert "convert.py" in written and "capture_go.sh" in written
    compile((tmp_path / "kit" / "convert.py").read_text(), "convert.py", "exec")
    with pytest.raises(ValueError):
        capture_kit.write_kit(tmp_path / "kit", ["cobol"])
