"""A kit that records per-test coverage in a sandbox of one's own; it is written, never run."""

from __future__ import annotations

from pathlib import Path

LANGUAGES = {"python": (".py",), "javascript": (".js", ".ts", ".tsx"), "go": (".go",), "rust": (".rs",)}

_CONVERT = '''"""Turn a coverage database with test contexts into the per-test artifact."""
import ast, json, sqlite3, sys
from pathlib import Path

root, database, out = Path(sys.argv[1]), sys.argv[2], sys.argv[3]


def spans(path):
    found, work = [], [(ast.parse(path.read_text(encoding="utf-8")), "")]
    while work:
        node, qual = work.pop()
        for child in ast.iter_child_nodes(node):
            named = isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            name = f"{qual}.{child.name}" if qual and named else child.name if named else qual
            if named and not isinstance(child, ast.ClassDef):
                found.append((child.lineno + (child.end_lineno > child.lineno), child.end_lineno, name))
            work.append((child, name))
    return found


tests = {}
db = sqlite3.connect(database)
query = "SELECT f.path, c.context, b.numbits FROM line_bits b JOIN file f ON f.id = b.file_id JOIN context c ON c.id = b.context_id"
for path, test, bits in db.execute(query):
    where = Path(path)
    if not test or root.resolve() not in where.resolve().parents:
        continue
    lines = {8 * i + k for i, byte in enumerate(bits) for k in range(8) if byte >> k & 1}
    relative = where.resolve().relative_to(root.resolve()).as_posix()
    for lo, hi, name in spans(where):
        if any(lo <= n <= hi for n in lines):
            tests.setdefault(test, set()).add(f"{relative}::{name}")
Path(out).write_text(json.dumps({"format": "coverage.py", "tests": {t: sorted(f) for t, f in tests.items()}}))
'''

_RUN = {
    "python": "coverage run --context=test -m pytest -q || true\npython convert.py . .coverage coverage_modes.json\n",
    "javascript": "npx c8 --reporter=lcov npm test || true\n",
    "go": "go test ./... -coverprofile=cover.out || true\n",
    "rust": "cargo llvm-cov --lcov --output-path lcov.info || true\n",
}


def detect_languages(root: str | Path) -> list[str]:
    present = {p.suffix for p in Path(root).rglob("*") if p.is_file()}
    return [name for name, ends in LANGUAGES.items() if present & set(ends)]


def write_kit(out: str | Path, languages: list[str]) -> list[str]:
    """Write the kit for some languages into a folder; the names of the files written."""
    unknown = set(languages) - set(_RUN)
    if unknown or not languages:
        raise ValueError(f"no kit for {sorted(unknown) or 'no language'}")
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    files = {f"capture_{name}.sh": "#!/bin/sh\nset -eu\n" + _RUN[name] for name in languages}
    if "python" in languages:
        files |= {"convert.py": _CONVERT, "Dockerfile": "FROM python:3.13-slim\nRUN pip install pytest coverage\nWORKDIR /work\nCOPY . /work\nCMD [\"sh\", \"capture_python.sh\"]\n"}
    files["README.md"] = "# Recording coverage\n\nRun in a sandbox, from the root of the project:\n\n" + "".join(f"    sh {f}\n" for f in files if f.endswith(".sh"))
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    return sorted(files)
