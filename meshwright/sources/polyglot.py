"""Definitions and references of other languages than Python, by patterns.

No parser for these languages is at hand here, so this reads what patterns can tell: declarations
with the extent of their braces (or ``end``), calls, imports and heritage, after comments and
strings are blanked. It over-approximates like all resolution by name, within one language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from meshwright.sources.pysource import NODE_SCHEMA, REF_SCHEMA

_ID = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Language:
    """How one language declares: patterns with the groups ``name`` and, where it has one, ``owner``."""

    functions: tuple[str, ...]
    classes: tuple[str, ...]
    heritage: str | None = None
    imports: tuple[str, ...] = ()
    comment: str = r"//[^\n]*|/\*.*?\*/"
    string: str = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    block: str = "brace"


_C_FUNCTION = rf"^[ \t]*(?:[\w:<>,*&~\[\]]+[ \t*&]+)+(?:(?P<owner>{_ID})::)?(?P<name>~?{_ID})[ \t]*\([^;{{}}]*\)[^;{{}}()]*\{{"
_MEMBER = rf"^[ \t]+(?:(?:public|protected|private|internal|static|final|abstract|async|override|virtual|sealed|synchronized|readonly|get|set|export|default)[ \t]+)*(?:[\w<>\[\],.?]+[ \t]+)?(?P<name>{_ID})[ \t]*(?:<[^>\n]*>)?\([^;{{}}]*\)[^;{{}}()=]*\{{"
_TYPE = rf"\b(?:class|interface|enum|struct|record|trait|object)[ \t]+(?P<name>{_ID})"

_JS = Language(
    (rf"\bfunction\b\s*\*?\s*(?P<name>{_ID})\s*\(", rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()\n]*\)\s*(?::[^=\n]+)?=>|{_ID}\s*=>)", _MEMBER),
    (_TYPE,), rf"\bclass\s+{_ID}[^{{\n]*?\bextends\s+(?P<base>[\w.$]+)", (r"\bfrom\s+['\"](?P<name>[^'\"]+)['\"]", r"\brequire\(\s*['\"](?P<name>[^'\"]+)['\"]"),
    string=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`",
)
_JVM = Language((_MEMBER,), (_TYPE,), rf"\b(?:class|interface)\s+{_ID}[^{{\n]*?(?:\bextends\b|\bimplements\b|:)\s*(?P<base>{_ID})", (r"^\s*(?:import|using)\s+(?:static\s+)?(?P<name>[\w.]+)",))
LANGUAGES = {
    "js": _JS,
    "java": _JVM,
    "csharp": _JVM,
    "go": Language((rf"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>{_ID})[^)]*\)\s*)?(?P<name>{_ID})\s*[\[(]",), (rf"^type\s+(?P<name>{_ID})\s+(?:struct|interface)\b",), None, (r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<name>[\w./-]+)\"",), string=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`"),
    "rust": Language((rf"\bfn\s+(?P<name>{_ID})",), (rf"\b(?:struct|enum|trait|union)\s+(?P<name>{_ID})", rf"\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>{_ID})"), None, (r"\buse\s+(?P<name>[\w:]+)",), string=r"\"(?:\\.|[^\"\\])*\""),
    "c": Language((_C_FUNCTION,), (rf"\b(?:class|struct|union|enum)\s+(?P<name>{_ID})\s*(?:final\s*)?(?:[:{{])",), rf"\bclass\s+{_ID}\s*:\s*(?:public|protected|private)?\s*(?P<base>{_ID})", (r"^\s*#\s*include\s+[<\"](?P<name>[^>\"]+)",)),
    "ruby": Language((r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)",), (r"^\s*(?:class|module)\s+(?P<name>[A-Z]\w*)",), r"^\s*class\s+\w+\s*<\s*(?P<base>[A-Z]\w*)", (r"^\s*require(?:_relative)?\s+['\"](?P<name>[^'\"]+)",), comment=r"#[^\n]*", block="end"),
    "php": Language((rf"\bfunction\s+&?(?P<name>{_ID})\s*\(",), (_TYPE,), rf"\bclass\s+{_ID}\s+extends\s+\\?(?P<base>{_ID})", (r"^\s*use\s+(?P<name>[\w\\]+)",), comment=r"//[^\n]*|#[^\n\[]*|/\*.*?\*/"),
    "bash": Language((r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{", r"^\s*function\s+(?P<name>[\w-]+)\s*\{"), (), None, (r"^\s*(?:source|\.)\s+(?P<name>\S+)",), comment=r"(?<![\w$\\{])#[^\n]*"),
}
# Words before a parenthesis that call nothing.
KEYWORDS = frozenset(
    "if for while switch catch return function new typeof sizeof match with do else elif until unless when and or not in is as await yield throw "
    "func fn def class struct case foreach super this self".split()
)
# Words that are such in one language only.
OWN_KEYWORDS = {"go": {"go", "defer", "select"}, "php": {"echo", "print", "isset", "empty", "array", "list", "unset", "exit", "die"}, "csharp": {"using", "lock"}}
EXTENSIONS = {
    "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "java": "java", "cs": "csharp", "go": "go", "rs": "rust",
    "c": "c", "cc": "c", "cpp": "c", "cxx": "c", "h": "c", "hpp": "c", "hxx": "c", "rb": "ruby", "php": "php", "sh": "bash", "bash": "bash",
}


def header_dialect(text: str) -> str:
    """'cpp' if a header uses what C has not, else 'c'."""
    return "cpp" if re.search(r"\b(?:class|namespace|template|public:|private:|using|virtual|constexpr|std::)", text) else "c"


def blank(text: str, lang: Language) -> str:
    """The text with comments and strings blanked, every character in its place."""
    hide = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(f"(?:{lang.comment})|(?:{lang.string})", hide, text, flags=re.DOTALL | re.MULTILINE)


def _extent(code: str, start: int, lang: Language) -> int:
    """Where the body that opens after ``start`` ends."""
    if lang.block == "end":
        depth = 1
        for m in re.finditer(r"(?:^|;)[ \t]*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\b|\bend\b", code[start:], re.MULTILINE):
            depth += -1 if m[0] == "end" else 1
            if not depth:
                return start + m.end()
        return len(code)
    at = code.find("{", start)
    stop = code.find(";", start)
    if at < 0 or (0 <= stop < at):
        return code.find("\n", start) if "\n" in code[start:] else len(code)
    depth = 0
    for m in re.finditer(r"[{}]", code[at:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return at + m.end()
    return len(code)


def parse(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """(nodes, references) of a file of a known language; of another none."""
    name = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower())
    if name is None:
        return [], []
    lang, keywords = LANGUAGES[name], KEYWORDS | OWN_KEYWORDS.get(name, set())
    code = blank(text, lang)
    line = lambda at: code.count("\n", 0, at) + 1
    found: dict[int, tuple[int, int, str, str | None, str]] = {}
    for kind, patterns in (("Class", lang.classes), ("Function", lang.functions)):
        for pattern in patterns:
            for m in re.finditer(pattern, code, re.MULTILINE):
                at = m.start("name")
                if m["name"] not in keywords and at not in found:
                    opening = m.end() - 1 if code[m.end() - 1] == "{" else m.end()
                    found[at] = (at, _extent(code, opening, lang), m["name"], m.groupdict().get("owner"), kind)
    spans = sorted(found.values(), key=lambda x: (x[0], -x[1]))
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    module = f"{path}::{stem}"
    is_test = bool(re.search(r"(?:^|[/._-])(?:test|tests|spec)s?(?:[/._-]|$)", path.lower()))
    nodes = [(module, "Module", stem, f"{path}:1", line(len(code)), False, None, None, [])]
    owners: list[tuple[int, int, str]] = [(0, len(code) + 1, module)]
    taken: dict[str, int] = {}
    stack: list[tuple[int, int, str, str]] = []
    for start, end, called, owner, kind in spans:
        while stack and stack[-1][1] <= start:
            stack.pop()
        if kind == "Class" and any(s[2] == called and s[3] == "Class" for s in stack):
            continue
        inside = [s for s in stack if s[3] == "Class"]
        qual = f"{owner}.{called}" if owner else ".".join([*(s[2] for s in stack), called])
        if kind == "Class" and taken.get(qual):
            stack.append((start, end, called, kind))  # a type is opened again: an implementation block
            continue
        taken[qual] = taken.get(qual, 0) + 1
        ident = f"{path}::{qual}" + (f"#{taken[qual]}" if taken[qual] > 1 else "")
        real = "Method" if kind == "Function" and (owner or inside) else kind
        before = code[code.rfind("\n", 0, start) + 1 : start]
        body = code[code.find("{", start) + 1 : end - 1].strip() if lang.block == "brace" and "{" in code[start:end] else "x"
        roles = ["exported"] if re.search(r"\b(?:export|public|pub)\b", before) or (name == "go" and called[:1].isupper()) else []
        if called == "main":
            roles.append("main")
        if is_test and called.lower().startswith("test"):
            roles.append("test")
        nodes.append((ident, real, called, f"{path}:{line(start)}", line(max(start, end - 1)), kind == "Function" and not body and "abstract" not in before, None, None, sorted(roles)))
        owners.append((start, end, ident))
        stack.append((start, end, called, kind))
    starts = {s for s, *_ in spans}
    refs: list[tuple] = []

    def holder(at: int) -> str:
        return min((e - s, i) for s, e, i in owners if s <= at < e)[1]

    for m in re.finditer(rf"(?P<dot>(?:\.|->|::)\s*)?(?P<name>{_ID})\s*\(", code):
        if m["name"] not in keywords and m.start("name") not in starts:
            refs.append((holder(m.start("name")), "CALLS", m["name"], None, bool(m["dot"]), line(m.start())))
    if name == "bash":
        for m in re.finditer(r"^[ \t]*(?P<name>[\w-]+)(?=\s|$)(?!\s*\(\))", code, re.MULTILINE):
            if m["name"] not in keywords and m["name"] not in ("then", "fi", "done", "esac"):
                refs.append((holder(m.start("name")), "CALLS", m["name"], None, False, line(m.start())))
    if lang.heritage:
        for m in re.finditer(lang.heritage, code, re.MULTILINE):
            refs.append((holder(min(s for s in starts | {m.end()} if s >= m.start())) if starts else module, "INHERITS", m["base"].rsplit(".", 1)[-1], None, False, line(m.start())))
    for pattern in lang.imports:
        for m in re.finditer(pattern, text, re.MULTILINE):
            refs.append((module, "IMPORTS", m["name"], "module", False, line(m.start())))
    return nodes, refs


def _emit(which: int):
    columns = [c.split()[0] for c in (NODE_SCHEMA, REF_SCHEMA)[which].split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(s, *x, p) for s, p, t in zip(pdf["snapshot"], pdf["path"], pdf["text"]) for x in parse(p, t)[which]]
            yield pd.DataFrame(rows, columns=columns)

    return run


def definitions(sources: DataFrame) -> DataFrame:
    """Nodes of (snapshot, path, text) rows; join them with ``pysource.definitions`` for all files."""
    return sources.select("snapshot", "path", "text").mapInPandas(_emit(0), NODE_SCHEMA)


def references(sources: DataFrame) -> DataFrame:
    """References in the form that ``pysource.resolve`` takes."""
    return sources.select("snapshot", "path", "text").mapInPandas(_emit(1), REF_SCHEMA)
