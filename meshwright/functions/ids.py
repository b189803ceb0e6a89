"""Columns over ids of the form ``path::qualified.name`` with an optional ``#n``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fragments of a lower-case path that mark test code.
TEST_PATH_HINTS = ("/test", "test_", "_test", "/tests/", "/spec", ".spec.", ".test.")

# Language of a file by its extension. Unknown extensions match any language.
LANGUAGE_OF = {
    "py": "python", "pyi": "python",
    "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js",
    "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "rb": "ruby", "php": "php",
    "c": "c", "h": "c", "cc": "c", "cpp": "c", "cxx": "c", "hpp": "c", "hxx": "c",
    "sh": "bash", "bash": "bash",
}


def file_of(ident: Column) -> Column:
    """The owning file: what stands before ``::``."""
    return F.substring_index(ident, "::", 1)


def qual_of(ident: Column) -> Column:
    """The qualified name: what follows the first ``::``, empty without one."""
    return F.when(F.instr(ident, "::") > 0, F.substring(ident, F.instr(ident, "::") + 2, F.length(ident))).otherwise(F.lit(""))


def leaf_of(name: Column) -> Column:
    """Last segment of a dotted or ``::`` name."""
    return F.substring_index(F.substring_index(name, ".", -1), "::", -1)


def owner_of(ident: Column) -> Column:
    """The enclosing scope of a member id, null for an id that is no member."""
    qual = qual_of(ident)
    kept = F.concat(file_of(ident), F.lit("::"), F.regexp_replace(qual, r"\.[^.]*$", ""))
    return F.when(F.instr(qual, ".") > 0, kept)


def is_test_path(ident: Column) -> Column:
    path = F.lower(file_of(ident))
    hit = F.startswith(F.substring_index(path, "/", -1), F.lit("test"))
    for hint in TEST_PATH_HINTS:
        hit = hit | F.contains(path, F.lit(hint))
    return hit


def under_scope(ident: Column, scope: str) -> Column:
    """Whether an id is the scope or a child of it at ``/``, ``::`` or ``.``."""
    inside = F.startswith(ident, F.lit(scope))
    if scope.endswith(("/", "::", ".")):
        return inside
    rest = F.substring(ident, len(scope) + 1, 2)
    return inside & ((ident == scope) | (rest == "::") | F.substring(rest, 1, 1).isin("/", "."))


def language_of(ident: Column) -> Column:
    """Language of the owning file, null if the extension is not known."""
    ext = F.lower(F.substring_index(file_of(ident), ".", -1))
    out = F.lit(None).cast("string")
    for name in dict.fromkeys(LANGUAGE_OF.values()):
        out = F.when(ext.isin([e for e, lang in LANGUAGE_OF.items() if lang == name]), F.lit(name)).otherwise(out)
    return out


def same_language(a: Column, b: Column) -> Column:
    x, y = language_of(a), language_of(b)
    return x.isNull() | y.isNull() | (x == y)


def start_line(location: Column) -> Column:
    """Line of a location ``path:line``, null if there is none."""
    return F.substring_index(location, ":", -1).try_cast("int")


def base_test_id(test: Column) -> Column:
    """A test without run phase and parameters, its class path joined by dots."""
    plain = F.regexp_replace(F.regexp_replace(test, r"\|(?:run|setup|teardown)\z", ""), r"\[.*\]\z", "")
    parts = F.split(plain, "::")
    joined = F.concat(parts[0], F.lit("::"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), "."))
    return F.when(F.size(parts) > 2, joined).otherwise(plain)


def set_signature(members: Column) -> Column:
    """Content address of a set of ids."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(members)), "\x1f"), 256)
