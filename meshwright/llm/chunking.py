"""Splitting oversized texts at natural boundaries.

A text is a tree: sections by the depth of their heading (marked or underlined), paragraphs and
fenced code, list items by their depth, lines, sentences, tokens. The tree is given by the
strength of the boundary before each token. A node that fits stays whole; an oversized one is
taken apart at its strongest boundaries, and siblings are merged again from below as long as they
fit together. What is left over at the end of an oversized node, or a short sibling before one, joins
what follows if it is under an eighth of the limit; else a piece does not run out of or into an
oversized section. Only a sentence that
alone is too long is cut between tokens. In fenced code, and in runs of code without a fence, a
hash makes a comment and no heading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm.tokens import TOKEN, token_count

LIMIT, OVERLAP = 512, 64

#: Strength of a boundary: an item of depth d has ITEM - d down to CODE, a heading of depth d SECTION + 6 - d.
NONE, SENTENCE, LINE, CODE, ITEM, PARAGRAPH, SECTION = 0, 1, 2, 3, 9, 10, 11

_STOPS, _CLOSERS = frozenset(".!?…。！？"), frozenset("\"'”’)]»」")
_STOP = re.compile(r"[.!?…。！？]+[\"'”’)\]»」]*\Z")
_WIDE = frozenset("。！？")
_TAG = re.compile(r"<(?:h([1-6])|(p|div|section|article|table|pre|ul|ol)|(?:li|tr|br|dt|dd))\b", re.IGNORECASE)
_FENCE = re.compile(r"[^\S\n]{0,3}(`{3,}|~{3,})")
_HASHES = re.compile(r" {0,3}(#{1,6})(?=\s|$)")
_RULE = re.compile(r" {0,3}(=+|-{2,})\s*$")
_BULLET = re.compile(r"(\s*)(?:[-*+•]|\d{1,9}[.)])\s+\S")
_CODE = re.compile(r"\s{4,}\S|.*[{};:\\]\s*$|.*\w\s*=\s*\S|\s*(?:def|class|import|from|return|func|fn|var|let|const)\s+\w|.*\w\(.*\)\s*$")


def name_of(strength: int) -> str:
    if strength >= SECTION:
        return "section"
    return {NONE: "token", SENTENCE: "sentence", LINE: "line", PARAGRAPH: "paragraph"}.get(strength, "item")


def _tag_strength(text: str, at: int) -> int:
    tag = _TAG.match(text, at)
    return NONE if not tag else SECTION + 6 - int(tag[1]) if tag[1] else PARAGRAPH if tag[2] else LINE


def _is_heading(lines: list[str], i: int, depth: int) -> bool:
    """Whether a line of hashes is no comment: not in a run of such lines, nor beside code."""
    for j in (i - 1, i + 1):
        if 0 <= j < len(lines) and lines[j].strip():
            mark = _HASHES.match(lines[j])
            if (mark and len(mark[1]) == depth) or (not mark and _CODE.match(lines[j])):
                return False
    return True


def line_strengths(text: str) -> dict[int, int]:
    """{place of the first character of a line that is not blank: strength of the boundary before it}."""
    lines, out = text.split("\n"), {}
    fence, blank, underlined = "", True, False
    indents: list[int] = []
    place = 0
    for i, line in enumerate(lines):
        bare = line.lstrip()
        at, place = place + len(line) - len(bare), place + len(line) + 1
        if not bare:
            blank = True
            continue
        mark = _FENCE.match(line)
        if fence:
            out[at] = CODE if blank else LINE
            closes = mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip()
            fence, blank = ("", True) if closes else (fence, False)
            continue
        after, blank = blank, False
        if mark and not ("`" in line[mark.end() :] and mark[1][0] == "`"):
            fence = mark[1]
            out[at] = max(CODE, ITEM - len(indents)) if indents and len(line) > len(bare) else PARAGRAPH
            continue
        if underlined:
            underlined, out[at], blank = False, NONE, True
            continue
        if (head := _HASHES.match(line)) and _is_heading(lines, i, len(head[1])):
            indents, out[at], blank = [], SECTION + 6 - len(head[1]), True
            continue
        indent = len(line) - len(bare)
        if _BULLET.match(line):
            new = not indents
            while indents and indents[-1] > indent:
                indents.pop()
            if not indents or indents[-1] < indent:
                indents.append(indent)
            out[at] = PARAGRAPH if new and after else max(CODE, ITEM + 1 - len(indents))
            continue
        if indents and (indent > indents[0] or not after):
            out[at] = max(CODE, ITEM - len(indents)) if after else LINE
            continue
        indents = []
        below = lines[i + 1] if i + 1 < len(lines) else ""
        if (rule := _RULE.match(below)) and not _RULE.match(line) and indent < 4:
            underlined, out[at] = True, SECTION + 6 - (1 if rule[1][0] == "=" else 2)
            continue
        out[at] = PARAGRAPH if after or _RULE.match(line) else LINE
    return out


def strengths(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Strength of the boundary before each token; the first token's is that of a section."""
    out, marks = [SECTION + 6], line_strengths(text)
    for (_, end), (start, _) in zip(spans, spans[1:]):
        strong = marks.get(start)
        if text[start] == "<":
            strong = max(strong or NONE, _tag_strength(text, start))
        if not strong:
            last = text[end - 1]
            if start == end:
                strong = SENTENCE if last in _WIDE else NONE
            elif strong is None and (last in _STOPS or (last in _CLOSERS and _STOP.search(text, max(0, end - 8), end))):
                strong = SENTENCE
        out.append(strong or NONE)
    return out


def pack_tree(strong: list[int], start: int, end: int, limit: int, first: int | None = None) -> list[tuple[int, int]]:
    """Consecutive units that make up tokens start..end, each of at most ``limit`` tokens; the one
    that begins the text may have ``first``."""
    first = limit if first is None else first

    def fits(a: int, b: int) -> bool:
        return b - a <= (limit if a else first)

    def merge(units: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
        out: list[tuple[int, int, bool]] = []
        for a, b, whole in units:
            if out and fits(out[-1][0], b) and ((whole and out[-1][2]) or (out[-1][1] - out[-1][0]) * 8 < limit):
                out[-1] = (out[-1][0], b, whole)
            else:
                out.append((a, b, whole))
        return out

    def pack(start: int, end: int) -> list[tuple[int, int, bool]]:
        if fits(start, end):
            return [(start, end, True)]
        top = max(strong[start + 1 : end])
        if top == NONE:
            cuts = [start, *range(start + (limit if start else first), end, limit), end]
            return [(a, b, False) for a, b in zip(cuts, cuts[1:])]
        cuts = [start, *(i for i in range(start + 1, end) if strong[i] == top), end]
        units: list[tuple[int, int, bool]] = []
        for a, b in zip(cuts, cuts[1:]):
            units += [(a, b, True)] if fits(a, b) else [(x, y, False) for x, y, _ in pack(a, b)]
        return merge(units)

    return [(a, b) for a, b, _ in pack(start, end)]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int, int, str]]:
    """(first token, own first token, end token, start, own start, end, boundary) of each piece.

    Token and character positions; a piece begins with the last ``overlap`` tokens of the piece
    before, its own part follows. Own parts laid end to end give the text. A beginning shorter
    than the overlap is joined to what follows it.
    """
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= limit:
        return [(0, 0, len(spans), 0, 0, len(text), "start")]
    strong = strengths(text, spans)
    units = pack_tree(strong, 0, len(spans), limit - overlap, limit)
    while len(units) > 1 and units[1][0] < overlap:
        units[:2] = [(0, units[1][1])]
    out = []
    for i, (a, b) in enumerate(units):
        first = max(0, a - overlap) if i else 0
        begin, own = (spans[first][0], spans[a][0]) if i else (0, 0)
        stop = spans[b][0] if b < len(spans) else len(text)
        out.append((first, a, b, begin, own, stop, name_of(strong[a]) if i else "start"))
    return out


def _split(limit: int, overlap: int, texts: bool):
    schema = pa.schema(
        [("id", pa.string()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("start_token", pa.int64()), ("own_token", pa.int64()), ("end_token", pa.int64())]
        + [("start_char", pa.int64()), ("own_char", pa.int64()), ("end_char", pa.int64()), ("boundary", pa.string()), ("text", pa.large_string())]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                pieces = split_text(text, limit, overlap)
                for i, p in enumerate(pieces):
                    rows.append((ident, i, len(pieces), *p, text[p[3] : p[5]] if texts else None))
                held += len(text)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return split


def split_items(items: DataFrame, ident: str, text: str, *, limit: int = LIMIT, overlap: int = OVERLAP, texts: bool = True) -> DataFrame:
    """Pieces of the texts of more than ``limit`` tokens; texts within the limit give no rows.

    (id, piece, n_pieces, start_token, own_token, end_token, n_tokens, start_char, own_char,
    end_char, boundary, text). Characters are code points. No piece has more than ``limit``
    tokens, every piece but the first begins with the last ``overlap`` tokens of the one before,
    and ``boundary`` names what its own part was cut at. A null or blank text has no tokens and
    no pieces. Every row is split by itself, rows with equal or null ids too; the id comes out
    with its type.
    """
    if not 0 <= 2 * overlap <= limit:
        raise ValueError("the overlap may be half the limit at most")
    kind = items.schema[ident].dataType
    large = items.select(F.col(ident).cast("string").alias("id"), F.col(text).alias("text")).where(token_count(F.col("text")) > limit)
    kinds = (
        "id string, piece int, n_pieces int, start_token long, own_token long, end_token long, start_char long, own_char long, end_char long, boundary string, text string"
    )
    out = large.mapInArrow(_split(limit, overlap, texts), kinds)
    tokens = (F.col("end_token") - F.col("start_token")).alias("n_tokens")
    keep = ["piece", "n_pieces", "start_token", "own_token", "end_token", tokens, "start_char", "own_char", "end_char", "boundary"]
    return out.select(F.col("id").cast(kind).alias(ident), *keep, *["text"] * texts)
