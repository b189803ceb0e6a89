import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshwright.llm.chunking import CODE, ITEM, LINE, PARAGRAPH, SECTION, line_strengths, pack_tree, split_items, split_text
from meshwright.llm.tokens import TOKEN, token_count

PARTS = ["word", "```\n", "\n  - sub\n", "\n===\n", "\n---\n", "\n    x = 1\n", "\n# note\n# note\n", "two words.", "Ende!", "\n", "\n\n", "# head\n", "\n## sub\n", "- item\n", "1. one\n", " ", "。", "語", "x_y", "...", "<h2>t</h2>", "<p>", "\t", "é", " ", "\x1c", "\r\n"]


def check(text, limit, overlap):
    tokens = TOKEN.findall(text)
    pieces = split_text(text, limit, overlap)
    assert "".join(text[p[4] : p[5]] for p in pieces) == text
    if len(tokens) <= limit:
        assert len(pieces) == 1
        return pieces
    assert len(pieces) > 1
    for i, (first, own, end, start, own_char, stop, _) in enumerate(pieces):
        assert 0 < end - first <= limit
        assert TOKEN.findall(text[start:stop]) == tokens[first:end]
        if i:
            assert own == pieces[i - 1][2] and own_char == pieces[i - 1][5]
            assert own - first == overlap and first >= pieces[i - 1][0]
    assert pieces[0][0] == 0 and pieces[-1][2] == len(tokens)
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120), st.integers(4, 30))
def test_pieces_of_any_text(parts, limit):
    check("".join(parts), limit, limit // 4)


def test_cuts_at_the_strongest_boundary():
    text = "# One\n" + "alpha beta. " * 10 + "\n\n" + "gamma delta. " * 10 + "\n# Two\n" + "eps zeta. " * 12
    names = [p[6] for p in check(text, 40, 4)]
    assert names[0] == "start" and "section" in names and "paragraph" in names and "token" not in names
    assert {p[6] for p in check("w " * 5000, 512, 64)} == {"start", "token"}
    assert len(check("word " * 200_000, 512, 64)) > 400


def marks(text):
    found = line_strengths(text)
    return [found[at] for at in sorted(found)]


def test_headings_marked_and_underlined():
    assert marks("intro\n\nTitle\n=====\ntext\nmore\n\nSub\n---\n\ntext\n# Deep #\n###### Six\n####### seven") == [
        PARAGRAPH, SECTION + 5, 0, PARAGRAPH, LINE, SECTION + 4, 0, PARAGRAPH, SECTION + 5, SECTION, PARAGRAPH
    ]
    assert marks("a\n\n---\n\nb") == [PARAGRAPH, PARAGRAPH, PARAGRAPH]


def test_hashes_in_code_are_comments():
    assert marks("text\n```py\n# one\nx = 1\n\n# two\n```\nafter") == [PARAGRAPH, PARAGRAPH, LINE, LINE, CODE, LINE, PARAGRAPH]
    assert marks("x = f(1)\n# note\ny = 2") == [PARAGRAPH, LINE, LINE]
    assert marks("# a\n# b\n# c") == [PARAGRAPH, LINE, LINE]
    code = "Intro to it.\n\n```\n" + "# step of the run here\nvalue = call(value, 1)\n" * 120 + "```\n\nThe end of it. " * 4
    names = [p[6] for p in check(code, 128, 16)]
    assert "section" not in names and "line" in names


def test_list_items_by_depth():
    text = "intro\n\n- one\n  - sub\n    text\n\n    own paragraph\n  - sub\n- two\nlazy\n\nafter"
    assert marks(text) == [PARAGRAPH, PARAGRAPH, ITEM - 1, LINE, ITEM - 2, ITEM - 1, ITEM, LINE, PARAGRAPH]
    deep = "- top\n" + "".join(f"  - item {i} with words\n" for i in range(12))
    pieces = check(deep * 3, 60, 6)
    assert [p[6] for p in pieces][1:] == ["item"] * (len(pieces) - 1)


def test_remainders_join_their_siblings():
    # an oversized section of 22, then short ones: its last 2 join what follows
    strong = [SECTION] + [1] * 21 + [SECTION] + [0] * 8 + [SECTION] + [0] * 8
    strong[20] = LINE
    assert pack_tree(strong, 0, len(strong), 20) == [(0, 20), (20, 40)]
    # a heading's line joins the oversized text below it, not the section before it
    stub = [SECTION] + [1] * 11 + [SECTION, LINE] + [1] * 25
    stub[30] = LINE
    assert pack_tree(stub, 0, len(stub), 20) == [(0, 12), (12, 30), (30, 39)]
    wide = [SECTION] + [1] * 29 + [SECTION] + [0] * 8
    assert pack_tree(wide, 0, len(wide), 24)[-1] == (30, 39)


def test_jvm_and_python_count_alike(spark):
    rng = random.Random(5)
    odd = [chr(c) for c in (*range(0, 300), 0x0301, 0x0660, 0x1680, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x2160, 0x3000, 0x4E00, 0x3042, 0xFEFF, 0x1F600, 0xB2, 0xBD, 0x2460)]
    texts = ["".join(rng.choice(odd) for _ in range(60)) for _ in range(400)] + odd + ["", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", token_count(F.col("text")).alias("n"))
    for r in df.collect():
        assert r.n == len(TOKEN.findall(r.text or "")), repr(r.text)


def test_split_items(spark):
    long = "A sentence here. " * 400
    rows = [(1, long, "x"), (2, "short", "x"), (3, None, "x"), (4, "", "x"), (5, " \n ", "x"), (None, long, "x"), (1, long, "x"), (6, "!" * 100_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = split_items(df, "doc_id", "text").collect()
    assert {r.doc_id for r in out} == {1, None}
    one = sorted((r.piece, r.text) for r in out if r.doc_id == 1)
    assert len(one) == 2 * sum(r.doc_id is None for r in out)
    assert all(r.n_tokens <= 512 and r.text == long[r.start_char : r.end_char] for r in out)
    assert split_items(df.limit(0), "doc_id", "text").collect() == []
