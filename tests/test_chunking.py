"""Chunk packing, sections and defined terms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docmosaic.operators import chunking
from docmosaic.operators.chunking import ChunkSettings


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def chunks(spark, text, settings=ChunkSettings()):
    rows = chunking.chunk(docs(spark, text), settings).orderBy("pos").collect()
    return [(r.content_type, r.text) for r in rows]


def test_separator_lines_go_and_rows_stay(spark):
    table = "|Term|Meaning|\n|---|:--:|\n|Club|means a club|\n|Player|means a player|"
    assert chunks(spark, table) == [("table_row", table.replace("|---|:--:|\n", ""))]


def test_multi_line_row_is_one_chunk(spark):
    row = "\n".join(f"|line {i} of a long definition row|" for i in range(6))
    assert chunks(spark, row, ChunkSettings(table_chunk_size=1024)) == [("table_row", row)]


def test_prose_around_a_table(spark):
    got = chunks(spark, "Before.\n|a|b|\n\n|c|d|\nAfter.\n")
    assert got == [("prose", "Before."), ("table_row", "|a|b|"), ("table_row", "|c|d|"), ("prose", "After.")]


def test_nothing_but_separators_keeps_the_text(spark):
    assert [t for _, t in chunks(spark, "|---|\n|---|")] == ["|---|\n|---|"]


def test_long_prose_is_split(spark):
    prose = " ".join(f"Sentence number {i} has a handful of words in it." for i in range(40))
    got = [t for _, t in chunks(spark, prose, ChunkSettings("sentence", 100, 20))]
    assert len(got) > 1 and all(len(t) <= 400 for t in got)
    assert set(re.findall(r"\d+", " ".join(got))) == {str(i) for i in range(40)}
    assert got[1].split(".")[0] in got[0]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        chunking.chunk(docs(spark, "x"), ChunkSettings("magic"))


def naive_table_pieces(text, limit):
    """Line by line, with explicit state."""
    out, table, prose = [], [], []

    def flush():
        if table:
            out.append(("table_row", "\n".join(table)))
            table.clear()

    for line in text.split("\n"):
        if "|" not in line:
            flush()
            prose.append(line)
            continue
        if set(line.strip()) <= set("|-+: "):
            continue
        if "\n".join(prose).strip():
            out.append(("prose", "\n".join(prose).strip()))
        prose.clear()
        if sum(map(len, table)) + len(line) > limit:
            flush()
        if len(line) <= limit:
            table.append(line)
            continue
        words = line.split(" ")
        while words:
            n = 1
            while n < len(words) and sum(len(w) + 1 for w in words[: n + 1]) <= limit:
                n += 1
            out.append(("table_row", " ".join(words[:n])))
            words = words[n:]
    flush()
    if "\n".join(prose).strip():
        out.append(("prose", "\n".join(prose).strip()))
    return out or [("", text)]


def test_table_pieces_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        lines = [
            rng.choice(["", "prose", "a longer piece of prose", "|---|", "| x |", "|" + "word " * rng.randint(1, 20) + "|", "|" + "y" * 50])
            for _ in range(rng.randint(0, 15))
        ]
        text, limit = "\n".join(lines), rng.choice([10, 30, 60])
        assert chunking.table_pieces(text, limit) == naive_table_pieces(text, limit)


@pytest.mark.parametrize("text, want", [
    ("no heading", ["no heading"]),
    ("intro\n# One\nbody", ["intro\n# One\nbody"]),
    ("intro\n# One\nbody\n## Two\nmore\n", ["# One\nbody", "## Two\nmore"]),
])
def test_markdown_sections(spark, text, want):
    assert docs(spark, text).select(chunking.markdown_sections(F.col("text")).alias("s")).first().s == want


def test_markdown_sections_with_preamble(spark):
    got = docs(spark, "intro\n# One\nx\n# Two\ny").select(chunking.markdown_sections(F.col("text"), True).alias("s")).first().s
    assert got == ["intro", "# One\nx", "# Two\ny"]


def test_numbered_sections():
    pad = "x" * 150 + "\n"
    text = f"front\n# 1 - One\n{pad}# 1 - One\n{pad}## 2 – Two\n### 3 - near\n{pad}## Section 2\n{pad}# 1 - again\n{pad}"
    got = chunking.numbered_sections(text)
    # the repeated 1 continues, 3 is within the gap, the second 2 repeats the current number
    assert [(n, t) for n, t, *_ in got] == [(1, "One"), (2, "Two"), (1, "again")]
    assert got[0][4] == got[1][3] and got[-1][4] == len(text)


def test_numbered_sections_keep_the_last_of_a_number(spark):
    pad = "y" * 150
    text = f"# 1 - first\n{pad}\n# 2 - two\n{pad}\n# 1 - last\n{pad}\n# 3 - short"
    got = chunking.split_numbered_sections(docs(spark, text), "doc_id", "hb").orderBy("number").collect()
    assert [(r.collection, r.title) for r in got] == [("hb_s01", "last"), ("hb_s02", "two")]


def test_definitions(spark):
    texts = (
        "Club means a club playing the game;\n“Player” means any contract player.\nShort means x",
        "|Match<br>Official|means a person appointed|\nCLUB means something else entirely\n**\"Cup\"** means the main competition ;",
    )
    got = chunking.definitions(docs(spark, *texts), "doc_id").collect()
    assert {tuple(r) for r in got} == {
        ("Club", "a club playing the game"), ("Player", "any contract player"),
        ("Match Official", "a person appointed"), ("Cup", "the main competition"),
    }


def test_sentence_pieces_hold_the_whole_text():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "end. ", "line\n", "x" * 30 + " ", "a; ", "\n\n"]) for _ in range(rng.randint(1, 40)))
        if not text.strip():
            continue
        limit = rng.choice([20, 50, 120])
        got = chunking.sentence_pieces(text, limit, 0)
        assert "".join("".join(got).split()) == "".join(text.split())
        assert all(len(c) <= max(limit, 31) for c in got)
        over = chunking.sentence_pieces(text, limit, limit // 3)
        assert all(len(c) <= max(limit, 31 + limit // 3) for c in over)
