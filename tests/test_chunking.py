"""Chunking by what the rules promise: bounds, places, sizes and order, on random Markdown.

The registered queries coalesce_units and chunk_documents are held against recursive SQL.
"""

import math
import random
import re

import pytest

from lanternfish.operators import chunking as C

OPTIONS = C.ChunkOptions(target_tokens=12, min_tokens=5, max_tokens=18)


def parts_of(text):
    latin = len(re.findall(r"[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)?", text))
    rest = re.sub(r"[A-Za-z0-9_\s'-]", "", text)
    return latin + math.ceil(len(rest) / 3)


def sections(text):
    """(heading, text) of each stretch that a heading line begins."""
    starts = [m.start() for m in re.finditer(r"^#{1,6}\s+\S", text, re.M)]
    bounds = sorted({0, *starts, len(text)})
    found = []
    for a, b in zip(bounds, bounds[1:]):
        head = re.match(r"#{1,6}\s+(.*?)[\s#]*(?:\n|$)", text[a:b]) if a in starts else None
        found.append((head[1].strip() if head else "root", text[a:b].strip()))
    return [(h, t) for h, t in found if t]


def is_dense(text, o):
    items = re.findall(r"^(?:[-*+]|\d+[.)])\s", text, re.M)
    labels = re.findall(r"^(?:(?:[-*+]|\d+[.)])\s+)?\*\*[^*\n]{1,120}:\*\*", text, re.M)
    return len(items) >= 3 and (len(labels) >= 2 or parts_of(text) > o.target_tokens)


def random_markdown(rng):
    lines = []
    for _ in range(rng.randint(0, 25)):
        words = " ".join(rng.choice(["alpha", "beta", "gamma,", "delta's", "e-f", "x."]) for _ in range(rng.choice([1, 2, 4, 7, 25])))
        lines.append(rng.choice(["", "", words, words, f"- {words}", f"2. {words}", f"**Label:** {words}", f"- **L:** {words}", f"# Head {rng.randint(1, 2)}", f"  - {words}", "## Sub ##"]))
    return "\n".join(lines)


def test_chunks_keep_the_rules(spark):
    rng, o = random.Random(7), OPTIONS
    texts = [random_markdown(rng) for _ in range(150)] + ["", "\n\n", "# Only", "no heading here at all my friend today"]
    docs = spark.createDataFrame([(f"memory/users/{i}.md", f"/c/memory/users/{i}.md", t, 86_400_000) for i, t in enumerate(texts)], "source string, absolute_path string, text string, mtime long")
    got = C.chunk_documents(docs, o).select("source", "section", "text", "id", "token_count", "metadata.type", "metadata.date").collect()
    assert {r["type"] for r in got} == {"memory"} and {r["date"] for r in got} == {"1970-01-02"}
    assert len({r["id"] for r in got}) == len(got)
    assert all(r["token_count"] == parts_of(r["text"]) >= o.min_tokens and r["text"] == r["text"].strip() for r in got)
    by_section = {}
    for r in got:
        by_section.setdefault((r["source"], r["section"]), []).append(r["text"])
    known = set()
    for i, text in enumerate(texts):
        same = {}
        for head, body in sections(text):
            same.setdefault(head, []).append(body)
        for head, bodies in same.items():
            known.add((f"memory/users/{i}.md", head))
            made = by_section.get((f"memory/users/{i}.md", head), [])
            whole = [b for b in bodies if parts_of(b) <= o.max_tokens and not is_dense(b, o)]
            # what needs no split is one chunk as it stands, if it is large enough
            assert sorted(b for b in whole if parts_of(b) >= o.min_tokens) == sorted(c for c in made if c in whole)
            cut = [b for b in bodies if b not in whole]
            pieces = [c for c in made if c not in whole]
            assert cut or not pieces
            for c in pieces:
                # a piece is words of its section side by side, and within the bound but for words that a window cuts
                assert any(" ".join(c.split()) in " ".join(b.split()) or len(c.split()) > o.max_tokens - o.min_tokens for b in cut)
                assert parts_of(c) <= o.max_tokens or len(max(c.split("\n\n"), key=len).split()) <= o.max_tokens
            for b in cut:
                # every paragraph that is large enough stands in some piece, whole or in windows
                for unit in re.split(r"\n\s*\n", b):
                    if o.min_tokens <= parts_of(unit) <= o.max_tokens and "\n" not in unit.strip():
                        assert any(unit.strip() in c for c in pieces)
    assert set(by_section) <= known


def test_small_units_join_and_long_ones_are_cut(spark):
    small = "\n".join(f"- item {k}" for k in range(5))
    long = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([("a.md", "/c/a.md", f"# List\n\n{small}\n\n{long}\n\nend", 0)], "source string, absolute_path string, text string, mtime long")
    got = [r["text"] for r in C.chunk_documents(docs, OPTIONS).collect()]
    windows = [" ".join(f"w{k}" for k in range(a, min(a + 18, 40))) for a in (0, 12, 24, 36)]
    assert sorted(got) == sorted(["# List\n\n- item 0\n\n- item 1", "- item 2\n\n- item 3\n\n- item 4", *windows[:3], windows[3] + "\n\nend"])


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_repeated_headings_have_their_own_ids(spark, ending):
    text = ending.join(["## A", "one two three four five six", "## A", "one two three four five six"])
    docs = spark.createDataFrame([("a.md", "/c/a.md", text, 0)], "source string, absolute_path string, text string, mtime long")
    got = C.chunk_documents(docs, OPTIONS).collect()
    assert len(got) == 2 and len({r["id"] for r in got}) == 2 and len({r["hash"] for r in got}) == 1


def test_windows_overlap(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a b c d e f g", ""), ], "t string, e string").select(C.word_windows(F.col("t"), 3, 5).alias("w"), C.word_windows(F.col("e"), 3, 5).alias("n")).first()
    assert row["w"] == ["a b c d e", "d e f g", "g"] and row["n"] == []


def test_fingerprint_changes_with_options(spark):
    rows = spark.range(1).select(C.fingerprint(OPTIONS).alias("a"), C.fingerprint(C.ChunkOptions()).alias("b")).first()
    assert rows["a"] != rows["b"] and len(rows["a"]) == 64
