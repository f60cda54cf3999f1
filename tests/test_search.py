"""Full-text and dense search against SQLite's FTS5 and against brute force."""

import random
import sqlite3
import unicodedata

import numpy as np
import pytest

from lanternfish.operators import dense, embed, fulltext, stages, textscan
from lanternfish.sources import tables

WORDS = ["alpha", "beta", "gamma", "Café", "naïve", "foo_bar", "x", "delta", "memo", "ZETA", "纯中文"]


def corpus(rng, n=60):
    return [(f"c{i:03d}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))), f"notes/{rng.choice(WORDS)}-{i}.md", rng.choice(WORDS), i) for i in range(n)]


def test_bm25_equals_fts5(spark):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(id unindexed, text, source, section, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    rows = corpus(random.Random(3))
    db.executemany("insert into f values (?, ?, ?, ?)", [r[:4] for r in rows])
    queries = ["alpha", "cafe beta", "foo_bar gamma", "ZETA zeta Zeta", "nothing here", "纯中文 x", '"unbalanced alpha', "alpha NEAR beta*", "café cafe", "ｇａｍｍａ ﬁx"]
    chunks = spark.createDataFrame(rows, "id string, text string, source string, section string, mtime long")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {(r["query_id"], r["id"]): r["bm25_score"] for r in fulltext.bm25(asked, fulltext.TextIndex(fulltext.occurrences(chunks))).collect()}
    want = {}
    for i, q in enumerate(queries):
        seen = {}
        for t in __import__("regex").findall(r"[\p{L}\p{N}_]+", unicodedata.normalize("NFKC", q)):
            seen.setdefault(t.lower(), t)
        match = " OR ".join(f'"{t}"' for t in seen.values())
        for ident, score in db.execute("select id, -bm25(f) from f where f match ?", (match,)):
            want[i, ident] = score
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    top = fulltext.search_text(asked, fulltext.TextIndex(fulltext.occurrences(chunks)), 3).collect()
    assert max(r["bm25_rank"] for r in top) == 3


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors, asked = rng.normal(size=(500, 8)), rng.normal(size=(7, 8))
    vectors[10:20] = vectors[0]  # ties go by id
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id long, vector array<double>")
    got = {}
    for r in dense.nearest(q, v, 12).collect():
        got.setdefault(r["query_id"], []).append((r["dense_rank"], r["id"]))
    for i, x in enumerate(asked):
        d = np.round(np.sqrt(((vectors - x) ** 2).sum(axis=1)), 9)
        assert [k for _, k in sorted(got[i])] == np.lexsort((np.arange(500), d))[:12].tolist()


def test_nearest_in_blocks_and_empty(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "id long, vector array<double>")
    q = spark.createDataFrame([(i, [i + 0.1]) for i in range(9)], "query_id long, vector array<double>")
    monkeypatch.setattr(dense, "SCAN_BYTES", 32)
    assert {(r["query_id"], r["id"]) for r in dense.nearest(q, v, 1).collect()} == {(i, i) for i in range(9)}
    assert dense.nearest(q.limit(0), v, 3).collect() == []
    assert dense.nearest(q, v.limit(0), 3).collect() == []
    with pytest.raises(Exception, match="dimensions"):
        dense.nearest(q, spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>"), 1).collect()


def test_hashing_embedder(spark):
    e = embed.HashingEmbedder(16)
    rows = embed.with_vectors(spark.createDataFrame([("a b",), (None,), ("A  b",)], "text string"), e, "passage").collect()
    assert rows[0]["vector"] == rows[2]["vector"] and sum(rows[1]["vector"]) == 0
    assert abs(sum(x * x for x in rows[0]["vector"]) - 1) < 1e-5
    with pytest.raises(ValueError, match="mode"):
        e.embed(["a"], "other")


def test_scan_equals_postings(spark, monkeypatch):
    """Chunks without an index are scanned: the same scores, ranks and phrases as by stored postings, whatever the blocks."""
    rng = random.Random(8)
    rows = corpus(rng, 90) + [("twin", "alpha x", "a", "b", 5), ("twin", "x gamma", "a", "b", 7), ("late", None, None, None, 9), ("untimed", "alpha x", "alpha", "", None)]
    rows += [(f"same{i}", "memo delta", "s", "t", i % 3) for i in range(40)]
    chunks = spark.createDataFrame(rows, "id string, text string, source string, section string, mtime long").repartition(3)
    queries = ["alpha", "cafe beta", "foo_bar gamma foo", "nothing here", "纯中文 x_alpha", "alpha ZETA memo delta", "", None, "x_x_x foo_bar_x", "memo_delta memo"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    scan, stored = fulltext.scan(chunks), fulltext.TextIndex(fulltext.occurrences(chunks))
    want = {k: sorted(map(tuple, fulltext.search_text(asked, stored, k).collect())) for k in (1, 7, 200)}
    phrases = fulltext.query_phrases(asked)
    counts = sorted(map(tuple, fulltext.phrase_counts(phrases, stored).collect()))
    for piece, tile, some in ((1 << 24, 1 << 21, 500_000), (64, 1, 2)):
        monkeypatch.setattr(textscan, "PIECE", piece)
        monkeypatch.setattr(textscan, "TILE", tile)
        monkeypatch.setattr(textscan, "SCAN_PHRASES", some)
        assert {k: sorted(map(tuple, fulltext.search_text(asked, scan, k).collect())) for k in want} == want
        assert sorted(map(tuple, fulltext.phrase_counts(phrases, scan).collect())) == counts
    assert fulltext.search_text(asked.limit(0), scan, 3).collect() == [] == fulltext.search_text(asked, fulltext.scan(chunks.limit(0)), 3).collect()
    assert fulltext.phrase_counts(phrases.limit(0), scan).collect() == []


def test_scan_keeps_a_row_for_each_chunk(spark, monkeypatch):
    """What a search without an index stores does not grow with the occurrences of its terms."""
    kept = []
    for module in (fulltext, textscan):
        monkeypatch.setattr(module, "settled", lambda df, f=module.settled: kept.append(f(df)) or kept[-1])
    docs = spark.createDataFrame([(i, "the the of the " * 50, "s") for i in range(30)], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(1, "the of"), (2, "of the")], "query_id int, query string")
    chunks = tables.document_chunks(docs)
    assert stages.Context({"retrieval": {"bm25TopK": 3}}, asked, chunks, chunks, 0).index is None
    found = stages.bm25_retrieve(stages.Context({"retrieval": {"bm25TopK": 3}}, asked, chunks, chunks, 0)).lists["bm25"]
    assert found.count() == 6 and max(df.count() for df in kept) <= 30
