"""Stages on small lists of candidates."""

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import rerank, stages
from lanternfish.plans import config as settings

NOW = 1_780_963_200_000
BASE = settings.make()["retrieval"]
SCHEMA = "query_id int, pos int, id string, source string, section string, text string, hash string, mtime long, token_count int, date string, type string, score double, bm25_rank int, normalized_fused double"


def candidates(spark, rows):
    out = []
    for i, r in enumerate(rows):
        d = {"query_id": 1, "pos": i + 1, "source": f"memory/{r['id']}.md", "section": r["id"], "text": f"{r['id']} text", "hash": f"{r['id']}-hash", "mtime": NOW + i * 1000, "token_count": 6, "date": "2026-06-09", "type": "memory", "score": None, "bm25_rank": None, "normalized_fused": None} | r
        out.append(tuple(d[c.split()[0]] for c in SCHEMA.split(", ")))
    return stages.complete(spark.createDataFrame(out, SCHEMA))


def gated(spark, rows, over=None, live=None):
    return {r["id"]: r for r in stages.gate(candidates(spark, rows), BASE | {"recencyWeight": 0.0} | (over or {}), NOW + 10_000, live).collect()}


def test_gates_and_budget(spark):
    got = gated(spark, [{"id": "a", "score": 0.9}, {"id": "low", "score": 0.4}, {"id": "twin", "score": 0.8, "hash": "a-hash"}, {"id": "b", "score": 0.7}], {"threshold": 0.5, "maxTotalTokens": 12, "chunkTokens": 6})
    assert {k: r["drop_reason"] for k, r in got.items()} == {"a": None, "low": "belowThreshold", "twin": "dup", "b": None}
    assert (got["a"]["rank"], got["b"]["rank"]) == (1, 2)


def test_budget_passes_over_what_does_not_fit(spark):
    got = gated(spark, [{"id": "a", "score": 0.9}, {"id": "big", "score": 0.8, "token_count": 50}, {"id": "c", "score": 0.7}], {"maxTotalTokens": 12, "chunkTokens": 10})
    assert [got[k]["drop_reason"] for k in ("a", "big", "c")] == [None, "budget", None]
    first = gated(spark, [{"id": "huge", "score": 0.9, "token_count": 99}], {"maxTotalTokens": 5, "chunkTokens": 50})
    assert first["huge"]["drop_reason"] is None


def test_keywords_alone(spark):
    got = gated(spark, [{"id": "near", "bm25_rank": 2, "normalized_fused": 0.6}, {"id": "far", "bm25_rank": 3, "normalized_fused": 0.5}, {"id": "none"}])
    assert [got[k]["drop_reason"] for k in ("near", "far", "none")] == [None, "bm25WeakNoDense", "bm25WeakNoDense"]


def test_stale_files(spark):
    live = spark.createDataFrame([("memory/old.md", NOW + 99_999, 0), ("memory/ok.md", NOW, 0), ("memory/ok.md", NOW + 99_999, 1)], "source string, mtime_ms long, root_ord int")
    got = gated(spark, [{"id": "ok", "score": 0.9}, {"id": "old", "score": 0.9}, {"id": "gone", "score": 0.9}], live=live)
    assert [got[k]["drop_reason"] for k in ("ok", "old", "gone")] == [None, "stale", "stale"]


def test_a_duplicate_of_a_dropped_candidate_stays(spark):
    got = gated(spark, [{"id": "low", "score": 0.1, "hash": "h"}, {"id": "same", "score": 0.9, "hash": "h"}])
    assert got["same"]["drop_reason"] is None


def test_tiers_lower_the_score(spark):
    got = gated(spark, [{"id": "s", "score": 0.9, "type": "session"}, {"id": "m", "score": 0.88}, {"id": "w", "score": 0.84}])
    assert got["s"]["final_score"] == pytest.approx(0.85)
    assert [got[k]["rank"] for k in ("m", "s", "w")] == [1, 2, 3]


def test_fusion(spark):
    d = candidates(spark, [{"id": "dense-only", "score": 0.9}, {"id": "both", "score": 0.8}]).withColumn("dense_rank", F.col("pos"))
    b = candidates(spark, [{"id": "both", "bm25_rank": 1}, {"id": "bm25-only", "bm25_rank": 2}]).withColumn("bm25_score", F.lit(3.0))
    got = {r["id"]: r for r in stages.fuse({"dense": d, "bm25": b}, 60).collect()}
    assert round(got["both"]["fused_score"], 6) == 0.032522 and got["both"]["pos"] == 1
    assert got["both"]["score"] == 0.8 and got["both"]["bm25_rank"] == 1
    alone = stages.fuse({"dense": d}, 60).collect()
    assert max(r["normalized_fused"] for r in alone) == pytest.approx(1.0)


def context(spark, over=None, scorer=None):
    chunks = candidates(spark, [{"id": "a", "text": "alpha beta"}, {"id": "b", "text": "gamma"}, {"id": "c", "text": "delta"}]).select("id", "text", "source", "section", "hash", "mtime", "token_count", "date", "type")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "id string, vector array<double>")
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0]), (2, "  ", [0.0, 1.0]), (3, "nothing", [0.0, -9.0])], "query_id int, query string, vector array<double>")
    return stages.Context(settings.make(over), queries, chunks, vectors, NOW, scorer=scorer)


def test_whole_pipeline(spark):
    ctx = stages.run_pipeline(context(spark))
    got = {r["query_id"]: r["additional_context"] for r in ctx.assembled.collect()}
    assert got.keys() == {1, 3}  # a blank query asks nothing
    lines = got[1].split("\n")
    assert lines[0] == stages.OPENING and lines[-1] == stages.CLOSING and lines[1] == "[memory/a.md · 2026-06-09] alpha beta"
    assert got[3] == ""
    assert [name for name, _ in ctx.log] == ["denseRetrieve", "bm25Retrieve", "rrfFuse", "freeGates", "assemble"]
    assert not any("text" in str(rows.schema) for _, rows in ctx.log)
    assert [r["query_id"] for r in stages.hook_payload(ctx.assembled).collect()] == [1]


def test_unknown_stage(spark):
    with pytest.raises(ValueError, match="nope"):
        stages.run_pipeline(context(spark, {"retrieval": {"pipeline": ["nope"]}}))


def test_rerank(spark):
    over = {"filter": {"provider": "rerank", "keepK": 1, "threshold": 0.2}, "retrieval": {"pipeline": ["denseRetrieve", "rerankFilter", "freeGates", "assemble"]}}
    ctx = stages.run_pipeline(context(spark, over, rerank.overlap_scorer))
    assert [(r["query_id"], r["id"]) for r in ctx.candidates.collect()] == [(1, "a")]
    off = stages.run_pipeline(context(spark, {"retrieval": {"pipeline": ["denseRetrieve", "rerankFilter", "freeGates", "assemble"]}}))
    assert off.candidates.count() == 6


def test_model_scorer(spark):
    score = rerank.model_scorer(lambda q, p: [0.0 for _ in q])
    rows = score(spark.createDataFrame([("q", "p")], "query string, passage string")).collect()
    assert rows[0]["rerank_score"] == 0.5


def test_failing_search_and_reranker_leave_a_note(spark):
    rows = candidates(spark, [{"id": "a", "score": 0.9}, {"id": "b", "score": 0.8}])
    queries = spark.createDataFrame([(1, "a text")], "query_id int, query string")
    config = settings.make({"filter": {"provider": "rerank"}})

    def broken(rows):
        return rows.withColumn("rerank_score", F.raise_error(F.lit("no model")).cast("double"))

    def shapeless(rows):
        return rows.withColumn("rerank_score", F.lit(float("nan")))

    for scorer, reason in ((None, "reranker_unavailable"), (broken, "no model"), (shapeless, "invalid scores")):
        ctx = stages.rerank_filter(stages.Context(config, queries, rows, rows, NOW, candidates=rows, scorer=scorer, fail_open=True))
        assert {r["id"] for r in ctx.candidates.collect()} == {"a", "b"}
        note = ctx.log[-1][1].first()
        assert note["fail_open"] and reason in note["reason"]
    with pytest.raises(Exception, match="no model"):
        stages.rerank_filter(stages.Context(config, queries, rows, rows, NOW, candidates=rows, scorer=broken)).candidates.collect()
    from lanternfish.operators.fulltext import TextIndex

    lost = TextIndex(rows.select(F.raise_error(F.lit("postings are gone")).cast("string").alias("term"), "id", F.lit("text").alias("col"), F.lit(0).alias("pos"), F.lit(1).cast("bigint").alias("n_tokens"), "mtime"))
    ctx = stages.bm25_retrieve(stages.Context(config, queries, rows, rows, NOW, index=lost, fail_open=True, lists={"dense": rows.withColumn("dense_rank", F.col("pos"))}))
    assert set(ctx.lists) == {"dense"} and "postings are gone" in ctx.log[-1][1].first()["reason"]
