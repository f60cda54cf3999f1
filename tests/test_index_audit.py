"""Corpus trees, index versions, freshness, evaluation, logs and settings."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lanternfish.operators import audit, embed, evaluation, index
from lanternfish.plans import config as settings
from lanternfish.sources.corpus import corpus_changes, read_corpus
from lanternfish.streaming import freshness


def write(root, name, text, mtime=1_700_000_000):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (mtime, mtime))
    return path


def conf(*roots, **corpus):
    return settings.make({"corpus": {"roots": [str(r) for r in roots], "allow": ["**/*.md"], **corpus}, "chunking": {"minTokens": 2, "targetTokens": 20, "maxTokens": 30}})


def test_corpus_policy(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("a.md", "sub/.hid/b.MARKDOWN", "sub/c.txt", "sub/my-token.md", "node_modules/d.md", "secret-things/e.md", "sub/big.md"):
        write(root, name, "x" * (400 if "big" in name else 5))
    (root / "link.md").symlink_to(root / "a.md")
    files = read_corpus(spark, conf(root, tmp_path / "none", allow=["**/*"], maxFileBytes=100))
    got = {r["source"]: r["text"] for r in files.collect()}
    assert got == {"a.md": "xxxxx", "sub/.hid/b.MARKDOWN": "xxxxx"}
    listed = read_corpus(spark, conf(root, allow=["**/*"]), content=False).collect()
    assert {r["text"] for r in listed} == {None} and any(r["source"] == "sub/big.md" for r in listed)


def test_last_root_wins(spark, tmp_path):
    write(tmp_path / "one", "a.md", "first")
    write(tmp_path / "two", "a.md", "second")
    assert [r["text"] for r in read_corpus(spark, conf(tmp_path / "one", tmp_path / "two")).collect()] == ["second"]
    assert read_corpus(spark, conf(tmp_path / "nowhere")).collect() == []


def test_index_is_incremental(spark, tmp_path):
    root = tmp_path / "corpus"
    write(root, "a.md", "# A\nalpha beta gamma delta\n# B\none two three four")
    write(root, "b.md", "# C\nfive six seven eight")
    store, e, c = index.IndexStore(spark, str(tmp_path / "index")), embed.HashingEmbedder(8), conf(root)
    assert store.manifest() is None and not store.backfill()
    assert freshness.build_index(spark, c, store, e, 1_000) == {"inserted": 3, "updated": 0, "unchanged": 0, "removed": 0, "total": 3, "files": 2}
    assert freshness.build_index(spark, c, store, e, 2_000) == {"reused": True}
    write(root, "a.md", "# A\nalpha beta gamma CHANGED\n# B\none two three four", 1_700_000_999)
    (root / "b.md").unlink()
    assert freshness.build_index(spark, c, store, e, 3_000) == {"inserted": 0, "updated": 1, "unchanged": 1, "removed": 1, "total": 2, "files": 1}
    chunks = {r["section"]: r for r in store.table("chunks").collect()}
    assert chunks["B"]["created_at"] == 1_000 and chunks["B"]["updated_at"] == 3_000
    assert store.table("vectors").count() == 2 and store.counts()["indexed"] == 2
    other = embed.HashingEmbedder(16)
    assert freshness.build_index(spark, c, store, other, 4_000)["inserted"] == 2
    assert {len(r["vector"]) for r in store.table("vectors").collect()} == {16}
    assert not store.backfill()


def test_sweep_stream_refreshes_once_per_batch(spark, tmp_path):
    reports, calls = [], []
    q = freshness.sweep_stream(spark, lambda: calls.append(1) or {"reused": True}, 200, str(tmp_path / "cp"), reports)
    try:
        until = time.time() + 60
        while len(calls) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        q.stop()
    assert len(calls) >= 2 and reports[0][1] == {"reused": True}


def test_debounce_closes_bursts(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00.5"), (1, "2024-01-01 00:00:03"), (2, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "k int, t string").select("k", F.to_timestamp("t").alias("ts"))
    assert sorted((r["k"], r["n"]) for r in freshness.debounced(events, "k").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_signature_sees_every_change(spark):
    def sign(*rows):
        return index.corpus_signature(spark.createDataFrame(list(rows), "source string, mtime long, size long")).first()["signature"]

    a, b = ("a.md", 1, 2), ("b.md", 3, 4)
    assert sign(a, b) == sign(b, a)
    assert len({sign(a, b), sign(a), sign(("a.md", 2, 2), b), sign(("a.md", 1, 3), b)}) == 4


def judged(spark):
    cases = spark.createDataFrame([("hit",), ("quiet",), ("loud",)], "case_id string")
    row = lambda case, source, score: (case, source, score, source, source, 0, 5, "2026-01-01", "memory", None)
    pools = spark.createDataFrame([row("hit", "a", 0.9), row("hit", "b", 0.8), row("hit", "c", 0.7), row("quiet", "a", 0.2), row("loud", "b", 0.9)], "case_id string, source string, score double, id string, hash string, mtime long, token_count int, date string, type string, bm25_rank int")
    grades = spark.createDataFrame([("hit", "b", 3), ("hit", "z", 1)], "case_id string, source string, grade int")
    forbidden = spark.createDataFrame([("loud", "b")], "case_id string, source string")
    return cases, pools, grades, forbidden


def test_evaluation(spark):
    import math

    retrieval = settings.make()["retrieval"] | {"threshold": 0.5, "recencyWeight": 0.0}
    got = {r["case_id"]: r for r in evaluation.evaluate(*judged(spark), retrieval, 0).collect()}
    hit = got["hit"]
    assert hit["precision_at_k"] == pytest.approx(1 / 5) and hit["recall_at_k"] == 0.5 and hit["mrr"] == 0.5
    assert hit["ndcg_at_k"] == pytest.approx((7 / math.log2(3)) / (7 + 1 / math.log2(3)))
    assert hit["injected_precision"] == pytest.approx(1 / 3) and hit["injected_recall"] == 0.5
    assert got["quiet"]["quiet"] and not got["loud"]["quiet"] and got["loud"]["forbid_violations"] == 1
    summary = evaluation.summarize(evaluation.evaluate(*judged(spark), retrieval, 0))
    row = summary.first()
    assert row["quiet_accuracy"] == 0.5 and row["injected_f1"] == pytest.approx(0.4) and row["forbid_violations"] == 1
    assert not evaluation.passes(summary, {}).first()["passes"]
    assert evaluation.passes(summary, {"max_forbid_violations": 1}).first()["passes"]


def test_sweep_prefers_fewer_forbidden(spark):
    rows = evaluation.sweep(*judged(spark), settings.make()["retrieval"], 0, [0.1, 0.95], [0.0], [3, 5]).orderBy("place").collect()
    assert len(rows) == 4 and rows[0]["threshold"] == 0.95 and rows[0]["forbid_violations"] == 0
    assert evaluation.sweep_values("0.30:0.45:0.05") == [0.3, 0.35, 0.4, 0.45] and evaluation.sweep_values("1|3") == [1.0, 3.0]
    with pytest.raises(ValueError, match="step"):
        evaluation.sweep_values("0:1:0")


def test_toc(spark):
    rows = [("session", "s.md", "B", "2026-01-01", 1, 1), ("session", "s.md", "A", "2026-02-01", 2, 2), ("session", "s.md", "B", "2025-01-01", 3, 3), ("doc", "d.md", None, "2026-01-01", 1, 4)]
    chunks = spark.createDataFrame(rows, "type string, source string, section string, date string, mtime long, ord int")
    got = {r["type"]: r for r in audit.toc(chunks).collect()}
    assert (got["session"]["date"], got["session"]["n_chunks"], got["session"]["sections"]) == ("2026-02-01", 3, ["B", "A"])
    assert got["doc"]["sections"] == [] and audit.toc(chunks, "doc").count() == 1
    lines = {(r["type"], r["source"]): r["line"] for r in audit.toc_lines(audit.toc(chunks), full=True).collect()}
    assert lines["session", "s.md"] == "- s.md · 2026-02-01 · 3 chunks\n  - B\n  - A" and set(lines) == {("session", "s.md"), ("doc", "d.md")}


def test_transcripts(spark, tmp_path):
    records = [
        {"type": "attachment", "attachment": {"type": "hook_additional_context", "content": "<retrieved-memory> early"}},
        {"type": "user", "message": {"content": "<current-message>first</current-message>"}},
        {"type": "attachment", "attachment": {"type": "hook_additional_context", "content": ["<retrieved-memory>", "[a.md · 2026-01-01] x"]}},
        {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "text": "no"}]}},
        {"type": "user", "message": {"content": [{"type": "text", "text": "second"}, {"type": "text", "text": "line"}]}},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join([json.dumps(r) for r in records[:3]] + ["broken {"] + [json.dumps(r) for r in records[3:]]))
    got = audit.turns(audit.transcript_lines(spark, str(tmp_path))).orderBy("turn_id").collect()
    assert [(r["prompt"], r["injection"]) for r in got] == [("first", "<retrieved-memory>\n[a.md · 2026-01-01] x"), ("second\nline", None)]


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("a secret: hunter2", "2026-01-01T00:00:00Z", "delivered", 5)], "query string, ts string, outcome string, duration_ms int")
    audit.append_log(audit.client_records(rows), str(tmp_path / "log"))
    audit.append_log(audit.client_records(rows), str(tmp_path / "log"))
    (tmp_path / "log" / "x.json").write_text("not json\n")
    assert audit.read_log(spark, str(tmp_path / "log")).count() == 2
    log = spark.createDataFrame([(None, "h1", None, 3), ("client", "h1", "empty", 4), ("service", "h2", None, 5)], "kind string, query_hash string, outcome string, duration_ms long")
    assert audit.log_summary(log).first().asDict() == {"records": 3, "service": 2, "client": 1}
    assert {(r["query_hash"], r["client_outcome"]) for r in audit.matched_log(log).collect()} == {("h1", "empty"), ("h2", None)}


def test_settings(tmp_path):
    with pytest.raises(settings.ConfigError, match="service.port.*|.*; .*"):
        settings.make({"service": {"port": 0}, "retrieval": {"topK": -1}})
    with pytest.raises(settings.ConfigError, match="keepK"):
        settings.make({"filter": {"provider": "rerank", "keepK": 9}})
    path = str(tmp_path / "c" / "config.json")
    settings.save(settings.set_value(settings.make(), "retrieval.topK", "7"), path)
    assert settings.load(path)["retrieval"]["topK"] == 7 and os.stat(path).st_mode & 0o777 == 0o600
    assert settings.load(str(tmp_path / "none.json")) == settings.DEFAULTS
    assert settings.clamped({"topK": 99.9, "bm25TopK": "x", "maxTotalTokens": -1}) == {"topK": 25, "bm25TopK": 15, "maxTotalTokens": 1}
    assert settings.clamped({"topK": 2.7, "bm25TopK": "x"}, defaults=False) == {"topK": 2}
    assert settings.is_sensitive("api_key") and settings.is_sensitive("authToken") and not settings.is_sensitive("maxTotalTokens")
    added = settings.edit_list(settings.make(), "deny", "add", "**/*.tmp")
    assert settings.edit_list(added, "deny", "add", "**/*.TMP") == added
    with pytest.raises(settings.ConfigError, match="default"):
        settings.edit_list(added, "deny", "remove", "**/.git/**")
    with pytest.raises(settings.ConfigError, match="cannot"):
        settings.set_value(settings.make(), "service.port", "1")


def test_changes_stream(spark, tmp_path):
    root, seen = tmp_path / "c", []
    write(root, "a.md", "one")
    write(root, "b.md", "two")
    stream = corpus_changes(spark, conf(root)).writeStream.foreachBatch(lambda df, n: seen.extend((r["source"], r["change"]) for r in df.collect()))
    q = stream.trigger(processingTime="200 milliseconds").option("checkpointLocation", str(tmp_path / "cp")).start()

    def until(rows):
        for _ in range(150):
            if all(r in seen for r in rows):
                return True
            time.sleep(0.2)
        return False

    try:
        assert until([("a.md", "added"), ("b.md", "added")]), (seen, q.exception())
        write(root, "a.md", "one more", 1_700_000_555)
        (root / "b.md").unlink()
        assert until([("a.md", "changed"), ("b.md", "removed")]), (seen, q.exception())
    finally:
        q.stop()
    assert len(seen) == 4


def test_log_and_session_are_rendered(spark, tmp_path):
    path = str(tmp_path / "logs" / "r.jsonl")
    stages_ = [{"stage": "bm25Retrieve", "fail_open": True, "reason": "gone"}, {"stage": "denseRetrieve", "count": 1, "candidates": [{"id": "x", "score": 0.5}]}, {"stage": "freeGates", "selected": 1, "drops": {"dup": 2}}, {"stage": "assemble", "injected": True, "bytes": 9}]
    audit.append_line(path, audit.service_line("my password: hunter2 here", True, 12, stages_, [{"rank": 1, "id": "x", "source": "a.md", "final_score": 0.7, "text": "never"}]))
    audit.append_line(path, audit.client_line("q", "delivered", 3))
    with open(path, "a") as f:
        f.write("{broken\n")
    log = audit.read_log(spark, path)
    rows = [json.loads(r["record"]) for r in audit.last_records(log, 5).select(F.to_json("record").alias("record")).collect()]
    text = audit.render_log(audit.log_summary(log).first().asDict(), rows)
    assert "# records: 2 total" in text and "# service/client: 1/1" in text and "hunter2" not in text and "never" not in text
    assert "selected(1): x:a.md@0.7" in text and "bm25Retrieve fail_open reason=gone" in text and "denseRetrieve count=1 candidates=x@0.5" in text and "drops=dup:2" in text and "outcome=delivered duration=3ms" in text
    shown = [{"line_no": 4, "prompt": "a  question", "injection": None}, {"line_no": 9, "prompt": "b", "injection": "[a.md · 2026-01-01] t"}]
    text = audit.render_session("s.jsonl", 7, 3, shown)
    assert "7 total, showing last 2" in text and "3/7 turns" in text and "YOU: a question" in text and "a.md (2026-01-01)" in text
    assert "   | [a.md" in audit.render_session("s.jsonl", 7, 3, shown, full=True)


def test_transcripts_are_found(tmp_path):
    import os

    for i, name in enumerate(("b.jsonl", "a.jsonl", "c.txt")):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (i, i))
    folder = str(tmp_path)
    assert audit.resolve_transcript(folder).endswith("a.jsonl") and audit.resolve_transcript(folder, "b").endswith("b.jsonl")
    assert audit.resolve_transcript("/x/y.jsonl") == "/x/y.jsonl" and audit.default_transcripts("/a/b", "/h") == "/h/.claude/projects/-a-b"
    with pytest.raises(FileNotFoundError):
        audit.resolve_transcript(folder, "zz")


def test_default_globs_refuse_secrets():
    from lanternfish.functions.globs import Policy
    from lanternfish.plans import config as settings

    c = settings.make()["corpus"]
    policy = Policy(c["allow"], c["deny"])
    for name in ("workspace/my-api-key/README.md", "memory/users/apikeys.md", "memory/users/private_key.md", "memory/reference/x.md.backup", "memory/archive/x.md", "workspace/CLAUDE.md.bak", "notes.md"):
        assert not policy.allows(name, f"/r/{name}")
    for name in ("memory/reference/a/b.md", "workspace/a/b/README.md", ".claude/skills/s/SKILL.md"):
        assert policy.allows(name, f"/r/{name}")


def test_refreshes_do_not_overlap():
    import threading

    from lanternfish.streaming import freshness

    running, seen, gate = [], [], threading.Event()

    def refresh():
        running.append(1)
        assert len(running) == 1
        gate.wait(5)
        running.pop()
        seen.append(1)
        return {"n": len(seen)}

    single = freshness.SingleFlight(refresh)
    first = threading.Thread(target=single)
    first.start()
    while not running:
        pass
    assert single() is None and single() is None  # remembered, once
    gate.set()
    first.join()
    assert len(seen) == 2


def test_changes_of_files_start_a_refresh(spark, tmp_path):
    import time

    from lanternfish.plans import config as settings
    from lanternfish.streaming import freshness

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.md").write_text("one")
    config = settings.make({"corpus": {"roots": [str(tmp_path / "c")], "allow": ["**/*.md"]}, "freshness": {"debounceMs": 200}})
    reports, n = [], []
    stream = freshness.watch_stream(spark, config, lambda: n.append(1) or {"n": len(n)}, str(tmp_path / "cp"), reports)
    try:
        stop = time.time() + 60
        while len(n) < 1 and time.time() < stop:
            time.sleep(0.2)
        (tmp_path / "c" / "b.md").write_text("two")
        while len(n) < 2 and time.time() < stop:
            time.sleep(0.2)
        assert len(n) >= 2 and stream.exception() is None
    finally:
        stream.stop()
