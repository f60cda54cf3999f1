"""The local service and its client, with retrieval faked."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from lanternfish.plans import config as settings
from lanternfish.service import client, server


@pytest.fixture
def live():
    state = {"ready": True, "asked": []}

    def retrieve(query, over):
        state["asked"].append((query, over))
        if "boom" in query:
            raise RuntimeError("broken")
        return "" if "empty" in query else f"about {query}"

    s = server.make_server("127.0.0.1", 0, lambda: state["ready"], retrieve)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield state, s.server_address[1]
    s.shutdown()


def ask(port, body, path="/retrieve"):
    data = body if isinstance(body, bytes) or body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", data)) as r:
        return json.load(r)


def test_service(live):
    state, port = live
    assert ask(port, None, "/health") == {"ok": True, "ready": True}
    assert ask(port, {"query": " a question ", "topK": 3, "other": 1}) == {"additionalContext": "about a question", "injected": True}
    assert state["asked"] == [("a question", {"topK": 3})]
    assert ask(port, {"query": "boom"})["additionalContext"] == "" and ask(port, b"no json")["injected"] is False
    state["ready"] = False
    assert ask(port, {"query": "later"}) == {"additionalContext": "", "injected": False, "ready": False}
    for path, body, code in (("/nowhere", b"{}", 404), ("/retrieve", b"x" * (server.MAX_BODY + 5), 413)):
        with pytest.raises(urllib.error.HTTPError) as e:
            ask(port, body, path)
        assert e.value.code == code


def test_an_answer_of_an_older_generation_is_not_given():
    state = {"stamp": 1, "port": 1}
    runtime = server.Runtime(lambda: settings.make({"service": {"port": state["port"]}}), lambda c: c["service"]["port"], lambda: state["stamp"])
    runtime.DEBOUNCE = 0
    assert (runtime.generation, runtime.state) == (1, 1) and runtime.refresh() == 1

    def retrieve(query, over):
        if query == "slow":
            state.update(stamp=state["stamp"] + 1, port=2)
        return {"additionalContext": "c", "selected": [{"id": "x"}], "stages": [{"stage": "assemble"}]}

    logged = []
    ask_ = lambda q: server.answer(json.dumps({"query": q}).encode(), lambda: True, retrieve, logged.append, runtime.refresh)[1]
    assert ask_("quick") == {"additionalContext": "c", "selected": [{"id": "x"}], "injected": True}
    assert logged[0]["stages"] == [{"stage": "assemble"}] and logged[0]["selected"] == [{"id": "x"}]
    assert ask_("slow") == {"additionalContext": "", "injected": False} and runtime.state == 2 and len(logged) == 1
    state.update(stamp=9, port=-4)
    assert runtime.refresh() == 2 and runtime.config["service"]["port"] == 2  # broken settings change nothing
    assert server.answer(b'{"query": "q"}', lambda: True, retrieve, lambda r: (_ for _ in ()).throw(OSError("full")))[1]["injected"]


def test_recall_asks_the_service_first(live):
    from lanternfish import cli

    config = settings.make({"service": {"port": live[1]}})
    asked = []

    def fetch(url, body, timeout):
        asked.append((url, json.loads(body)))
        return {"selected": [{"source": "a.md", "date": "2026-01-01", "text": "t", "cosine": 0.5, "bm25": None}]}

    items = cli.recall(config, "q", lambda: 1 / 0, fetch)
    assert cli.recall_block(items[0]) == "a.md · 2026-01-01 · cosine=0.5\nt"
    assert asked[0][0].endswith("/retrieve") and asked[0][1] == {"query": "q", "topK": 5, "bm25TopK": 10, "maxTotalTokens": 1500}
    for broken in (lambda *_: {"ready": False}, lambda *_: (_ for _ in ()).throw(TimeoutError())):
        assert cli.recall(config, "q", lambda: ["direct"], broken) == ["direct"]


def test_client_entry(live, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)  # without a settings file the log lies below the working folder
    import io
    import os
    import stat

    settings.save(settings.make({"dataDir": str(tmp_path / "data"), "service": {"port": live[1]}}), str(tmp_path / "c.json"))
    for argv, raw in (([], '{"prompt": "where is the harbour"}'), (["where", "is", "it", "now"], "ignored"), ([], "heartbeat check of all")):
        out = io.StringIO()
        assert client.main(["--config", str(tmp_path / "c.json"), *argv], io.StringIO(raw), out) == 0
        assert ("harbour" in out.getvalue()) == ("harbour" in raw) and (not out.getvalue()) == raw.startswith("heart")
    path = str(tmp_path / "data" / "logs" / "retrieval.jsonl")
    lines = [json.loads(x) for x in open(path)]
    assert [r["outcome"] for r in lines] == ["delivered"] * 2 and all(len(r["query_hash"]) == 64 and "query" not in r for r in lines)
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
    assert client.main(["--config", "/nowhere/x/c.json"], io.StringIO("a question to nobody"), io.StringIO()) == 0


def test_client(live):
    _, port = live
    config = settings.make({"service": {"port": port}})
    out, log = [], []
    assert client.run('{"prompt": "[chat] ann said: where is the harbour"}', config, out.append, log.append)
    assert json.loads(out[0])["hookSpecificOutput"]["additionalContext"] == "about where is the harbour"
    assert not client.run("an empty answer please", config, out.append, log.append)
    assert not client.run("ok", config, out.append, log.append) and not client.run("heartbeat check now please", config, out.append, log.append)

    def late(*_):
        raise TimeoutError

    assert not client.run("what about the harbour", config, out.append, log.append, late)
    assert not client.run("what about the harbour", config, out.append, log.append, lambda *_: 1 / 0)
    assert [r["outcome"] for r in log] == ["delivered", "empty", "timeout", "error"]


def test_normalize_equals_the_column(spark):
    from lanternfish.functions import text as X
    from pyspark.sql import functions as F

    texts = ["<current-message>\n hi \n</current-message> tail", "[chat 1] ann said: hello", "ask\n---- reply via: node x\nmore", "<replying-to>a\nb</replying-to> q", " \ufeffplain\u3000", "", "<CURRENT-MESSAGE>x</CURRENT-MESSAGE>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalize_prompt(F.col("t")).alias("n"), X.redact(F.col("t")).alias("r")).collect()
    from lanternfish.operators import audit

    assert all(client.normalize(r["t"]) == r["n"] and audit.redacted(r["t"]) == r["r"] for r in rows)


@pytest.mark.parametrize(("raw", "want"), [('{"prompt":"","message":" m "}', "m"), (" raw ", "raw"), ("[1]", ""), ("", "")])
def test_extract(raw, want):
    assert client.extract(raw) == want
