"""The command line from an empty folder to an answer."""

import json

from lanternfish import cli
from lanternfish.plans import config as settings


def test_verbs(spark, tmp_path, capsys):
    root = tmp_path / "corpus"
    root.mkdir()
    (root / "notes.md").write_text("# Harbour\nthe harbour opens at dawn and closes at dusk\n# Bread\nmix flour water and salt then wait")
    path, idx = str(tmp_path / "config.json"), str(tmp_path / "index")
    settings.save(settings.make({"dataDir": str(tmp_path / "data"), "service": {"port": 9}, "corpus": {"roots": [str(root)], "allow": ["**/*.md"]}, "chunking": {"minTokens": 3}, "embedder": {"dimension": 32}}), path)

    def run(*words):
        code = cli.main(["--config", path, "--index", idx, *words])
        return code, capsys.readouterr().out

    assert run("toc")[0] == 1
    assert json.loads(run("index")[1])["inserted"] == 2
    assert "Harbour" in run("query", "harbour", "dawn")[1]
    assert "flour" in run("retrieve", "flour water salt")[1]
    assert "notes.md" in run("recall", "harbour dusk", "--top-k", "1")[1]
    assert run("toc", "--full")[1].startswith("doc\n- notes.md")
    assert run("config", "set", "retrieval.topK", "3")[0] == 0 and run("config", "get", "retrieval.topK")[1].strip() == "3"
    golden = tmp_path / "golden.json"
    golden.write_text(json.dumps([{"id": "g", "query": "flour water salt", "expect": [{"source": "corpus/notes.md", "grade": 2}], "forbid": []}]))
    row = json.loads(run("--format", "json", "eval", str(golden))[1])
    assert row["mrr"] == 1.0 and row["should_hit"]
    code, out = run("eval", str(golden))
    assert code == 0 and out.splitlines()[0].startswith("g\thit\t0.200\t1.000\t1.000\t1.000") and "passes=True" in out
    floors = tmp_path / "baseline.json"
    floors.write_text(json.dumps({"meanNdcgAtK": 0.9, "injectedF1": 0.5}))
    assert run("eval", str(golden), "--baseline", str(floors))[0] == 0
    floors.write_text(json.dumps({"meanNdcgAtK": 1.1}))
    assert run("eval", str(golden), "--baseline", str(floors))[0] == 1
    assert "# records: 0 total" in run("inspect", "--log")[1]
    assert len(run("eval", str(golden), "--sweep", "threshold=0.1|0.9,topK=3")[1].splitlines()) == 2
