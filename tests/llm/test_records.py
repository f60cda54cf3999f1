"""The fixity audit and preference pairs by plain loops."""

import gzip
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanternfish.llm import fixity, preferences

PAGES = "page_id long, url string, html string, record string"


def pages(n):
    return [(i, f"http://h/{i}", "é" * (i % 7) + f"<p>{i}</p>", "x") for i in range(n)] + [(None, None, None, None), (3, "http://h/3", "again", "y"), (3, "http://h/3", "again", "y")]


def stored(spark, tmp_path, n, per_file):
    index = fixity.write_archive(spark.createDataFrame(pages(n), PAGES), f"{tmp_path}/a", per_file).cache()
    return index, index.collect()


def files(folder):
    return {int(f.name[:8]): f.read_bytes() for f in sorted(folder.iterdir())}


def test_archive_is_gzipped_warc(spark, tmp_path):
    _, rows = stored(spark, tmp_path, 60, 20)
    assert len(rows) == 63
    by_file = {}
    for r in rows:
        by_file.setdefault(r["file_no"], []).append(r)
    held = files(tmp_path / "a")
    assert set(held) == set(by_file)
    seen = []
    for no, own in by_file.items():
        whole = gzip.decompress(held[no])
        at = stored_at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["ordinal"])):
            assert (r["ordinal"], r["record_offset"], r["member_offset"]) == (k, at, stored_at)
            record = gzip.decompress(held[no][stored_at : stored_at + r["member_bytes"]])
            assert record == whole[at : at + r["record_bytes"]] and hashlib.sha256(record).hexdigest() == r["record_sha256"]
            head, body = record.decode().split("\r\n\r\n", 1)
            version, *lines = head.split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            assert version == "WARC/1.1" and fields["WARC-Type"] == "resource" and uuid.UUID(fields["WARC-Record-ID"][10:-1])
            assert fields["WARC-Date"].endswith("Z") and int(fields["Content-Length"]) == len(body[:-4].encode()) and body.endswith("\r\n\r\n")
            seen.append((r["page_id"], fields["WARC-Target-URI"], body[:-4]))
            at, stored_at = at + r["record_bytes"], stored_at + r["member_bytes"]
        assert at == len(whole) and stored_at == len(held[no])
    assert sorted(seen, key=str) == sorted([(i, u or "about:blank", h or "") for i, u, h, _ in pages(60)], key=str)


@pytest.mark.parametrize(("n", "per_file"), [(5, 100), (300, 7), (400, 80)])
def test_audit_finds_exactly_the_damage(spark, tmp_path, n, per_file):
    index, rows = stored(spark, tmp_path, n, per_file)
    own = {}
    for r in rows:
        own[r["file_no"]] = max(own.get(r["file_no"], 0), r["ordinal"] + 1)
    last = F.col("ordinal") == F.max("ordinal").over(Window.partitionBy("file_no"))
    marked = index.withColumn("last", last)
    cut = F.col("last") & (F.col("file_no") % 3 == 1)
    fixity.copy_archive(marked, f"{tmp_path}/a", f"{tmp_path}/b", F.col("page_id") % 50 == 4, cut, F.col("last") & (F.col("file_no") % 3 == 2))
    fixity.copy_archive(index, f"{tmp_path}/a", f"{tmp_path}/same")
    assert files(tmp_path / "same") == files(tmp_path / "a") != files(tmp_path / "b")
    a, b, same = (fixity.leaf_hashes(fixity.read_archive(index, f"{tmp_path}/{f}"), "digest") for f in ("a", "b", "same"))
    want = {(r["file_no"], r["ordinal"]): "changed" for r in rows if r["page_id"] is not None and r["page_id"] % 50 == 4}
    want |= {(f, k - 1): "missing" for f, k in own.items() if f % 3 == 1} | {(f, k): "extra" for f, k in own.items() if f % 3 == 2}
    found, _ = fixity.audit(a, b)
    got = {(r["file_no"], r["idx"]): r["status"] for r in found.collect()}
    assert {k: s for k, s in got.items() if s != "ok"} == want
    branches = {(f, i // fixity.FANOUT) for f, i in want}
    assert set(got) == {(r["file_no"], r["ordinal"]) for r in rows if (r["file_no"], r["ordinal"] // fixity.FANOUT) in branches} | set(want)
    swapped = {"missing": "extra", "extra": "missing"}
    assert {(r["file_no"], r["idx"]): r["status"] for r in fixity.audit(b, a)[0].collect()} == {k: swapped.get(s, s) for k, s in got.items()}
    clean, steps = fixity.audit(a, same)
    assert clean.where("status <> 'ok'").collect() == [] and sum(steps) == 1  # equal roots: nothing below them is compared


def test_audit_of_nothing(spark, tmp_path):
    index = fixity.write_archive(spark.createDataFrame([], PAGES), f"{tmp_path}/a")
    empty = fixity.leaf_hashes(fixity.read_archive(index, f"{tmp_path}/a"), "digest")
    assert index.collect() == [] and fixity.audit(empty, empty)[0].collect() == []


def test_audit_query_on_odd_tables(spark, tmp_path):
    odd = [(1, "http://h/\r\nX: y", "<p>" + "é" * 400_000, "u"), (None, None, None, "u"), (None, None, None, "u"), (1, "http://h/\r\nX: y", "", "u"), (13, "u", "p", "u")]
    for name, rows in (("odd", odd), ("none", [])):
        spark.createDataFrame(rows, "page_id long, url string, html string, record string").write.parquet(f"{tmp_path}/{name}/pages.parquet")
        got = fixity.op5_query(spark, f"{tmp_path}/{name}").collect()
        assert len([r for r in got if r["status"] != "extra"]) == len(rows) and {r["page_id"] for r in got} == {i for i, *_ in rows}
        assert all(r["compared"] for r in got if r["status"] != "ok") and len({r["archive_root"] for r in got}) <= 1


def test_tree_hashes(spark):
    leaf = spark.createDataFrame([(0, 0, 0, 5, "aa"), (0, 1, 5, 9, "bb")], "file_no long, idx long, lo long, hi long, hash string")
    root = fixity.tree(leaf, 2, 1)[-1].collect()
    assert [r["hash"] for r in root] == [hashlib.sha256(b"0:9:0:aa,1:bb").hexdigest()]


def turns(*said):
    return [(r, t) for r, t in said]


def test_pairs(spark):
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "né")
    given = [(1, turns(u, a), turns(u, b)), (2, turns(u, a), turns(u, a)), (3, turns(u), turns(a)), (4, turns(u, a, u), turns(u)), (5, turns(), turns(b)), (6, turns(a, b, u), turns(a, u))]
    kind = "array<struct<role:string,text:string>>"
    rows = spark.createDataFrame([(i, x, y, "c") for i, x, y in given], f"pair_id int, chosen_turns {kind}, rejected_turns {kind}, `my col` string")
    got = {r["pair_id"]: r for r in preferences.format_pairs(rows).collect()}

    def text(said):
        return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in said)

    for i, x, y in given:
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        r = got[i]
        assert (r["n_prefix_turns"], r["prompt"], r["chosen"], r["rejected"], r["my col"]) == (k, text(x[:k]), text(x[k:]), text(y[k:]), "c")
        for side, said in (("chosen", x[k:]), ("rejected", y[k:])):
            spans = [tuple(map(int, s.split("-"))) for s in r[f"{side}_mask"].split(",") if s]
            assert [r[side][p:q] for p, q in spans] == [t + "<|im_end|>" for role, t in said if role == "assistant"]
    assert [got[i]["status"] for i in (1, 2, 3)] == ["pair", "same", "apart"]


def test_pairs_of_nothing_and_clashing_names(spark):
    kind = "array<struct<role:string,text:string>>"
    long = turns(("user", "x" * 300_000))
    rows = [(1, None, None, "p", 7, "s"), (2, long, None, "p", 7, "s"), (2, long, None, "p", 7, "s")]
    got = preferences.format_pairs(spark.createDataFrame(rows, f"pair_id int, chosen_turns {kind}, rejected_turns {kind}, prompt string, `a.b` int, status string"))
    assert got.columns == ["pair_id", "a.b", "n_prefix_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask", "status"]
    got = sorted(got.collect(), key=lambda r: r["pair_id"])
    assert (got[0]["status"], got[0]["prompt"], got[0]["a.b"]) == ("same", "", 7) and got[1] == got[2] and len(got[1]["chosen"]) > 300_000
    alone = preferences.format_pairs(spark.createDataFrame(rows, f"pair_id int, chosen_turns {kind}, rejected_turns {kind}, c1 string, c2 int, c3 string").select("chosen_turns", "rejected_turns"))
    assert alone.count() == 3


def test_conversations_and_neighbours(spark):
    said = [(1, 1, "assistant", "r1"), (1, 0, "user", "q"), (1, 0, "user", "q"), (2, 0, None, None), (2, 1, "assistant", "r2"), (3, 0, "user", "alone"), (2_000_000, 0, "assistant", "far")]
    turns_ = preferences.conversations(spark.createDataFrame([(*s, "z") for s in said], "conv_id long, turn long, role string, text string, turns string"))
    rows = {r["conv_id"]: r for r in preferences.with_borrowed_reply(turns_).collect()}
    assert [tuple(t) for t in rows[1]["chosen_turns"]] == [("user", "q"), ("user", "q"), ("assistant", "r1")]
    assert rows[1]["rejected_turns"][-1]["text"] == "r2" and rows[2]["rejected_turns"] == rows[2]["chosen_turns"]  # its neighbour has no reply
    assert rows[3]["rejected_turns"] == rows[3]["chosen_turns"] and rows[2_000_000]["rejected_turns"][0]["text"] == "r1"
    assert rows[2]["chosen_turns"][0]["role"] == "user" and rows[2]["chosen_turns"][0]["text"] == ""
    assert preferences.format_pairs(preferences.with_borrowed_reply(turns_.limit(0))).collect() == []
    named = preferences.conversations(spark.createDataFrame([(f"c{i * 999}" if i % 4 else None, 0, "assistant", f"r{i}") for i in range(40)], "conv_id string, turn long, role string, text string"))
    for rings in (1, 3):
        rows = preferences.with_borrowed_reply(named, rings=rings).collect()
        assert len(rows) == 40 and sorted(r["rejected_turns"][0]["text"] for r in rows) == sorted(f"r{i}" for i in range(40))
        assert sum(r["rejected_turns"] == r["chosen_turns"] for r in rows) <= 1  # but for a ring of one, nobody meets itself
