"""Histogram-sort shards against a plain sort."""

import random
import zlib

from pyspark.sql import functions as F

from lanternfish.llm import sharding


def shards(df, n=8, **how):
    return sharding.histogram_shards(df, n, F.col("size"), F.col("k"), F.xxhash64("doc_id"), [F.col("doc_id")], **how).collect()


def check(rows, n, slack):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total = sum(r["size"] for r in rows)
    assert all(abs(sum(r["size"] for r in by.get(s, [])) - total / n) <= slack for s in range(n))
    return by


def test_equal_bytes_in_key_order(spark):
    rng = random.Random(5)
    given = [(i, rng.randint(1, 3000), rng.choice([rng.randint(-(2**63), 2**63 - 1), rng.randint(0, 50), 2**40 + i])) for i in range(3000)]
    rows = shards(spark.createDataFrame(given, "doc_id long, size long, k long"))
    assert len(rows) == len(given)
    by = check(rows, 8, 2 * 3000)
    key = {i: k for i, _, k in given}
    edges = [(min(key[r["doc_id"]] for r in by[s]), max(key[r["doc_id"]] for r in by[s])) for s in range(8)]
    assert all(a[1] <= b[0] for a, b in zip(edges, edges[1:]))
    for own in by.values():
        inside = [key[r["doc_id"]] for r in sorted(own, key=lambda r: r["slot"])]
        assert inside == sorted(inside)


def test_one_key_for_all_is_cut_by_the_tie(spark):
    rows = shards(spark.range(4000).selectExpr("id as doc_id", "10L as size", "7L as k"))
    check(rows, 8, 40)


def test_equal_texts_stay_together_where_bytes_allow(spark):
    given = [(i, 5, i // 10) for i in range(2000)]
    rows = shards(spark.createDataFrame(given, "doc_id long, size long, k long"), tolerance=0.1)
    assert all(len({r["shard"] for r in rows if r["doc_id"] // 10 == g}) == 1 for g in range(200))


def test_edges(spark):
    assert shards(spark.createDataFrame([], "doc_id long, size long, k long")) == []
    one = shards(spark.createDataFrame([(None, 3, None)], "doc_id long, size long, k long"))
    assert len(one) == 1 and one[0]["slot"] == 0
    mixed = shards(spark.createDataFrame([(i, None if i % 7 == 0 else 5, None if i % 3 else i) for i in range(900)], "doc_id long, size long, k long"), tolerance=0.01)
    check([r.asDict() for r in mixed], 8, 50)
    given = spark.createDataFrame([(i, "t" * i, 9, 8, 7, "s", i % 2) for i in range(50)], "doc_id long, text string, key int, tie int, size int, `a.b` string, shard int")
    keep = [F.col("doc_id"), F.col("key"), F.col("tie"), F.col("size"), F.col("`a.b`"), F.col("shard")]
    for small in (True, False):
        if not small:
            sharding.BROADCAST_INTERVALS, held = 0, sharding.BROADCAST_INTERVALS
        got = sharding.histogram_shards(given, 4, F.length("text"), F.xxhash64("text"), F.xxhash64("doc_id"), keep)
        assert got.columns == ["doc_id", "key", "tie", "a.b", "size", "shard", "slot"]
        rows = got.collect()
        assert {r["key"] for r in rows} == {9} and {r["tie"] for r in rows} == {8} and sorted(r["size"] for r in rows) == list(range(50)) and {r["shard"] for r in rows} == {0, 1, 2, 3}
    sharding.BROADCAST_INTERVALS = held
    same = shards(spark.createDataFrame([(1, 2, 3)] * 20, "doc_id long, size long, k long"))
    assert sorted(r["slot"] for r in same) == list(range(20))


def test_query(spark, tmp_path):
    texts = ["a", "bé", None, "", "x" * 20_000, "a"] + [f"text {i}" for i in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in sharding.op1_query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert rows[0]["law"] == "bytes" and rows[0]["grown_shard"] is None
    check(list(rows.values()), 8, 20_001)
