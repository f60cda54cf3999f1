"""Targets, permutations, draws and what a mix takes."""

import random

import pytest
from pyspark.sql import functions as F

from lanternfish.llm import mixing


def test_targets():
    assert mixing.targets([100, 100], [5, 2]) == pytest.approx([1000 / 7, 400 / 7])
    got = mixing.targets([10, 1000, 500], [5, 2, 1])
    assert got[0] == 30 and sum(got) == pytest.approx(1510)
    assert mixing.targets([0, 5], [5, 2]) == pytest.approx([0, 5])
    assert mixing.targets([], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_permutations(spark, n):
    rows = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("bigint").alias("n"), F.lit(987654321987).alias("salt"))
    got = [r["x"] for r in mixing.permuted(rows, "x", "n", "salt").collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or sum(abs(a - b) > 1 for a, b in zip(got, got[1:])) > 0.9 * n)


def test_slots_for():
    rng = random.Random(3)
    for _ in range(500):
        size = rng.randint(1, 900)
        goal = rng.randint(0, 3 * size)
        n, excess = mixing.slots_for(goal, size)
        lengths = ([size % 128] if size % 128 else []) + [128] * (size // 128)
        taken = sum((lengths * 4)[:n])
        assert taken - excess == goal and (not n or 0 <= excess < (lengths * 4)[n - 1])


def test_shards_are_draws_from_the_quotas(spark):
    """Every slot once, shards of equal numbers of slots, and counts by source as a draw without replacement has them."""
    sums = [("a", 128 * 20_000, 1), ("b", 128 * 9000 + 5, 1), ("c", 40, 1)]
    sources = mixing.plan(sums, (1, 1, 1))
    slots = mixing.dealt_slots(spark, sources).collect()
    total = sum(s["quota"] for s in sources)
    assert sorted(r["place"] for r in slots) == list(range(total))
    by_shard = {}
    for r in slots:
        by_shard.setdefault(r["shard"], []).append(r["source_no"])
    assert [len(by_shard[j]) for j in range(len(by_shard) - 1)] == [4096] * (len(by_shard) - 1)
    share = sources[0]["quota"] / total
    spread = (4096 * share * (1 - share) * (1 - 4096 / total)) ** 0.5
    off = [(own.count(0) - 4096 * share) / spread for j, own in by_shard.items() if len(own) == 4096]
    assert max(map(abs, off)) < 4.5 and 0.4 < (sum(x * x for x in off) / len(off)) ** 0.5 < 1.8
    for s in sources:
        own = [r for r in slots if r["source_no"] == s["source_no"]]
        assert sum(r["upto"] for r in own) == round(s["target"])
        assert len({(r["epoch"], r["block"]) for r in own}) == len(own) and max(r["epoch"] for r in own) < 3


def corpus():
    rng = random.Random(12)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "c", "tiny" if i % 50 == 0 else "b", None])
        rows.append((i, " ".join(f"w{i}_{k}" for k in range(rng.choice([0, 1, 30, 200, 900]))) or rng.choice([None, "", " \n"]), source, 1))
    return rows + [rows[5], rows[5]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


def test_report_and_documents(spark):
    rows = corpus()
    report = mixing.mix_report(frame(spark, rows)).collect()
    assert len(report) == len(rows)
    again = mixing.mix_report(frame(spark, list(reversed(rows))).repartition(7)).collect()
    assert sorted(map(tuple, report)) == sorted(map(tuple, again))
    source = {i: s for i, _, s, _ in rows}
    taken, goal, size = {}, {}, {}
    for r in report:
        s = source[r["doc_id"]]
        assert r["taken"] <= 3 * r["size"]
        taken[s], size[s], goal[s] = taken.get(s, 0) + r["taken"], size.get(s, 0) + r["size"], r["target"]
        assert r["source_size"] == sum(len((t or "").split()) for _, t, q, _ in rows if q == s)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, t in zip(order, want):
        assert goal[s] == pytest.approx(t) and taken[s] == round(t)
    documents = mixing.mixed_documents(frame(spark, rows)).collect()
    words = {}
    for r in documents:
        assert r["n_chars"] == len(r["text"]) and r["source"] == source[r["doc_id"]]
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
        whole = next(t for i, t, _, _ in rows if i == r["doc_id"]).split()
        assert set(r["text"].split()) <= set(whole)
    expected = {}
    for r in report:
        expected[r["doc_id"]] = expected.get(r["doc_id"], 0) + r["taken"]
    assert words == {i: n for i, n in expected.items() if n}


def test_taken_equals_a_recount_of_slots_and_words(spark):
    """What each document gives, counted word by word from the slots and the packing order."""
    rows = [r for r in corpus() if r[2]][:250] + [(9000, "long " * 70_000, "b", 1)]
    docs = frame(spark, rows)
    packed, sums = mixing._packed(docs, "text", "source", "doc_id", [])
    slots = mixing.dealt_slots(spark, mixing.plan(sums)).collect()
    owner, names = {}, [s for s, _, _ in sums]
    for r in packed.collect():
        for w in range(r["start"], r["start"] + r["size"]):
            assert (names.index(r["source"]), w) not in owner
            owner[names.index(r["source"]), w] = r["doc_id"]
    assert len(owner) == sum(n for _, n, _ in sums)
    want = {}
    for r in slots:
        for w in range(r["block"] * mixing.BLOCK, r["block"] * mixing.BLOCK + r["upto"]):
            doc = owner[r["source_no"], w]
            want[doc] = want.get(doc, 0) + 1
    clash = docs.selectExpr("*", "'k' as block", "1 as size", "2 as part", "3 as epoch", "4 as k", "5 as _n", "6 as _text")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_report(clash).collect()}
    assert {i: n for i, n in got.items() if n} == want
    made = mixing.mixed_documents(clash)
    assert made.columns == clash.columns and {r["block"] for r in made.select("block").collect()} == {"k"}


def test_edges(spark):
    assert mixing.mix_report(frame(spark, [])).collect() == [] and mixing.mixed_documents(frame(spark, [])).collect() == []
    none = mixing.mix_report(frame(spark, [(1, None, "a", 0), (2, " ", None, 0)])).collect()
    assert {(r["doc_id"], r["size"], r["taken"], r["target"]) for r in none} == {(1, 0, 0, 0.0), (2, 0, 0, 0.0)}
    one = mixing.mix_report(frame(spark, [(1, "only words here", "a", 0)])).first()
    assert (one["taken"], one["target"]) == (3, 3.0)


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix_report(frame(spark, [(i, "a b", str(i), 0) for i in range(3)]))
