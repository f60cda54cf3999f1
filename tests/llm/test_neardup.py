"""Near-duplicate classes against brute force over all pairs."""

import random
from collections import Counter

import numpy as np

from lanternfish.llm import components, neardup


def bag(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jp(a, b):
    return sum(1 / sum(max(a[k] / a[d], b[k] / b[d]) for k in set(a) | set(b)) for d in set(a) & set(b))


def classes(rows):
    """The least id of each row's class, by testing all pairs."""
    bags, parent = [bag(t or "") for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (a and b and (len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) or jp(a, b) >= 0.8)):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least[find(i)] for i in range(len(rows))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


def corpus():
    rng = random.Random(11)
    rows = [None, "", "", "  \n", "one", "one ", "one two three", "one two three", "a b c d e", "a b c d f", "x " * 400, "x " * 700]
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows += [" ".join(base)] + [edited(rng, base, n) for n in (1, 1, 2, 3, 6, 9)] + ["  ".join(base) + "\n"]
    rows += [" ".join(f"u{rng.randrange(9999)}" for _ in range(60)) for _ in range(30)]
    ids = list(range(100, 100 + len(rows)))
    rng.shuffle(ids)
    return [*zip(ids, rows), (ids[20], rows[20])]  # a repeated row


def test_classes(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "b", "k") for i, t in rows], "doc_id long, text string, bucket string, key string")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter((i, c) for (i, _), c in zip(rows, classes(rows)))
    sizes = Counter(r["class_id"] for r in got)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in got)
    kept = neardup.one_of_each(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(sizes) and {r["bucket"] for r in kept} == {"b"}


def test_large_mixed_buckets_lose_no_link(spark, monkeypatch):
    """A group of near copies around one text, some too far from it: prefix filtering settles the large buckets."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, base, rng.choice([1, 2, 3, 5, 7, 9]))) for i in range(120)]
    calls = []
    real = neardup._overlapping
    monkeypatch.setattr(neardup, "_overlapping", lambda *a: calls.append(1) or real(*a))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert calls and [got[i] for i, _ in rows] == classes(rows)


def test_prefix_filtering_loses_no_link_by_counts(spark):
    """Texts around one much repeated line, and lines mixed in other shares: every pair that is linked is a candidate."""
    rng = random.Random(9)
    line = [f"l{j}" for j in range(10)]
    texts = [" ".join(line * 30 + [f"t{i}w{j}" for j in range(20)]) for i in range(4)]
    for i in range(36):
        parts = [" ".join(f"m{k}w{j}" for j in range(6)) for k in range(3)]
        texts.append(" ".join(" ".join([part] * rng.randint(1, 12)) for part in parts) + "".join(f" o{i}w{j}" for j in range(rng.randint(0, 25))))
    rows = [(bytes([i]), bytes([i]), t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "key binary, root binary, text string")
    got = {(bytes(r["a"])[0], bytes(r["b"])[0]) for r in neardup._overlapping(frame.select("key", "root"), frame.select("key", "text"), 0.8).collect()}
    bags = [bag(t) for t in texts]
    by_sets = {(i, j) for j in range(len(texts)) for i in range(j) if len(set(bags[i]) & set(bags[j])) >= 0.8 * len(set(bags[i]) | set(bags[j]))}
    by_counts = {(i, j) for j in range(len(texts)) for i in range(j) if jp(bags[i], bags[j]) >= 0.8}
    assert {(0, 1), (2, 3)} <= by_counts - by_sets and len(by_counts - by_sets) > 10
    assert by_sets | by_counts <= got


def test_copies_that_repeat_a_line_are_linked_by_their_sets(spark):
    """A line once against 30 times: plain Jaccard 0.96, probability Jaccard 0.34, so bands of bags alone miss most."""
    rows = []
    for i in range(12):
        own, line = " ".join(f"p{i}w{j}" for j in range(100)), " ".join(f"p{i}l{j}" for j in range(8))
        rows += [(2 * i, f"{own} {line}"), (2 * i + 1, f"{own} " + " ".join([line] * 30))]
    assert jp(bag(rows[0][1]), bag(rows[1][1])) < 0.4
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == classes(rows) == [i - i % 2 for i, _ in rows]


def test_links_by_counts_alone_in_a_large_bucket(spark):
    """Sixty texts around one line repeated 30 to 36 times, each with words of its own: sets differ, bags are near."""
    line = [f"l{j}" for j in range(10)]
    rows = [(i, " ".join(line * (30 + i % 7) + [f"t{i}w{j}" for j in range(20 + 9 * (i % 5))])) for i in range(60)]
    bags = [bag(t) for _, t in rows]
    assert max(len(set(a) & set(b)) / len(set(a) | set(b)) for k, a in enumerate(bags) for b in bags[:k]) < 0.4
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == classes(rows) and len(set(got.values())) < 40


def test_one_text_repeated_in_the_other(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words) + " x" * 1000), (3, "é " * 200_000 + "end"), (4, "é " * 200_000 + "fin")]
    docs = spark.createDataFrame([(i, t, 9, b"k", 0) for i, t in rows], "doc_id long, text string, class_id int, key binary, bands int")
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in neardup.near_duplicates(docs).collect()}
    assert got[1] == got[2] == (1, 1) and got[3] == got[4] == (3, 1)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_empty_and_null_ids(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = neardup.near_duplicates(spark.createDataFrame([(None, "same text"), (5, "same text"), (None, "other")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in rows) == [(0, 0), (0, 5), (5, 5)]


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(8)
    for edits in (2, 10, 25):
        words = [f"w{rng.randrange(300)}" for _ in range(200)] + ["again and again it comes"] * 5
        a, b = " ".join(words), edited(rng, words, edits)
        sig, done = neardup.signatures([a.encode(), b.encode(), b""], 2048)
        assert done.tolist() == [True, True, False]
        assert abs(float(np.mean(sig[0] == sig[1])) - jp(bag(a), bag(b))) < 0.05


def test_similarity_is_exact():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(2))
        x, y = bag(a), bag(b)
        got = neardup.similarity(a.encode(), b.encode())
        want = jp(x, y), len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0.0
        assert max(abs(got[0] - want[0]), abs(got[1] - want[1])) < 1e-12


def test_components(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(40)]
    edges = chain + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(500, 500 + i) for i in range(1, 20)] + chain[:3]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []
