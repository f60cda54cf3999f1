"""Counts by plain loops, and what weak supervision and the classifier decide."""

import random
import re

import numpy as np

from lanternfish.llm import quality, rule_classifier


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "harbour", "stone", "under", "light", "remain", "window"]) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(n)).capitalize() + "."


def good(rng):
    return "\n".join(sentence(rng, rng.randint(8, 20)) for _ in range(rng.randint(4, 12)))


def bad(rng):
    t = good(rng)
    return rng.choice([t.replace(" ", "$$$ "), t.upper().replace(" ", "!! "), t.replace(" ", " | ")])


def test_counts_equal_loops(spark):
    rng = random.Random(2)
    texts = [None, "", "a b c d e f g h a b c d e f g h i", " \t\x0b\x0c\r\n\n x", "a\x1cb\x85c d😀#", "z " * 40, "q " * 7, "l\nl\nl \n\n", "w " * 3000 + good(rng)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(150)] + [good(rng) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, n_words int")
    got = {r["doc_id"]: tuple(r[c] for c in quality.STATS[:5]) for r in quality.with_stats(docs).collect()}
    assert {i: got[i] for i in got} == {i: counts(t) for i, t in enumerate(texts)}


def test_rules_reject_bad_and_keep_clean(spark):
    rng = random.Random(9)
    texts = [(i, good(rng), 1) for i in range(300)] + [(1000 + i, bad(rng), 0) for i in range(40)] + [(2000, None, 0), (2001, "short text", 0), (2002, "one line only here. " * 30, 0)]
    docs = spark.createDataFrame(texts, "doc_id int, text string, kept int")
    out = quality.quality_filter(docs).collect()
    assert {r["doc_id"] for r in out} == set(range(300)) and {r["kept"] for r in out} == {1}
    alone = quality.quality_filter(docs.where("doc_id < 300"))
    assert alone.count() == 300  # with nothing bad to find, nothing clean goes


def test_accuracies_are_estimated(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(good(rng),) for _ in range(200)] + [(bad(rng),) for _ in range(60)], "text string")
    model = quality.fit(quality.with_stats(docs))
    assert model["accuracy"]["symbols"] > 0.9 and model["accuracy"]["plain_letters"] > 0.9 and 0.6 < model["good"] < 0.95
    assert quality.fit(quality.with_stats(docs.limit(0)))["documents"] == 0 and quality.quality_filter(docs.limit(0)).count() == 0


def labelled(spark, n=400):
    rng = random.Random(7)
    rows = [(i, good(rng) if i % 4 else bad(rng), int(i % 4 > 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows] + [(n, None, "en", 0.5), (n + 1, "", "en", 0.5)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 0)], "doc_id long, quality int")
    return docs, labels, {i: y for i, _, y in rows}


def test_classifier_on_held_out_rows(spark):
    import zlib

    docs, labels, truth = labelled(spark)
    model = rule_classifier.train(docs, labels)
    assert model["rules"] and all(len(p) <= rule_classifier.DEPTH for p, _ in model["rules"])
    rows = {r["doc_id"]: r for r in rule_classifier.scored(docs, model).withColumn("h", rule_classifier.held_out(docs["doc_id"])).collect()}
    assert len(rows) == 402 and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i]["h"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    assert np.mean([rows[i]["predicted"] == truth[i] for i in held]) > 0.97
    kept = rule_classifier.classifier_filter(docs, labels)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {0.5}


def test_classifier_learns_from_few_or_no_labels(spark):
    docs, labels, _ = labelled(spark, 40)
    model = rule_classifier.train(docs, labels.limit(0))
    assert model["rules"] == [] and {round(r["score"], 3) for r in rule_classifier.scored(docs, model).collect()} == {0.5}
    same = rule_classifier.train(docs, labels.where("quality = 1"))
    assert same["rules"] == [] and rule_classifier.scored(docs, same).where("predicted = 0").count() == 0
    assert rule_classifier.scored(docs.limit(0), model).count() == 0


def test_rules_hold_in_numpy_as_in_columns(spark):
    docs, labels, _ = labelled(spark)
    model = rule_classifier.train(docs, labels)
    rows = rule_classifier.with_features(docs).withColumn("s", rule_classifier.score_column(model)).collect()
    x = np.array([[r[f] for f in rule_classifier.FEATURES] for r in rows])
    z = model["intercept"] + sum(w * rule_classifier.holds(x, p) for p, w in model["rules"])
    assert np.allclose(1 / (1 + np.exp(-z)), [r["s"] for r in rows])


def test_splits_equal_a_search_over_all():
    """The root's split against every feature and cut, one after the other."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4)).round(1)
    y = ((x[:, 2] > 0.3) ^ (rng.random(120) < 0.1)).astype(float)
    gradient, weight = y - 0.5, np.full(120, 0.25)
    cuts = [(v[1:] + v[:-1]) / 2 for v in (np.unique(x[:, f]) for f in range(4))]
    out = []
    rule_classifier.grow(x, gradient, weight, cuts, np.arange(120), 1, (), out)
    (f, at, _), = out[0][0]

    def gain(f, at):
        parts = [x[:, f] > at, x[:, f] <= at]
        if min(p.sum() for p in parts) < rule_classifier.MIN_LEAF:
            return 0.0
        return sum(gradient[p].sum() ** 2 / (weight[p].sum() + 1) for p in parts) - gradient.sum() ** 2 / (weight.sum() + 1)

    assert gain(f, at) == max(gain(k, c) for k in range(4) for c in cuts[k])
    assert all(sorted(rows) == np.flatnonzero(rule_classifier.holds(x, path)).tolist() for path, rows, _, _ in out)


def test_lasso_equals_a_second_solver():
    """Against coordinate descent, and against the conditions that hold at the optimum alone."""
    rng = np.random.default_rng(8)
    z = np.c_[np.ones(300), rng.normal(size=(300, 6))]
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + 1.5 * z[:, 1] - z[:, 2])))).astype(float)
    weight = np.where(y == 1, 0.8, 1.3)
    beta = rule_classifier.lasso(z, y, weight)
    other = np.zeros(7)
    curve = (weight[:, None] * z**2).sum(axis=0) / 300 / 4
    for _ in range(3000):
        for j in range(7):
            slope = (z[:, j] * weight * (1 / (1 + np.exp(-z @ other)) - y)).sum() / 300
            moved = other[j] - slope / curve[j]
            other[j] = moved if j == 0 else np.sign(moved) * max(abs(moved) - rule_classifier.L1 / curve[j], 0)
    assert np.allclose(beta, other, atol=1e-4)
    slopes = z.T @ (weight * (1 / (1 + np.exp(-z @ beta)) - y)) / 300
    assert abs(slopes[0]) < 1e-6
    for b, g in zip(beta[1:], slopes[1:]):
        assert abs(g + np.sign(b) * rule_classifier.L1) < 1e-5 if b else abs(g) <= rule_classifier.L1 + 1e-6


def test_classifier_on_ties_repeats_and_long_texts(spark):
    docs, labels, _ = labelled(spark, 60)
    odd = spark.createDataFrame([(7, "word " * 200_000, "en", 0.5)] * 2 + [(None, None, None, None)], docs.schema)
    rows = rule_classifier.scored(docs.unionByName(odd), rule_classifier.train(docs.unionByName(odd), labels.unionByName(labels))).collect()
    assert len(rows) == 65 and len({r["score"] for r in rows if r["doc_id"] == 7}) <= 2 and all(0 <= r["score"] <= 1 for r in rows)


def test_texts_are_counted_without_walks_over_words(spark, capsys):
    rng = random.Random(6)
    texts = [None, "", " ", "a a", "a a a b b a", "aa a aa aa", " lead lead", "É É É! x", "😀 😀😀 😀", "$1 $1 \\1 \\1", "a\x1ca a\x1ca", "1 11 11 #|"] + [" ".join(rng.choice("ab") for _ in range(n)) for n in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    made, stats = rule_classifier.with_features(docs), quality.with_stats(docs)
    for r in made.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
        n = max(len(w), 1)
        assert abs(r["stutter_rate"] - sum(a == b for a, b in zip(w, w[1:])) / n) < 1e-12 and abs(r["word_length"] - sum(map(len, w)) / n) < 1e-12
        assert abs(r["digit_rate"] - sum(c in "0123456789" for x in w for c in x) / max(sum(map(len, w)), 1)) < 1e-12
    made.explain(True)
    stats.explain(True)
    plan = capsys.readouterr().out
    assert "aggregate(sequence(" not in plan and "xxhash64(slice(" not in plan
