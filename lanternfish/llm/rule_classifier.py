"""A quality classifier of sparse rules, which Spark scores as one column expression.

Shallow gradient-boosted trees are grown on counts of a bounded sample of labelled texts. Every path from a root to
a node is a rule: a conjunction of comparisons. A logistic regression with an L1 penalty, fitted by accelerated
proximal gradient, keeps few of these rules, and the kept ones are compiled to a column.

The sample holds at most ``SAMPLE_PER_CLASS`` ids of either label, the first by a hash of their id, and of the rows with these
ids, which may be more where ids repeat, the first ``SAMPLE_ROWS``; so the same tables give the same model, and only
these rows' counts reach the driver. Inputs of a score are counts of the text, never
labels, lang, source or ids.

Defined results: null and empty texts are scored by their zero counts; a document with contradictory labels is no
example; repeated rows count once in the sample, and ids that tie in their hash are taken in their own order; a text of any
length is counted whole, as one row; with examples of fewer than two classes the score is the share of
label 1 (0.5 without any); an empty table gives no rows; columns of the input pass through, except that
output names win over equal names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import marks, table, words

SAMPLE_PER_CLASS, SAMPLE_ROWS = 4000, 16_000
TREES, DEPTH, RATE = 40, 3, 0.3
BINS = 32
MIN_LEAF = 8
L1 = 0.002
STEPS = 1500

#: What a text's characters are counted by.
COUNTED = r"#*$%&|<>!.?;:0-9\p{Lu}"
FEATURES = ["log_words", "word_length", "symbol_rate", "exclaim_rate", "bar_rate", "upper_rate", "stop_rate", "digit_rate", "variety", "stutter_rate", "line_words", "repeat_line_rate"]


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of FEATURES, rates of counts over the whole text; the text column goes."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    made = {*FEATURES, "_marks", "_words", "_joined", "_lines", text}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    rows = docs.select(*kept, marks(body, COUNTED).alias("_marks"), words(F.col(f"`{text}`")).alias("_words"), F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    rows = rows.select(*kept, "_marks", "_words", "_lines", F.array_join("_words", " ").alias("_joined"))
    t, w, lines = F.col("_marks"), F.col("_words"), F.col("_lines")
    chars = F.length("_joined") - F.greatest(F.size(w) - 1, F.lit(0))

    def count(letters: str) -> Column:
        return F.length(t) - F.length(F.translate(t, letters, ""))

    n = F.greatest(F.size(w), F.lit(1))
    # words that their like follows
    stutter = F.regexp_count("_joined", F.lit(r"(?<![^ ])([^ ]++)(?= \1(?![^ ]))"))
    n_lines = F.greatest(F.size(lines), F.lit(1))
    values = {
        "log_words": F.log1p(F.size(w)),
        "word_length": chars / n,
        "symbol_rate": count("#*$%&|<>") / n,
        "exclaim_rate": count("!") / n,
        "bar_rate": count("|") / n,
        "upper_rate": (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))) / F.greatest(chars, F.lit(1)),
        "stop_rate": count(".?;:") / n,
        "digit_rate": count("0123456789") / F.greatest(chars, F.lit(1)),
        # the logarithm of the distinct words over that of all words: hardly falls with the length
        "variety": F.when(F.size(w) > 1, F.log(F.size(F.array_distinct(w))) / F.log(F.size(w))).otherwise(1.0),
        "stutter_rate": stutter / n,
        "line_words": F.size(w) / n_lines,
        "repeat_line_rate": (F.size(lines) - F.size(F.array_distinct(lines))) / n_lines,
    }
    return rows.select(*kept, *[v.cast("double").alias(k) for k, v in values.items()])


def grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple, out: list) -> None:
    """Grow one regression tree; append (path, rows, value) of each node below the root.

    A path is a tuple of (feature, threshold, above).
    """
    g, h = gradient[rows].sum(), weight[rows].sum()
    if path:
        out.append((path, rows, g / (h + 1.0), depth == 0))
    if not depth or len(rows) < 2 * MIN_LEAF:
        if path:
            out[-1] = (*out[-1][:3], True)
        return
    best = (1e-6, None)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        bin_ = np.searchsorted(cut, x[rows, f], side="left")
        gs = np.cumsum(np.bincount(bin_, gradient[rows], len(cut) + 1))[:-1]
        hs = np.cumsum(np.bincount(bin_, weight[rows], len(cut) + 1))[:-1]
        ns = np.cumsum(np.bincount(bin_, minlength=len(cut) + 1))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < MIN_LEAF) | (len(rows) - ns < MIN_LEAF)] = 0
        tied = np.flatnonzero(gain >= gain.max() - 1e-6 * abs(gain.max()))
        i = int(tied[len(tied) // 2])  # the middle of the gap between the classes
        if gain[i] > best[0]:
            best = (gain[i], (f, float(cut[i])))
    if best[1] is None:
        if path:
            out[-1] = (*out[-1][:3], True)
        return
    f, at = best[1]
    above = x[rows, f] > at
    grow(x, gradient, weight, cuts, rows[~above], depth - 1, (*path, (f, at, False)), out)
    grow(x, gradient, weight, cuts, rows[above], depth - 1, (*path, (f, at, True)), out)


def holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, at, above in path:
        out &= (x[:, f] > at) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Coefficients of a weighted logistic regression with an L1 penalty on all but the first, by accelerated proximal gradient."""
    step = 4 / np.linalg.norm(z * np.sqrt(weight / len(y))[:, None], 2) ** 2
    beta = ahead = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30)))
        new = ahead - step * (z.T @ (weight * (p - y))) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * L1, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_new * (new - beta)
        beta, t = new, t_new
    return beta


def fit_rules(x: np.ndarray, y: np.ndarray) -> dict:
    """Rules and weights from features and 0/1 labels, by boosting and then L1 logistic regression."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return {"intercept": float(np.log((share + 1e-3) / (1 - share + 1e-3))), "rules": []}
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middles = (values[1:] + values[:-1]) / 2
        ranks = np.searchsorted(values, np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        even = np.linspace(0, len(middles) - 1, BINS).astype(int)
        cuts.append(middles[np.unique(np.r_[ranks[ranks < len(middles)], even])] if len(middles) else middles)
    # the rarer class weighs more, but few examples of it do not outweigh all others
    balance = np.sqrt(np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    margin, paths = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        nodes: list = []
        grow(x, balance * (y - p), balance * np.maximum(p * (1 - p), 1e-3), cuts, np.arange(len(y)), DEPTH, (), nodes)
        for path, rows, value, leaf in nodes:
            paths[tuple(sorted(path))] = None
            if leaf:
                margin[rows] += RATE * value
        if not nodes:
            break
    rules = list(paths)
    r = np.array([holds(x, p) for p in rules], dtype=np.float64).T if rules else np.zeros((len(y), 0))
    _, first = np.unique(r, axis=1, return_index=True) if rules else (None, [])
    first = sorted(first)
    rules, r = [rules[i] for i in first], r[:, first]
    mean = r.mean(axis=0)
    scale = np.maximum(np.sqrt(mean * (1 - mean)), 0.05)
    z = np.c_[np.ones(len(y)), (r - mean) / scale]
    beta = lasso(z, y, balance)
    w = beta[1:] / scale
    keep = np.flatnonzero(np.abs(beta[1:]) > 1e-4)
    return {"intercept": float(beta[0] - (w[keep] * mean[keep]).sum()), "rules": [(rules[i], float(w[i])) for i in keep]}


def score_column(model: dict) -> Column:
    """The rules over the columns of FEATURES as one expression between 0 and 1."""
    z = F.lit(model["intercept"])
    for path, weight in model["rules"]:
        test = F.lit(True)
        for f, at, above in path:
            c = F.col(FEATURES[f])
            test = test & ((c > F.lit(at)) if above else (c <= F.lit(at)))
        z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def held_out(ident: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(ident.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> dict:
    """Fit the rules to labelled documents that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(ident).isNotNull() & ~held_out(F.col(ident)))
    known = known.groupBy(ident).agg(F.min(label).alias("y"), F.max(label).alias("_most")).where("y = _most").select(F.col(ident).alias("_id"), "y")
    picks = [known.where(F.col("y") == v).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for v in (0, 1)]
    picked = picks[0].unionByName(picks[1])
    # bounded: 2 * per_class ids
    found = docs.select(F.col(f"`{ident}`").alias("_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "_id")
    rows = with_features(found).groupBy("_id", "y", *FEATURES).agg(F.lit(1)).orderBy(F.xxhash64("_id"), "_id", *FEATURES).limit(SAMPLE_ROWS).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit_rules(x, np.array([r["y"] for r in rows], dtype=np.float64))


def scored(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The columns of docs without the text, and score and predicted."""
    out = with_features(docs, text)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "score", "predicted", *FEATURES)]
    return out.select(*kept, score_column(model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classifier_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model predicts to have quality 1, with their own columns."""
    model = train(docs, labels)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text"))
    return scored(whole, model).where("predicted = 1").select("_doc.*")


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
