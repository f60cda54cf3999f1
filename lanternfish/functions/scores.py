"""Score expressions of retrieval and of its evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
DAY_MS = 86_400_000.0


def l2_distance(a: Column, b: Column) -> Column:
    sq = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def distance_score(distance: Column) -> Column:
    return 1 / (1 + distance)


def idf(rows: Column, with_term: Column) -> Column:
    raw = F.log((rows - with_term + 0.5) / (with_term + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def bm25_term(weight: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def recency_boost(mtime_ms: Column, now_ms: int, weight: float) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(now_ms) - mtime_ms) / DAY_MS)
    return F.lit(float(weight)) / (1 + age / 30)


def tier_penalty(tier: Column, penalties: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, value in sorted(penalties.items()):
        out = F.when(tier == name, float(value)).otherwise(out)
    return out


def rounded(score: Column) -> Column:
    return F.round(score, 6)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gain(grade: Column, rank: Column) -> Column:
    """Discounted gain of a grade at a rank from 1."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(F.floor(value), F.lit(low)), F.lit(high))
