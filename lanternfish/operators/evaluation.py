"""Retrieval metrics for batches of cases, and parameter sweeps over one pool of candidates.

pools: candidates (case_id, source, score, ...) with everything that the gates need; grades: (case_id, source,
grade), the relevant sources; forbidden: (case_id, source). Sweep points are a key like the case.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from .stages import complete, gate


def ranked_sources(pools: DataFrame) -> DataFrame:
    """(case_id, source, rank): sources by their best candidate."""
    best = pools.groupBy("case_id", "source").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "source")))


def ranking_metrics(cases: DataFrame, pools: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """(case_id, precision_at_k, recall_at_k, mrr, ndcg_at_k) of every case."""
    hit = ranked_sources(pools).join(grades, ["case_id", "source"]).where("rank is not null")
    top = F.col("rank") <= k
    got = hit.groupBy("case_id").agg(F.count_if(top).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(top, S.gain(F.col("grade"), F.col("rank")))).alias("dcg"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "source"))
    ideal = grades.withColumn("place", place).groupBy("case_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("place") <= k, S.gain(F.col("grade"), F.col("place")))).alias("idcg"))
    rows = cases.select("case_id").join(got, "case_id", "left").join(ideal, "case_id", "left")

    def ratio(a, b):
        return F.coalesce(F.when(b > 0, a / b), F.lit(0.0))

    hits = F.coalesce("hits", F.lit(0))
    return rows.select(
        "case_id",
        (ratio(hits, F.lit(k)) if k > 0 else F.lit(0.0)).alias("precision_at_k"),
        ratio(hits, F.col("relevant")).alias("recall_at_k"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        ratio(F.coalesce("dcg", F.lit(0.0)), F.col("idcg")).alias("ndcg_at_k"),
    )


def pooled(pools: DataFrame, top_k, keys: tuple[str, ...]) -> DataFrame:
    """The first top_k candidates of each case by score and source, with their place as pos."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "source", "id")
    return pools.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top_k)


def injection_metrics(cases: DataFrame, selected: DataFrame, grades: DataFrame, forbidden: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Precision, recall and F1 of what was selected, whether a case stayed quiet, and forbidden sources, by case."""
    marks = grades.select("case_id", "source", F.lit(1).alias("good"))
    bans = forbidden.select("case_id", "source", F.lit(1).alias("bad"))
    chosen = selected.select(*keys, "source").distinct().join(marks, ["case_id", "source"], "left").join(bans, ["case_id", "source"], "left")
    got = chosen.groupBy(*keys).agg(F.count("*").alias("n"), F.count("good").alias("good"), F.count("bad").alias("forbid_violations"))
    relevant = grades.groupBy("case_id").agg(F.count("*").alias("relevant"))
    rows = cases.select(*keys).join(relevant, "case_id", "left").join(got, list(keys), "left").fillna(0, ["n", "good", "forbid_violations", "relevant"])
    precision = F.when(F.col("n") > 0, F.col("good") / F.col("n")).otherwise(0.0)
    recall = F.when(F.col("relevant") > 0, F.col("good") / F.col("relevant")).otherwise(0.0)
    should = F.col("relevant") > 0
    return rows.select(*keys, should.alias("should_hit"), precision.alias("injected_precision"), recall.alias("injected_recall"), S.f1(precision, recall).alias("injected_f1"), (F.col("good") > 0).alias("injected_hit"), (~should & (F.col("n") == 0)).alias("quiet"), "forbid_violations")


def summarize(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over the cases that should hit, and counts over all; F1 is of the means, not the mean of F1."""
    def mean(c: str):
        return F.coalesce(F.avg(F.when(F.col("should_hit"), F.col(c))), F.lit(0.0))

    precision, recall = mean("injected_precision"), mean("injected_recall")
    quiet = F.coalesce(F.avg(F.when(~F.col("should_hit"), F.col("quiet").cast("double"))), F.lit(1.0))
    return results.groupBy(*keys).agg(
        F.count("*").alias("cases"),
        F.count_if(F.col("should_hit")).alias("should_hit_cases"),
        F.count_if(~F.col("should_hit")).alias("expect_empty_cases"),
        *[mean(c).alias(f"mean_{c}") for c in ("precision_at_k", "recall_at_k", "mrr", "ndcg_at_k")],
        precision.alias("injected_precision"),
        recall.alias("injected_recall"),
        S.f1(precision, recall).alias("injected_f1"),
        quiet.alias("quiet_accuracy"),
        F.coalesce(F.sum("forbid_violations"), F.lit(0)).alias("forbid_violations"),
        F.count_if(F.col("injected_hit")).alias("injected_hits"),
    )


def evaluate(cases: DataFrame, pools: DataFrame, grades: DataFrame, forbidden: DataFrame, retrieval: dict, now_ms: int, k: int = 5, rerank=None) -> DataFrame:
    """All metrics of every case; rerank, where given, maps the pooled candidates to those that it keeps."""
    rows = complete(pooled(pools, retrieval["topK"], ("case_id",)))
    rows = rerank(rows) if rerank is not None else rows
    selected = gate(rows, retrieval, now_ms, keys=("case_id",)).where("drop_reason is null")
    return ranking_metrics(cases, pools, grades, k).join(injection_metrics(cases, selected, grades, forbidden), "case_id")


def golden_cases(spark, path: str, multi_line: bool = True) -> DataFrame:
    """(id, query, expect, forbid, requires_filter) of a file of golden cases: one array, or a case on each line."""
    schema = "id string, query string, expect array<struct<source:string,grade:int>>, forbid array<string>, requiresFilter boolean"
    cases = spark.read.option("multiLine", multi_line).schema(schema).json(path)
    return cases.select("id", "query", "expect", "forbid", F.coalesce("requiresFilter", F.lit(False)).alias("requires_filter"))


def gating(results: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results that gate a baseline, and those of cases that only a usefulness filter can pass (``requires_filter``)."""
    needs = cases.where(F.coalesce("requires_filter", F.lit(False))).select("case_id")
    return results.join(needs, "case_id", "left_anti"), results.join(needs, "case_id", "left_semi")


def report_lines(results: DataFrame) -> DataFrame:
    """(case_id, line): a tab-separated line of each case, figures to three digits."""
    def three(c: str):
        return F.format_string("%.3f", F.col(c))

    kind = F.when(F.coalesce(F.col("requires_filter"), F.lit(False)), "filter").when(F.col("should_hit"), "hit").otherwise("empty") if "requires_filter" in results.columns else F.when(F.col("should_hit"), "hit").otherwise("empty")
    figures = [three(c) for c in ("precision_at_k", "recall_at_k", "mrr", "ndcg_at_k", "injected_recall", "injected_precision")]
    return results.select("case_id", F.concat_ws("\t", F.col("case_id").cast("string"), kind, *figures, F.when(F.col("quiet"), "yes").otherwise("-"), F.col("forbid_violations").cast("string")).alias("line"))


def sweep_values(spec: str) -> list[float]:
    """``start:end:step`` with the end included, or values between bars."""
    if ":" not in spec:
        return [float(v) for v in spec.split("|")]
    start, end, step = (float(v) for v in spec.split(":"))
    if step <= 0:
        raise ValueError(f"{spec} needs a step above 0")
    count = int((end - start) / step + 0.1) + 1
    return [round(start + i * step, 6) for i in range(max(count, 0))]


def sweep(cases: DataFrame, pools: DataFrame, grades: DataFrame, forbidden: DataFrame, retrieval: dict, now_ms: int, thresholds: list[float], recency_weights: list[float], top_ks: list[int], k: int = 5) -> DataFrame:
    """A summary for each point of the grid, best first by ``place``.

    The grid is a list of settings of the caller; the pool is gated once for all points, with the point as a key.
    """
    spark = pools.sparkSession
    grid = list(itertools.product(thresholds, recency_weights, top_ks))
    points = F.array(*[F.struct(F.lit(i).alias("point"), F.lit(float(t)).alias("threshold"), F.lit(float(w)).alias("recency_weight"), F.lit(n).alias("top_k")) for i, (t, w, n) in enumerate(grid)])
    fields = ["point", "threshold", "recency_weight", "top_k"]
    at = lambda df: df.select("*", F.explode(points).alias("_p")).select("*", *[F.col(f"_p.{f}").alias(f) for f in fields]).drop("_p")
    rows = complete(at(pooled(pools, max(top_ks), ("case_id",))).where("pos <= top_k"))
    keys = ("point", "case_id")
    judged = rows.where("score is null or score >= threshold")
    base = {**retrieval, "threshold": float("-inf")}  # each point's own threshold has been applied
    parts = None
    for w in sorted(set(recency_weights)):
        part = gate(judged.where(F.col("recency_weight") == float(w)), {**base, "recencyWeight": w}, now_ms, keys=keys)
        parts = part if parts is None else parts.unionByName(part)
    all_cases = at(cases.select("case_id")).select("point", "case_id")
    injected = injection_metrics(all_cases, parts.where("drop_reason is null"), grades, forbidden, keys)
    results = injected.join(ranking_metrics(cases, pools, grades, k), "case_id")
    summary = summarize(results, ("point",))
    named = spark.createDataFrame([(i, float(t), float(w), int(n)) for i, (t, w, n) in enumerate(grid)], "point int, threshold double, recency_weight double, top_k int")
    r = lambda c: F.round(c, 9)
    order = Window.orderBy("forbid_violations", r(F.col("quiet_accuracy")).desc(), r(F.col("injected_f1")).desc(), r(F.col("injected_recall")).desc(), r(F.col("mean_ndcg_at_k")).desc(), "point")
    # one row for each point of the grid
    return summary.join(F.broadcast(named), "point").withColumn("place", F.row_number().over(order))


def passes(summary: DataFrame, floors: dict) -> DataFrame:
    """Add ``passes``: no more forbidden sources, and no less quality, than the floors."""
    ok = F.col("forbid_violations") <= floors.get("max_forbid_violations", 0)
    for c in ("mean_ndcg_at_k", "injected_f1", "quiet_accuracy"):
        ok = ok & (F.col(c) >= floors.get(c, 0.0))
    return summary.withColumn("passes", ok)
