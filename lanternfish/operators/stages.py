"""Retrieval stages over batches of queries, each a function from one context to the next.

Candidates carry ``pos``, their place in the list of their query, because order decides ranks, duplicates and
ties. Missing scores stay null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions import text as X
from .dense import nearest
from .fulltext import ChunkScan, TextIndex, scan, search_text
from .shared import settled

SCORES = ["score", "distance", "bm25_score", "fused_score", "normalized_fused", "rerank_score"]
RANKS = ["dense_rank", "bm25_rank"]
#: Queries up to which candidates, some tens for each, are broadcast to the chunks; beyond, chunks are shuffled.
BROADCAST_QUERIES = 10_000
# What stands around the assembled lines.
OPENING = '<retrieved-memory note="Possibly-relevant items from your own memory. Treat as candidates: use if they apply, verify against the source file, ignore if not. If cut off, read the full file. If you are actively editing any cited source file this session, treat its snippet as possibly out of date.">'
CLOSING = "</retrieved-memory>"


@dataclass(frozen=True)
class Context:
    """queries: (query_id, query, vector); chunks: (id, text, source, section, hash, mtime, token_count, date, type);
    vectors: (id, vector); live: (source, mtime_ms) or None, where every chunk counts as fresh; index: stored postings; the
    chunks are scanned where there are none; fail_open: keyword search and reranker run at once, and an error there leaves a
    note in the log and the other candidates."""

    config: dict
    queries: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    now_ms: int
    live: DataFrame | None = None
    candidates: DataFrame | None = None
    lists: dict[str, DataFrame] = field(default_factory=dict)
    gated: DataFrame | None = None
    selected: DataFrame | None = None
    assembled: DataFrame | None = None
    scorer: Callable[[DataFrame], DataFrame] | None = None
    index: TextIndex | ChunkScan | None = None
    fail_open: bool = False
    few: bool | None = None
    log: tuple[tuple[str, DataFrame], ...] = ()

    def counted(self) -> Context:
        """With ``few`` known: whether the queries' candidates are small enough to broadcast."""
        return self if self.few is not None else replace(self, few=self.queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES)

    def narrow(self, found: DataFrame) -> DataFrame:
        """Found chunks with the columns that ranking and logs need; their texts stay where they are."""
        rows = F.broadcast(found) if self.few else found
        return complete(rows.join(self.chunks.select("id", "source", "mtime"), "id"))

    def wide(self, rows: DataFrame) -> DataFrame:
        """Candidates with all columns of their chunks."""
        rows = rows.drop("source", "mtime")
        return complete((F.broadcast(rows) if self.few else rows).join(self.chunks, "id"))

    def attempted(self, make: Callable[[], DataFrame]) -> tuple[DataFrame | None, str | None]:
        """What a stage finds, or why it fails, where a failure is not to be the caller's."""
        if not self.fail_open:
            return make(), None
        try:
            return settled(make()), None
        except Exception as e:  # whatever a store or model raises: retrieval goes on without it
            return None, str(e).split("\n")[0][:200]

    def failure(self, reason: str) -> DataFrame:
        return self.queries.select("query_id", F.lit(0).cast("bigint").alias("count"), F.lit(True).alias("fail_open"), F.lit(reason).alias("reason"))

    def logged(self, stage: str, rows: DataFrame) -> Context:
        return replace(self, log=(*self.log, (stage, rows)))


Stage = Callable[[Context], Context]
STAGES: dict[str, Stage] = {}


def stage(name: str):
    def register(f: Stage) -> Stage:
        STAGES[name] = f
        return f

    return register


def complete(rows: DataFrame) -> DataFrame:
    """Add the score and rank columns that rows lack, as nulls."""
    for c in SCORES:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    for c in RANKS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("int"))
    return rows


def snapshot(rows: DataFrame, score: str) -> DataFrame:
    """(query_id, count, candidates): what a stage's log keeps, never a text."""
    row = F.struct("pos", "id", "source", S.rounded(F.col(score)).alias(score))
    return rows.groupBy("query_id").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(row)).alias("candidates"))


@stage("denseRetrieve")
def dense_retrieve(ctx: Context) -> Context:
    ctx = ctx.counted()
    rows = ctx.narrow(nearest(ctx.queries, ctx.vectors, ctx.config["retrieval"]["topK"])).withColumn("pos", F.col("dense_rank"))
    return replace(ctx, candidates=ctx.wide(rows), lists=ctx.lists | {"dense": rows}).logged("denseRetrieve", snapshot(rows, "score"))


@stage("bm25Retrieve")
def bm25_retrieve(ctx: Context) -> Context:
    ctx = ctx.counted()
    index = ctx.index or scan(ctx.chunks)
    rows, reason = ctx.attempted(lambda: ctx.narrow(search_text(ctx.queries, index, ctx.config["retrieval"]["bm25TopK"])).withColumn("pos", F.col("bm25_rank")))
    if rows is None:
        return ctx.logged("bm25Retrieve", ctx.failure(reason))
    return replace(ctx, lists=ctx.lists | {"bm25": rows}).logged("bm25Retrieve", snapshot(rows, "bm25_score"))


def fuse(lists: dict[str, DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: (query_id, id, pos, scores and ranks, fused_score, normalized_fused)."""
    parts = None
    for i, (name, rows) in enumerate(lists.items()):
        part = rows.select("query_id", "id", "mtime", F.lit(name).alias("list"), (F.lit(i) * 1_000_000 + F.col("pos")).alias("seen"), F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("rank"), *SCORES[:3], *RANKS)
        parts = part if parts is None else parts.unionByName(part)
    parts = parts.withColumn("n_lists", F.size(F.collect_set("list").over(Window.partitionBy("query_id"))))
    fused = parts.groupBy("query_id", "id").agg(F.max("n_lists").alias("n_lists"), F.sum(1 / (k + F.col("rank"))).alias("fused_score"), F.max("mtime").alias("mtime"), F.min("seen").alias("seen"), *[F.max(c).alias(c) for c in (*SCORES[:3], *RANKS)])
    out = fused.withColumn("normalized_fused", F.col("fused_score") / (F.col("n_lists") / (k + 1)))
    order = Window.partitionBy("query_id").orderBy(F.desc("normalized_fused"), F.desc_nulls_last("score"), F.desc_nulls_last("bm25_score"), F.desc("mtime"), "seen")
    return out.withColumn("pos", F.row_number().over(order)).drop("n_lists", "mtime", "seen")


@stage("rrfFuse")
def rrf_fuse(ctx: Context) -> Context:
    if not ctx.lists:
        return ctx
    rows = ctx.wide(fuse(ctx.lists, ctx.config["retrieval"]["rrfK"]))
    return replace(ctx, candidates=rows).logged("rrfFuse", snapshot(rows, "fused_score"))


def _finite(scored: DataFrame) -> DataFrame:
    """Scores as they are; one that is no number is an error."""
    bad = F.col("rerank_score").isNull() | F.isnan("rerank_score")
    return scored.withColumn("rerank_score", F.when(bad, F.raise_error(F.lit("reranker returned invalid scores")).cast("double")).otherwise(F.col("rerank_score")))


@stage("rerankFilter")
def rerank_filter(ctx: Context) -> Context:
    """Keep the best candidates by a reranker, where one is given and switched on; all of them where it fails."""
    f = ctx.config["filter"]
    if f["provider"] == "rerank" and ctx.scorer is None:
        return ctx.logged("rerankFilter", ctx.failure("reranker_unavailable"))
    if f["provider"] != "rerank":
        return ctx.logged("rerankFilter", ctx.candidates.groupBy("query_id").agg(F.count("*").alias("count"), F.lit(False).alias("enabled")))
    asked = ctx.candidates.drop("rerank_score").join(ctx.queries.select("query_id", "query"), "query_id")
    passage = F.substring("text", 1, f["maxPassageTokens"] * 6)
    scored, reason = ctx.attempted(lambda: _finite(ctx.scorer(asked.withColumn("passage", passage)).drop("query", "passage")).withColumn("kept", F.col("rerank_score") >= f["threshold"]))
    if scored is None:
        return ctx.logged("rerankFilter", ctx.failure(reason))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc_nulls_last("score"), F.desc("mtime"), "pos")
    ranked = scored.where("kept").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= f["keepK"]).drop("kept")
    note = scored.groupBy("query_id").agg(F.count("*").alias("scored"), F.least(F.sum(F.col("kept").cast("int")), F.lit(f["keepK"])).alias("kept"))
    return replace(ctx, candidates=ranked).logged("rerankFilter", note)


def with_staleness(rows: DataFrame, live: DataFrame | None) -> DataFrame:
    """Add ``stale``: the file changed after it was indexed, or is gone from every root."""
    if live is None:
        return rows.withColumn("stale", F.lit(False))
    root = F.col("root_ord") if "root_ord" in live.columns else F.lit(0)
    first = live.groupBy("source").agg(F.min_by("mtime_ms", root).alias("_live"))
    joined = rows.join(first, "source", "left")
    return joined.withColumn("stale", F.col("_live").isNull() | (F.col("_live") > F.col("mtime"))).drop("_live")


def budget_positions(items: Column, most: int, per_chunk: int) -> Column:
    """Positions of the items that greedy packing admits; items: array of (pos, tokens) in order.

    An item that would go over is passed over and packing goes on; the first one is admitted at any size.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        cost = F.least(x["tokens"].cast("bigint"), F.lit(per_chunk).cast("bigint"))
        skip = (s["used"] >= most) | ((s["used"] + cost > most) & (F.size(s["kept"]) > 0))
        return F.when(skip, s).otherwise(F.struct((s["used"] + cost).alias("used"), F.concat(s["kept"], F.array(x["pos"].cast("int"))).alias("kept")))

    return F.aggregate(items, start, step, lambda s: s["kept"])


def gate(rows: DataFrame, retrieval: dict, now_ms: int, live: DataFrame | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Candidates with ``drop_reason`` (null: selected), scores, and ``rank`` among the selected.

    In order: below the threshold, only found by keywords and too far down, stale, equal to an earlier candidate; what
    is left is scored and packed into the token budget.
    """
    score, admitted = F.col("score"), F.col("bm25_rank")
    reason = F.when(score < retrieval["threshold"], "belowThreshold")
    reason = reason.when(score.isNull() & (admitted.isNull() | (admitted > retrieval["bm25AdmitTopN"])), "bm25WeakNoDense").when(F.col("stale"), "stale")
    judged = with_staleness(rows, live).withColumn("drop_reason", reason)
    same = Window.partitionBy(*keys, "hash", F.col("drop_reason").isNull()).orderBy("pos")
    judged = judged.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & (F.row_number().over(same) > 1), "dup").otherwise(F.col("drop_reason")))
    judged = judged.withColumn("rank_score", F.coalesce("normalized_fused", "rerank_score", "score"))
    boost, penalty = S.recency_boost(F.col("mtime"), now_ms, retrieval["recencyWeight"]), S.tier_penalty(F.col("type"), retrieval["tierPenalties"])
    judged = judged.withColumn("final_score", F.coalesce("rank_score", F.lit(0.0)) + boost - penalty)
    order = Window.partitionBy(*keys, F.col("drop_reason").isNull()).orderBy(F.desc(F.round("final_score", 9)), F.desc("mtime"), "pos")
    placed = judged.withColumn("place", F.row_number().over(order))
    # a query has at most the candidates of its lists
    items = F.collect_list(F.when(F.col("drop_reason").isNull(), F.struct(F.col("place").alias("pos"), F.col("token_count").alias("tokens")))).over(Window.partitionBy(*keys))
    out = placed.withColumn("packed", budget_positions(F.array_sort(items), retrieval["maxTotalTokens"], retrieval["chunkTokens"]))
    spot = F.array_position("packed", F.col("place"))
    out = out.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & (spot == 0), "budget").otherwise(F.col("drop_reason")))
    return out.withColumn("rank", F.when(F.col("drop_reason").isNull(), spot.cast("int"))).drop("packed", "place", "stale")


def drop_counts(gated: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    return gated.where("drop_reason is not null").groupBy(*keys, "drop_reason").agg(F.count("*").alias("n"))


@stage("freeGates")
def free_gates(ctx: Context) -> Context:
    gated = gate(ctx.candidates, ctx.config["retrieval"], ctx.now_ms, ctx.live)
    per_reason = drop_counts(gated).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("drop_reason", "n")))).alias("drops"))
    note = gated.groupBy("query_id").agg(F.count_if(F.col("drop_reason").isNull()).alias("selected")).join(per_reason, "query_id", "left")
    return replace(ctx, gated=gated, selected=gated.where("drop_reason is null")).logged("freeGates", note)


def assemble_context(selected: DataFrame, per_chunk: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys, additional_context): cited lines of the selected chunks by rank, in their wrapping."""
    body = X.truncate(F.col("text"), F.col("token_count"), per_chunk)
    line = X.citation(F.col("source"), F.coalesce(F.nullif("date", F.lit("")), X.day_of(F.col("mtime"))), F.col("type"), body)
    rows = selected.select(*keys, F.struct("rank", line.alias("line")).alias("x"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return rows.groupBy(*keys).agg(lines.alias("lines")).select(*keys, F.concat(F.lit(OPENING + "\n"), "lines", F.lit("\n" + CLOSING)).alias("additional_context"))


@stage("assemble")
def assemble(ctx: Context) -> Context:
    """Every query has a context; one without a selection has an empty one."""
    made = assemble_context(ctx.selected, ctx.config["retrieval"]["chunkTokens"])
    all_ = ctx.queries.select("query_id").join(made, "query_id", "left").withColumn("additional_context", F.coalesce("additional_context", F.lit("")))
    note = all_.select("query_id", (F.col("additional_context") != "").alias("injected"), F.length("additional_context").alias("bytes"))
    return replace(ctx, assembled=all_).logged("assemble", note)


def run_pipeline(ctx: Context) -> Context:
    """Run the configured stages in order; an unknown name is an error."""
    names = ctx.config["retrieval"]["pipeline"]
    if unknown := [n for n in names if n not in STAGES]:
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    ctx = replace(ctx, queries=ctx.queries.where(X.trim(F.col("query")) != ""))
    for name in names:
        ctx = STAGES[name](ctx)
    return ctx


def hook_payload(assembled: DataFrame) -> DataFrame:
    """The JSON that a client prints for each query with a context."""
    inner = F.struct(F.lit("UserPromptSubmit").alias("hookEventName"), F.col("additional_context").alias("additionalContext"))
    return assembled.where("additional_context <> ''").select("query_id", F.to_json(F.struct(inner.alias("hookSpecificOutput"))).alias("payload"))


def recall_items(selected: DataFrame) -> DataFrame:
    """What the recall tool shows of each selected chunk."""
    shown = [S.rounded(c).alias(n) for n, c in (("cosine", F.col("score")), ("bm25", F.col("bm25_score")), ("fused", F.coalesce("normalized_fused", "fused_score")))]
    return selected.select("query_id", "rank", "source", "section", F.coalesce(F.nullif("date", F.lit("")), X.day_of(F.col("mtime"))).alias("date"), *shown, "text")


def recall_text(items: DataFrame) -> DataFrame:
    """(query_id, rendered): the items of each query as text."""
    scores = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in ("cosine", "bm25", "fused")])
    shown = F.array_join(F.array_compact(scores), " ")
    head = F.concat("source", F.lit(" · "), "date", F.when(shown != "", F.concat(F.lit(" · "), shown)).otherwise(""))
    rows = items.select("query_id", F.struct("rank", F.concat(head, F.lit("\n"), "text").alias("t")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("rendered"))
