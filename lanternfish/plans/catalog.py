"""The registered queries: each operator over the driver's tables, whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import globs
from ..functions import scores as S
from ..functions import text as X
from ..operators import audit, chunking, dense, embed, evaluation, fulltext, index, rerank, stages
from ..operators.shared import remove, settled, shared_folder
from ..sources import tables
from ..sources.corpus import read_corpus
from ..sources.tables import table
from ..streaming import freshness
from . import config as settings
from .oracles import ALLOW, DENY, ORACLE_SQL  # noqa: F401

NOW_MS = 1_767_225_600_000
OPTIONS = chunking.ChunkOptions(target_tokens=60, min_tokens=8, max_tokens=90)
RETRIEVAL = settings.make()["retrieval"] | {"threshold": 0.45}
POOL_K = 30

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- shared inputs


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    return tables.document_chunks(table(spark, d, "documents"))


def vectors_of(spark: SparkSession, d: str) -> DataFrame:
    known = chunks_of(spark, d).select("id", "doc_id")
    return known.join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("id", F.col("embedding").alias("vector"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the benchmark's texts, with the vector of the same number."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return table(spark, d, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "vector")


def context(spark: SparkSession, d: str, over: dict | None = None, live: bool = False, scorer=None) -> stages.Context:
    chunks = chunks_of(spark, d)
    conf = settings.make(settings.merged({"retrieval": {"threshold": 0.45}}, over or {}))
    return stages.Context(conf, asked(spark, d), chunks, vectors_of(spark, d), NOW_MS, tables.live_files(chunks) if live else None, scorer=scorer)


def after(ctx: stages.Context, *names: str) -> stages.Context:
    for n in names:
        ctx = stages.STAGES[n](ctx)
    return ctx


def fused(spark: SparkSession, d: str, **how) -> stages.Context:
    return after(context(spark, d, **how), "denseRetrieve", "bm25Retrieve", "rrfFuse")


def r6(name: str):
    return S.rounded(F.col(name)).alias(name)


# --- retrieval


@query
def knn_topk(spark, d):
    found = dense.nearest(asked(spark, d), vectors_of(spark, d), 10)
    return found.select("query_id", "id", r6("distance"), r6("score"), "dense_rank")


@query
def threshold_gate(spark, d):
    rows = dense.nearest(asked(spark, d), vectors_of(spark, d), 10)
    return rows.select("query_id", "id", (F.col("score") >= 0.45).alias("kept"))


@query
def bm25_topk(spark, d):
    return fulltext.search_text(asked(spark, d), fulltext.scan(chunks_of(spark, d)), 10)


def paired_words(text):
    """Each pair of adjacent words joined by an underscore, which the index sees as a phrase."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit("_"), F.get(found, i + 1))), " ")


@query
def bm25_phrase(spark, d):
    """Every pair of adjacent words of each query as a phrase, in all indexed columns."""
    queries = asked(spark, d).withColumn("query", paired_words(F.col("query")))
    counts = fulltext.phrase_counts(fulltext.query_phrases(queries), fulltext.scan(chunks_of(spark, d)))
    return counts.select("query_id", "phrase_no", "id", "tf")


def stored_index(spark, d) -> index.IndexStore:
    """An index version of all documents in the shared folder."""
    store = index.IndexStore(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    store.init()
    chunks = chunks_of(spark, d)
    rows = chunks.select("id", "text", "source", "section", "hash", "mtime", "token_count", "date", "type", F.lit(1).cast("bigint").alias("created_at"), F.lit(2).cast("bigint").alias("updated_at"))
    vectors = vectors_of(spark, d).join(chunks.select("id", "hash"), "id").select("id", "hash", F.lit("mine").alias("embedder_id"), F.col("vector").cast("array<float>").alias("vector"))
    store.write(rows, vectors, {"embedder_id": "mine", "embedder_dimension": 64})
    return store


@query
def stored_search(spark, d):
    """Keyword search over the stored postings; equal to the search that tokenises."""
    store = stored_index(spark, d)
    found = settled(fulltext.search_text(asked(spark, d), store.text_index(), 10))
    remove(spark, store.folder)
    return found


def over_stored(spark, d, store: index.IndexStore) -> dict:
    """Searches that read a stored index, by name; for the bench."""
    conf = settings.make({"retrieval": {"threshold": 0.45}})

    def hybrid():
        return stages.run_pipeline(stages.Context(conf, asked(spark, d), store.table("chunks"), store.table("vectors").select("id", "vector"), NOW_MS, index=store.text_index())).assembled

    return {"bm25_topk_stored": lambda: fulltext.search_text(asked(spark, d), store.text_index(), 10), "hybrid_retrieve_stored": hybrid}


@query
def index_counts(spark, d):
    """What the stored index tells of itself: rows, tables and meta data, after one of these was replaced."""
    store = stored_index(spark, d)
    store.set_meta({"embedder_id": "yours"})
    n = store.counts()
    row = (n["chunks"], n["indexed"], n["vectors"], n["files"], store.exists("postings"), store.exists("nothing"), str(store.meta("embedder_id")), str(store.meta("embedder_dimension")), store.meta("unknown") is None, store.backfill())
    remove(spark, store.folder)
    return spark.createDataFrame([row], "chunks bigint, indexed bigint, vectors bigint, files bigint, has_postings boolean, has_nothing boolean, embedder_id string, embedder_dimension string, unknown_is_null boolean, backfilled boolean")


@query
def reindex_needed(spark, d):
    """Chunks that another embedder has to embed again, and those whose vectors the same one keeps."""
    chunks = chunks_of(spark, d)
    held = chunks.select("id", "hash", F.lit("mine").alias("embedder_id"))
    out = None
    for name in ("mine", "other"):
        todo, kept = index.split_by_vector(chunks, held, name)
        one = todo.agg(F.count("*").alias("todo")).join(kept.agg(F.count("*").alias("kept"))).select(F.lit(name).alias("embedder_id"), "todo", "kept")
        out = one if out is None else out.unionByName(one)
    return out


@query
def rrf_fuse(spark, d):
    rows = fused(spark, d).candidates
    return rows.select("query_id", "id", "pos", "dense_rank", "bm25_rank", r6("score"), r6("bm25_score"), r6("fused_score"), r6("normalized_fused"))


@query
def bm25_only_admission(spark, d):
    gated = stages.gate(fused(spark, d).candidates, RETRIEVAL, NOW_MS)
    return gated.where("score is null").select("query_id", "id", "bm25_rank", F.coalesce(F.col("drop_reason") != "bm25WeakNoDense", F.lit(True)).alias("admitted"))


@query
def free_gates(spark, d):
    gated = after(fused(spark, d, live=True), "freeGates").gated
    return gated.select("query_id", "id", "pos", "drop_reason", "rank", r6("rank_score"), r6("final_score"))


@query
def drop_reasons(spark, d):
    return stages.drop_counts(after(fused(spark, d, live=True), "freeGates").gated)


@query
def dedup_by_hash(spark, d):
    """The first source of each content, reduced before the shuffle."""
    return chunks_of(spark, d).groupBy("hash").agg(F.min_by("source", "doc_id").alias("source"))


@query
def staleness_join(spark, d):
    chunks = chunks_of(spark, d)
    return stages.with_staleness(chunks, tables.live_files(chunks)).select("id", "source", "stale")


@query
def recency_tier_score(spark, d):
    rows = chunks_of(spark, d)
    boost, penalty = S.recency_boost(F.col("mtime"), NOW_MS, 0.05), S.tier_penalty(F.col("type"), {"session": 0.05})
    return rows.select("id", S.rounded(boost).alias("boost"), penalty.alias("penalty"), F.round(0.75 + (boost - penalty), 5).alias("final_score"))


@query
def budget_pack(spark, d):
    """Greedy packing of each source's documents in parts of 1000 ids."""
    rows = chunks_of(spark, d).withColumn("src", F.substring_index("source", "/", 1)).withColumn("part", F.floor(F.col("doc_id") / 1000))
    items = F.array_sort(F.collect_list(F.struct(F.col("doc_id").cast("int").alias("pos"), F.col("token_count").alias("tokens"))))
    packed = rows.groupBy("src", "part").agg(items.alias("items"))
    kept = packed.select("src", "part", F.explode(stages.budget_positions(F.col("items"), 1500, 350)).alias("doc_id"))
    return kept.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query
def truncate_chunk(spark, d):
    return chunks_of(spark, d).select("id", X.truncate(F.col("text"), F.col("token_count"), 100).alias("cut"))


@query
def assemble_context(spark, d):
    return after(fused(spark, d), "freeGates", "assemble").assembled


@query
def hybrid_retrieve(spark, d):
    ctx = stages.run_pipeline(context(spark, d, live=True))
    chosen = ctx.selected.groupBy("query_id").agg(F.count("*").alias("n_selected"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]), ",").alias("sources"))
    return ctx.assembled.join(chosen, "query_id", "left").select("query_id", F.coalesce("n_selected", F.lit(0)).alias("n_selected"), "sources", "additional_context")


@query
def rerank_filter(spark, d):
    ctx = context(spark, d, {"filter": {"provider": "rerank", "keepK": 3, "threshold": 0.15}}, scorer=rerank.overlap_scorer)
    rows = after(ctx, "denseRetrieve", "rerankFilter").candidates
    return rows.select("query_id", "id", "pos", r6("rerank_score"))


@query
def recall_items(spark, d):
    return stages.recall_items(after(fused(spark, d), "freeGates").selected).drop("text")


@query
def recall_text(spark, d):
    return stages.recall_text(stages.recall_items(after(fused(spark, d), "freeGates").selected))


@query
def hook_payload(spark, d):
    return stages.hook_payload(after(fused(spark, d), "freeGates", "assemble").assembled).select("query_id", F.sha2("payload", 256).alias("payload_sha256"))


@query
def stage_log(spark, d):
    """What each stage of the pipeline logs: stage, query and a count."""
    ctx = after(fused(spark, d, live=True), "freeGates", "assemble")
    counts = {"denseRetrieve": "count", "bm25Retrieve": "count", "rrfFuse": "count", "freeGates": "selected", "assemble": "bytes"}
    out = None
    for name, rows in ctx.log:
        part = rows.select(F.lit(name).alias("stage"), "query_id", F.col(counts[name]).cast("bigint").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def service_records(spark, d):
    ctx = after(fused(spark, d), "freeGates")
    rows = audit.service_records(ctx.queries, ctx.gated, F.lit("2026-01-01T00:00:00Z"), F.lit(1))
    return rows.select("query_id", "kind", "query_hash", "query_preview", "injected", F.size(F.coalesce("selected", F.array())).alias("n_selected"))


# --- text functions


@query
def estimate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query
def chunk_id(spark, d):
    return chunks_of(spark, d).select("id", "source")


@query
def infer_type_date(spark, d):
    pages = table(spark, d, "pages")
    path = F.concat(F.element_at(F.array(*[F.lit(p) for p in ("memory/sessions/", "memory/users/", "http/public/pages/", ".claude/skills/", "notes/")]), (F.col("page_id") % 5).cast("int") + 1), F.when(F.col("page_id") % 3 == 0, F.lit("2025-03-04-")).otherwise(""), F.col("page_id").cast("string"), F.lit(".md"))
    return pages.select("page_id", X.infer_type(path).alias("type"), X.infer_date(path, tables.FIRST_MS + F.col("page_id") * tables.DAY_MS).alias("date"))


@query
def citation_line(spark, d):
    rows = chunks_of(spark, d)
    return rows.select("id", X.citation(F.col("source"), F.col("date"), F.col("type"), F.col("text")).alias("line"))


@query
def injection_sources(spark, d):
    rows = chunks_of(spark, d)
    line = X.citation(F.col("source"), F.col("date"), F.col("type"), F.col("text"))
    return rows.select("id", F.explode(X.cited_sources(line)).alias("x")).select("id", F.col("x.source").alias("source"), F.col("x.date").alias("date"))


@query
def redact_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", X.redact(F.col("text")).alias("preview"))


def enveloped():
    """Conversation texts in the envelopes of a chat."""
    t, kind = F.col("text"), F.col("turn") % 5
    out = F.when(kind == 0, F.concat(F.lit("<current-message>\n"), t, F.lit("\n</current-message>")))
    out = out.when(kind == 1, F.concat(F.lit("[chat 1] ann said: "), t)).when(kind == 2, F.concat(t, F.lit("\n---- reply via: node send.js x")))
    return out.when(kind == 3, F.concat(F.lit("<replying-to>old\ntext</replying-to> "), t)).otherwise(F.concat(F.lit("  "), t, F.lit(" \n")))


@query
def normalize_prompt(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.normalize_prompt(enveloped()).alias("prompt"))


@query
def clean_prompt(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.clean_prompt(enveloped()).alias("prompt"))


@query
def substantive_filter(spark, d):
    rows = table(spark, d, "conversations")
    text = F.when(F.col("turn") % 3 == 0, F.col("role")).when(F.col("turn") == 4, F.concat(F.lit("Heartbeat CHECK "), "text")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", X.is_substantive(text).alias("substantive"))


@query
def extract_prompt(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"prompt":"","message":" ask '), F.col("user_id").cast("string"), F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit(" plain "), "event_type"))
    return table(spark, d, "events").select("event_id", X.extract_prompt(raw).alias("prompt"))


@query
def fixture_date(spark, d):
    rows = table(spark, d, "conversations")
    stated = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n  Date: 2025-03-0"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit(" \nmore"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("It was dated 2024-12-24, "), "text")).otherwise(F.col("text"))
    date = X.fixture_date(stated)
    return rows.select("conv_id", "turn", date.alias("date"), X.noon_ms(date).alias("mtime"))


@query
def glob_policy(spark, d):
    path = F.regexp_replace("url", "^https?://[^/]*/?", "")
    return table(spark, d, "pages").select("page_id", globs.Policy(ALLOW, DENY).column(path, F.concat(F.lit("/srv/"), path)).alias("allowed"))


# --- chunking


@query
def section_split(spark, d):
    lines = chunking.lines_of(tables.markdown_documents(table(spark, d, "conversations")))
    return chunking.sections_of(lines).select("source", F.col("section_id").cast("bigint").alias("section_id"), "heading", F.sha2("text", 256).alias("hash"), "tokens")


@query
def heading_occurrence(spark, d):
    lines = chunking.lines_of(tables.markdown_documents(table(spark, d, "conversations")))
    return chunking.sections_of(lines).select("source", F.col("section_id").cast("bigint").alias("section_id"), "slug", F.col("occurrence").cast("bigint").alias("occurrence"))


@query
def semantic_units(spark, d):
    lines = chunking.lines_of(tables.markdown_documents(table(spark, d, "conversations")))
    return chunking.units_of(lines).select("source", F.col("section_id").cast("bigint").alias("section_id"), F.col("unit_no").cast("bigint").alias("unit_no"), F.sha2("unit", 256).alias("hash"))


@query
def split_decision(spark, d):
    lines = chunking.lines_of(tables.markdown_documents(table(spark, d, "conversations")))
    rows = chunking.sections_of(lines)
    return rows.select("source", F.col("section_id").cast("bigint").alias("section_id"), X.needs_split(F.col("tokens"), F.col("list_items"), F.col("bold_labels"), OPTIONS.target_tokens, OPTIONS.max_tokens).alias("split"))


@query
def coalesce_units(spark, d):
    lines = chunking.lines_of(tables.markdown_documents(table(spark, d, "conversations")))
    return chunking.coalesce_units(chunking.units_of(lines), OPTIONS)


@query
def chunk_documents(spark, d):
    rows = chunking.chunk_documents(tables.markdown_documents(table(spark, d, "conversations")), OPTIONS)
    return rows.select("id", "text", "source", "section", "hash", "mtime", "token_count", "metadata.date", "metadata.type")


@query
def long_split_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.word_windows(F.col("text"), 350, 500)).alias("i", "w"))
    return rows.select("doc_id", F.col("i").cast("bigint").alias("i"), F.sha2("w", 256).alias("hash"))


@query
def chunk_fingerprint(spark, d):
    return table(spark, d, "region").select("r_regionkey", chunking.fingerprint(chunking.ChunkOptions()).alias("fingerprint"))


# --- full text


@query
def postings(spark, d):
    rows = fulltext.postings(chunks_of(spark, d))
    return rows.groupBy("term", "id", "col").agg(F.count("*").alias("tf"), F.min("pos").cast("bigint").alias("first_pos"))


@query
def doc_stats(spark, d):
    return fulltext.doc_stats(chunks_of(spark, d))


@query
def fts_query_terms(spark, d):
    terms = X.query_terms(F.col("query"))
    return asked(spark, d).select("query_id", F.size(terms).cast("bigint").alias("n_terms"), F.sha2(X.match_expression(terms), 256).alias("expression_sha256"))


# --- index


def versions(spark, d):
    docs = table(spark, d, "documents")
    return tables.document_chunks(docs), tables.document_chunks(tables.second_version(docs))


@query
def index_diff(spark, d):
    return index.diff(*versions(spark, d))


@query
def index_merge_counts(spark, d):
    return index.change_counts(index.diff(*versions(spark, d)))


@query
def index_merge(spark, d):
    old, new = versions(spark, d)
    old = old.withColumn("created_at", F.lit(1_000).cast("bigint"))
    return index.merge(old, new, 2_000).select("id", "hash", "created_at", F.col("updated_at").cast("bigint").alias("updated_at"))


@query
def embed_needed(spark, d):
    old, new = versions(spark, d)
    held = old.select("id", "hash", F.when(F.col("doc_id") % 13 == 0, "other").otherwise("mine").alias("embedder_id"))
    todo, _ = index.split_by_vector(new, held, "mine")
    return todo.select("id", "hash")


@query
def corpus_signature(spark, d):
    rows = chunks_of(spark, d).select("source", "mtime", F.octet_length("text").alias("size"))
    return index.corpus_signature(rows)


@query
def toc(spark, d):
    return audit.toc(toc_rows(spark, d)).select("type", "source", "date", "n_chunks", F.array_join("sections", ",").alias("sections"))


def toc_rows(spark, d):
    rows = table(spark, d, "documents")
    mtime = tables.FIRST_MS + F.col("doc_id") * tables.DAY_MS
    return rows.select("source", F.col("lang").alias("section"), mtime.alias("mtime"), F.col("doc_id").alias("ord"), X.day_of(mtime).alias("date"), tables.tier_of(F.col("doc_id")).alias("type"))


@query
def toc_tier(spark, d):
    return audit.toc(toc_rows(spark, d), "session").select("type", "source", "date", "n_chunks")


@query
def toc_text(spark, d):
    return audit.toc_lines(audit.toc(toc_rows(spark, d)), full=True)


# --- evaluation


def judged(spark, d):
    """Cases, pools, grades and forbidden sources from the embeddings' classes and the labels."""
    named = chunks_of(spark, d).drop("source").withColumn("source", F.col("doc_id").cast("string"))
    all_ = table(spark, d, "embeddings")
    asked_ = all_.where("vec_id % 50 = 0").select(F.col("vec_id").alias("case_id"), "label", F.col("embedding").alias("vector"))
    vectors = named.join(all_, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("id"), F.col("embedding").alias("vector"))
    pools = dense.nearest(asked_.select(F.col("case_id").alias("query_id"), "vector"), vectors, POOL_K).withColumnRenamed("query_id", "case_id")
    pools = pools.join(named.drop("id").withColumn("id", F.col("doc_id")), "id").withColumn("score", F.round("score", 9))
    relevant = all_.where("label < 9").select("label", F.col("vec_id").cast("string").alias("source"), (F.col("vec_id") % 3 + 1).alias("grade"))
    grades = asked_.select("case_id", "label").join(relevant, "label").select("case_id", "source", "grade")
    banned = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("source")).distinct()
    forbidden = pools.join(banned, "source", "left_semi").select("case_id", "source").distinct()
    return asked_.select("case_id"), pools, grades, forbidden


def rounded_all(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def ranking_metrics(spark, d):
    cases, pools, grades, _ = judged(spark, d)
    return rounded_all(evaluation.ranking_metrics(cases, pools, grades, 5))


@query
def eval_cases(spark, d):
    return rounded_all(evaluation.evaluate(*judged(spark, d), RETRIEVAL, NOW_MS))


@query
def eval_summary(spark, d):
    return rounded_all(evaluation.summarize(evaluation.evaluate(*judged(spark, d), RETRIEVAL, NOW_MS)))


@query
def baseline_gate(spark, d):
    low = {"mean_ndcg_at_k": 0.05, "injected_f1": 0.001, "quiet_accuracy": 0.0, "max_forbid_violations": 1_000_000}
    high = {"mean_ndcg_at_k": 0.05, "injected_f1": 0.999, "quiet_accuracy": 0.0, "max_forbid_violations": 1_000_000}
    summary = settled(evaluation.summarize(evaluation.evaluate(*judged(spark, d), RETRIEVAL, NOW_MS)))
    rows = [evaluation.passes(summary, f).select(F.lit(name).alias("floors"), "cases", "passes") for name, f in (("low", low), ("high", high), ("none", {"max_forbid_violations": -1}))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def golden_partition(spark, d):
    """Golden cases read from a file, and how many of them gate a baseline, by what they expect."""
    path = f"{shared_folder(spark)}/golden-{uuid.uuid4().hex}"
    cases = table(spark, d, "benchmark").select(F.concat(F.lit("g"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("query"), F.when(F.col("item_id") % 3 > 0, F.array(F.struct(F.lit("corpus/a.md").alias("source"), F.lit(2).alias("grade")))).otherwise(F.array().cast("array<struct<source:string,grade:int>>")).alias("expect"), F.array(F.lit("corpus/b.md")).alias("forbid"), F.when(F.col("item_id") % 4 == 0, True).alias("requiresFilter"))
    cases.write.json(path)
    read = settled(evaluation.golden_cases(spark, path, multi_line=False))
    remove(spark, path)
    shown = read.withColumn("should_hit", F.size("expect") > 0).withColumnRenamed("id", "case_id")
    gating, needs = evaluation.gating(shown.drop("requires_filter"), shown.select("case_id", "requires_filter"))
    rows = gating.withColumn("gates", F.lit(True)).unionByName(needs.withColumn("gates", F.lit(False)))
    return rows.groupBy("gates", "should_hit").agg(F.count("*").alias("cases"), F.sum(F.length("query")).alias("chars"), F.min("forbid").getItem(0).alias("forbid"))


@query
def sweep_grid(spark, d):
    cases, pools, grades, forbidden = judged(spark, d)
    rows = evaluation.sweep(cases, pools, grades, forbidden, RETRIEVAL, NOW_MS, evaluation.sweep_values("0.30:0.60:0.05"), [0.0, 0.05], [3, 5])
    return rounded_all(rows.select("threshold", "recency_weight", "top_k", "injected_f1", "injected_recall", "quiet_accuracy", "mean_ndcg_at_k", "forbid_violations", "place"))


# --- files, logs and transcripts


def written(rows: DataFrame, folder: str) -> None:
    """Write texts (path, text) as files below a folder that driver and executors share."""
    root = folder.removeprefix("file://").removeprefix("file:")

    def write(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                full = f"{root}/{path}"
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(f"{full}.part", "w", encoding="utf-8", newline="") as f:
                    f.write(text)
                os.replace(f"{full}.part", full)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("path", "text").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


@query
def corpus_walk(spark, d):
    """Markdown files below two roots, read by the corpus source: of one name the later root's, none that the policy denies."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = tables.markdown_documents(table(spark, d, "conversations")).withColumn("n", F.regexp_extract("source", "([0-9]+)[.]md", 1).cast("bigint"))
    number = F.col("n")
    secret = docs.withColumn("source", F.when(number % 5 == 1, F.regexp_replace("source", "sessions/", "sessions/api-keys/")).when(number % 5 == 2, F.regexp_replace("source", "[.]md$", ".txt")).when(number % 5 == 3, F.regexp_replace("source", "[.]md$", ".MARKDOWN")).otherwise(F.col("source")))
    one = secret.where(number % 3 != 2).select(F.concat(F.lit("one/"), "source").alias("path"), "text")
    two = secret.where(number % 3 != 0).select(F.concat(F.lit("two/"), "source").alias("path"), F.concat("text", F.lit("\n\nlater")).alias("text"))
    written(one.unionByName(two), folder)
    roots = [f"{folder}/{r}".removeprefix("file://").removeprefix("file:") for r in ("one", "two")]
    config = settings.make({"corpus": {"roots": [*roots, f"{roots[0]}-missing"], "allow": ["memory/sessions/**"], "maxFileBytes": 4000}})
    found = settled(read_corpus(spark, config, ordered=True).select("source", "root_ord", "size", F.sha2("text", 256).alias("hash")))
    remove(spark, folder)
    return found


@query
def log_round_trip(spark, d):
    """A log appended to twice as lines of JSON and read back: its last records by time."""
    folder = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    log = event_log(spark, d).select("kind", "ts", "query_hash", "outcome", "duration_ms", "injected", "event_id")
    audit.append_log(log.where("event_id % 2 = 0"), folder)
    audit.append_log(log.where("event_id % 2 = 1"), folder)
    read = settled(audit.read_log(spark, folder).withColumn("line_no", F.try_variant_get("record", "$.event_id", "bigint")))
    remove(spark, folder)
    last = audit.last_records(read, 20)
    return last.select(F.col("line_no").alias("event_id"), "ts", audit.log_kind(F.col("kind")).alias("kind"), "query_hash", "duration_ms")


@query
def transcript_sessions(spark, d):
    """Conversations as transcript files, read back: prompts and injected turns of each."""
    folder = f"{shared_folder(spark)}/transcripts-{uuid.uuid4().hex}"
    user = F.to_json(F.struct(F.lit("user").alias("type"), (F.col("turn") == 2).alias("isMeta"), F.struct(F.col("text").alias("content")).alias("message")))
    block = F.concat(F.lit("<retrieved-memory>\n[a.md · 2026-01-01] "), "text")
    attached = F.to_json(F.struct(F.lit("attachment").alias("type"), F.struct(F.lit("hook_additional_context").alias("type"), F.array(block).alias("content")).alias("attachment")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", user).when(F.col("turn") % 3 == 1, attached).otherwise(F.lit("{broken")).alias("line"))
    files = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    written(files.select(F.concat(F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), "text"), folder)
    lines = audit.transcript_lines(spark, folder)
    found = settled(audit.session_summary(audit.turns(lines)).select(F.regexp_extract("session", "([0-9]+)[.]jsonl", 1).cast("bigint").alias("conv_id"), "turns", "injected_turns"))
    remove(spark, folder)
    return found


@query
def hashed_vectors(spark, d):
    """Vectors of the benchmark's texts by the hashing embedder, a row for each component that is not nil."""
    rows = embed.with_vectors(table(spark, d, "benchmark").select("item_id", "text"), embed.HashingEmbedder(16), "passage")
    parts = rows.select("item_id", F.posexplode("vector").alias("i", "x")).where("x <> 0")
    return parts.select("item_id", F.col("i").cast("bigint").alias("i"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query
def clamped_overrides(spark, d):
    """What callers ask for, floored and kept within a tool's bounds."""
    low, high = settings.TOOL_BOUNDS["topK"]
    return table(spark, d, "events").select("event_id", S.clamp(F.col("value") - 20, low, high).cast("bigint").alias("top_k"))


@query
def golden_sources(spark, d):
    docs = table(spark, d, "documents")
    given = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("corpus/"), "source")).otherwise(F.col("source"))
    return docs.select("doc_id", X.normalize_source(given).alias("source"))


def event_log(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "client").when(F.col("event_id") % 4 == 1, "service")
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("delivered", "empty", "error", "timeout")]), (F.col("user_id") % 4).cast("int") + 1)
    return e.select("event_id", kind.alias("kind"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.sha2(F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 40).cast("string")), 256).alias("query_hash"), F.when(kind == "client", outcome).alias("outcome"), F.floor(F.col("value")).cast("bigint").alias("duration_ms"), (F.col("event_id") % 2 == 1).alias("injected"))


@query
def retrieval_log_summary(spark, d):
    return audit.log_summary(event_log(spark, d))


@query
def service_client_join(spark, d):
    return audit.matched_log(event_log(spark, d)).select("event_id", "query_hash", "client_outcome", "client_ms")


@query
def log_lines(spark, d):
    return audit.log_lines(event_log(spark, d).withColumn("ts", F.to_timestamp("ts"))).select("event_id", "line")


@query
def turn_injection_asof(spark, d):
    rows = table(spark, d, "conversations")
    lines = rows.select(F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), F.when(F.col("role") == "user", F.col("text")).alias("prompt"), F.when(F.col("role") == "assistant", F.col("text")).alias("injection"))
    return audit.turns(lines).select("session", F.col("turn_id").cast("bigint").alias("turn_id"), "line_no", "prompt", "injection")


# --- streams


@query
def stream_debounce_sessions(spark, d):
    return freshness.debounced(table(spark, d, "events"), "user_id", quiet="6 hours")


@query
def stream_incremental_index(spark, d):
    """Documents arrive in three files; each micro-batch merges its own into the chunks so far, the last state returns."""
    folder = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents")
    for i in range(3):
        docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)) == i).write.mode("append").parquet(f"{folder}/in")
    state = {"path": None}

    def merge(batch: DataFrame, n: int) -> None:
        new = tables.document_chunks(batch).select("id", "hash", "mtime")
        if state["path"]:
            old = spark.read.parquet(state["path"])
            new = old.join(new, "id", "left_anti").unionByName(new)
        path = f"{folder}/v{n}"
        new.write.mode("overwrite").parquet(path)
        state["path"] = path

    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    stream.writeStream.foreachBatch(merge).trigger(availableNow=True).option("checkpointLocation", f"{folder}/cp").start().awaitTermination()
    last = settled(spark.read.parquet(state["path"]))
    remove(spark, folder)
    return last


def flagship(spark, d):
    return hybrid_retrieve(spark, d)
