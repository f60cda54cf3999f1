"""Command line: index, build-index, watch, serve, query, retrieve, recall, toc, inspect, eval and config.

    python -m lanternfish.cli --config config.json index
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import scores as S
from .functions import text as X
from .operators import audit, embed, evaluation, index, rerank, stages
from .plans import config as settings
from .service import client, server
from .sources.corpus import read_corpus
from .streaming import freshness


def embedder_of(config: dict) -> embed.Embedder:
    """The configured ONNX model where its files are named, else hashed words."""
    e = config["embedder"]
    if e.get("modelPath"):
        return embed.OnnxEmbedder(e["modelPath"], e["tokenizerPath"], e["dimension"])
    return embed.HashingEmbedder(e["dimension"])


def scorer_of(config: dict):
    """The configured reranker where it is switched on: the ONNX model where its files lie, else the overlap of words."""
    f = config["filter"]
    if f["provider"] != "rerank":
        return None
    folder = os.path.join(f["cacheDir"], f["model"])
    model, tokenizer = f.get("modelPath") or os.path.join(folder, f"model_{f['dtype']}.onnx"), f.get("tokenizerPath") or os.path.join(folder, "tokenizer.json")
    if os.path.exists(model) and os.path.exists(tokenizer):
        return rerank.model_scorer(rerank.OnnxReranker(model, tokenizer))
    return rerank.overlap_scorer


def asked(spark: SparkSession, embedder: embed.Embedder, prompts: list[str]):
    rows = spark.createDataFrame(list(enumerate(prompts)), "query_id int, query string")
    return embed.with_vectors(rows, embedder, "query", "query")


def retrieval_context(spark: SparkSession, config: dict, store: index.IndexStore, prompts: list[str], now_ms: int) -> stages.Context:
    live = read_corpus(spark, config, content=False).select("source", F.col("mtime").alias("mtime_ms"), "root_ord")
    return stages.Context(config, asked(spark, embedder_of(config), prompts), store.table("chunks"), store.table("vectors").select("id", "vector"), now_ms, live, scorer=scorer_of(config), index=store.text_index(), fail_open=True)


def baseline_floors(path: str | None) -> dict | None:
    """Floors of a baseline file, by the names of a summary's columns; None without a file."""
    if not path or not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    names = {"meanNdcgAtK": "mean_ndcg_at_k", "injectedF1": "injected_f1", "quietAccuracy": "quiet_accuracy", "maxForbidViolations": "max_forbid_violations"}
    return {names[k]: v for k, v in given.items() if k in names}


def evaluate(spark: SparkSession, config: dict, store: index.IndexStore, golden: str, k: int, pool_k: int, now_ms: int, sweep: dict | None = None):
    """Metrics of golden cases over the index, or a sweep; pools are dense only, reranked where the settings say so."""
    cases = evaluation.golden_cases(spark, golden)
    queries = embed.with_vectors(cases.select(F.col("id").alias("query_id"), "query"), embedder_of(config), "query", "query")
    found = stages.nearest(queries, store.table("vectors").select("id", "vector"), max(pool_k, config["retrieval"]["topK"]))
    pools = stages.complete(found.join(store.table("chunks"), "id").withColumnRenamed("query_id", "case_id").withColumn("source", X.normalize_source(F.col("source"))))
    grades = cases.select(F.col("id").alias("case_id"), F.explode("expect").alias("e")).select("case_id", "e.source", "e.grade")
    forbidden = cases.select(F.col("id").alias("case_id"), F.explode("forbid").alias("source"))
    named = cases.select(F.col("id").alias("case_id"), "requires_filter")
    if sweep is not None:
        grid = {"threshold": evaluation.sweep_values("0.30:0.80:0.05"), "recencyWeight": [0.05], "topK": [5.0]} | sweep
        return evaluation.sweep(named, pools, grades, forbidden, config["retrieval"], now_ms, grid["threshold"], grid["recencyWeight"], [int(n) for n in grid["topK"]], k)
    reranked = None
    if config["filter"]["provider"] == "rerank":

        def reranked(rows):
            ctx = stages.Context(config, cases.select(F.col("id").alias("query_id"), "query"), store.table("chunks"), store.table("vectors"), now_ms, candidates=rows.withColumnRenamed("case_id", "query_id"), scorer=scorer_of(config))
            return stages.STAGES["rerankFilter"](ctx).candidates.withColumnRenamed("query_id", "case_id")

    return evaluation.evaluate(named, pools, grades, forbidden, config["retrieval"], now_ms, k, reranked).join(named, "case_id")


def stage_logs(ctx: stages.Context) -> list[dict]:
    """The log of one query's stages."""
    return [{"stage": name} | json.loads(r["record"]) for name, rows in ctx.log for r in rows.drop("query_id").select(F.to_json(F.struct("*")).alias("record")).toLocalIterator()]


def reply_of(ctx: stages.Context) -> dict:
    """A service's reply to one query: context, selected chunks, and the stages' log."""
    context = ctx.assembled.first()
    rows = stages.recall_items(ctx.selected).drop("query_id").withColumnRenamed("text", "_text")
    scores = ctx.selected.select("rank", "id", "text", *[S.rounded(F.col(c)).alias(c) if not c.endswith("_rank") else F.col(c) for c in audit.LOG_SCORES])
    chosen = [r.asDict() for r in rows.join(scores, "rank").drop("_text").orderBy("rank").collect()]
    return {"additionalContext": context["additional_context"] if context else "", "selected": chosen, "stages": stage_logs(ctx)}


def from_service(config: dict, query: str, fetch=None) -> list[dict]:
    """The selected chunks that the running service answers with."""
    s = config["service"]
    over = {k: config["retrieval"][k] for k in settings.TOOL_BOUNDS}
    reply = (fetch or client._post)(f"http://{s['host']}:{s['port']}/retrieve", json.dumps({"query": query} | over).encode(), s["timeoutMs"] / 1000)
    if reply.get("ready") is False:
        raise OSError("the service is not ready")
    return reply.get("selected") or []


def recall(config: dict, query: str, direct, fetch=None) -> list[dict]:
    """Selected chunks by the service, and directly where there is none."""
    try:
        return from_service(config, query, fetch)
    except (OSError, ValueError):
        print("no service answers; reading the index directly", file=sys.stderr)
        return direct()


def recall_block(item: dict) -> str:
    scores = " ".join(f"{c}={item[c]}" for c in ("cosine", "bm25", "fused") if item.get(c) is not None)
    return f"{item['source']} · {item['date']}{' · ' + scores if scores else ''}\n{item['text']}"


def serve(spark: SparkSession, path: str, folder: str):
    """A server whose settings follow their file; it warms up once, and is ready when an index is there."""
    store = index.IndexStore(spark, folder)

    def opened(config: dict):
        spark.range(1).count()  # the first job of a session is the slow one
        return embedder_of(config)

    runtime = server.Runtime(lambda: settings.load(path), opened, lambda: os.stat(path).st_mtime_ns if os.path.exists(path) else None)

    def answer(query: str, over: dict) -> dict:
        asked_ = settings.merged(runtime.config, {"retrieval": settings.clamped(over, defaults=False)})
        return reply_of(stages.run_pipeline(retrieval_context(spark, asked_, store, [query], int(time.time() * 1000))))

    def log(r: dict) -> None:
        audit.append_line(settings.log_path(runtime.config), audit.service_line(r["query"], r["injected"], r["duration_ms"], r["stages"], r["selected"]))

    def ready() -> bool:
        runtime.refresh()
        return runtime.state is not None and store.manifest() is not None

    s = runtime.config["service"]
    return server.make_server(s["host"], s["port"], ready, answer, log, lambda: runtime.refresh())


def watch(spark: SparkSession, path: str, folder: str) -> list:
    """Streams that keep an index fresh: changes of files, and a sweep; builds never overlap."""
    config, store = settings.load(path), index.IndexStore(spark, folder)

    def build() -> dict:
        now = settings.load(path)
        return freshness.build_index(spark, now, store, embedder_of(now), int(time.time() * 1000)) if now["enabled"] else {"enabled": False}

    refresh, streams = freshness.SingleFlight(build), []
    f = config["freshness"]
    if f["enabled"] and f["watch"]:
        streams.append(freshness.watch_stream(spark, config, refresh, f"{folder}/watch"))
    if f["enabled"] and f["sweep"]:
        streams.append(freshness.sweep_stream(spark, refresh, f["sweepIntervalMs"] or 300_000, f"{folder}/sweep"))
    return streams


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lanternfish")
    p.add_argument("--config", default="config.json")
    p.add_argument("--index", default="index")
    p.add_argument("--format", choices=["text", "json"], default="text")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("index")
    sub.add_parser("watch")
    sub.add_parser("serve")
    for verb in ("query", "retrieve", "recall"):
        v = sub.add_parser(verb)
        v.add_argument("prompt", nargs="+")
        v.add_argument("--top-k", type=float)
    t = sub.add_parser("toc")
    t.add_argument("--tier")
    t.add_argument("--full", action="store_true")
    i = sub.add_parser("inspect")
    i.add_argument("path", nargs="?")
    i.add_argument("--log", action="store_true")
    i.add_argument("--last", type=int)
    i.add_argument("--session", default="latest")
    i.add_argument("--full", action="store_true")
    e = sub.add_parser("eval")
    e.add_argument("golden")
    e.add_argument("--k", type=int, default=5)
    e.add_argument("--pool-k", type=int, default=30)
    e.add_argument("--sweep")
    e.add_argument("--baseline")
    g = sub.add_parser("build-index")
    g.add_argument("roots", nargs="+")
    c = sub.add_parser("config")
    c.add_argument("action", choices=["get", "set", "allow", "deny"])
    c.add_argument("words", nargs="*")
    c.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    config = settings.load(a.config)

    if a.verb == "config":
        if a.action == "get":
            value = settings.at(config, a.words[0]) if a.words else config
            print("[redacted]" if a.words and settings.is_sensitive(a.words[0].split(".")[-1]) else json.dumps(value))
            return 0
        changed = settings.set_value(config, *a.words) if a.action == "set" else settings.edit_list(config, a.action, *a.words, force=a.force)
        settings.save(changed, a.config)
        return 0

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store, now_ms = index.IndexStore(spark, a.index), int(time.time() * 1000)

    def show(rows) -> None:
        for r in rows.toLocalIterator():
            print(json.dumps(r.asDict(True), ensure_ascii=False, default=str) if a.format == "json" or len(r) > 1 else r[0])

    if a.verb == "index":
        print(json.dumps(freshness.build_index(spark, config, store, embedder_of(config), now_ms)))
    elif a.verb == "build-index":
        fixtures = settings.for_evaluation(a.roots, {"embedder": config["embedder"]})
        print(json.dumps(freshness.build_index(spark, fixtures, store, embedder_of(fixtures), settings.EVALUATION_NOW_MS, dated=True)))
    elif a.verb == "watch":
        for stream in watch(spark, a.config, a.index):
            stream.awaitTermination()
    elif a.verb == "serve":
        serve(spark, a.config, a.index).serve_forever()
    elif a.verb == "inspect":
        if a.log:
            path = a.path or settings.log_path(config)
            log = audit.read_log(spark, path) if os.path.exists(path) or "://" in path else None
            rows = [] if log is None else [json.loads(r["record"]) for r in audit.last_records(log, a.last or 20).select(F.to_json("record").alias("record")).collect()]
            counts = {"records": 0, "service": 0, "client": 0} if log is None else audit.log_summary(log).first().asDict()
            print(json.dumps({"summary": counts, "records": rows}, ensure_ascii=False) if a.format == "json" else audit.render_log(counts, rows))
        else:
            path = audit.resolve_transcript(a.path or audit.default_transcripts(os.getcwd(), os.path.expanduser("~")), a.session)
            turns = audit.turns(audit.transcript_lines(spark, path))
            found = audit.session_summary(turns).agg(F.sum("turns").alias("n"), F.sum("injected_turns").alias("injected")).first()
            shown = [r.asDict() for r in turns.orderBy(F.desc("turn_id")).limit(a.last or 12).orderBy("turn_id").collect()]
            if a.format == "json":
                print(json.dumps({"turns": found["n"] or 0, "injected_turns": found["injected"] or 0, "shown": shown}, ensure_ascii=False))
            else:
                print(audit.render_session(os.path.basename(path), found["n"] or 0, found["injected"] or 0, shown, a.full))
    elif store.manifest() is None:
        print("there is no index yet", file=sys.stderr)
        return 1
    elif a.verb == "toc":
        rows = audit.toc_lines(audit.toc(store.table("chunks").withColumn("ord", F.col("mtime")), a.tier), a.full).orderBy("type", "source")
        tier = None
        for r in rows.toLocalIterator():
            if a.format == "json":
                print(json.dumps(r.asDict(), ensure_ascii=False))
                continue
            if r["type"] != tier:
                tier = r["type"]
                print(tier)
            print(r["line"])
    elif a.verb == "eval":
        spec = dict(part.split("=") for part in a.sweep.split(",")) if a.sweep else None
        grid = {k: evaluation.sweep_values(v) for k, v in spec.items()} if spec is not None else None
        found = evaluate(spark, config, store, a.golden, a.k, a.pool_k, now_ms, grid)
        if grid is not None or a.format == "json":
            show(found)
            return 0
        gating, _ = evaluation.gating(found.drop("requires_filter"), found.select("case_id", "requires_filter"))
        show(evaluation.report_lines(found).orderBy("case_id").select("line"))
        floors = baseline_floors(a.baseline)
        summary = evaluation.passes(evaluation.summarize(gating), floors or {"max_forbid_violations": sys.maxsize}).first().asDict()
        print("\t".join(f"{k}={v:.3f}" if isinstance(v, float) else f"{k}={v}" for k, v in summary.items()))
        return 0 if summary["passes"] else 1
    else:
        prompt = " ".join(a.prompt)
        if a.verb == "recall":
            tool = settings.with_overrides(config, {} if a.top_k is None else {"topK": a.top_k})
            items = recall(tool, prompt, lambda: reply_of(stages.run_pipeline(retrieval_context(spark, tool, store, [prompt], now_ms)))["selected"])
            print(json.dumps(items, ensure_ascii=False) if a.format == "json" else "\n\n".join(map(recall_block, items)))
            return 0
        ctx = retrieval_context(spark, config, store, [prompt], now_ms)
        if a.verb == "query":
            show(stages.STAGES["denseRetrieve"](ctx).candidates.orderBy("pos").select("pos", "id", "source", "section", "score"))
        else:
            show(stages.run_pipeline(ctx).assembled.select("additional_context"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
