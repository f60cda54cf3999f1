"""Tables of contents, retrieval logs and session transcripts."""

from __future__ import annotations

import hashlib
import json
import os
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions import text as X

LOG_SCORES = ["score", "bm25_score", "dense_rank", "bm25_rank", "fused_score", "normalized_fused", "rerank_score", "rank_score", "final_score"]


def toc(chunks: DataFrame, tier: str | None = None) -> DataFrame:
    """(type, source, date, n_chunks, sections): files by tier, sections in the order of their first chunk."""
    rows = chunks if tier is None else chunks.where(F.col("type") == tier)
    firsts = rows.groupBy("type", "source", "section").agg(F.min("mtime").alias("at"), F.min("ord").alias("ord"), F.max("date").alias("date"), F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.when(F.coalesce("section", F.lit("")) != "", F.struct("ord", "section"))))
    return firsts.groupBy("type", "source").agg(F.max("date").alias("date"), F.sum("n").alias("n_chunks"), F.transform(listed, lambda x: x["section"]).alias("sections"))


def toc_lines(rows: DataFrame, full: bool = False) -> DataFrame:
    """(type, source, line) of each file, to be read in the order of type and source; no row gathers more than a file."""
    line = F.format_string("- %s · %s · %d chunks", "source", "date", "n_chunks")
    if full:
        line = F.concat(line, F.array_join(F.transform("sections", lambda s: F.concat(F.lit("\n  - "), s)), ""))
    return rows.select("type", "source", line.alias("line"))


def last_records(log: DataFrame, n: int) -> DataFrame:
    """The last n records of a log by time, oldest first."""
    return log.orderBy(F.desc("ts"), F.desc("line_no")).limit(n).orderBy("ts", "line_no")


def session_summary(turns_: DataFrame, session: str = "session") -> DataFrame:
    """(session, turns, injected_turns): how many prompts a session has, and how many got a context."""
    return turns_.groupBy(session).agg(F.count("*").alias("turns"), F.count("injection").alias("injected_turns"))


def now_text() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def redacted(text: str) -> str:
    """functions.text.redact for one text on the driver: the same patterns in the same order."""
    line = re.sub(f"^[{X.WS}]+|[{X.WS}]+\\Z", "", re.sub(f"[{X.WS}]+", " ", text))
    for pattern in X.SECRETS:
        line = re.sub(X.python_pattern(pattern), "[redacted]", line)
    return line[:200]


def client_line(query: str, outcome: str, duration_ms: int) -> dict:
    return {"kind": "client", "ts": now_text(), "query_hash": sha256(query), "outcome": outcome, "duration_ms": duration_ms}


def service_line(query: str, injected: bool, duration_ms: int, stages: list, selected: list) -> dict:
    """A record of one retrieval: hash and redacted preview, ids and scores, never the text of a chunk."""
    kept = [{k: r.get(k) for k in ("rank", "id", "source", *LOG_SCORES)} for r in selected]
    return {"kind": "service", "ts": now_text(), "query_hash": sha256(query), "query_preview": redacted(query), "duration_ms": duration_ms, "injected": injected, "stages": stages, "selected": kept}


def append_line(path: str, record: dict) -> None:
    """Append a record to a local log that only its owner reads."""
    os.makedirs(os.path.dirname(path) or ".", mode=0o700, exist_ok=True)
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600), "a", encoding="utf-8") as f:
        f.write(json.dumps(record, ensure_ascii=False) + "\n")


def _score(row: dict, key: str) -> str:
    return "" if row.get(key) is None else f"@{row[key]}"


def stage_line(stage: dict) -> str:
    """One line of a stage's log."""
    name, found = stage.get("stage", "stage"), stage.get("candidates")
    if stage.get("fail_open"):
        return f"{name} fail_open reason={stage.get('reason')}"
    key = {"denseRetrieve": "score", "bm25Retrieve": "bm25_score", "rrfFuse": "fused_score"}.get(name)
    if key:
        listed = ",".join(f"{c['id']}{_score(c, key)}" for c in found or []) or "(none)"
        return f"{name} count={stage.get('count') or 0} candidates={listed}"
    if name == "rerankFilter":
        return f"{name} enabled=false count={stage.get('count') or 0}" if stage.get("enabled") is False else f"{name} scored={stage.get('scored')} kept={stage.get('kept')}"
    if name == "freeGates":
        drops = ",".join(f"{k}:{v}" for k, v in sorted((stage.get("drops") or {}).items())) or "(none)"
        return f"{name} selected={stage.get('selected') or 0} drops={drops}"
    if name == "assemble":
        return f"{name} injected={str(bool(stage.get('injected'))).lower()} bytes={stage.get('bytes') or 0}"
    return f"{name} {json.dumps(stage, sort_keys=True)}"


BAR = "─" * 42


def _when(ts: str | None) -> str:
    return ts[:19].replace("T", " ") if ts else "(no ts)"


def render_log(summary: dict, records: list[dict]) -> str:
    """The last records of a log as text, under its counts."""
    out = [f"# records: {summary['records']} total, showing last {len(records)}", f"# service/client: {summary['service']}/{summary['client']}", ""]
    for r in records:
        head = f"[{_when(r.get('ts'))}] {'CLIENT' if r.get('kind') == 'client' else 'SERVICE'} {(r.get('query_hash') or '')[:12] or '(no hash)'}"
        took = f"{r['duration_ms']}ms" if r.get("duration_ms") is not None else "?ms"
        out.append(BAR)
        if r.get("kind") == "client":
            out.append(f"{head} outcome={r.get('outcome') or 'unknown'} duration={took}")
            continue
        out.append(f"{head} injected={str(bool(r.get('injected'))).lower()} duration={took}")
        if r.get("query_preview"):
            out.append(f"   query: {r['query_preview']}")
        if r.get("selected") is not None:
            best = [f"{x.get('id') or '?'}:{x.get('source') or '?'}{_score(x, 'final_score')}" for x in r["selected"]]
            out.append(f"   selected({len(best)}): {', '.join(best) or '(none)'}")
        out += [f"   {stage_line(s)}" for s in r.get("stages") or []]
    return "\n".join([*out, BAR])


def render_session(name: str, total: int, injected: int, shown: list[dict], full: bool = False) -> str:
    """The last turns of a session as text: what was asked, and what was put beside it."""
    out = [f"# session: {name}", f"# prompt-turns: {total} total, showing last {len(shown)}", f"# injected: {injected}/{total} turns had a context", ""]
    for t in shown:
        asked = re.sub(f"[{X.WS}]+", " ", t["prompt"])
        out += [BAR, f"[line {t['line_no']}] YOU: {asked[:200]}{' …' if len(asked) > 200 else ''}"]
        if not t["injection"]:
            out.append("   CONTEXT: (none this turn)")
        elif full:
            out += ["   CONTEXT:", *(f"   | {line}" for line in t["injection"].split("\n"))]
        else:
            cited = re.findall(X.CITED, t["injection"])
            out += [f"   CONTEXT: {len(cited)} chunk(s):", *(f"     • {source} ({date})" for source, date in cited)]
    return "\n".join([*out, BAR])


def default_transcripts(cwd: str, home: str) -> str:
    """The folder of a project's transcripts."""
    return os.path.join(home, ".claude", "projects", cwd.replace("/", "-"))


def resolve_transcript(path: str, session: str = "latest") -> str:
    """A transcript file: the path itself, or the folder's newest file, or that whose name starts with the session's."""
    if not os.path.isdir(path):
        return path
    files = sorted(f for f in os.listdir(path) if f.endswith(".jsonl") and (session == "latest" or f.startswith(session)))
    if not files:
        raise FileNotFoundError(f"no transcript {session} in {path}")
    return os.path.join(path, max(files, key=lambda f: os.stat(os.path.join(path, f)).st_mtime_ns) if session == "latest" else files[0])


def service_records(queries: DataFrame, gated: DataFrame, ts: Column, duration_ms: Column) -> DataFrame:
    """A log record for each query: hash and redacted preview, never the text of a chunk."""
    item = F.struct("rank", "id", "source", *[S.rounded(F.col(c)).alias(c) if not c.endswith("_rank") else F.col(c) for c in LOG_SCORES])
    chosen = gated.where("drop_reason is null").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("selected"))
    rows = queries.join(chosen, "query_id", "left")
    return rows.select("query_id", F.lit("service").alias("kind"), ts.alias("ts"), F.sha2(F.coalesce("query", F.lit("")), 256).alias("query_hash"), X.redact(F.coalesce("query", F.lit(""))).alias("query_preview"), duration_ms.alias("duration_ms"), F.col("selected").isNotNull().alias("injected"), "selected")


def client_records(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("client").alias("kind"), "ts", F.sha2(F.coalesce("query", F.lit("")), 256).alias("query_hash"), "outcome", "duration_ms")


def append_log(records: DataFrame, folder: str) -> None:
    records.write.mode("append").json(folder)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log (record as a variant, and the fields that all share); lines that are no JSON are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.try_parse_json("value").alias("record"), F.monotonically_increasing_id().alias("line_no")).where("record is not null")
    fields = {"kind": "string", "ts": "string", "query_hash": "string", "outcome": "string", "duration_ms": "bigint", "injected": "boolean"}
    return rows.select("line_no", "record", *[F.try_variant_get("record", f"$.{k}", t).alias(k) for k, t in fields.items()])


def log_kind(kind: Column) -> Column:
    return F.when(kind == "client", "client").otherwise("service")


def log_summary(log: DataFrame) -> DataFrame:
    """(records, service, client); a record without a kind is an old service record."""
    kind = log_kind(F.col("kind"))
    return log.agg(F.count("*").alias("records"), F.count_if(kind == "service").alias("service"), F.count_if(kind == "client").alias("client"))


def matched_log(log: DataFrame) -> DataFrame:
    """Service records with the outcome that the client logged for the same query."""
    kind = log_kind(F.col("kind"))
    client = log.where(kind == "client").select("query_hash", F.col("outcome").alias("client_outcome"), F.col("duration_ms").alias("client_ms"))
    return log.where(kind == "service").join(client, "query_hash", "left")


def log_lines(log: DataFrame) -> DataFrame:
    """A line of text for each record."""
    when = F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("(no ts)"))
    short = F.coalesce(F.nullif(F.substring(F.coalesce("query_hash", F.lit("")), 1, 12), F.lit("")), F.lit("(no hash)"))
    took = F.coalesce(F.concat(F.col("duration_ms").cast("string"), F.lit("ms")), F.lit("?ms"))
    client = F.concat(F.lit("["), when, F.lit("] CLIENT "), short, F.lit(" outcome="), F.coalesce("outcome", F.lit("unknown")), F.lit(" duration="), took)
    service = F.concat(F.lit("["), when, F.lit("] SERVICE "), short, F.lit(" injected="), F.coalesce("injected", F.lit(False)).cast("string"), F.lit(" duration="), took)
    return log.withColumn("line", F.when(log_kind(F.col("kind")) == "client", client).otherwise(service))


def turns(lines: DataFrame, session: str = "session") -> DataFrame:
    """(session, turn_id, line_no, prompt, injection) of each prompt: the last injection before the next prompt.

    lines: (session, line_no, prompt, injection); a line has a prompt, an injection, or neither. Injections before the
    first prompt belong to none.
    """
    order = Window.partitionBy(session).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("turn_id", F.sum(F.col("prompt").isNotNull().cast("int")).over(order)).where("turn_id > 0")
    return numbered.groupBy(session, "turn_id").agg(F.min("line_no").alias("line_no"), F.max("prompt").alias("prompt"), F.max_by("injection", F.when(F.col("injection").isNotNull(), F.col("line_no"))).alias("injection"))


def transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """Prompts and injections of transcript files: (session, line_no, prompt, injection).

    A file's lines are numbered within its row, so a transcript is read whole, as one session is.
    """
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("session"), "value")
    rows = files.select("session", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).withColumn("r", F.try_parse_json("line")).where("r is not null")
    content = F.try_variant_get("r", "$.message.content", "string")
    many = F.from_json(F.when(content.startswith("["), content), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(many, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    tool = F.coalesce(F.exists(many, lambda p: p["type"] == "tool_result"), F.lit(False))
    said = F.nullif(X.trim(F.coalesce(joined, content)), F.lit(""))
    user = (F.try_variant_get("r", "$.type", "string") == "user") & ~F.coalesce(F.try_variant_get("r", "$.isMeta", "boolean"), F.lit(False)) & ~tool
    block = F.try_variant_get("r", "$.attachment.content", "string")
    listed = F.array_join(F.from_json(F.when(block.startswith("["), block), "array<string>"), "\n")
    block = F.coalesce(listed, block)
    attached = (F.try_variant_get("r", "$.type", "string") == "attachment") & (F.try_variant_get("r", "$.attachment.type", "string") == "hook_additional_context") & block.contains("<retrieved-memory")
    return rows.select("session", "line_no", F.when(user, X.clean_prompt(said)).alias("prompt"), F.when(attached, block).alias("injection"))
