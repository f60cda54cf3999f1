"""Keeping an index fresh: a sweep in micro-batches, and debounced change events.

A sweep lists the corpus without reading it, and rebuilds only if its signature or the settings have changed. The
micro-batches of one query run one after the other, so builds never overlap; the manifest is written last, so a
build that fails or is run again leaves a whole index.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, index
from ..operators.embed import Embedder, with_vectors
from ..sources.corpus import corpus_changes, read_corpus


def settings_meta(spark: SparkSession, files: DataFrame, options: chunking.ChunkOptions, embedder: Embedder) -> dict:
    """What an index is built from: embedder, corpus signature and chunking fingerprint."""
    print_ = spark.range(1).select(chunking.fingerprint(options).alias("f")).first()["f"]
    return {"embedder_id": embedder.id(), "embedder_dimension": embedder.dimension(), "corpus_signature": index.corpus_signature(files).first()["signature"], "chunking_fingerprint": print_}


def build_index(spark: SparkSession, config: dict, store: index.IndexStore, embedder: Embedder, now_ms: int, dated: bool = False) -> dict:
    """Bring the index up to date; the counts of what changed and of files, or ``{"reused": True}``.

    dated: files are fixtures, whose time is noon of the date that their text states.
    """
    c = config["chunking"]
    options = chunking.ChunkOptions(c["targetTokens"], c["minTokens"], c["maxTokens"], c["overlapRatio"])
    meta = settings_meta(spark, read_corpus(spark, config, content=False), options, embedder)
    if store.reusable(meta):
        return {"reused": True}
    files = read_corpus(spark, config)
    if dated:
        files = files.withColumn("mtime", X.noon_ms(X.fixture_date(F.col("text"))))
    chunks = chunking.chunk_documents(files, options)
    chunks = chunks.select("id", "text", "source", "section", "hash", "mtime", "token_count", F.col("metadata.date").alias("date"), F.col("metadata.type").alias("type"))
    same = store.manifest() is not None and str(store.manifest()["meta"]["embedder_id"]) == embedder.id()
    none = spark.createDataFrame([], "id string, hash string, created_at bigint")
    old = store.table("chunks") if same else none
    vectors = store.table("vectors") if same else spark.createDataFrame([], "id string, hash string, embedder_id string, vector array<float>")
    counts = index.change_counts(index.diff(old, chunks)).first().asDict()
    todo, kept = index.split_by_vector(chunks, vectors, embedder.id())
    fresh = with_vectors(todo.select("id", "hash", "text"), embedder, "passage").select("id", "hash", F.lit(embedder.id()).alias("embedder_id"), "vector")
    store.write(index.merge(old, chunks, now_ms), kept.unionByName(fresh), meta)
    return counts | {"files": store.counts()["files"]}


class SingleFlight:
    """Runs one refresh at a time; a request that comes meanwhile is remembered, and one more run follows."""

    def __init__(self, refresh: Callable[[], dict]):
        self.refresh, self._lock, self._pending = refresh, threading.Lock(), threading.Event()

    def __call__(self) -> dict | None:
        self._pending.set()
        report = None
        while self._pending.is_set() and self._lock.acquire(blocking=False):
            try:
                self._pending.clear()
                report = self.refresh()
            finally:
                self._lock.release()
        return report


def watch_stream(spark: SparkSession, config: dict, refresh: Callable[[], dict], checkpoint: str, reports: list | None = None):
    """Refresh after changes of the corpus, once for all that come within the debounce period."""

    def once(changes: DataFrame, batch: int) -> None:
        if changes.isEmpty():
            return
        report = refresh()
        if reports is not None:
            reports.append((batch, report))

    every = config["freshness"]["debounceMs"] or 1000
    return corpus_changes(spark, config).writeStream.foreachBatch(once).trigger(processingTime=f"{every} milliseconds").option("checkpointLocation", checkpoint).start()


def sweep_stream(spark: SparkSession, refresh: Callable[[], dict], every_ms: int, checkpoint: str, reports: list | None = None):
    """Refresh now and every so many milliseconds until the returned query is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def once(_: DataFrame, batch: int) -> None:
        report = refresh()
        if reports is not None:
            reports.append((batch, report))

    return ticks.writeStream.foreachBatch(once).trigger(processingTime=f"{every_ms} milliseconds").option("checkpointLocation", checkpoint).start()


def debounced(events: DataFrame, key: str, ts: str = "ts", quiet: str = "1 second") -> DataFrame:
    """(key, begins, ends, n): bursts of events of a key, each closed by a quiet period. For tables and streams."""
    return events.groupBy(key, F.session_window(ts, quiet).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")
