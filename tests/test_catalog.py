"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lanternfish.operators import fulltext, textscan
from lanternfish.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return c


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or str(value) in ("<NA>", "NaT", "nan"):
        return "null"
    if isinstance(value, float):
        return str(int(value)) if math.isfinite(value) and value == int(value) else repr(round(value, 9))
    return str(value)


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), db.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_injection_sources_reads_whole_texts(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(1)
    late = docs.selectExpr("doc_id", "repeat('word ', 40) || '[notes/late.md · 2025-03-04] end' as text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    late.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["injection_sources"](spark, str(tmp_path)).collect()
    assert len(got) == 2 and ("notes/late.md", "2025-03-04") in {(r["source"], r["date"]) for r in got}


UNINDEXED = [
    "bm25_topk",
    "bm25_phrase",
    "assemble_context",
    "drop_reasons",
    "hook_payload",
    "hybrid_retrieve",
    "service_records",
    "stage_log",
    "bm25_only_admission",
    "free_gates",
    "recall_items",
    "recall_text",
    "rrf_fuse",
]


@pytest.mark.parametrize("name", UNINDEXED)
def test_search_keeps_a_row_for_each_document(spark, monkeypatch, name):
    """What a search without an index stores does not grow with the occurrences of its terms."""
    kept = []
    for module in (fulltext, textscan):
        monkeypatch.setattr(module, "settled", lambda df, f=module.settled: kept.append(f(df)) or kept[-1])
    catalog.QUERIES[name](spark, FOLDER).collect()
    n, asked = (spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("documents", "benchmark"))
    assert kept and max(df.count() for df in kept) <= max(n, 10 * asked)


def written(spark) -> int:
    """Bytes that shuffles and kept tables of this session came to."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    kept = sc.getCheckpointDir()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept.get()) if kept.isDefined() else None
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength() if folder else 0
    return files + sum(x.totalShuffleWrite() for x in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().executorList(False)))


@pytest.mark.parametrize("name", ["drop_reasons", "hook_payload", "hybrid_retrieve", "service_records", "bm25_only_admission", "recall_text", "stage_log"])
def test_search_writes_less_than_its_texts(spark, tmp_path, name):
    """Disk of a search without an index, where each word of each document is one of the queries'."""
    asked = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").limit(2).cache()
    words = sorted({w for r in asked.collect() for w in r["text"].split()})
    docs = [(i, " ".join(words[(i * 7 + j * (1 + i % 5)) % len(words)] for j in range(800)), "en", f"s{i % 3}") for i in range(1000)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{FOLDER}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = written(spark)
    assert catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert written(spark) - before < sum(len(text) for _, text, *_ in docs)
