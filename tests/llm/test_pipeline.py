"""The registered queries with SQL, and the pipeline's stages one after the other."""

import os

import duckdb
import pytest

import corpus_pipeline
from lanternfish.llm import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in os.listdir(FOLDER):
        db.execute(f"create view {table.split('.')[0]} as select * from '{FOLDER}/{table}'")
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), db.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    classified, judged, single, mixed, coded = seen
    assert all(d.columns == documents.columns for d in seen[:-1])
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    kept = {r["doc_id"]: r["text"] for r in classified.collect()}
    assert all(text[i] == t for i, t in kept.items())
    assert not [i for i in kept if labels.get(i) == 0]
    clean = [i for i, y in labels.items() if y == 1]  # the smallest tables have ten bad examples to learn from
    assert len([i for i in clean if i not in kept]) <= 0.1 * len(clean)
    left = {r["doc_id"] for r in judged.collect()}
    assert left <= set(kept) and all(len(text[i].split()) < 20 or len(text[i].split()) > len(set(text[i].split())) for i in set(kept) - left)
    ones = [r["text"] for r in single.collect()]
    assert len(ones) == len(set(ones)) and {r["doc_id"] for r in single.collect()} <= left
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in single.collect()}
    assert coded.count() == mixed.count() and coded.where("n_tokens = 0").count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ties, other columns, and empty tables."""
    import random

    rng = random.Random(5)
    prose = [" ".join(rng.choice(["the", "harbour", "of", "stone", "light", "under"]) + str(rng.randrange(40)) for _ in range(60)) + "." for _ in range(12)]
    rows = [(i, t, "en", "s", len(t), "k", 1.5, 9) for i, t in enumerate(prose)]
    rows += [rows[0], rows[0], (3, prose[4], "en", "s", 1, "k", 1.5, 9), (None, None, None, None, None, None, None, None), (None, prose[5], None, None, None, None, None, None), (50, "", "", "", 0, "", 0.0, 0), (51, " \n ", "en", "s", 3, "k", 0.0, 0)]
    rows.append((52, " ".join(prose[6].split() + [f"long{k}" for k in range(60_000)]) + ".", "en", "s", 1, "k", 0.0, 0))
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, n_tokens int"
    spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, kind)
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{len(given)}-{name}"
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            made = spark.read.parquet(path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert made.columns == docs.columns
            if not given:
                assert made.count() == 0
            elif name == "quality_classifier":
                assert made.count() == len(rows)  # nothing bad was labelled
            elif name == "quality_rules":
                assert made.where("text is null or trim(text) = ''").count() == 0 and made.where("doc_id = 52").count() == 1
            elif name == "near_dedup":
                texts = [r["text"] for r in made.collect()]
                assert sorted(texts) == sorted({t for _, t, *_ in rows if t and len(t.split()) >= 20})
            docs = made


def test_run(spark):
    from lanternfish.llm import common

    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    shared = common.shared_folder(spark).removeprefix("file:")
    assert not [f for f in os.listdir(shared) if f.startswith(("pipeline-", "warc-"))]
