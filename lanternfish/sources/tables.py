"""Tables of documents as chunks, files and queries, for corpora that come as Parquet and not as Markdown trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

FIRST_MS, DAY_MS = 1_704_067_200_000, 86_400_000
TIERS = ["memory", "page", "skill", "session"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tier_of(ident: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.pmod(ident, F.lit(len(TIERS))).cast("int") + 1)


def document_chunks(docs: DataFrame) -> DataFrame:
    """Each document as one chunk of a file named after its source and id."""
    source = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    mtime = F.lit(FIRST_MS) + F.col("doc_id") * DAY_MS
    rows = docs.select("doc_id", source.alias("source"), "text", mtime.alias("mtime"), tier_of(F.col("doc_id")).alias("type"))
    return rows.select(
        X.chunk_id(F.col("source"), F.lit("root"), F.lit(0), F.lit(0)).alias("id"),
        "doc_id",
        "text",
        "source",
        F.lit("root").alias("section"),
        X.content_hash(F.col("text")).alias("hash"),
        "mtime",
        X.estimate_tokens(F.col("text")).cast("int").alias("token_count"),
        X.day_of(F.col("mtime")).alias("date"),
        "type",
    )


def markdown_documents(conversations: DataFrame) -> DataFrame:
    """Each conversation as a Markdown document with a heading for each turn."""
    part = F.concat(F.lit("## "), "role", F.lit("\n\n"), "text")
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n")
    source = F.concat(F.lit("memory/sessions/"), F.col("conv_id").cast("string"), F.lit(".md"))
    return rows.select(source.alias("source"), F.concat(F.lit("/corpus/"), source).alias("absolute_path"), text.alias("text"), (F.lit(FIRST_MS) + F.col("conv_id") * DAY_MS).alias("mtime"))


def live_files(chunks: DataFrame) -> DataFrame:
    """A later listing of the files of document chunks: every 7th changed, every 11th gone."""
    kept = chunks.where(F.col("doc_id") % 11 != 0)
    return kept.select("source", (F.col("mtime") + F.when(F.col("doc_id") % 7 == 0, 1000).otherwise(0)).alias("mtime_ms"))


def second_version(docs: DataFrame) -> DataFrame:
    """A later version of documents: every tenth gone, the next of ten changed, a copy of the one after added."""
    last = F.col("doc_id") % 10
    changed = docs.where(last != 0).withColumn("text", F.when(last == 1, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")))
    return changed.unionByName(docs.where(last == 2).withColumn("doc_id", F.col("doc_id") + 1_000_000))
