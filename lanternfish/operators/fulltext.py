"""Full-text index and BM25 search as joins and sums.

Chunks without stored postings are scanned (``textscan``). Postings have a row for each occurrence, with the length and time of its chunk, and one row without a term for each chunk,
so one pass of tokenising serves search and statistics. They are kept in buckets of terms; a search reads the buckets of its
terms only. Terms of several tokens match as phrases, by their common start. Only tokens of the queries
survive the join, and term statistics are sums reduced before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions import text as X
from . import textscan
from .shared import settled
from .textscan import ChunkScan

INDEXED = ("text", "source", "section")
BUCKETS = 64
#: Distinct query terms up to which the postings are filtered by name in the scan; beyond, by the join alone.
NAMED_TERMS = 2_000
#: Rows of a query's terms up to which they are broadcast.
BROADCAST_TERMS = 500_000


def postings(chunks: DataFrame, columns: tuple[str, ...] = INDEXED) -> DataFrame:
    """(id, col, term, pos) of each token of the indexed columns."""
    found = F.array(*[F.struct(F.lit(c).alias("col"), X.tokens(F.col(c)).alias("tokens")) for c in columns])
    by_column = chunks.select("id", F.explode(found).alias("x")).select("id", "x.col", "x.tokens")
    return by_column.select("id", "col", F.posexplode("tokens").alias("pos", "term"))


def doc_stats(chunks: DataFrame, columns: tuple[str, ...] = INDEXED) -> DataFrame:
    """(id, n_tokens) over all indexed columns."""
    total = F.lit(0)
    for c in columns:
        total = total + F.size(X.tokens(F.col(c)))
    return chunks.select("id", total.cast("bigint").alias("n_tokens"))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def occurrences(chunks: DataFrame, columns: tuple[str, ...] = INDEXED) -> DataFrame:
    """(term, id, col, pos, n_tokens, mtime) of each token, and a row with the empty term for each chunk."""
    found = F.array(*[F.struct(F.lit(c).alias("col"), X.tokens(F.col(c)).alias("tokens")) for c in columns])
    rows = chunks.select("id", "mtime", found.alias("found"))
    total = F.aggregate("found", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x["tokens"]))
    none = F.array(F.struct(F.lit("").alias("col"), F.array(F.lit("")).alias("tokens")))
    by_column = rows.select("id", "mtime", total.alias("n_tokens"), F.explode(F.concat(none, "found")).alias("x"))
    return by_column.select("id", F.col("x.col").alias("col"), F.posexplode("x.tokens").alias("pos", "term"), "n_tokens", "mtime").select("term", "id", "col", "pos", "n_tokens", "mtime")


def lengths(rows: DataFrame) -> DataFrame:
    """(id, n_tokens) of each chunk, from its occurrences."""
    return rows.where("term = ''").select("id", "n_tokens")


@dataclass(frozen=True)
class TextIndex:
    """rows: as ``occurrences``, with ``bucket`` where they are stored in buckets; stored: whether reading them again is cheap."""

    rows: DataFrame
    stored: bool = False

    def wanted(self, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Occurrences of the phrases' tokens, and one row with n_chunks and mean_tokens."""
        terms = phrases.select(F.explode("tokens").alias("term")).distinct()
        if not self.stored:
            # tokenised once: what the search needs of it is small, and is kept
            met = settled(self.rows.join(_few(terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))), "term"))
            return met.where("term <> ''"), _corpus(lengths(met))
        named = [r["term"] for r in terms.limit(NAMED_TERMS + 1).collect()]
        rows = self.rows
        if len(named) <= NAMED_TERMS:
            rows = rows.where(rows["term"].isin(named) & F.col("bucket").isin(_buckets(terms.sparkSession, named)))
        else:
            rows = rows.join(_few(terms.withColumn("bucket", bucket_of(F.col("term")))), ["bucket", "term"])
        empty = _buckets(terms.sparkSession, [""])
        return rows.where("term <> ''"), _corpus(lengths(self.rows.where(F.col("bucket").isin(empty))))


def _few(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def _buckets(spark, terms: list[str]) -> list[int]:
    rows = spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term")).alias("b")).distinct()
    return [r["b"] for r in rows.collect()]


def _corpus(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n_chunks"), F.avg("n_tokens").alias("mean_tokens"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase_no, term, tokens) of each term of a query; terms without a token go."""
    plain = queries.select("query_id", X.nfkc(F.col("query")).alias("query"))
    terms = plain.select("query_id", F.posexplode(X.query_terms(F.col("query"))).alias("phrase_no", "term"))
    return terms.withColumn("tokens", X.tokens(F.col("term"))).where(F.size("tokens") > 0)


def _single(phrases: DataFrame) -> DataFrame:
    return phrases.where(F.size("tokens") == 1).select("query_id", "phrase_no", F.get("tokens", F.lit(0)).alias("term"))


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, id, tf, n_tokens, mtime) of each term in each chunk that has it."""
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"), F.max("n_tokens").alias("n_tokens"), F.max("mtime").alias("mtime"))


def _several(phrases: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, phrase_no, id, tf, n_tokens, mtime) of phrases of several tokens, by their common start."""
    many = phrases.where(F.size("tokens") > 1).select("query_id", "phrase_no", F.size("tokens").alias("n"), F.posexplode("tokens").alias("shift", "term"))
    starts = many.join(rows, "term").groupBy("query_id", "phrase_no", "n", "id", "col", (F.col("pos") - F.col("shift")).alias("start")).agg(F.count("*").alias("hits"), F.max("n_tokens").alias("n_tokens"), F.max("mtime").alias("mtime"))
    return starts.where("hits = n").groupBy("query_id", "phrase_no", "id").agg(F.count("*").alias("tf"), F.max("n_tokens").alias("n_tokens"), F.max("mtime").alias("mtime"))


def scan(chunks: DataFrame, columns: tuple[str, ...] = INDEXED) -> ChunkScan:
    """Chunks to search without an index."""
    return ChunkScan(chunks, columns)


def phrase_counts(phrases: DataFrame, index: TextIndex | ChunkScan) -> DataFrame:
    """(query_id, phrase_no, id, tf): how often each phrase occurs in each chunk that has it."""
    if isinstance(index, ChunkScan):
        return textscan.phrase_counts(phrases, index)
    rows, _ = index.wanted(phrases)
    one = _single(phrases).join(_term_counts(rows), "term").select("query_id", "phrase_no", "id", "tf")
    return one.unionByName(_several(phrases, rows).select("query_id", "phrase_no", "id", "tf"))


def bm25(queries: DataFrame, index: TextIndex) -> DataFrame:
    """(query_id, id, bm25_score, mtime) of every chunk that has a term of the query.

    What a term adds to a chunk's score is the same for all queries, so it is computed once for each term and chunk; only
    sums by query and chunk follow the expansion to queries, and those are reduced before their shuffle.
    """
    phrases = query_phrases(queries)
    rows, corpus = index.wanted(phrases)

    def parts(counts: DataFrame, keys: list[str]) -> DataFrame:
        with_term = counts.groupBy(*keys).agg(F.count("*").alias("df"))
        # one row
        joined = counts.join(with_term, keys).join(F.broadcast(corpus))
        score = S.bm25_term(S.idf(F.col("n_chunks"), F.col("df")), F.col("tf"), F.col("n_tokens"), F.col("mean_tokens"))
        return joined.select(*keys, "id", "mtime", score.alias("part"))

    cols = ["query_id", "id", "mtime", "part"]
    one = _single(phrases).join(parts(_term_counts(rows), ["term"]), "term").select(*cols)
    more = parts(_several(phrases, rows), ["query_id", "phrase_no"]).select(*cols)
    return one.unionByName(more).groupBy("query_id", "id").agg(F.sum("part").alias("bm25_score"), F.max("mtime").alias("mtime"))


def search_text(queries: DataFrame, index: TextIndex | ChunkScan, top_k: int) -> DataFrame:
    """(query_id, id, bm25_score, bm25_rank) of the best chunks; newer ones first among equal scores."""
    most, scanned = max(1, int(top_k) or 10), isinstance(index, ChunkScan)
    if scanned:
        scored = textscan.best_chunks(query_phrases(queries), index, most)
    else:
        scored = bm25(queries, index).withColumn("bm25_score", S.rounded(F.col("bm25_score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), F.desc("mtime"), "id")
    ranked = scored.withColumn("bm25_rank", F.row_number().over(order))
    found = ranked.where(F.col("bm25_rank") <= most).select("query_id", "id", "bm25_score", "bm25_rank")
    # some rows for each query, which several stages read
    return settled(found) if scanned else found
