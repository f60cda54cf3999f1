"""Exact nearest neighbours of a batch of queries.

Queries are a stated set. Their matrix is broadcast, at most ``SCAN_BYTES`` of it at a time, and meets every vector once,
inside the tasks of one scan, which keep their best k; a larger set takes another scan for each further part. Distances come
from a matrix product, with a margin for its rounding; those near enough to count are computed again exactly. Only
the tasks' lists are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import scores as S

#: Bytes of query vectors that one scan carries.
SCAN_BYTES = 256 << 20
#: Distances that are held at once.
TILE = 1 << 22
ROWS = 2048


def _nearest(asked_of, top_k: int, types: tuple[pa.DataType, pa.DataType]):
    def best(matrix: np.ndarray, norms: np.ndarray, ids: np.ndarray, vectors: np.ndarray, held: list) -> None:
        own = (vectors**2).sum(axis=1)
        margin = 1e-9 * (1 + norms.max() + own.max())
        for a in range(0, len(matrix), max(1, TILE // len(vectors))):
            block = slice(a, a + max(1, TILE // len(vectors)))
            near = norms[block, None] + own[None] - 2 * (matrix[block] @ vectors.T)
            k = min(top_k, near.shape[1])
            edge = np.partition(near, k - 1, axis=1)[:, k - 1] + margin
            for q in range(len(near)):
                old_ids, old_d = held[a + q]
                limit = min(edge[q], old_d[-1] ** 2 + margin) if len(old_d) == top_k else edge[q]
                at = np.flatnonzero(near[q] <= limit)
                if not len(at):
                    continue
                d = np.sqrt(((matrix[a + q] - vectors[at]) ** 2).sum(axis=1))
                all_ids, all_d = np.concatenate([old_ids, ids[at]]), np.concatenate([old_d, d])
                keep = np.lexsort((all_ids, all_d))[:top_k]
                held[a + q] = (all_ids[keep], all_d[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = asked_of.value
        norms, held = (matrix**2).sum(axis=1), None
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                ids = np.array(part.column(0).to_pylist())
                vectors = np.array(part.column(1).to_pylist(), dtype=np.float64)
                if vectors.ndim != 2 or vectors.shape[1] != matrix.shape[1]:
                    raise ValueError(f"vectors of {matrix.shape[1]} dimensions are needed")
                if held is None:
                    held = [(ids[:0], np.zeros(0)) for _ in query_ids]
                best(matrix, norms, ids, vectors, held)
        if held is not None:
            n = [len(i) for i, _ in held]
            owner = [q for q, c in zip(query_ids, n) for _ in range(c)]
            yield pa.RecordBatch.from_arrays([pa.array(owner, types[0]), pa.array(np.concatenate([i for i, _ in held]).tolist(), types[1]), pa.array(np.concatenate([d for _, d in held]))], names=["query_id", "id", "distance"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, top_k: int) -> DataFrame:
    """(query_id, id, distance, score, dense_rank) of the top_k vectors of each query by L2 distance, ties by id.

    queries: (query_id, vector); vectors: (id, vector). Distances are rounded to nine digits before they are ranked.
    """
    kinds = queries.schema["query_id"].dataType, vectors.schema["id"].dataType
    types = to_arrow_type(kinds[0]), to_arrow_type(kinds[1])
    schema = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, distance double"
    sc, parts, ids, rows, size = vectors.sparkSession.sparkContext, None, [], [], 0

    def scanned() -> DataFrame:
        asked = sc.broadcast((ids, np.array(rows, dtype=np.float64)))
        found = vectors.select("id", "vector").mapInArrow(_nearest(asked, top_k, types), schema)
        return found if parts is None else parts.unionByName(found)

    for r in queries.select("query_id", "vector").toLocalIterator():
        ids.append(r["query_id"])
        rows.append(r["vector"])
        size += 8 * len(r["vector"])
        if size >= SCAN_BYTES:
            parts = scanned()
            ids, rows, size = [], [], 0
    if rows:
        parts = scanned()
    if parts is None:
        parts = vectors.sparkSession.createDataFrame([], schema)
    parts = parts.withColumn("distance", F.round("distance", 9))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return parts.withColumn("dense_rank", rank).where(F.col("dense_rank") <= top_k).select("query_id", "id", "distance", S.distance_score(F.col("distance")).alias("score"), "dense_rank")
