"""Rerankers: a function that adds ``rerank_score`` to candidates with ``query`` and ``passage``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X


def overlap_scorer(rows: DataFrame) -> DataFrame:
    """A deterministic scorer: the share of the query's tokens that the passage has, through a sigmoid."""
    asked, given = F.array_distinct(X.tokens(F.col("query"))), F.array_distinct(X.tokens(F.col("passage")))
    share = F.size(F.array_intersect(asked, given)) / F.greatest(F.size(asked), F.lit(1))
    return rows.withColumn("rerank_score", S.sigmoid(8 * share - 2))


class OnnxReranker:
    """A local ONNX cross-encoder with its tokenizer file; loaded once in each worker, on first use."""

    def __init__(self, model_path: str, tokenizer_path: str, most_tokens: int = 512):
        self.model_path, self.tokenizer_path, self.most_tokens, self._loaded = model_path, tokenizer_path, most_tokens, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def __call__(self, queries: list[str], passages: list[str]) -> np.ndarray:
        """The last logit of each pair."""
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.tokenizer_path)
            tokenizer.enable_padding()
            tokenizer.enable_truncation(self.most_tokens)
            self._loaded = tokenizer, onnxruntime.InferenceSession(self.model_path)
        tokenizer, session = self._loaded
        coded = tokenizer.encode_batch(list(zip(queries, passages)))
        known = {"input_ids": [c.ids for c in coded], "attention_mask": [c.attention_mask for c in coded], "token_type_ids": [c.type_ids for c in coded]}
        logits = session.run(None, {i.name: np.array(known[i.name], dtype=np.int64) for i in session.get_inputs()})[0]
        return logits.reshape(len(coded), -1)[:, -1]


def model_scorer(score: Callable[[list[str], list[str]], np.ndarray], batch: int = 16) -> Callable[[DataFrame], DataFrame]:
    """A scorer from a model's function of queries and passages to its last logits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            q, p = (b.column(names.index(c)).to_pylist() for c in ("query", "passage"))
            logits = [x for a in range(0, len(q), batch) for x in np.asarray(score(q[a : a + batch], p[a : a + batch]), dtype=float)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([1 / (1 + np.exp(-x)) for x in logits], pa.float64())], names=[*names, "rerank_score"])

    def scorer(rows: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, schema + ", rerank_score double")

    return scorer
