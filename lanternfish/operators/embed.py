"""Embedders: anything with an id, a dimension and embed(texts, mode) to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = 16
# What a text gets in front of it by mode.
PREFIX = {"query": "query: ", "passage": "passage: "}


class Embedder(Protocol):
    def id(self) -> str: ...

    def dimension(self) -> int: ...

    def embed(self, texts: list[str], mode: str) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic vectors for tests: each word adds to a hashed bucket; the vector has unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def id(self) -> str:
        return f"hashing:words@{self.dim}"

    def dimension(self) -> int:
        return self.dim

    def embed(self, texts: list[str], mode: str) -> np.ndarray:
        if mode not in PREFIX:
            raise ValueError(f"unknown mode {mode}")
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for w in text.lower().split():
                h = hashlib.md5(w.encode()).digest()
                row[int.from_bytes(h[:4], "big") % self.dim] += 1 if h[4] >> 7 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class OnnxEmbedder:
    """A local ONNX sentence model with its tokenizer file; loaded once in each worker, on first use."""

    def __init__(self, model_path: str, tokenizer_path: str, dim: int):
        self.model_path, self.tokenizer_path, self.dim, self._loaded = model_path, tokenizer_path, dim, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def id(self) -> str:
        return f"local-onnx:{self.model_path}@{self.dim}"

    def dimension(self) -> int:
        return self.dim

    def embed(self, texts: list[str], mode: str) -> np.ndarray:
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.tokenizer_path)
            tokenizer.enable_padding()
            self._loaded = tokenizer, onnxruntime.InferenceSession(self.model_path)
        tokenizer, session = self._loaded
        coded = tokenizer.encode_batch([PREFIX[mode] + t for t in texts])
        ids = np.array([c.ids for c in coded], dtype=np.int64)
        mask = np.array([c.attention_mask for c in coded], dtype=np.int64)
        known = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        states = session.run(None, {i.name: known[i.name] for i in session.get_inputs()})[0]
        pooled = (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)
        return pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)


def with_vectors(rows: DataFrame, embedder: Embedder, mode: str, text: str = "text", batch: int = BATCH) -> DataFrame:
    """Add ``vector`` to each row; texts reach the embedder in batches."""
    names, dim = rows.columns, embedder.dimension()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(names.index(text)).to_pylist()]
            out = [v for a in range(0, len(texts), batch) for v in np.asarray(embedder.embed(texts[a : a + batch], mode), dtype=np.float32)]
            if any(len(v) != dim for v in out):
                raise ValueError(f"{embedder.id()} must give {dim} dimensions")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, "vector"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, schema + ", vector array<float>")
