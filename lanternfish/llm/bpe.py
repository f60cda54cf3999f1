"""Byte-level BPE over whole texts: token counts, encoding and decoding.

Two ways to merge are kept here, one per operator:

* token counts merge a batch of distinct pre-tokens as ragged numpy arrays, each sequence applying all
  occurrences of its own lowest-rank pair in every step, and count what is left;
* encoding keeps, for one short pre-token, the part boundaries and the rank of each adjacent pair in a
  contiguous list, scans it for the minimum, deletes a boundary and refreshes the two neighbours. Words
  beyond ``LONG`` bytes take a heap over a linked list, so that no word costs the square of its length.

The vocabulary file is a parameter. The driver reads it, refuses it beyond ``MAX_VOCAB_BYTES`` and
broadcasts the tables; executors need no file. It refuses files whose settings ask for anything that is not done here.
Text is processed whole, in slices of Arrow batches of about ``SLICE_BYTES``, a longer text alone, and distinct
pre-tokens are remembered up to ``CACHE`` entries for each task.

Defined results: null counts as the empty text, which has no tokens; special strings inside a text become
their own token, as the tokenizer's default is; of pairs that tie for the lowest rank the leftmost is merged first; repeated
rows give repeated result rows; an empty table gives no rows; other columns of the input pass through untouched,
except that output names win over equal names of the input.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, ship

MAX_VOCAB_BYTES = 64 << 20
SLICE_BYTES = 4 << 20
CACHE = 300_000
LONG = 96
NONE = 1 << 30

# The pre-token pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, inverted."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def unsupported(spec: dict) -> list[str]:
    """Settings of a tokenizer file that these operators do not follow."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = {
        "model.type": model.get("type", "BPE") != "BPE",
        "normalizer": spec.get("normalizer") is not None,
        "pre_tokenizer": pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True),
        "decoder": (spec.get("decoder") or {}).get("type") != "ByteLevel",
        "model.vocab": len(set(model["vocab"].values())) != len(model["vocab"]) or not set(byte_letters()) <= set(model["vocab"]),
        "added_tokens": any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in spec.get("added_tokens", [])),
    }
    wrong |= {f"model.{k}": bool(model.get(k)) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
    return [k for k, bad in wrong.items() if bad]


def load_vocab(path: str) -> dict:
    """Tables of a byte-level BPE file: token bytes by id, merges by pair of ids, special strings."""
    if os.path.getsize(path) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if found := unsupported(spec):
        raise ValueError(f"{path} has settings that are not supported: {', '.join(found)}")
    letters = byte_letters()
    ids = spec["model"]["vocab"]
    raw = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    raw |= {i: t.encode() for t, i in special.items()}
    pairs = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        pairs[ids[left], ids[right]] = (rank, ids[left + right])
    by_byte = [0] * 256
    for c, b in letters.items():
        by_byte[b] = ids[c]
    return {"bytes": raw, "pairs": pairs, "by_byte": by_byte, "special": special}


class Pretokenizer:
    """Splits texts into pre-tokens; special strings come out as their own piece."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for i, piece in enumerate(self.cut.split(text)):
            if i % 2:
                out.append("\0" + piece)
            elif piece:
                out += self.find(piece)
        return out


class RaggedMerger:
    """Rank-synchronous merging of many pre-tokens at once."""

    def __init__(self, vocab: dict):
        keys = np.array([(a << 32) | b for a, b in vocab["pairs"]], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.array([r for r, _ in vocab["pairs"].values()], dtype=np.int64)[order]
        self.made = np.array([m for _, m in vocab["pairs"].values()], dtype=np.int64)[order]
        self.by_byte = np.array(vocab["by_byte"], dtype=np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NONE), at

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        out = sizes.copy()
        sym = self.by_byte[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), sizes)
        live = out[seq] > 1
        sym, seq = sym[live], seq[live]
        # a pair stands at its left symbol; the last symbol of a sequence has none
        rank, at = self._pairs(sym, seq)
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.r_[first, len(seq)])
            low = np.repeat(np.minimum.reduceat(rank, first), lengths)
            more = low < NONE
            take = (rank == low) & more
            twice = np.flatnonzero(take[1:] & take[:-1]) + 1
            if len(twice):  # overlapping pairs of one letter: the leftmost wins, then every other one
                pos = np.arange(len(take))
                start = take & ~np.r_[False, take[:-1]]
                since = pos - np.maximum.accumulate(np.where(start, pos, 0))
                take &= since % 2 == 0
            gone = np.r_[False, take[:-1]]
            hit = np.flatnonzero(take)
            sym[hit] = self.made[at[hit]]
            np.subtract.at(out, seq[hit], 1)
            keep = more & ~gone
            changed = take | np.r_[take[1:], False] | np.r_[take[2:], False, False][: len(take)]
            sym, seq, rank, at, changed = sym[keep], seq[keep], rank[keep], at[keep], changed[keep]
            redo = np.flatnonzero(changed)
            if len(redo):
                nxt = np.minimum(redo + 1, len(sym) - 1)
                r, a = self.lookup(sym[redo], sym[nxt])
                r[(redo + 1 >= len(sym)) | (seq[nxt] != seq[redo])] = NONE
                rank[redo], at[redo] = r, a
        return out

    def _pairs(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sym):
            return sym, sym
        rank, at = self.lookup(sym, np.r_[sym[1:], sym[:1]])
        rank[np.r_[seq[1:] != seq[:-1], True]] = NONE
        return rank, at


class RankArray:
    """Encodes one pre-token with a contiguous array of boundaries and ranks.

    Ranks are of pairs of parts, so a pair that is no merge stays apart even where its bytes spell a token.
    """

    def __init__(self, vocab: dict):
        self.rank_of = {(vocab["bytes"][a], vocab["bytes"][b]): rank for (a, b), (rank, _) in vocab["pairs"].items()}
        special = set(vocab["special"].values())
        self.id_of = {t: i for i, t in vocab["bytes"].items() if i not in special}

    def __call__(self, token: bytes) -> list[int]:
        if len(token) == 1:
            return [self.id_of[token]]
        if len(token) > LONG:
            return self._long(token)
        rank_of = self.rank_of
        edge = list(range(len(token) + 1))
        rank = [rank_of.get((token[i : i + 1], token[i + 1 : i + 2]), NONE) for i in range(len(token) - 1)]
        while rank:
            low = min(rank)
            if low == NONE:
                break
            i = rank.index(low)
            del edge[i + 1], rank[i]
            made = token[edge[i] : edge[i + 1]]
            if i < len(rank):
                rank[i] = rank_of.get((made, token[edge[i + 1] : edge[i + 2]]), NONE)
            if i:
                rank[i - 1] = rank_of.get((token[edge[i - 1] : edge[i]], made), NONE)
        return [self.id_of[token[a:b]] for a, b in zip(edge, edge[1:])]

    def _long(self, token: bytes) -> list[int]:
        n = len(token)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def push(i: int, j: int, stop: int) -> None:
            if (r := self.rank_of.get((token[i:j], token[j:stop]))) is not None:
                heapq.heappush(heap, (r, i, j, stop))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            push(i, i + 1, i + 2)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != j or not alive[j] or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                push(i, stop, end[stop])
            if (p := before[i]) >= 0:
                push(p, i, stop)
        return [self.id_of[token[i : end[i]]] for i in range(n) if alive[i]]


def _count_batches(vocab_of) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocab_of.value
        split, merger, known = Pretokenizer(vocab["special"]), RaggedMerger(vocab), {}
        for batch in pieces(batches, SLICE_BYTES):
            words = [split(t or "") for t in batch.column(0).to_pylist()]
            new = [w for w in set().union(*map(set, words)) if w not in known]
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set().union(*map(set, words)))
            plain = [w for w in new if w[0] != "\0" or w[1:] not in vocab["special"]]
            known.update((w, 1) for w in new)
            known.update(zip(plain, merger.counts([w.encode() for w in plain]).tolist()))
            out = [sum(map(known.__getitem__, p)) for p in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.int64())], names=[*batch.schema.names[1:], "n_tokens"])

    return run


def _encode_batches(vocab_of, with_ids: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocab_of.value
        split, encode, known = Pretokenizer(vocab["special"]), RankArray(vocab), {}
        token_of = vocab["bytes"]

        def ids_of(piece: str) -> bytes:
            if piece[0] == "\0" and piece[1:] in vocab["special"]:
                ids = [vocab["special"][piece[1:]]]
            else:
                ids = encode(piece.encode())
            return np.array(ids, dtype="<u4").tobytes()

        for batch in pieces(batches, SLICE_BYTES):
            n, ids_sha, text_sha, arrays = [], [], [], []
            for text in batch.column(0).to_pylist():
                words = split(text or "")
                for w in set(words):
                    if w not in known:
                        if len(known) >= CACHE:
                            known.clear()
                        known[w] = ids_of(w)
                try:
                    packed = b"".join(map(known.__getitem__, words))
                except KeyError:  # the cache was cleared while this text filled it
                    packed = b"".join([known.get(w) or ids_of(w) for w in words])
                ids = np.frombuffer(packed, dtype="<u4")
                decoded = b"".join(map(token_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    arrays.append((ids.astype(np.int32), decoded))
            cols = [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [*batch.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array([a for a, _ in arrays], pa.list_(pa.int32())), pa.array([t for _, t in arrays], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _mapped(docs: DataFrame, text: str, run, added: str) -> DataFrame:
    made = {part.split()[0] for part in added.split(", ")}
    kept = [c for c in docs.columns if c != text and c not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema), added])
    return docs.select(f"`{text}`", *[f"`{c}`" for c in kept]).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """Replace the text column by ``n_tokens``; see the module text for nulls and special strings."""
    ship(__name__)
    vocab = docs.sparkSession.sparkContext.broadcast(load_vocab(vocab_path))
    return _mapped(docs, text, _count_batches(vocab), "n_tokens bigint")


def encode_decode(docs: DataFrame, vocab_path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Replace the text column by counts and digests of its ids and of the text decoded from them.

    with_ids adds ``ids array<int>`` and the decoded text itself.
    """
    ship(__name__)
    vocab = docs.sparkSession.sparkContext.broadcast(load_vocab(vocab_path))
    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return _mapped(docs, text, _encode_batches(vocab, with_ids), added)


def op2_query(spark, sf_dir: str, vocab_path: str | None = None) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    out = count_tokens(docs, vocab_path or public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op9_query(spark, sf_dir: str, vocab_path: str | None = None) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, vocab_path or public_tokenizers.path("byte_bpe_50k.json"))
