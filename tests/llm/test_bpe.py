"""Both ways to merge against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lanternfish.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rng = random.Random(1)
    fixed = ["", None, "a" * 5000, "ab" * 300, "x<|endoftext|>y  <|endoftext|>\n\n z's 123   　 ", "\0<|endoftext|> \0", "日本語テキスト😀" * 50, " " * 700 + "\n", "aaaa aaa aa a" * 9, "word " * 60_000]
    bits = ["a", "b", "\t", " ", "é", "!", "1", "'s", "中", "́", "\x00", "<|endoftext|>", "the", " of"]
    return fixed + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(400)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_and_round_trip(spark, library):
    given = texts() + texts()[:3]
    docs = spark.createDataFrame([(i, t, "kept", 1.5) for i, t in enumerate(given)], "doc_id long, text string, `n_tokens` string, `other col` double")
    want = [e.ids for e in library.encode_batch([t or "" for t in given], add_special_tokens=False)]
    counted = {r["doc_id"]: r for r in bpe.count_tokens(docs, PATH).collect()}
    assert [counted[i]["n_tokens"] for i in range(len(given))] == [len(w) for w in want]
    assert counted[0]["other col"] == 1.5
    coded = {r["doc_id"]: r for r in bpe.encode_decode(docs, PATH, with_ids=True).collect()}
    for i, ids in enumerate(want):
        row = coded[i]
        assert row["ids"] == ids and row["decoded"] == library.decode(ids, skip_special_tokens=False) and row["decoded"] == (given[i] or "")
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(row["decoded"].encode()).hexdigest()


def test_pairs_that_are_no_merge_stay_apart():
    """b"abc" is a token by ab and c only; a and bc do not join, though their bytes spell it."""
    raw = {0: b"a", 1: b"b", 2: b"c", 3: b"bc", 4: b"ab", 5: b"abc", 6: b"b!"}
    vocab = {"bytes": raw, "pairs": {(1, 2): (0, 3), (0, 1): (1, 4), (4, 2): (2, 5)}, "special": {}, "by_byte": [0] * 256}
    vocab["by_byte"][97], vocab["by_byte"][98], vocab["by_byte"][99] = 0, 1, 2
    encode = bpe.RankArray(vocab)
    assert encode(b"abc") == [0, 3] == encode._long(b"abc") and encode(b"ab") == [4]
    assert encode(b"abc" * 60) == [0, 3] * 60
    assert bpe.RaggedMerger(vocab).counts([b"abc", b"ab", b"abcab"]).tolist() == [2, 1, 3]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"ignore_merges": True}}, {"added_tokens": [{"id": 50256, "content": "<x>", "lstrip": True}]}])
def test_other_settings_are_refused(tmp_path, change):
    spec = json.load(open(PATH, encoding="utf-8"))
    for k, v in change.items():
        spec[k] = spec[k] | v if isinstance(v, dict) and spec[k] else v
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match=next(iter(change))):
        bpe.load_vocab(str(tmp_path / "t.json"))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.count_tokens(docs, PATH).collect() == [] and bpe.encode_decode(docs, PATH).collect() == []


def test_caches_may_overflow(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "CACHE", 3)
    vocab = type("Held", (), {"value": bpe.load_vocab(PATH)})
    given = ["one two three four five six seven", "eight nine ten one two", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(given)], names=["text"])
    want = [len(e.ids) for e in library.encode_batch(given, add_special_tokens=False)]
    assert next(bpe._count_batches(vocab)(iter([batch]))).column("n_tokens").to_pylist() == want
    assert next(bpe._encode_batches(vocab, False)(iter([batch]))).column("n_tokens").to_pylist() == want


def test_large_vocabularies_are_refused(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCAB_BYTES", 10)
    with pytest.raises(ValueError, match="larger"):
        bpe.load_vocab(PATH)
