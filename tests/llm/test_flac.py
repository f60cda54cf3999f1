"""FLAC round trips, checksums and seeking."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from lanternfish.llm import flac


def payloads():
    rng = random.Random(2)
    words = ["the", "of", "tion", "ing,", "a", "é.", "\n"]
    texts = [None, "", "a" * 9000, " ".join(rng.choice(words) for _ in range(30_000)), "x"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    return [flac.payload_of(t) for t in texts] + [os.urandom(64 * i) for i in (1, 7, 64, 65, 200)] + [bytes([0, 255] * 3200), bytes([0] * 6400 + [255] * 448)]


def test_streams_come_back(monkeypatch):
    given = payloads()
    media = flac.encode(given)
    assert [b"".join(b for _, b in blocks) for blocks in flac.decode(media)] == given
    kinds = set()
    for m in media:
        info = flac.stream_info(m)
        kinds |= {flac.frame_head(m, info["frames_at"] + at)["kind"] for _, at, _ in info["points"]}
    assert {0, 1, 32 + flac.LPC_ORDER - 1} <= kinds  # constant, verbatim and linear frames all occur
    for m, p in zip(media, given):  # without its seek table a stream is decoded frame by frame
        info = flac.stream_info(m)
        bare = m[:4] + b"\x80" + m[5:42] + m[info["frames_at"] :]
        if len(p) <= 9000:
            assert b"".join(b for _, b in flac.decode([bare])[0]) == p


def plain_decode(stream):
    """A decoder of its own, bit by bit from the format's description: mono, 8 bits, blocks with any header that we meet."""
    assert stream[:4] == b"fLaC"
    at, last, total = 4, False, 0
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            total = int.from_bytes(stream[at + 4 + 10 : at + 4 + 18], "big") & ((1 << 36) - 1)
        at += 4 + size
    bits, pos, out = "".join(f"{b:08b}" for b in stream[at:]), 0, []

    def take(n):
        nonlocal pos
        pos += n
        return int(bits[pos - n : pos], 2) if n else 0

    def signed(n):
        v = take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary():
        n = 0
        while not take(1):
            n += 1
        return n

    while len(out) < total:
        assert take(14) == 0b11111111111110 and take(1) == 0
        take(1)
        size_code, _rate = take(4), take(4)
        assert take(4) == 0 and take(3) in (0, 1) and take(1) == 0
        first = take(8)
        for _ in range(0 if first < 128 else f"{first:08b}".index("0") - 1):
            take(8)
        n = {6: lambda: take(8) + 1, 7: lambda: take(16) + 1}.get(size_code, lambda: 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8))()
        take(8)
        assert take(1) == 0
        kind, wasted = take(6), take(1)
        assert not wasted
        if kind == 0:
            x = [signed(8)] * n
        elif kind == 1:
            x = [signed(8) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            x = [signed(8) for _ in range(order)]
            weights, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else None, 0
            if kind >= 32:
                width = take(4) + 1
                shift = signed(5)
                weights = [signed(width) for _ in range(order)]
            width, parts = (5 if take(2) else 4), 1 << take(4)
            for k in range(parts):
                rice = take(width)
                raw = take(5) if rice == (1 << width) - 1 else None
                for _ in range(n // parts - (order if k == 0 else 0)):
                    if raw is not None:
                        e = signed(raw)
                    else:
                        u = unary() << rice | take(rice)
                        e = u >> 1 if u % 2 == 0 else -(u >> 1) - 1
                    x.append(e + (sum(w * v for w, v in zip(weights, reversed(x))) >> shift))
        out += x
        pos += -pos % 8
        take(16)
    return bytes((v + 128) & 255 for v in out)


def test_another_decoder_reads_the_streams():
    given = [p for p in payloads() if len(p) <= 13_000]
    for m, p in zip(flac.encode(given), given):
        assert plain_decode(m) == p


def test_samples_can_be_sought():
    payload = flac.payload_of("seek me " * 3000)
    (m,) = flac.encode([payload])
    info = flac.stream_info(m)
    blocks = dict(flac.decode([m])[0])
    for first, at, n in info["points"]:
        head = flac.frame_head(m, info["frames_at"] + at)
        samples, _ = flac.read_frames(m, [head])[0]
        assert head["n"] == n and (samples + 128).astype(np.uint8).tobytes() == payload[first : first + n] == blocks[first]


@pytest.mark.parametrize("where", [66, -1, -2, -40, 30])
def test_damage_is_found(where):
    (m,) = flac.encode([flac.payload_of("some words to store " * 40)])
    bad = bytearray(m)
    bad[where] ^= 0x10
    with pytest.raises((ValueError, IndexError)):
        flac.decode([bytes(bad)])


def test_escaped_and_long_residuals():
    """A frame as another encoder may write it: an escaped partition, and a unary run over many bytes."""
    out = []

    def put(v, n):
        out.extend((v >> (n - 1 - i)) & 1 for i in range(n))

    head = bytes([0xFF, 0xF8, 0x70, 0x02, 0, 0, 31])
    head += bytes([flac.crc8(head)])
    put(8 << 1, 8)  # fixed order 0
    put(0, 2)
    put(1, 4)  # two partitions
    put(15, 4)
    put(6, 5)
    x = list(range(-16, 0))
    for v in x:
        put(v & 63, 6)
    put(0, 4)
    y = [60, -100, 0, 1] + [0] * 12
    for v in y:
        u = 2 * v if v >= 0 else -2 * v - 1
        put(0, u)
        put(1, 1)
    body = head + np.packbits(np.array(out, dtype=np.uint8)).tobytes()
    data = np.frombuffer(body, dtype=np.uint8)
    frame = body + int(flac.crc16s(data, np.array([0]), np.array([len(body)]))[0]).to_bytes(2, "big")
    want = bytes((v + 128) & 255 for v in x + y)
    packed = 8000 << 44 | 7 << 36 | 32
    info = (32).to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + hashlib.md5(bytes(b ^ 0x80 for b in want)).digest()
    stream = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame
    assert b"".join(b for _, b in flac.decode([stream])[0]) == want


def test_columns(spark):
    given = [(1, "hello", "c"), (2, None, "c"), (3, "hello", "d"), (4, "x" * 5000, None), (5, "", "")]
    docs = spark.createDataFrame(given, "doc_id long, text string, feature string")
    for made in (flac.flac_round_trip(docs), flac.flac_digest(flac.to_flac(docs))):
        got = {r["doc_id"]: r for r in made.collect()}
        for i, t, _ in given:
            p = flac.payload_of(t)
            assert (got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert [got[i]["block_offsets"] for i in (2, 4)] == [[0], [0, 4096]]
        assert got[1]["media_sha256"] == got[3]["media_sha256"] and got[1]["feature"] == got[3]["feature"] and got[2]["feature"] == got[5]["feature"]
    blocks = flac.flac_blocks(flac.to_flac(docs)).where("doc_id = 4").orderBy("sample_offset").collect()
    assert [r["sample_offset"] for r in blocks] == [0, 4096] and b"".join(bytes(r["pcm"]) for r in blocks)[:5000] == b"x" * 5000
    assert flac.flac_round_trip(docs.limit(0)).collect() == []
