"""FLAC columns: encode byte payloads losslessly, decode them, verify every checksum, and seek by sample.

The encoder writes mono streams of 8-bit samples (a payload byte less 128) with STREAMINFO (its MD5
included), a SEEKTABLE with one point for each frame, and frames of up to ``BLOCK`` samples. Each frame takes
the cheapest of a constant, verbatim, fixed (orders 1 and 2) and linear predictor (order 4) subframe, with
Rice partitions. The decoder handles these subframes, fixed orders 0 to 4, linear orders 1 to 32 and
both Rice methods with escapes, for mono streams of 8 bits; anything else raises ValueError, as does a wrong
CRC-8, CRC-16 or MD5. Frames are decoded side by side in numpy, one sample of every frame per step; with no
complete seek table they are decoded one after the other.

A text's payload is its UTF-8 bytes (none for null) and zero bytes up to a positive multiple of ``PAD``. Texts
are processed whole, in groups of about ``ENCODE_BYTES`` and ``DECODE_BYTES``; a longer text is a group of its own.

Defined results: null and the empty text have the same stream, of ``PAD`` zero bytes; repeated rows give repeated result
rows and equal texts equal streams, so there are no ties to settle; an empty table gives no rows; other columns pass
through, except that output names win over equal names of the input.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, ship

BLOCK = 4096
PAD = 64
#: Payload bytes encoded at once, and stream bytes decoded at once; encoding needs some 150 bytes of memory for each.
ENCODE_BYTES, DECODE_BYTES = 1 << 20, 3 << 20
RATE = 8000
PARTITION_ORDER = 2
LPC_ORDER, LPC_BITS, LPC_SHIFT = 4, 12, 9
MAX_ORDER = 32
# The format's fixed predictors by order, and its block size codes.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def crc8(data: bytes) -> int:
    table = crc_table(8, 0x07)
    crc = 0
    for b in data:
        crc = table[crc ^ b]
    return crc


_TABLES: dict = {}


def crc_table(bits: int, poly: int) -> list[int]:
    if (bits, poly) not in _TABLES:
        _TABLES[bits, poly] = _crc_table(bits, poly)
    return _TABLES[bits, poly]


def _crc_table(bits: int, poly: int) -> list[int]:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        crc = b << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
        out.append(crc)
    return out


def crc16_places(size: int) -> np.ndarray:
    """What a byte adds to the CRC-16 when so many bytes follow it."""
    if size in _TABLES:
        return _TABLES[size]
    step = np.array(crc_table(16, 0x8005), dtype=np.uint16)
    out = np.empty((size, 256), dtype=np.uint16)
    out[0] = step
    for i in range(1, size):
        out[i] = (out[i - 1] << np.uint16(8)) ^ step[out[i - 1] >> np.uint16(8)]
    _TABLES[size] = out
    return out


def crc16s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-16 of each range of bytes; ranges follow one another without gaps between their starts."""
    sizes = ends - starts
    at = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    after = np.repeat(ends, sizes) - 1 - at
    most = 1 << int(sizes.max()).bit_length()
    each = crc16_places(most)[after, data[at]]
    return np.bitwise_xor.reduceat(each, np.r_[0, np.cumsum(sizes)[:-1]])


def utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    out = []
    lead = 0x3F
    while n > lead:
        out.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(~(2 * lead + 1)) & 0xFF | n, *out[::-1]])


def put_bits(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Write each value, most significant bit first, at its place."""
    for b in range(int(width.max(initial=0))):
        on = np.flatnonzero((width > b) & ((value >> b) & 1).astype(bool))
        bits[at[on] + width[on] - 1 - b] = 1


def linear_coefficients(x: np.ndarray, of: np.ndarray, starts: np.ndarray, n_frames: int) -> np.ndarray:
    """Quantised coefficients of the order-4 predictor of each frame, by Levinson-Durbin."""
    r = np.empty((LPC_ORDER + 1, n_frames))
    xf = x.astype(np.float64)
    for lag in range(LPC_ORDER + 1):
        prod = xf * np.r_[np.zeros(lag), xf[: len(xf) - lag]]
        if lag:
            prod[of != np.r_[np.full(lag, -1), of[: len(of) - lag]]] = 0
        r[lag] = np.add.reduceat(prod, starts)
    err = r[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((LPC_ORDER, n_frames))
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum((a[j] * r[i - j] for j in range(i)), np.zeros(n_frames))) / err
        new = a.copy()
        new[i] = k
        for j in range(i):
            new[j] = a[j] - k * a[i - 1 - j]
        a, err = new, err * np.maximum(1 - k * k, 1e-9)
    top = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -top, top).astype(np.int64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; payloads hold a positive multiple of PAD bytes."""
    size = np.fromiter(map(len, payloads), dtype=np.int64, count=len(payloads))
    if (size == 0).any() or (size % PAD).any():
        raise ValueError(f"a payload needs a positive multiple of {PAD} bytes")
    x = np.frombuffer(b"".join(payloads), dtype=np.uint8).astype(np.int32) - 128
    per = -(-size // BLOCK)
    doc = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    n = np.minimum(BLOCK, size[doc] - number * BLOCK)
    start = np.cumsum(n) - n
    n_frames = len(n)
    of = np.repeat(np.arange(n_frames), n)
    i = np.arange(len(x)) - start[of]

    def back(lag: int) -> np.ndarray:
        return np.r_[np.zeros(lag, np.int32), x[: len(x) - lag]]

    coef = linear_coefficients(x, of, start, n_frames)
    lags = [back(k) for k in range(1, LPC_ORDER + 1)]
    guess = sum(coef[k][of] * lags[k] for k in range(LPC_ORDER)) >> LPC_SHIFT
    ways = [(1, x - lags[0]), (2, x - 2 * lags[0] + lags[1]), (LPC_ORDER, x - guess)]
    parts = 1 << PARTITION_ORDER
    part_of = of * parts + i // (n[of] >> PARTITION_ORDER)
    part_start = np.flatnonzero(np.r_[True, part_of[1:] != part_of[:-1]])
    best_bits, best, residual = None, None, None
    for way, (order, res) in enumerate(ways):
        z = np.where(i < order, 0, (res << 1) ^ (res >> 31)).astype(np.int64)
        total = np.add.reduceat(z, part_start)
        count = np.diff(np.r_[part_start, len(x)]) - np.where(np.arange(len(part_start)) % parts == 0, order, 0)
        mean = total / np.maximum(count, 1)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 0.5))) + 1, 0, 14).astype(np.int64)
        length = np.where(i < order, 0, (z >> k[part_of]) + 1 + k[part_of])
        bits = np.add.reduceat(length, start) + 6 + 4 * parts + 8 * order + (9 + LPC_BITS * order) * (way == 2)
        if best is None:
            best_bits, best, residual, rice, lengths = bits, np.full(n_frames, way), z, k, length
        else:
            win = bits < best_bits
            best_bits, best = np.where(win, bits, best_bits), np.where(win, way, best)
            w = win[of]
            residual, lengths = np.where(w, z, residual), np.where(w, length, lengths)
            rice = np.where(np.repeat(win, parts), k, rice)
    orders = np.array([o for o, _ in ways])[best]
    flat = np.maximum.reduceat(x, start) == np.minimum.reduceat(x, start)
    plain = best_bits > 8 * n
    coded = ~flat & ~plain
    # header bytes of each frame
    heads = []
    for f in range(n_frames):
        code = bytes([0xFF, 0xF8, 0x70, 0x02]) + utf8_number(int(number[f])) + int(n[f] - 1).to_bytes(2, "big")
        heads.append(code + bytes([crc8(code)]))
    head_len = np.fromiter(map(len, heads), dtype=np.int64, count=n_frames)
    body_bits = 8 + np.where(flat, 8, np.where(plain, 8 * n, best_bits))
    frame_len = head_len + -(-body_bits // 8) + 2
    frame_at = np.cumsum(frame_len) - frame_len
    bits = np.zeros(int(frame_len.sum()) * 8, dtype=np.uint8)
    at = (frame_at + head_len) * 8
    lpc = coded & (best == 2)
    kind = np.where(flat, 0, np.where(plain, 1, np.where(lpc, 32 | (orders - 1), 8 | orders)))
    put_bits(bits, at, kind << 1, np.full(n_frames, 8))
    at = at + 8
    raw = (flat[of] & (i == 0)) | plain[of] | (coded[of] & (i < orders[of]))
    where = np.flatnonzero(raw)
    put_bits(bits, at[of[where]] + 8 * i[where], (x[where] & 0xFF).astype(np.int64), np.full(len(where), 8))
    at = at + 8 * orders
    f = np.flatnonzero(lpc)
    put_bits(bits, at[f], np.full(len(f), ((LPC_BITS - 1) << 5) | LPC_SHIFT), np.full(len(f), 9))
    for k in range(LPC_ORDER):
        put_bits(bits, at[f] + 9 + LPC_BITS * k, coef[k][f] & ((1 << LPC_BITS) - 1), np.full(len(f), LPC_BITS))
    at = np.where(lpc, at + 9 + LPC_BITS * LPC_ORDER, at)
    f = np.flatnonzero(coded)
    put_bits(bits, at[f], np.full(len(f), PARTITION_ORDER), np.full(len(f), 6))
    at = at + 6
    # residuals: each partition has its parameter first
    lengths = np.where(coded[of], lengths, 0)
    before = np.cumsum(lengths) - lengths
    place = at[of] + before - before[start][of] + 4 * (part_of % parts + 1)
    p = np.flatnonzero(np.repeat(coded, parts))
    put_bits(bits, place[part_start[p]] - 4, rice[p], np.full(len(p), 4))
    s = np.flatnonzero(lengths > 0)
    k = rice[part_of[s]]
    q = residual[s] >> k
    bits[place[s] + q] = 1
    put_bits(bits, place[s] + q + 1, residual[s] & ((1 << k) - 1), k)
    data = np.packbits(bits)
    del bits
    for f in range(n_frames):
        data[frame_at[f] : frame_at[f] + head_len[f]] = np.frombuffer(heads[f], dtype=np.uint8)
    crc = crc16s(data, frame_at, frame_at + frame_len - 2)
    data[frame_at + frame_len - 2] = crc >> np.uint16(8)
    data[frame_at + frame_len - 1] = crc & np.uint16(0xFF)
    body = data.tobytes()
    out, f = [], 0
    for d, payload in enumerate(payloads):
        own = slice(f, f + int(per[d]))
        f += int(per[d])
        base, stop = int(frame_at[own][0]), int(frame_at[own][-1] + frame_len[own][-1])
        points = b"".join(int(a).to_bytes(8, "big") + int(b - base).to_bytes(8, "big") + int(c).to_bytes(2, "big") for a, b, c in zip(number[own] * BLOCK, frame_at[own], n[own]))
        packed = RATE << 44 | 7 << 36 | len(payload)  # one channel, 8 bits
        signed = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + int(frame_len[own].min()).to_bytes(3, "big") + int(frame_len[own].max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + body[base:stop])
    return out


class Bits:
    """Reads single fields of a stream; the samples themselves are read side by side elsewhere."""

    def __init__(self, data: bytes, byte: int):
        self.data, self.at = data, byte * 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        v = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n)
        self.at += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v


def stream_info(media: bytes) -> dict:
    """STREAMINFO and seek points of a stream, and where its frames begin."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points = 4, None, []
    while True:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 0x7F == 0:
            packed = int.from_bytes(block[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": block[18:34]}
        elif kind & 0x7F == 3:
            points = [(int.from_bytes(block[i : i + 8], "big"), int.from_bytes(block[i + 8 : i + 16], "big"), int.from_bytes(block[i + 16 : i + 18], "big")) for i in range(0, len(block), 18)]
        if kind & 0x80:
            break
    if info is None or info["channels"] != 1 or info["bits"] != 8:
        raise ValueError("only mono streams of 8 bits are decoded")
    return info | {"points": [p for p in points if p[0] != (1 << 64) - 1], "frames_at": at}


def frame_head(data: bytes, byte: int) -> dict:
    """Header and subframe fields of the frame at a byte, up to its residual."""
    if data[byte : byte + 1] != b"\xff" or data[byte + 1] >> 2 != 0x3E:
        raise ValueError("no frame where one should begin")
    size_code, rate_code = data[byte + 2] >> 4, data[byte + 2] & 15
    at = byte + 4
    lead = data[at]
    at += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    # Block sizes by code.
    if size_code == 6:
        n, at = data[at] + 1, at + 1
    elif size_code == 7:
        n, at = int.from_bytes(data[at : at + 2], "big") + 1, at + 2
    elif size_code == 1:
        n = 192
    elif 2 <= size_code <= 5:
        n = 576 << (size_code - 2)
    elif size_code >= 8:
        n = 256 << (size_code - 8)
    else:
        raise ValueError("reserved block size")
    at += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if crc8(data[byte:at]) != data[at]:
        raise ValueError("a frame header's CRC-8 is wrong")
    r = Bits(data, at + 1)
    kind = r.take(8)
    if kind & 0x81:
        raise ValueError("wasted bits are not decoded")
    kind >>= 1
    head = {"n": n, "byte": byte, "kind": kind, "coef": [], "shift": 0, "warm": []}
    if kind == 0:
        head["warm"] = [r.signed(8)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        head["warm"] = [r.signed(8) for _ in range(order)]
        if kind < 32:
            head["coef"] = FIXED[order]
        else:
            width = r.take(4) + 1
            head["shift"] = r.signed(5)
            head["coef"] = [r.signed(width) for _ in range(order)]
        method = r.take(2)
        if method > 1 or head["shift"] < 0:
            raise ValueError("reserved residual coding")
        head["wide"] = 4 + method
        head["parts"] = 1 << r.take(4)
    elif kind != 1:
        raise ValueError("reserved subframe")
    head["bit"] = r.at
    return head


def read_frames(data: bytes, heads: list[dict]) -> list[tuple[np.ndarray, int]]:
    """Samples, and the byte after the subframe, of each frame."""
    out: list = [None] * len(heads)
    coded = []
    for k, h in enumerate(heads):
        if h["kind"] == 0:
            out[k] = (np.full(h["n"], h["warm"][0], dtype=np.int32), (h["bit"] + 7) >> 3)
        elif h["kind"] == 1:
            bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=h["n"] + 1, offset=h["bit"] >> 3))[h["bit"] & 7 :][: 8 * h["n"]]
            out[k] = (np.packbits(bits).view(np.int8).astype(np.int32), (h["bit"] + 8 * h["n"] + 7) >> 3)
        else:
            coded.append(k)
    if coded:
        coded.sort(key=lambda k: -heads[k]["n"])
        for k, got in zip(coded, _read_coded(data, [heads[k] for k in coded])):
            out[k] = got
    return out


def _read_coded(data: bytes, heads: list[dict]) -> list[tuple[np.ndarray, int]]:
    """Rice residuals and predictors of all frames side by side; frames come longest first."""
    raw = np.frombuffer(data + bytes(16), dtype=np.uint8)
    window = np.zeros(len(raw) - 8, dtype=np.uint64)
    for k in range(8):
        window |= raw[k : k + len(window)].astype(np.uint64) << np.uint64(56 - 8 * k)
    m = len(heads)
    n = np.array([h["n"] for h in heads])
    order = np.array([len(h["coef"]) for h in heads])
    most = int(order.max(initial=0))
    pad = max(most, 1)
    coef = np.zeros((pad, m), dtype=np.int64)
    x = np.zeros((pad + int(n[0]), m), dtype=np.int64)
    for f, h in enumerate(heads):
        coef[: len(h["coef"]), f] = h["coef"]
        x[pad : pad + len(h["warm"]), f] = h["warm"]
    shift = np.array([h["shift"] for h in heads])
    wide = np.array([h["wide"] for h in heads])
    step = n // np.array([h["parts"] for h in heads])
    at = np.array([h["bit"] for h in heads], dtype=np.int64)
    rice = np.zeros(m, dtype=np.uint64)
    escape = np.full(m, -1)
    any_escape = False
    edges = np.zeros(int(n[0]) + 1, dtype=bool)
    for a, b, o in {(int(s), int(c), int(w)) for s, c, w in zip(step, n, order)}:
        edges[o] = True
        edges[0:b:a] = True
    one, six3, seven = np.uint64(1), np.uint64(63), np.int64(7)

    def look(pos: np.ndarray) -> np.ndarray:
        return window[pos >> 3] << (pos & seven).astype(np.uint64)

    for i in range(int(n[0])):
        live = m if n[-1] > i else int(np.searchsorted(-n, -i, side="left"))
        if edges[i]:
            opens = np.flatnonzero((i >= order[:live]) & ((i % step[:live] == 0) | (i == order[:live])))
            if len(opens):
                w = wide[opens]
                k = (look(at[opens]) >> (64 - w).astype(np.uint64)).astype(np.int64)
                at[opens] += w
                esc = k == (1 << w) - 1
                escape[opens] = -1
                if esc.any():
                    e = opens[esc]
                    escape[e] = (look(at[e]) >> np.uint64(59)).astype(np.int64)
                    at[e] += 5
                    k[esc] = 0
                rice[opens] = k.astype(np.uint64)
                any_escape = bool((escape >= 0).any())
        pos = at[:live]
        w = look(pos)
        q = 52 - ((w >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52) + 1023
        k = rice[:live]
        rare = q > 24  # a long run of zeros: count it in steps of what a window surely holds
        if rare.any():
            for f in np.flatnonzero(rare & (i >= order[:live]) & (escape[:live] < 0)):
                p, run = int(pos[f]), 0
                while not (top := int(window[p >> 3]) << (p & 7) & (1 << 64) - 1) >> 8:
                    p, run = p + 56 - 7, run + 49
                    if p >> 3 >= len(window):
                        raise ValueError("a residual runs past the end")
                q[f] = run + 64 - top.bit_length()
            q[rare & ((i < order[:live]) | (escape[:live] >= 0))] = 0
        p = pos + q + 1
        v = ((look(p) >> one) >> (six3 - k)).astype(np.int64)
        u = (q << k.astype(np.int64)) | v
        res = (u >> 1) ^ -(u & 1)
        p = p + k.astype(np.int64)
        if any_escape:
            for f in np.flatnonzero(escape[:live] >= 0):
                width = int(escape[f])
                res[f] = Bits(data, 0).signed(0) if not width else _signed_at(data, int(pos[f]), width)
                p[f] = pos[f] + width
        guess = coef[0, :live] * x[pad + i - 1, :live]
        for j in range(1, most):
            guess += coef[j, :live] * x[pad + i - 1 - j, :live]
        value = res + (guess >> shift[:live])
        if i < most:
            ready = i >= order[:live]
            x[pad + i, :live] = np.where(ready, value, x[pad + i, :live])
            at[:live] = np.where(ready, p, pos)
        else:
            x[pad + i, :live] = value
            at[:live] = p
        if i & 255 == 255 and (at >> 3 >= len(window)).any():
            raise ValueError("a residual runs past the end")
    if (at > 8 * len(data)).any():
        raise ValueError("a residual runs past the end")
    columns = np.ascontiguousarray(x[pad:].T)
    return [(columns[f, : n[f]], int(at[f] + 7) >> 3) for f in range(m)]


def _signed_at(data: bytes, bit: int, width: int) -> int:
    r = Bits(data, 0)
    r.at = bit
    return r.signed(width)


def decode(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks of each stream: (offset of the first sample, samples as the payload's bytes)."""
    infos = [stream_info(m) for m in media]
    data = b"".join(media)
    base = np.cumsum([0, *map(len, media)])
    heads, owner, ends, slow = [], [], [], []
    for d, (m, info) in enumerate(zip(media, infos)):
        points = info["points"]
        if points and points[0][:2] == (0, 0) and sum(c for _, _, c in points) == info["samples"] and all(a[0] + a[2] == b[0] for a, b in zip(points, points[1:])):
            at = [int(base[d]) + info["frames_at"] + p[1] for p in points]
            heads += [frame_head(data, b) for b in at]
            ends += [*at[1:], int(base[d]) + len(m)]
            owner += [d] * len(at)
        else:
            slow.append(d)
    frames = read_frames(data, heads)
    for d in slow:
        at, got = int(base[d]) + infos[d]["frames_at"], 0
        while got < infos[d]["samples"]:
            h = frame_head(data, at)
            s, stop = read_frames(data, [h])[0]
            heads.append(h)
            frames.append((s, stop))
            at = stop + 2
            ends.append(at)
            owner.append(d)
            got += len(s)
    raw = np.frombuffer(data, dtype=np.uint8)
    starts, ends = np.array([h["byte"] for h in heads]), np.array(ends)
    if any(stop + 2 != e for (_, stop), e in zip(frames, ends)):
        raise ValueError("a frame ends elsewhere than the seek table says")
    if len(ends) and (crc16s(raw, starts, ends - 2) != (raw[ends - 2].astype(np.uint16) << np.uint16(8) | raw[ends - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    out: list = [[] for _ in media]
    for d, (s, _) in zip(owner, frames):
        offset = out[d][-1][0] + len(out[d][-1][1]) if out[d] else 0
        out[d].append((offset, (s + 128).astype(np.uint8).tobytes()))
    for d, info in enumerate(infos):
        signed = (np.frombuffer(b"".join(b for _, b in out[d]), dtype=np.uint8) ^ 0x80).tobytes()
        if len(signed) != info["samples"] or hashlib.md5(signed).digest() != info["md5"]:
            raise ValueError("the samples' MD5 is wrong")
    return out


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def feature(blocks: list[tuple[int, bytes]]) -> str:
    """Whole-number features of the samples: blocks, sum and mean square, sign changes, peak."""
    x = np.frombuffer(b"".join(b for _, b in blocks), dtype=np.uint8).astype(np.int64) - 128
    turns = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"blocks={len(blocks)};sum={int(x.sum())};energy={int((x * x).sum() // len(x))};crossings={turns};peak={int(np.abs(x).max())}"


def groups(values: list, size, most: int) -> Iterator[list]:
    group, total = [], 0
    for v in values:
        group.append(v)
        total += size(v)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group


def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, DECODE_BYTES):
        media = [m for g in groups([payload_of(t) for t in batch.column(0).to_pylist()], len, ENCODE_BYTES) for m in encode(g)]
        yield pa.RecordBatch.from_arrays([pa.array(media, pa.binary()), *batch.columns[1:]], names=["media", *batch.schema.names[1:]])


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "block_offsets"]
    for batch in pieces(batches, DECODE_BYTES):
        rows = []
        for g in groups(batch.column(0).to_pylist(), len, DECODE_BYTES):
            for media, blocks in zip(g, decode(g)):
                pcm = b"".join(b for _, b in blocks)
                rows.append((len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(blocks), [o for o, _ in blocks]))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], *names])


def round_trip_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return digest_batches(encode_batches(batches))


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, DECODE_BYTES):
        decoded = [b for g in groups(batch.column(0).to_pylist(), len, DECODE_BYTES) for b in decode(g)]
        rows = np.repeat(np.arange(batch.num_rows), [len(b) for b in decoded])
        flat = [b for d in decoded for b in d]
        cols = [c.take(pa.array(rows)) for c in batch.columns[1:]]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([o for o, _ in flat], pa.int64()), pa.array([b for _, b in flat], pa.binary())], names=[*batch.schema.names[1:], "sample_offset", "pcm"])


def _run(df: DataFrame, column: str, run, first: str, last: str) -> DataFrame:
    ship(__name__)
    made = {part.split()[0] for part in ", ".join(filter(None, (first, last))).split(", ")}
    kept = [f for f in df.schema if f.name != column and f.name not in made]
    schema = ", ".join(filter(None, [first, *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), last]))
    return df.select(F.col(f"`{column}`"), *[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def to_flac(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text column by ``media``, its FLAC stream; equal texts give equal streams."""
    return _run(df, text, encode_batches, "media binary", "")


DIGEST = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, block_offsets array<bigint>"


def flac_digest(df: DataFrame) -> DataFrame:
    """Decode ``media`` with every checksum verified, and replace it by digests, features and the blocks' first samples."""
    return _run(df, "media", digest_batches, "", DIGEST)


def flac_round_trip(df: DataFrame, text: str = "text") -> DataFrame:
    """As flac_digest(to_flac(df)), in one Python worker for each task; the decoder gets the streams alone."""
    return _run(df, text, round_trip_batches, "", DIGEST)


def flac_blocks(df: DataFrame) -> DataFrame:
    """Decode ``media`` to one row for each PCM block, with the offset of its first sample."""
    return _run(df, "media", block_batches, "", "sample_offset bigint, pcm binary")


def op8_query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return flac_round_trip(docs)
