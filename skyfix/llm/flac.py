"""Media columns as FLAC: 8-bit mono streams encoded and decoded with NumPy, many frames in lockstep.

A payload's bytes, less 128, are the samples. A stream is the marker, STREAMINFO (with the MD5 of the samples), a SEEKTABLE
with the first sample of every `seek_every`th frame, and frames of `block` samples. Each frame's subframe is a constant, or the
cheapest of the fixed linear predictors of order 0 to 2 and a quantised linear predictor of order 8 fitted to the frame, with Rice-coded residuals in as many partitions as are shortest,
or verbatim where Rice codes would be longer.

Decoding reads what the format allows for such streams in general: constant, verbatim, fixed (order 0 to 4) and LPC
subframes, residuals in either Rice coding method with any number of partitions and escaped partitions, 8-bit mono frames of one block size (a shorter
last one too). Frames of like layout are decoded together, sample by sample: a step reads one residual of every
frame from a 64-bit window (leading zeros, then the remainder). Frame headers are checked by CRC-8, frames by CRC-16, the whole by MD5.

Defined results: a null payload is the empty text, which pads to one block; equal payloads give equal streams. Other
columns are never read, ids pass through (null or repeated ones too), an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfix.llm.common import map_slices

BLOCK, RATE, SEEK_EVERY = 576, 8000, 64
#: The format's polynomials, predictors, and codes of block size 576, rate 8 kHz, 8 bits.
POLY8, POLY16 = 0x07, 0x8005
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
SIZE_CODE, RATE_CODE, BITS_CODE = 2, 4, 1
#: Frames handled in one lockstep pass.
LANES = 4096
#: Order and bits of the fitted predictor, and the most partitions of a frame, as a power of two.
ORDER, PRECISION, MOST_PARTITIONS = 8, 12, 4


@functools.lru_cache(maxsize=2)
def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.uint32)
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        out[b] = c
    return out


@functools.lru_cache(maxsize=1)
def _crc16_wide() -> list[np.ndarray]:
    """Tables for eight bytes at a step: what a byte adds once k more bytes have passed."""
    t = _crc_table(POLY16, 16)
    out = [t]
    for _ in range(7):
        p = out[-1]
        out.append((((p << 8) & 0xFFFF) ^ t[p >> 8]).astype(np.uint32))
    return out


def crc16(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges at once, eight bytes a step; ranges count as preceded by zero bytes, which don't change it."""
    out = np.zeros(len(starts), np.uint32)
    if not len(starts):
        return out
    tables = _crc16_wide()
    steps = int(sizes.max() + 7) // 8
    padded = np.concatenate([np.zeros(8, np.uint8), flat])
    # lane l holds its range right-aligned in steps * 8 bytes; bytes before the range read as zero
    begin = starts + 8 + sizes - steps * 8
    for s in range(steps):
        at = begin + s * 8
        first = starts + 8
        b = [np.where(at + k >= first, padded[np.maximum(at + k, 0)], 0) if s * 8 + k < steps * 8 - int(sizes.min()) else padded[at + k] for k in range(8)]
        out = tables[7][b[0] ^ (out >> 8)] ^ tables[6][b[1] ^ (out & 255)] ^ tables[5][b[2]] ^ tables[4][b[3]] ^ tables[3][b[4]] ^ tables[2][b[5]] ^ tables[1][b[6]] ^ tables[0][b[7]]
    return out


def crc8(data: bytes) -> int:
    t, c = _crc_table(POLY8, 8), 0
    for x in data:
        c = int(t[c ^ x])
    return c


@functools.lru_cache(maxsize=1 << 16)
def _frame_header(number: int) -> bytes:
    """Sync, fixed block size, the codes, the frame's number in the format's UTF-8 form, CRC-8."""
    if number < 128:
        coded = bytes([number])
    else:
        n = next(n for n in range(2, 8) if number < 1 << (5 * n + 1))
        parts = [0x80 | (number >> (6 * k)) & 63 for k in reversed(range(n))]
        parts[0] = ((0xFF << (8 - n)) & 0xFF) | (number >> (6 * (n - 1)))
        coded = bytes(parts)
    head = bytes([0xFF, 0xF8, SIZE_CODE << 4 | RATE_CODE, BITS_CODE << 1]) + coded
    return head + bytes([crc8(head)])


class CorruptStream(ValueError):
    """A checksum or a field that doesn't fit."""


def _residuals(samples: np.ndarray, order: int) -> np.ndarray:
    return np.diff(samples, n=order, axis=1) if order else samples


def _fitted(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(taps, shift): quantised predictors of all frames, from their autocorrelations by the Levinson recursion."""
    x = samples.astype(np.float64)
    r = np.stack([(x[:, lag:] * x[:, : x.shape[1] - lag]).sum(axis=1) for lag in range(ORDER + 1)])
    error, taps = r[0] * (1 + 1e-9) + 1e-9, np.zeros((ORDER, len(x)))
    for i in range(ORDER):
        k = (r[i + 1] - (taps[:i] * r[i:0:-1]).sum(axis=0)) / error
        before = taps[:i].copy()
        taps[:i], taps[i] = before - k * before[::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(taps).max(axis=0), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)), 0, 15).astype(np.int64)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(taps * 2.0**shift), -most - 1, most).astype(np.int32), shift


def _unpredicted(samples: np.ndarray, taps: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals of the fitted predictors, of every sample but the first ORDER."""
    n = samples.shape[1]
    guess = np.zeros((len(samples), n - ORDER), np.int32)
    for j in range(ORDER):
        guess += taps[j][:, None] * samples[:, ORDER - 1 - j : n - 1 - j]
    return samples[:, ORDER:] - (guess >> shift[:, None].astype(np.int32))


def _rice_bits(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, parameter) of Rice codes of rows of folded residuals along the last axis, parameters apart."""
    near = np.clip(np.log2(u.mean(axis=-1) + 1e-9), 0, 13).astype(np.int32)  # the best parameter is this or one less
    best = None
    for k in (near, np.maximum(near - 1, 0)):
        bits = (u >> k[..., None]).sum(axis=-1, dtype=np.int64) + (k.astype(np.int64) + 1) * u.shape[-1]
        best = (bits, k) if best is None else (np.minimum(best[0], bits), np.where(bits < best[0], k, best[1]))
    return best


def _partitioned(u: np.ndarray, order: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, partition order, parameters of up to 2^MOST_PARTITIONS partitions) of rows of folded residuals; the first partition lacks the predictor's first samples."""
    n = len(u)
    bits, k = _rice_bits(u)
    bits, at, ks = bits + 4, np.zeros(n, np.int64), np.zeros((n, 1 << MOST_PARTITIONS), np.int64)
    ks[:, 0] = k
    for p in range(1, MOST_PARTITIONS + 1):
        size, parts = block >> p, 1 << p
        if block % parts or size <= order:
            break
        first, k0 = _rice_bits(u[:, : size - order])
        rest, k1 = _rice_bits(u[:, size - order :].reshape(n, parts - 1, size))
        total = first + rest.sum(axis=1) + 4 * parts
        better = total < bits
        bits, at = np.where(better, total, bits), np.where(better, p, at)
        ks[better, 0], ks[better, 1:parts] = k0[better], k1[better]
    return bits, at, ks


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of int samples (frames x block) with these numbers."""
    n, block = samples.shape
    taps, shift = _fitted(samples)
    best_bits, best_kind = np.full(n, 8 * block, np.int64), np.full(n, -1)  # kinds: the fixed order, or 3 for the fitted predictor
    orders, extra, folded = (0, 1, 2, ORDER), (0, 0, 0, 9 + ORDER * PRECISION), []
    for kind, order in enumerate(orders):
        r = _unpredicted(samples, taps, shift) if kind == 3 else _residuals(samples, order)
        u = ((r << 1) ^ (r >> 31)).astype(np.int32)
        folded.append(u)
        bits = _rice_bits(u)[0] + 8 * order + extra[kind] + 10
        better = bits < best_bits
        best_bits[better], best_kind[better] = bits[better], kind
    constant = (samples == samples[:, :1]).all(axis=1)
    partitions, ks = np.zeros(n, np.int64), np.zeros((n, 1 << MOST_PARTITIONS), np.int64)
    for kind, order in enumerate(orders):
        rows = np.flatnonzero(~constant & (best_kind == kind))
        if len(rows):
            bits, partitions[rows], ks[rows] = _partitioned(folded[kind][rows], order, block)
            best_bits[rows] = bits + 8 * order + extra[kind] + 6
    heads = [_frame_header(int(x)) for x in numbers]
    head_size = np.fromiter(map(len, heads), np.int64, n)
    body_bits = np.where(constant, 8 + 8, 8 + best_bits)
    sizes = head_size + (body_bits + 7) // 8 + 2
    starts = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()) // 4 + 3, np.float64)

    def put(bit: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
        """ORs values of up to 24 bits, given where they begin; disjoint bits add up exactly."""
        word, shift_ = bit >> 5, 64 - (bit & 31) - width
        wide = value.astype(np.uint64) << shift_.astype(np.uint64)
        base = int(word[0]) if len(word) else 0
        span = int(word[-1]) - base + 2 if len(word) else 0
        if not span:
            return
        words[base : base + span] += np.bincount(word - base, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=span)[:span]
        words[base : base + span] += np.bincount(word - base + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=span)[:span]

    body = (starts + head_size) * 8
    type_ = np.array([8 << 1, 9 << 1, 10 << 1, (31 + ORDER) << 1, 1 << 1])  # of kinds; the last, at -1, is verbatim
    put(body, np.where(constant, 0, type_[best_kind]), 8)
    raw = samples & 0xFF
    if constant.any():
        put(body[constant] + 8, raw[constant, 0], 8)
    verbatim = ~constant & (best_kind < 0)
    if verbatim.any():
        at = body[verbatim][:, None] + 8 + 8 * np.arange(block)[None, :]
        put(at.ravel(), raw[verbatim].ravel(), 8)
    for kind, order in enumerate(orders):
        for p in range(MOST_PARTITIONS + 1):
            rows = np.flatnonzero(~constant & (best_kind == kind) & (partitions == p))
            if not len(rows):
                continue
            at = body[rows] + 8
            for i in range(order):
                put(at + 8 * i, raw[rows, i], 8)
            at = at + 8 * order
            if kind == 3:
                put(at, ((PRECISION - 1) << 5) | shift[rows], 9)
                for j in range(ORDER):
                    put(at + 9 + PRECISION * j, taps[j, rows] & ((1 << PRECISION) - 1), PRECISION)
                at = at + 9 + PRECISION * ORDER
            put(at, np.full(len(rows), p), 6)  # method 0, the partition order
            part = np.arange(order, block) // (block >> p)
            opens = np.diff(part, prepend=-1) > 0
            u, k = folded[kind][rows], ks[rows][:, part]
            lens = (u >> k) + 1 + k
            ends = np.cumsum(lens + 4 * opens, axis=1) + (at + 6)[:, None]
            put((ends - lens - 4)[:, opens].ravel(), k[:, opens].ravel(), 4)
            width = k + 1
            put((ends - width).ravel(), ((1 << k) | (u & ((1 << k) - 1))).ravel(), width.ravel())
    flat = words.astype(np.uint32).astype(">u4").view(np.uint8)[: int(sizes.sum())]
    for length in np.unique(head_size):
        rows = np.flatnonzero(head_size == length)
        flat[starts[rows][:, None] + np.arange(length)] = np.frombuffer(b"".join(heads[i] for i in rows), np.uint8).reshape(-1, length)
    crc = crc16(flat, starts, sizes - 2)
    flat[starts + sizes - 2], flat[starts + sizes - 1] = crc >> 8, crc & 255
    data = flat.tobytes()
    return [data[a : a + s] for a, s in zip(starts.tolist(), sizes.tolist())]


def encode_streams(payloads: list[bytes], block: int = BLOCK, seek_every: int = SEEK_EVERY) -> list[bytes]:
    """A stream for each payload, of a positive multiple of block bytes."""
    counts = [len(p) // block for p in payloads]
    if block != BLOCK or any(len(p) % block or not p for p in payloads):
        raise ValueError("payloads must hold a positive multiple of 576 bytes")
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, block)
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    frames: list[bytes] = []
    for a in range(0, len(flat), LANES):
        frames += encode_frames(flat[a : a + LANES].astype(np.int32) - 128, numbers[a : a + LANES])
    out, at = [], 0
    for p, c in zip(payloads, counts):
        own = frames[at : at + c]
        at += c
        sizes = list(map(len, own))
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()  # two's complement of the byte less 128
        info = block.to_bytes(2) * 2 + min(sizes).to_bytes(3) + max(sizes).to_bytes(3) + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8) + hashlib.md5(signed).digest()
        points, offset = [], 0
        for i, s in enumerate(sizes):
            if i % seek_every == 0:
                points.append((i * block).to_bytes(8) + offset.to_bytes(8) + block.to_bytes(2))
            offset += s
        table = b"".join(points)
        out.append(b"fLaC" + bytes([0]) + len(info).to_bytes(3) + info + bytes([0x83]) + len(table).to_bytes(3) + table + b"".join(own))
    return out


class _Bits:
    """64 bits from any bit of a byte array, for many lanes at once."""

    def __init__(self, flat: np.ndarray):
        padded = np.concatenate([flat, np.zeros(16, np.uint8)])
        be = padded[: len(padded) // 8 * 8].view(">u8").astype(np.uint64)
        self.words = be

    def at(self, bit: np.ndarray) -> np.ndarray:
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        low = (self.words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - shift)
        return (self.words[word] << shift) | low


def _leading_zeros(window: np.ndarray) -> np.ndarray:
    """Of 52 bits at most: the exponent of the top bits as a float."""
    top = (window >> np.uint64(12)).astype(np.float64)
    return 52 - np.frexp(top)[1]


def _signed(value: np.ndarray, bits: int) -> np.ndarray:
    v = value.astype(np.int64)
    return v - ((v >> (bits - 1)) << bits)


def decode_subframes(bits: _Bits, at: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """8-bit samples (frames x block) of the subframes at these bit positions, and where they end."""
    n = len(at)
    out, end = np.zeros((n, block), np.int64), at.copy()
    head = (bits.at(at) >> np.uint64(56)).astype(np.int64)
    if (head & 0x81).any():
        raise CorruptStream("padding bit or wasted bits in a subframe header")
    kind = head >> 1
    for k in np.unique(kind):
        rows = np.flatnonzero(kind == k)
        pos = at[rows] + 8
        if k == 0:
            out[rows] = _signed(bits.at(pos) >> np.uint64(56), 8)[:, None]
            end[rows] = pos + 8
        elif k == 1:
            for i in range(block):
                out[rows, i] = _signed(bits.at(pos + 8 * i) >> np.uint64(56), 8)
            end[rows] = pos + 8 * block
        elif 8 <= k <= 12 or k >= 32:
            order = int(k - 8 if k < 32 else k - 31)
            got = np.zeros((block, len(rows)), np.int64)  # a row for each sample: lockstep writes whole rows
            for i in range(order):
                got[i] = _signed(bits.at(pos) >> np.uint64(56), 8)
                pos = pos + 8
            if k < 32:
                taps, shift = np.broadcast_to(np.array(FIXED[order], np.int64), (len(rows), order)), np.zeros(len(rows), np.int64)
            else:
                w = bits.at(pos)
                precision = (w >> np.uint64(60)).astype(np.int64) + 1
                shift = _signed((w >> np.uint64(55)) & np.uint64(31), 5)
                if (precision == 16).any() or (shift < 0).any():
                    raise CorruptStream("reserved predictor precision or shift")
                pos = pos + 9
                taps = np.zeros((len(rows), order), np.int64)
                for i in range(order):
                    v = (bits.at(pos) >> (np.uint64(64) - precision.astype(np.uint64))).astype(np.int64)
                    taps[:, i] = v - ((v >> (precision - 1)) << precision)
                    pos = pos + precision
            pos = _rice(bits, pos, got, order, block)
            if k < 32 and order <= 2:
                if order == 2:
                    got[1] -= got[0]
                    got[1:] = np.cumsum(got[1:], axis=0)
                if order:
                    got = np.cumsum(got, axis=0)
            else:
                taps = np.ascontiguousarray(taps.T)
                for i in range(order, block):
                    predicted = (taps * got[i - order : i][::-1]).sum(axis=0) if order else 0
                    got[i] += predicted >> shift
            out[rows] = got.T
            end[rows] = pos
        else:
            raise CorruptStream(f"reserved subframe type {k}")
    return out, end


def _rice(bits: _Bits, pos: np.ndarray, got: np.ndarray, order: int, block: int) -> np.ndarray:
    """Residuals into got[order:], a step a sample for all lanes; the parameter changes where a lane's partition does."""
    w = bits.at(pos)
    method, parts = (w >> np.uint64(62)).astype(np.int64), ((w >> np.uint64(58)) & np.uint64(15)).astype(np.int64)
    if (method > 1).any() or (block % (1 << parts) != 0).any():
        raise CorruptStream("reserved residual coding or uneven partitions")
    pos = pos + 6
    length = block >> parts
    width, escape = 4 + method, (16 << method) - 1
    k, raw = np.zeros(len(pos), np.int64), np.full(len(pos), -1)
    one, uk = np.uint64(1), np.zeros(len(pos), np.uint64)
    many = bool((parts > 0).any())
    plain = True
    for i in range(order, block):
        if i == order or (many and ((i % length) == 0).any()):
            new = np.full(len(pos), True) if i == order else (i % length) == 0
            w = bits.at(pos)
            p = (w >> (np.uint64(64) - width.astype(np.uint64))).astype(np.int64)
            esc = new & (p == escape)
            size = ((w << width.astype(np.uint64)) >> np.uint64(59)).astype(np.int64)
            k, raw = np.where(new, p, k), np.where(esc, size, np.where(new, -1, raw))
            pos = pos + np.where(new, width, 0) + np.where(esc, 5, 0)
            uk, plain = np.maximum(np.where(raw >= 0, 0, k), 0).astype(np.uint64), not (raw >= 0).any()
        w = bits.at(pos)
        q = _leading_zeros(w)
        far = q >= 40
        if far.any():
            lanes = np.flatnonzero(far if plain else far & (raw < 0))
            q = q.copy()
            for lane in lanes:
                p, n = int(pos[lane]), 0
                while True:
                    z = int(_leading_zeros(bits.at(np.array([p])))[0])
                    n, p = n + z, p + z
                    if z < 52:
                        break
                    if n > 1 << 16:
                        raise CorruptStream("endless unary code")
                q[lane] = n
            w = bits.at(pos + np.where(far, q, 0))
            drop = np.where(far, 0, q)
        else:
            drop = q
        rest = (w << drop.astype(np.uint64)) << one
        u = (q << k) | ((rest >> one) >> (np.uint64(63) - uk)).astype(np.int64)
        value = (u >> 1) ^ -(u & 1)
        step = q + 1 + k
        if not plain:
            e = raw >= 0
            bitsize = np.maximum(raw, 1)
            v = (bits.at(pos) >> (np.uint64(64) - bitsize.astype(np.uint64))).astype(np.int64)
            v = np.where(raw == 0, 0, v - ((v >> (bitsize - 1)) << bitsize))
            value, step = np.where(e, v, value), np.where(e, raw, step)
        got[i] = value
        pos = pos + step
    return pos


def _parse_header(stream: bytes, at: int) -> tuple[int, int]:
    """Checks a frame header; its number and size."""
    if stream[at] != 0xFF or stream[at + 1] != 0xF8 or stream[at + 2] >> 4 != SIZE_CODE or stream[at + 3] != BITS_CODE << 1:
        raise CorruptStream("no frame of 576 8-bit mono samples here")
    first = stream[at + 4]
    extra = 0 if first < 128 else 8 - (first ^ 0xFF).bit_length() - 1
    number = first if not extra else first & (0x3F >> extra)
    for i in range(extra):
        number = number << 6 | stream[at + 5 + i] & 63
    size = 5 + extra
    if crc8(stream[at : at + size]) != stream[at + size]:
        raise CorruptStream("frame header checksum")
    return number, size + 1


class Stream:
    """The metadata of a stream: samples, MD5, seek points, and where frames begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise CorruptStream("no FLAC marker")
        at, last, self.seek = 4, False, []
        while not last:
            kind, size = data[at] & 127, int.from_bytes(data[at + 1 : at + 4])
            last, body = bool(data[at] & 128), data[at + 4 : at + 4 + size]
            if kind == 0:
                self.block, packed = int.from_bytes(body[:2]), int.from_bytes(body[10:18])
                self.samples, self.md5 = packed & ((1 << 36) - 1), body[18:34]
                if (packed >> 36) & 31 != 7 or (packed >> 41) & 7 or self.block != BLOCK:
                    raise CorruptStream("not 8-bit mono of block 576")
            elif kind == 3:
                self.seek = [(int.from_bytes(body[i : i + 8]), int.from_bytes(body[i + 8 : i + 16])) for i in range(0, size, 18)]
            at += 4 + size
        self.first = at


def decode_streams(streams: list[bytes], verify: bool = True) -> list[bytes]:
    """The payloads of whole streams; all of their frames are decoded in lockstep, a frame's place known from the one before.

    Frame boundaries come from a scan for headers whose CRC-8 and number fit; a boundary counts only if the CRC-16 up to it is right.
    """
    heads = [Stream(s) for s in streams]
    flat = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])[:-1]
    starts, sizes, tops = [], [], []
    for s, h, b in zip(streams, heads, base):
        frames, at, number = -(-h.samples // h.block), h.first, 0
        places = []
        while number < frames:
            expected = _frame_header(number)
            found = at if not places else s.find(expected, at)
            if found < 0 or s[found : found + len(expected)] != expected:
                if not places or found < 0:
                    _parse_header(s, at)  # says what is wrong
                    raise CorruptStream("a frame is missing")
            places.append((found, len(expected)))
            at, number = found + len(expected), number + 1
        ends = [*(p for p, _ in places[1:]), len(s)]
        starts += [int(b) + p for p, _ in places]
        sizes += [e - p for (p, _), e in zip(places, ends)]
        tops += [n for _, n in places]
    starts, sizes, tops = np.array(starts, np.int64), np.array(sizes, np.int64), np.array(tops, np.int64)
    samples = np.zeros((len(starts), BLOCK), np.uint8)
    bits = _Bits(flat)
    for a in range(0, len(starts), LANES):
        z = slice(a, a + LANES)
        want = flat[starts[z] + sizes[z] - 2].astype(np.uint32) << 8 | flat[starts[z] + sizes[z] - 1]
        if (crc16(flat, starts[z], sizes[z] - 2) != want).any():
            if len(streams) > 1:  # the bytes of a header may stand inside a frame: such a stream is read frame by frame
                return [p for s in streams for p in decode_streams([s], verify)]
            return [_in_turn(streams[0], heads[0], verify)]
        got, end = decode_subframes(bits, (starts[z] + tops[z]) * 8, BLOCK)
        if ((end + 7) // 8 + 2 != starts[z] + sizes[z]).any():
            raise CorruptStream("a frame's length doesn't fit its content")
        samples[z] = (got + 128).astype(np.uint8)
    out, at = [], 0
    for h in heads:
        c = h.samples // h.block
        payload = samples[at : at + c].tobytes()
        at += c
        if verify and hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest() != h.md5:
            raise CorruptStream("MD5 of the samples")
        out.append(payload)
    return out


def _in_turn(stream: bytes, h: Stream, verify: bool) -> bytes:
    """A stream whose frames are found by decoding one after the other."""
    rows, at = [], h.first
    for number in range(-(-h.samples // h.block)):
        payload, at = _one_frame(stream, at, number, h.block)
        rows.append(payload)
    data = b"".join(rows)
    if verify and hashlib.md5((np.frombuffer(data, np.uint8) ^ 128).tobytes()).digest() != h.md5:
        raise CorruptStream("MD5 of the samples")
    return data


def _one_frame(stream: bytes, at: int, number: int, block: int) -> tuple[bytes, int]:
    got, size = _parse_header(stream, at)
    if got != number:
        raise CorruptStream("frame number")
    own = np.frombuffer(stream[at : at + 16 * block + 64], np.uint8)
    samples, end = decode_subframes(_Bits(own), np.array([size * 8]), block)
    length = int(end[0] + 7) // 8
    if int(crc16(own, np.zeros(1, np.int64), np.array([length]))[0]) != int.from_bytes(stream[at + length : at + length + 2]):
        raise CorruptStream("frame checksum")
    return (samples[0] + 128).astype(np.uint8).tobytes(), at + length + 2


def _frames_of(s: bytes, h: Stream, first: int, upto: int, careful: bool) -> list[tuple[int, int, int]]:
    """(begin, end, header size) of the frames that hold samples first to upto, from the nearest seek point before on. A frame ends where the next header stands; careful: only if its CRC-16 says so."""
    sample, offset = max((p for p in h.seek if p[0] <= first), default=(0, 0))
    at, number, out = h.first + offset, sample // h.block, []
    while number * h.block < upto:
        head = _frame_header(number)
        if s[at : at + len(head)] != head:
            _parse_header(s, at)
            raise CorruptStream("frame number")
        end = len(s)
        if (number + 1) * h.block < h.samples:
            follow = _frame_header(number + 1)
            end = s.find(follow, at + len(head))
            while careful and end >= 0 and int(crc16(np.frombuffer(s, np.uint8, end - at, at), np.zeros(1, np.int64), np.array([end - at - 2]))[0]) != int.from_bytes(s[end - 2 : end]):
                end = s.find(follow, end + 1)
            if end < 0:
                raise CorruptStream("a frame is missing")
        if (number + 1) * h.block > first:
            out.append((at, end, len(head)))
        at, number = end, number + 1
    return out


def pcm_ranges(streams: list[bytes], ranges: list[tuple[int, int]], careful: bool = False) -> list[bytes]:
    """PCM bytes of a range (first sample, count) of each stream: only its frames are decoded and their CRC-16 checked, those of all streams in lockstep."""
    heads = [Stream(s) for s in streams]
    ends = [min(h.samples, first + count) for h, (first, count) in zip(heads, ranges)]
    held = [_frames_of(s, h, first, upto, careful) for s, h, (first, _), upto in zip(streams, heads, ranges, ends)]
    counts = np.fromiter(map(len, held), np.int64, len(held))
    flat = np.frombuffer(b"".join(s[a:b] for s, own in zip(streams, held) for a, b, _ in own), np.uint8)
    sizes = np.array([b - a for own in held for a, b, _ in own], np.int64)
    starts, tops = np.cumsum(sizes) - sizes, np.array([t for own in held for *_, t in own], np.int64)
    samples, bits = np.zeros((len(sizes), BLOCK), np.uint8), _Bits(flat)
    for a in range(0, len(sizes), LANES):
        z = slice(a, a + LANES)
        if (crc16(flat, starts[z], sizes[z] - 2) != (flat[starts[z] + sizes[z] - 2].astype(np.uint32) << 8 | flat[starts[z] + sizes[z] - 1])).any():
            if careful:
                raise CorruptStream("frame checksum")
            return pcm_ranges(streams, ranges, True)  # the bytes of a header may stand inside a frame
        got, end = decode_subframes(bits, (starts[z] + tops[z]) * 8, BLOCK)
        if ((end + 7) // 8 + 2 != starts[z] + sizes[z]).any():
            raise CorruptStream("a frame's length doesn't fit its content")
        samples[z] = (got + 128).astype(np.uint8)
    out, at = [], 0
    for n, (first, _), upto, h in zip(counts.tolist(), ranges, ends, heads):
        out.append(samples[at : at + n].tobytes()[first % h.block : first % h.block + max(0, upto - first)])
        at += n
    return out


def pcm_blocks(stream: bytes, from_sample: int, count: int) -> bytes:
    """PCM bytes of one stream from a sample offset on."""
    return pcm_ranges([stream], [(from_sample, count)])[0]


def pcm_table(df: DataFrame, id_column: str = "doc_id", block: int = SEEK_EVERY * BLOCK) -> DataFrame:
    """(id, sample_offset, pcm): what the media column holds as PCM blocks of `block` samples, each with the offset of its first sample, decoded and verified a stream at a time."""
    kind = dict(df.select(id_column).dtypes)[id_column]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            payloads = decode_streams(batch.column(1).to_pylist())
            rows = [(i, at, p[at : at + block]) for i, p in zip(batch.column(0).to_pylist(), payloads) for at in range(0, len(p), block)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["id", "sample_offset", "pcm"])

        return each

    return map_slices(df.select(F.col(id_column).alias("id"), "media"), make, f"id {kind}, sample_offset long, pcm binary", text="media").withColumnRenamed("id", id_column)


def padded(data: bytes, block: int = BLOCK) -> bytes:
    return data + b"\xff" * ((-len(data)) % block if data else block)


def feature(payload: bytes) -> str:
    """Mean, root mean square (thousandths, in whole numbers) and zero crossings of the samples."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    n = len(s)
    crossings = int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))
    return f"mean={1000 * int(s.sum()) // n};power={1000 * int((s * s).sum()) // n};crossings={crossings}"


def encode_column(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The text column as a media column: id, n_bytes (before padding), media."""
    kind = dict(df.select(id_column).dtypes)[id_column]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            media = encode_streams([padded(t) for t in texts])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

        return each

    source = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    return map_slices(source, make, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_column)


def decode_column(df: DataFrame, id_column: str = "doc_id", keep_pcm: bool = False) -> DataFrame:
    """What the media column holds, read back and verified: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and pcm, if kept)."""
    kind = dict(df.select(id_column).dtypes)[id_column]

    def make():
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            media = batch.column(2).to_pylist()
            payloads = decode_streams(media)
            tails = pcm_ranges(media, [(len(p) - 32, 32) for p in payloads])  # read by sample offset
            if any(t != p[-32:] for t, p in zip(tails, payloads)):
                raise CorruptStream("a range differs from the whole")
            out = [
                batch.column(0), batch.column(1), pa.array(list(map(len, payloads)), pa.int64()), pa.array(list(map(sha, payloads))), pa.array([zlib.crc32(t) for t in tails], pa.int64()),
                pa.array(list(map(len, media)), pa.int64()), pa.array(list(map(sha, media))), pa.array(list(map(feature, payloads))),
            ]
            names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if keep_pcm:
                out.append(pa.array(payloads, pa.binary()))
                names.append("pcm")
            return pa.RecordBatch.from_arrays(out, names=names)

        return each

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pcm binary" * keep_pcm
    return map_slices(df.select(F.col(id_column).alias("id"), "n_bytes", "media"), make, schema, text="media").withColumnRenamed("id", id_column)
