"""Whether bytes are a whole JPEG stream: a walk over its segments and, in baseline frames, over every Huffman code of its scans.

A picture that ends early, has a piece of another one in it, or has a bit changed where codes no longer fit, is told apart from a whole one. Values aren't reconstructed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The format's markers.
SOI, EOI, SOS, DQT, DHT, DRI, DNL = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xDC
FRAMES, ALONE = {0xC0, 0xC1, 0xC2}, {0x01, *range(0xD0, 0xD8)}


def _codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    """Symbols by (length, code)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = values[at]
            code, at = code + 1, at + 1
        if code > 1 << length:
            raise ValueError("more codes than fit")
        code <<= 1
    return out


def _scan_end(data: bytes, at: int) -> int:
    """Where the entropy-coded data that begins here stops: at a marker that is neither stuffing nor a restart."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("ends within a scan")
        if data[at + 1] not in (0, 0xFF, *range(0xD0, 0xD8)):
            return at
        at += 2 if data[at + 1] != 0xFF else 1


class _Bits:
    """Bits of one restart interval, without stuffing."""

    def __init__(self, data: bytes):
        self.n, self.data, self.at = 8 * len(data), data + b"\0" * 8, 0

    def take(self, k: int) -> int:
        if self.at + k > self.n:
            raise ValueError("a code runs out of data")
        byte, shift = self.at >> 3, self.at & 7
        self.at += k
        return (int.from_bytes(self.data[byte : byte + 4]) >> (32 - shift - k)) & ((1 << k) - 1)


def _symbol(bits: _Bits, table: dict[tuple[int, int], int]) -> int:
    code = 0
    for length in range(1, 17):
        code = code << 1 | bits.take(1)
        if (s := table.get((length, code))) is not None:
            return s
    raise ValueError("no such code")


def _block(bits: _Bits, dc: dict, ac: dict) -> None:
    if (size := _symbol(bits, dc)) > 11:
        raise ValueError("a difference of too many bits")
    bits.take(size)
    k = 1
    while k < 64:
        s = _symbol(bits, ac)
        run, size = s >> 4, s & 15
        if size == 0:
            if run != 15:
                return
            k += 16
            continue
        k += run + 1
        if k > 64:
            raise ValueError("more coefficients than a block has")
        bits.take(size)


def _intervals(data: bytes) -> list[bytes]:
    """The data between restart markers, which must come in turn."""
    out, start, at, turn = [], 0, 0, 0
    while (at := data.find(b"\xff", at)) >= 0:
        if data[at + 1] == 0:
            at += 2
            continue
        if data[at + 1] == 0xFF:
            at += 1
            continue
        if data[at + 1] != 0xD0 + turn:
            raise ValueError("restart markers out of turn")
        out.append(data[start:at].replace(b"\xff\x00", b"\xff"))
        start = at = at + 2
        turn = (turn + 1) % 8
    return [*out, data[start:].replace(b"\xff\x00", b"\xff")]


def _walk_scan(body: bytes, data: bytes, frame: tuple, tables: dict, restart: int) -> None:
    height, width, parts = frame
    own = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
    known = {c: (h, v) for c, h, v, _ in parts}
    if any(c not in known or (0, t >> 4) not in tables or (1, t & 15) not in tables for c, t in own):
        raise ValueError("a scan of unknown components or tables")
    most_h, most_v = max(h for h, _ in known.values()), max(v for _, v in known.values())
    if len(own) == 1:
        h, v = known[own[0][0]]
        up = lambda a, b: -(-a // b)
        across, down = up(up(width * h, most_h), 8), up(up(height * v, most_v), 8)
        unit = [(own[0][1], 1)]
    else:
        across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        unit = [(t, known[c][0] * known[c][1]) for c, t in own]
    left = across * down
    for piece in _intervals(data):
        bits = _Bits(piece)
        for _ in range(min(left, restart) if restart else left):
            for t, blocks in unit:
                for _ in range(blocks):
                    _block(bits, tables[0, t >> 4], tables[1, t & 15])
            left -= 1
        if bits.n - bits.at >= 8 or bits.take(k := bits.n - bits.at) != (1 << k) - 1:
            raise ValueError("data left over after the last block")
    if left:
        raise ValueError("blocks are missing")


def problem(data: bytes, codes: bool = True) -> str | None:
    """What is wrong with a stream, or None. codes: follow the Huffman codes of baseline scans too; other kinds are walked by their segments."""
    try:
        if data[:2] != bytes([0xFF, SOI]):
            return "no start marker"
        at, frame, tables, quant, restart, scans, baseline = 2, None, {}, set(), 0, 0, True
        while True:
            if at + 2 > len(data) or data[at] != 0xFF:
                return "no marker where one must be"
            mark = data[at + 1]
            if mark == 0xFF:
                at += 1
                continue
            if mark == EOI:
                return None if scans and at + 2 == len(data) else "bytes after the end" if scans else "no scan"
            if mark in ALONE or mark == SOI:
                return "a marker out of place"
            size = int.from_bytes(data[at + 2 : at + 4])
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if size < 2 or at > len(data):
                return "ends within a segment"
            if mark == DQT:
                k = 0
                while k < len(body):
                    quant.add(body[k] & 15)
                    k += 65 + 64 * (body[k] >> 4)
                if k != len(body):
                    return "quantisation table of wrong length"
            elif mark == DHT:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    tables[body[k] >> 4, body[k] & 15] = _codes(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                    k += 17 + n
                if k != len(body):
                    return "code table of wrong length"
            elif mark == DRI:
                restart = int.from_bytes(body)
            elif mark in FRAMES:
                parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                frame, baseline = (int.from_bytes(body[1:3]), int.from_bytes(body[3:5]), parts), mark != 0xC2
                if not frame[0] or not frame[1] or any(q not in quant for *_, q in parts):
                    return "no size or no quantisation table"
            elif mark == SOS:
                if frame is None:
                    return "a scan before its frame"
                end = _scan_end(data, at)
                if codes and baseline:
                    _walk_scan(body, data[at:end], frame, tables, restart)
                else:
                    _intervals(data[at:end])
                scans, at = scans + 1, end
    except (ValueError, IndexError) as e:
        return str(e) or "ends early"


@F.pandas_udf(T.BooleanType())
def decodes(content: pd.Series) -> pd.Series:
    """For frames.verify: whether each content is a whole picture."""
    return pd.Series([c is not None and problem(bytes(c)) is None for c in content])
