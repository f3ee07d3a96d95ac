import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyfix.llm import flac


def test_checksums_against_the_polynomials():
    def plain(data, poly, bits):
        c = 0
        for b in data:
            c ^= b << (bits - 8)
            for _ in range(8):
                c = ((c << 1) ^ poly) if c >> (bits - 1) else c << 1
                c &= (1 << bits) - 1
        return c

    import numpy as np

    data = random.Random(2).randbytes(300)
    flat = np.frombuffer(data, np.uint8)
    starts, sizes = np.array([0, 5, 17, 290]), np.array([300, 9, 100, 0])
    assert [int(x) for x in flac.crc16(flat, starts, sizes)] == [plain(data[a : a + n], 0x8005, 16) for a, n in zip(starts, sizes)]
    assert flac.crc8(data[:6]) == plain(data[:6], 0x07, 8)


@given(st.lists(st.one_of(st.binary(max_size=1500), st.text("aé \n", max_size=2000).map(str.encode), st.sampled_from([b"", b"\x00" * 600, bytes(range(256)) * 5, b"\xff\x00" * 700])), min_size=1, max_size=5))
@settings(max_examples=40, deadline=None)
def test_round_trip(texts):
    payloads = [flac.padded(t) for t in texts]
    streams = flac.encode_streams(payloads)
    assert flac.decode_streams(streams) == payloads
    assert [flac._in_turn(s, flac.Stream(s), True) for s in streams] == payloads
    assert flac.encode_streams(payloads[:1]) == streams[:1]


def test_seek_reads_from_the_middle():
    payload = flac.padded(random.Random(3).randbytes(200_000))
    stream = flac.encode_streams([payload])[0]
    assert len(flac.Stream(stream).seek) > 2
    for a, n in ((0, 10), (575, 2), (150_000, 5000), (len(payload) - 3, 99)):
        assert flac.pcm_blocks(stream, a, n) == payload[a : a + n]


@pytest.mark.parametrize("bit", range(7))
def test_damage_is_found(bit):
    stream = bytearray(flac.encode_streams([flac.padded(b"some text " * 300)])[0])
    stream[len(stream) * (bit + 1) // 9 + 60] ^= 1 << bit
    with pytest.raises(flac.CorruptStream):
        flac.decode_streams([bytes(stream)])


def _bits_of(fields):
    s = "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in fields)
    return bytes(int((s + "0" * 128)[i : i + 8], 2) for i in range(0, len(s) + 64, 8))


@pytest.mark.parametrize("method", [0, 1])
def test_decodes_lpc_partitions_and_escapes(method):
    import numpy as np

    r = random.Random(7 + method)
    block, order, parts = 576, 3, 2
    taps, shift = [r.randint(-16, 15) for _ in range(order)], 5
    want = [r.randint(-128, 127) for _ in range(order)]
    residual, fields = [], [((32 + order - 1) << 1, 8), *((x, 8) for x in want), (4, 4), (shift, 5), *((t, 5) for t in taps), (method, 2), (parts, 4)]
    while len(want) < block:
        x = r.randint(-128, 127)
        residual.append(x - (sum(t * want[-1 - j] for j, t in enumerate(taps)) >> shift))
        want.append(x)
    at, width = 0, 4 + method
    for p in range(1 << parts):
        n = block // (1 << parts) - (order if p == 0 else 0)
        own, at = residual[at : at + n], at + n
        if p == 1:
            fields += [((16 << method) - 1, width), (13, 5), *((x, 13) for x in own)]
            continue
        k = 1 if p == 2 else 6
        fields.append((k, width))
        for x in own:
            u = (x << 1) ^ (x >> 63)
            fields += [(0, u >> k), (1, 1), (u, k)] if u >> k else [(1, 1), (u, k)]
    data = _bits_of([f for f in fields if f[1]])
    got, end = flac.decode_subframes(flac._Bits(np.frombuffer(data, np.uint8)), np.array([0]), block)
    assert got[0].tolist() == want and int(end[0]) == sum(n for _, n in fields)


def test_query_edge_cases(spark):
    texts = [(1, None), (2, ""), (None, "é" * 400), (4, "long " * 50_000), (4, "long " * 50_000), (6, "a" * 576)]
    df = spark.createDataFrame([(*x, b"x") for x in texts], "doc_id long, text string, media binary")
    got = sorted(flac.decode_column(flac.encode_column(df), keep_pcm=True).collect(), key=str)
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    for doc, text in texts:
        data = (text or "").encode()
        pad = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = by[doc]
        assert bytes(r.pcm) == pad and (r.n_bytes, r.payload_bytes) == (len(data), len(pad))
        assert r.payload_sha256 == hashlib.sha256(pad).hexdigest() and r.tail_crc32 == zlib.crc32(pad[-32:])
    assert flac.decode_column(flac.encode_column(df.limit(0))).collect() == []


def test_streams_of_text_hold_fitted_predictors_and_partitions():
    r = random.Random(5)
    text = " ".join("".join(r.choices("etaoinshrdlu", k=r.randint(1, 9))) for _ in range(4000)).encode() + b"\n" * 2000 + bytes(r.randrange(256) for _ in range(600))
    payload = flac.padded(text)
    stream = flac.encode_streams([payload])[0]
    h, kinds, partitions = flac.Stream(stream), [], []
    for a, _, head in flac._frames_of(stream, h, 0, h.samples, True):
        kind = stream[a + head] >> 1
        kinds.append(kind)
        if kind == 31 + flac.ORDER:
            at = 8 * (a + head) + 8 + 8 * flac.ORDER + 9 + flac.ORDER * flac.PRECISION
            partitions.append(int.from_bytes(stream[at // 8 : at // 8 + 3]) >> (24 - at % 8 - 6) & 15)
    assert kinds.count(31 + flac.ORDER) > 0.8 * (len(kinds) - 6) and 0 in kinds and max(partitions) > 0
    assert flac.decode_streams([stream]) == [payload] and len(stream) < 0.95 * len(payload)
    assert flac.pcm_ranges([stream, stream], [(10, 3000), (h.samples - 32, 32)]) == [payload[10:3010], payload[-32:]]


def test_blocks_of_samples_by_offset(spark):
    df = spark.createDataFrame([(1, "text " * 20_000), (2, ""), (3, None)], "doc_id long, text string")
    media = flac.encode_column(df)
    streams = {r.doc_id: bytes(r.media) for r in media.collect()}
    blocks = sorted((r.doc_id, r.sample_offset, bytes(r.pcm)) for r in flac.pcm_table(media).collect())
    assert [b[:2] for b in blocks] == [(1, 0), (1, 36864), (1, 73728), (2, 0), (3, 0)]
    assert all(p == flac.pcm_blocks(streams[i], at, len(p)) for i, at, p in blocks)
    damaged = bytearray(streams[1])
    damaged[-20] ^= 4
    with pytest.raises(flac.CorruptStream):
        flac.pcm_blocks(bytes(damaged), 99_990, 10)
