import numpy as np
import pytest

from tessera.llm import flac


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value & ((1 << n) - 1), f"0{n}b") if n else ""
        return self

    def rice(self, r, k):
        z = 2 * r if r >= 0 else -2 * r - 1
        self.text += "0" * (z >> k) + "1"
        return self.put(z, k)

    def bytes(self):
        t = self.text + "0" * (-len(self.text) % 8)
        return bytes(int(t[i : i + 8], 2) for i in range(0, len(t), 8))


def crc(data, poly, bits):
    out = 0
    for b in data:
        out ^= b << (bits - 8)
        for _ in range(8):
            out = (out << 1 ^ poly) & ((1 << bits) - 1) if out >> (bits - 1) & 1 else out << 1
    return out


def frame(number, size, layout, bits_code, body):
    head = bytes([0xFF, 0xF8, 0x70, layout << 4 | bits_code << 1, number]) + (size - 1).to_bytes(2)
    head += bytes([crc(head, 7, 8)])
    whole = head + body
    return whole + crc(whole, 0x8005, 16).to_bytes(2)


def stream(frames, size, channels, bits, total):
    info = size.to_bytes(2) * 2 + bytes(6) + (8000 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | total).to_bytes(8) + bytes(16)
    return b"fLaC" + b"\x80" + len(info).to_bytes(3) + info + b"".join(frames)


def test_round_trip_of_many_kinds():
    rng = np.random.default_rng(0)
    payloads = [bytes(576), b"\xff" * 576, rng.integers(0, 256, 576 * 5, dtype=np.uint8).tobytes(), (np.sin(np.arange(576 * 300) / 9) * 60 + 128).astype(np.uint8).tobytes(), (b"Some plain text. " * 300)[: 576 * 8]]
    for order in (0, 4, 9):
        found = {}
        for v, _, first, n, samples, s in flac.blocks(flac.encode(payloads, order)):
            assert first == sum(map(len, found.setdefault(v, []))) and n == len(samples) and s.bits == 8
            found[v].append(samples[:, 0])
        for v, p in enumerate(payloads):
            assert ((np.concatenate(found[v]).astype(np.int8).view(np.uint8)) ^ 0x80).tobytes() == p


def test_linear_prediction_side_channels_escapes_and_wasted_bits():
    n, k = 16, 3
    rng = np.random.default_rng(5)
    left, right = rng.integers(-2000, 2000, n) * 4, rng.integers(-2000, 2000, n) * 4
    mid, side = (left + right) >> 1, left - right
    b = Bits()
    # channel 1, mid: linear prediction of order 2, two partitions, the second escaped
    coefficients, shift = (37, -11), 5
    b.put(0, 1).put(0b100001, 6).put(0, 1)
    for i in range(2):
        b.put(int(mid[i]), 16)
    b.put(6, 4).put(shift, 5)
    for c in coefficients:
        b.put(c, 7)
    residual = [int(mid[i]) - ((37 * int(mid[i - 1]) - 11 * int(mid[i - 2])) >> shift) for i in range(2, n)]
    b.put(0, 2).put(1, 4).put(k + 6, 4)
    for r in residual[: n // 2 - 2]:
        b.rice(r, k + 6)
    b.put(15, 4).put(17, 5)
    for r in residual[n // 2 - 2 :]:
        b.put(r, 17)
    # channel 2, side: verbatim with two wasted bits, one bit wider
    b.put(0, 1).put(1, 6).put(1, 1).put(1, 2)
    for x in side:
        b.put(int(x) >> 2, 15)
    whole = frame(0, n, 10, 4, b.bytes())
    ((_, _, first, size, samples, s),) = list(flac.blocks([stream([whole], n, 2, 16, n)]))
    assert (first, size, s.channels, s.bits) == (0, n, 2, 16)
    assert (samples[:, 0] == left).all() and (samples[:, 1] == right).all()
    assert flac.pcm_bytes(samples, 16) == np.stack([left, right], 1).astype("<i2").tobytes()


def test_damage_is_found_and_later_blocks_keep_their_place(spark):
    media = bytearray(flac.encode([bytes(range(64)) * 9 * 4])[0])
    s = flac.metadata(bytes(media))
    second = flac.frames(bytes(media), s)[1]
    media[second.start + 30] ^= 4
    table = spark.createDataFrame([("a", bytes(media)), ("b", b"no stream"), ("c", None)], "name string, media binary")
    rows = flac.decoded(table, "name", "media").collect()
    a = sorted((r.first_sample, r.ok) for r in rows if r.name == "a")
    assert a == [(0, True), (576, False), (1152, True), (1728, True)]
    assert [(r.ok, r.pcm) for r in rows if r.name == "b"] == [(False, None)] and not [r for r in rows if r.name == "c"]


def test_seek_table_points_at_frames():
    media = flac.encode([bytes(576 * 200)])[0]
    s = flac.metadata(media)
    found = {f.number * 576: f.start - s.audio for f in flac.frames(media, s)}
    assert len(s.seek) == 4 and all(found[sample] == offset for sample, offset in s.seek)


def test_text_query_on_odd_texts(spark):
    import hashlib
    import zlib

    texts = [None, "", "a", "é" * 288, "é" * 289, "long " * 100_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, "a", "y")], "doc_id long, text string, media string")
    rows = flac.text_media(docs).collect()
    assert len(rows) == 7
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert len({tuple(r) for r in rows if r.doc_id == 2}) == 1
    assert flac.text_media(docs.limit(0)).collect() == []


def test_frame_numbers_beyond_one_byte():
    out, size = flac._utf8(np.array([0, 127, 128, 2047, 2048, 65535, 65536]))
    for n, row, k in zip([0, 127, 128, 2047, 2048, 0xFFFF, 65536], out, size, strict=True):
        if not 0xD800 <= n <= 0xDFFF:
            assert row[:k].tobytes() == chr(n).encode("utf-8")


@pytest.mark.parametrize("poly,bits", [(0x07, 8), (0x8005, 16)])
def test_checksums_equal_those_bit_by_bit(poly, bits):
    data = np.random.default_rng(2).integers(0, 256, 900).astype(np.uint8)
    got = flac.Crc(poly, bits).of(data, np.array([0, 5, 100]), np.array([5, 100, 900]))
    assert got.tolist() == [crc(data[a:b].tolist(), poly, bits) for a, b in ((0, 5), (5, 100), (100, 900))]
