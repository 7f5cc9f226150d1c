"""FLAC in numpy: frames side by side, one lane a frame.

The decoder finds frames by sync code, header CRC-8 and frame number, verifies each frame's CRC-16, reads Rice and escaped residuals
of all frames in step, undoes fixed and linear prediction, stereo decorrelation and wasted bits, and yields PCM blocks with the
number of their first sample, so a reader can start anywhere. The encoder writes fixed-size blocks with constant, verbatim, fixed or
linear-prediction subframes, whichever is shortest, and a seek table.

Defined results: a frame whose checksum or content is wrong gives a block with ok = false and null pcm (its place in the
stream still follows from its number); bytes that are no FLAC stream give one such block. Null media gives no block. A stream without
samples gives no block. For the text query: a null text is empty; an empty payload is 576 bytes of 255. Rows with the same doc_id are
separate. Other input columns are ignored. Memory is bounded by one value and LANES frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import materialise
from tessera.llm.text import buffers, slices

BLOCK = 576
LANES = 2048
LPC_ORDER = 4
SEEK_EVERY = 64
# fixed values of the format: block sizes and sample sizes by code
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
# fixed values of the format: coefficients of the fixed predictors
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _first_row(poly: int, bits: int) -> np.ndarray:
    v = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        v = np.where(v & (1 << (bits - 1)), (v << 1) ^ poly, v << 1) & ((1 << bits) - 1)
    return v.astype(np.uint16)


class Crc:
    """Remainders of each byte followed by 0, 1, 2 ... bytes; a message's CRC is the exclusive or of its bytes' own."""

    def __init__(self, poly: int, bits: int):
        self.bits, self.row = bits, _first_row(poly, bits)
        self.table = self.row[None]

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            rows = [self.table[-1]]
            for _ in range(max(64, len(self.table))):
                last = rows[-1]
                rows.append(((last.astype(np.uint32) << 8 & ((1 << self.bits) - 1)) ^ self.row[last >> (self.bits - 8)]).astype(np.uint16))
            self.table = np.concatenate([self.table, np.stack(rows[1:])])
        return self.table

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC of data[start:end] for each pair; none may be empty."""
        n = ends - starts
        stop = np.cumsum(n)
        left = np.repeat(stop, n) - 1 - np.arange(stop[-1])
        at = np.repeat(ends, n) - 1 - left
        return np.bitwise_xor.reduceat(self.upto(int(n.max()))[left, data[at]], stop - n)


CRC8, CRC16 = Crc(0x07, 8), Crc(0x8005, 16)


def _utf8(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as rows of 7, lengths) of frame numbers in the format's extended UTF-8."""
    out, size = np.zeros((len(numbers), 7), np.uint8), np.ones(len(numbers), np.int64)
    for k, limit in enumerate((7, 11, 16, 21, 26, 31), 1):
        size[numbers >= 1 << limit] = k + 1
    for k in np.unique(size):
        own, v = size == k, numbers[size == k]
        if k == 1:
            out[own, 0] = v
            continue
        for j in range(k):
            out[own, j] = (v >> 6 * (k - 1 - j) & 0x3F | 0x80) if j else (v >> 6 * (k - 1) | (0xFF00 >> k & 0xFF))
    return out, size


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(zz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, bits) of rows coded with one Rice parameter each."""
    k = np.clip(np.floor(np.log2(np.maximum(zz.mean(1) * 0.7, 1))).astype(np.int32), 0, 14)
    return k, (zz >> k[:, None]).sum(1, dtype=np.int64) + zz.shape[1] * (1 + k)


def _predictors(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients in 12 bits, shift) of each row by autocorrelation and Levinson's recursion."""
    f = x.astype(np.float64)
    f -= f.mean(1, keepdims=True)
    n = f.shape[1]
    auto = [np.einsum("ij,ij->i", f[:, : n - j], f[:, j:]) for j in range(order + 1)]
    a, error = np.zeros((len(x), order)), auto[0] + 1e-9
    for i in range(order):
        k = (auto[i + 1] - sum(a[:, j] * auto[i - j] for j in range(i))) / error
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = error * np.maximum(1 - k * k, 1e-9)
    shift = np.clip(10 - np.ceil(np.log2(np.abs(a).max(1) + 1e-9)).astype(np.int64), 0, 12)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -2048, 2047).astype(np.int32), shift.astype(np.int32)


def encode_blocks(x: np.ndarray, numbers: np.ndarray, order: int = LPC_ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all frames, length of each) of rows of 8-bit samples; numbers: their frame numbers."""
    rows, n = x.shape
    x = x.astype(np.int32)
    bits, best = np.full(rows, 8 + 8 * n, np.int64), np.full(rows, -1)  # -1: verbatim, 0 to 4: fixed, 5: linear prediction, 6: constant
    param, codes = np.zeros(rows, np.int32), np.zeros((rows, n), np.int32)
    r = x
    for p in range(5):
        zz = _zigzag(r[:, p:])
        k, cost = _rice(zz)
        better = (cost := cost + 8 + 8 * p + 10) < bits
        bits[better], best[better], param[better] = cost[better], p, k[better]
        codes[better, p:] = zz[better]
        r = np.concatenate([r[:, :1], np.diff(r, axis=1)], 1) if p < 4 else r
    coefficients, shift = np.zeros((rows, 0), np.int32), np.zeros(rows, np.int32)
    if order:
        coefficients, shift = _predictors(x, order)
        guess = sum(coefficients[:, j, None] * x[:, order - 1 - j : n - 1 - j] for j in range(order)) >> shift[:, None]
        zz = _zigzag(x[:, order:] - guess)
        k, cost = _rice(zz)
        better = (cost := cost + 8 + 8 * order + 9 + 12 * order + 10) < bits
        bits[better], best[better], param[better] = cost[better], 5, k[better]
        codes[better, order:] = zz[better]
    same = (x == x[:, :1]).all(1)
    bits[same], best[same] = 16, 6
    warm = np.select([best == -1, best == 6, best == 5], [n, 1, order], best)  # samples written as they are
    number, width = _utf8(numbers)
    head = 5 + width
    size = head + (bits + 7) // 8 + 2
    end = np.cumsum(size)
    start = end - size
    out = np.zeros(int(end[-1]) + 4, np.uint8)
    for j, v in enumerate((0xFF, 0xF8, 0x20 if n == 576 else 0x70, 0x02)):
        out[start + j] = v
    for j in range(int(width.max())):
        own = width > j
        out[start[own] + 4 + j] = number[own, j]
    out[start + head - 1] = CRC8.of(out, start, start + head - 1)
    # everything else as (value, bits) fields in order; a Rice code's leading zeros need no writing
    at = (start + head) * 8
    kind = np.select([best == -1, best == 6, best == 5], [1, 0, 0x20 | max(order - 1, 0)], 8 | best)
    values, places, widths = [kind << 1], [at], [np.full(rows, 8)]
    i, j = np.nonzero(np.arange(n) < warm[:, None])
    values.append(x[i, j] & 0xFF)
    places.append(at[i] + 8 + 8 * j)
    widths.append(np.full(len(i), 8))
    at = at + 8 + 8 * warm
    lpc = np.flatnonzero(best == 5)
    if len(lpc):
        values += [np.full(len(lpc), 11), shift[lpc], *((coefficients[lpc, j] & 0xFFF) for j in range(order))]
        places += [at[lpc], at[lpc] + 4, *(at[lpc] + 9 + 12 * j for j in range(order))]
        widths += [np.full(len(lpc), w) for w in (4, 5, *[12] * order)]
        at[lpc] += 9 + 12 * order
    coded = np.flatnonzero((best >= 0) & (best <= 5))
    if len(coded):
        values += [np.zeros(len(coded), np.int64), param[coded]]
        places += [at[coded], at[coded] + 6]
        widths += [np.full(len(coded), 6), np.full(len(coded), 4)]
        k = param[coded][:, None]
        zz, used = codes[coded], np.arange(n) >= warm[coded][:, None]
        stop = (at[coded] + 10)[:, None] + np.cumsum(np.where(used, (zz >> k) + 1 + k, 0), 1)
        values.append(((zz & ((1 << k) - 1)) | (1 << k))[used])
        places.append((stop - k - 1)[used])
        widths.append(np.broadcast_to(k + 1, zz.shape)[used])
    value, place, wide = (np.concatenate([np.asarray(a, np.int64) for a in z]) for z in (values, places, widths))
    value <<= 24 - wide - (place & 7)
    byte = place >> 3
    for lane in range(3):
        out += np.bincount(byte + lane, value >> (16 - 8 * lane) & 0xFF, len(out)).astype(np.uint8)
    out = out[: end[-1]]
    check = CRC16.of(out, start, end - 2)
    out[end - 2], out[end - 1] = check >> 8, check & 0xFF
    return out, size


def encode(payloads: list[bytes], order: int = LPC_ORDER) -> list[bytes]:
    """A mono 8-bit stream for each payload, whose length must be a positive multiple of BLOCK; byte b is the sample b - 128."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    numbers = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    parts = [encode_blocks(samples[a : a + LANES], numbers[a : a + LANES], order) for a in range(0, len(samples), LANES)]
    frames, sizes = b"".join(p[0].tobytes() for p in parts), np.concatenate([p[1] for p in parts])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out, first = [], 0
    for p, n in zip(payloads, counts.tolist(), strict=True):
        own, at = sizes[first : first + n], ends[first : first + n + 1] - ends[first]
        md5 = hashlib.md5(samples[first : first + n].tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3) + int(own.max()).to_bytes(3) + (8000 << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8) + md5
        seek = b"".join(struct.pack(">QQH", i * BLOCK, int(at[i]), BLOCK) for i in range(0, n, SEEK_EVERY))
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + len(seek).to_bytes(3) + seek + frames[ends[first] : ends[first + n]])
        first += n
    return out


@dataclass
class Stream:
    rate: int
    channels: int
    bits: int
    samples: int
    block: int
    md5: bytes
    seek: list[tuple[int, int]]
    audio: int  # where the frames begin


def metadata(media: bytes) -> Stream:
    """What a stream's metadata blocks say."""
    if media[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, found, seek = 4, None, []
    while True:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4])
        body = media[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("the metadata ends early")
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18])
            found = (packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, int.from_bytes(body[2:4]), body[18:34])
        elif kind & 0x7F == 3:
            seek = [struct.unpack(">QQ", body[i : i + 16]) for i in range(0, size - 17, 18)]
        at += 4 + size
        if kind & 0x80:
            break
    if found is None:
        raise ValueError("no stream info")
    return Stream(*found, seek, at)


@dataclass
class Frame:
    start: int
    body: int
    end: int
    number: int
    variable: bool
    size: int
    layout: int
    bits: int


def _header(b: bytes, at: int, s: Stream) -> Frame | None:
    """The frame header at a byte, if one is there and its CRC-8 is right."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return None
    size, rate, layout, bits = b[at + 2] >> 4, b[at + 2] & 15, b[at + 3] >> 4, b[at + 3] >> 1 & 7
    if not size or rate == 15 or layout > 10 or bits in (3, 7) or b[at + 3] & 1:
        return None
    i, lead = at + 4, b[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if lead >= 0x80 and not 1 <= more <= 6:
        return None
    number = lead if not more else lead & (0x3F >> more)
    for j in range(more):
        if i + 1 + j >= len(b):
            return None
        number = number << 6 | b[i + 1 + j] & 0x3F
    i += 1 + more
    if size in (6, 7):
        size, i = int.from_bytes(b[i : i + size - 5]) + 1, i + size - 5
    else:
        size = BLOCK_SIZES[size]
    i += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for v in b[at:i]:
        crc = int(CRC8.row[crc ^ v])
    if i >= len(b) or b[i] != crc:
        return None
    return Frame(at, i + 1, 0, number, bool(b[at + 1] & 1), size, layout, SAMPLE_BITS.get(bits, s.bits))


def frames(media: bytes, s: Stream) -> list[Frame]:
    """The frames in order, each with its end: the next header whose number follows, or the end of the stream."""
    data = np.frombuffer(media, np.uint8)
    found: list[Frame] = []
    for at in (np.flatnonzero((data[s.audio : -1] == 0xFF) & (data[s.audio + 1 :] & 0xFE == 0xF8)) + s.audio).tolist():
        f = _header(media, at, s)
        if f is None or not (s.audio == at if not found else f.number > found[-1].number):
            continue
        if found:  # a header inside a frame goes unless the bytes before it end a frame
            follows = f.number == found[-1].number + (found[-1].size if f.variable else 1)
            if not follows and CRC16.of(data, np.array([found[-1].start]), np.array([at]))[0]:
                continue
            found[-1].end = at
        found.append(f)
    if found:
        found[-1].end = len(media)
    return found


class Lanes:
    """Bit readers over one buffer, one a frame."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").reshape(-1).astype(np.uint64)
        self.at, self.last = at.astype(np.int64) * 8, len(padded) - 9

    def window(self) -> np.ndarray:
        return self.words[np.minimum(self.at >> 3, self.last)] << (self.at & 7).astype(np.uint64)

    def read(self, n: np.ndarray) -> np.ndarray:
        """n (0 to 32) bits of each lane, without sign."""
        n = np.broadcast_to(n, self.at.shape)
        out = np.where(n > 0, self.window() >> (64 - np.maximum(n, 1)).astype(np.uint64), 0).astype(np.int64)
        self.at += n
        return out

    def signed(self, n: np.ndarray) -> np.ndarray:
        v = self.read(n)
        return np.where((n > 0) & (v >> np.maximum(n - 1, 0) & 1 == 1), v - (np.int64(1) << n), v)

    def rice(self, k: np.ndarray, own: np.ndarray) -> np.ndarray:
        """A Rice code of each lane in ``own``; 0 and no reading for others."""
        q = np.zeros(len(self.at), np.int64)
        x = self.window()
        while (long := own & (x >> np.uint64(32) == 0)).any():  # more than 32 zeros
            q[long] += 32
            self.at[long] += 32
            if (q > 1 << 22).any():
                raise ValueError("a run of zeros has no end")
            x = self.window()
        zeros = 32 - np.frexp((x >> np.uint64(32)).astype(np.float64))[1].astype(np.int64)
        low = (x << (zeros + 1).astype(np.uint64)) >> (64 - np.maximum(k, 1)).astype(np.uint64)
        v = (q + zeros << k) | np.where(k > 0, low.astype(np.int64), 0)
        self.at += np.where(own, zeros + 1 + k, 0)
        return np.where(own, (v >> 1) ^ -(v & 1), 0)


def _subframes(lanes: Lanes, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples by step and lane, which lanes hold a well-formed subframe) of one channel of all frames."""
    n = int(size.max())
    head = lanes.read(np.full(len(size), 8))
    kind, good = head >> 1 & 0x3F, head < 0x80
    wasted = np.zeros(len(size), np.int64)
    if (flag := head & 1 == 1).any():
        unary = lanes.rice(np.zeros(len(size), np.int64), flag)
        wasted = np.where(flag, np.where(unary < 0, -2 * unary - 1, 2 * unary) + 1, 0)
    depth = bits - wasted
    good &= (depth > 0) & ((kind < 2) | (kind >> 3 == 1) & (kind & 7 <= 4) | (kind >= 32))
    depth = np.where(good, depth, 1)
    fixed, lpc = good & (kind >> 3 == 1), good & (kind >= 32)
    order = np.select([fixed, lpc], [kind & 7, (kind & 31) + 1], 0)
    good &= order <= size
    predicted = (fixed | lpc) & good
    out = np.zeros((n, len(size)), np.int64)
    constant = good & (kind == 0)
    first = lanes.signed(np.where(constant, depth, 0))
    out[:, constant] = first[constant]
    for i in range(int(order.max(initial=0))):
        out[i] += lanes.signed(np.where(predicted & (order > i), depth, 0))
    taps = int(order.max(initial=0))
    weight, shift = np.zeros((taps, len(size)), np.int64), np.zeros(len(size), np.int64)
    for p in range(1, min(taps, 4) + 1):
        for j, c in enumerate(FIXED[p]):
            weight[j, fixed & (order == p)] = c
    if lpc.any():
        precision = lanes.read(np.where(lpc, 4, 0)) + 1
        shift = np.where(lpc, lanes.signed(np.where(lpc, 5, 0)), 0)
        good &= ~lpc | (precision < 16) & (shift >= 0)
        for j in range(taps):
            own = lpc & (order > j)
            weight[j, own] = lanes.signed(np.where(own, precision, 0))[own]
    method = lanes.read(np.where(predicted, 2, 0))
    parts = lanes.read(np.where(predicted, 4, 0))
    good &= ~predicted | (method < 2) & (size & (1 << parts) - 1 == 0)
    predicted &= good
    raw = np.where(good & (kind == 1), depth, -1)  # bits a sample that has no Rice code; -1: it has one
    k, wide = np.zeros(len(size), np.int64), np.where(method == 1, 5, 4)
    turn = np.where(predicted, order, n + 1)  # the step at which the next partition's parameter comes
    span = size >> parts
    for i in range(n):
        while (at := turn == i).any():
            k = np.where(at, lanes.read(np.where(at, wide, 0)), k)
            escape = at & (k == (1 << wide) - 1)
            raw = np.where(at, -1, raw)
            if escape.any():
                raw = np.where(escape, lanes.read(np.where(escape, 5, 0)), raw)
            turn = np.where(at, (i // np.maximum(span, 1) + 1) * span, turn)
            turn[at & (turn >= size)] = n + 1
        live = i < size
        rice = predicted & live & (i >= order) & (raw < 0)
        if rice.any():
            out[i] += lanes.rice(k, rice)
        if (plain := live & (raw >= 0) & ((kind == 1) | (i >= order))).any():
            out[i] += lanes.signed(np.where(plain, raw, 0))
        if taps and (mine := predicted & live & (i >= order)).any():
            guess = np.zeros(len(size), np.int64)
            for j in range(min(taps, i)):
                guess += weight[j] * out[i - 1 - j]
            out[i] += np.where(mine, guess >> shift, 0)
    return out << wasted, good


def decode_frames(data: np.ndarray, group: list[Frame]) -> list[np.ndarray | None]:
    """Samples (by sample and channel) of frames of one buffer; None for a frame that fails."""
    starts, ends = (np.array([getattr(f, k) for f in group]) for k in ("start", "end"))
    sound = (ends - np.array([f.body for f in group]) >= 3) & (CRC16.of(data, starts, ends) == 0)
    out: list[np.ndarray | None] = [None] * len(group)
    layouts = np.array([f.layout for f in group])
    channels = np.where(layouts < 8, layouts + 1, 2)
    for count in np.unique(channels[sound]):
        own = np.flatnonzero(sound & (channels == count))
        lanes = Lanes(data, np.array([group[i].body for i in own]))
        size, depth, layout = (np.array([getattr(group[i], k) for i in own], np.int64) for k in ("size", "bits", "layout"))
        planes, good = [], np.ones(len(own), bool)
        for c in range(count):
            side = (layout == 8) & (c == 1) | (layout == 9) & (c == 0) | (layout == 10) & (c == 1)
            try:
                plane, fine = _subframes(lanes, size, depth + side)
            except ValueError:  # one lane spoils a group: take them singly
                if len(own) == 1:
                    good[:] = False
                    break
                for i in own:
                    out[i] = decode_frames(data, [group[i]])[0]
                good = None
                break
            planes.append(plane)
            good &= fine
        if good is None:
            continue
        good &= (lanes.at + 7 >> 3) == ends[own] - 2
        if not good.any():
            continue
        if count == 2:
            a, b = planes
            mid = (a << 1) | (b & 1)
            left = np.select([layout == 9, layout == 10], [a + b, mid + b >> 1], a)
            right = np.select([layout == 8, layout == 10], [a - b, mid - b >> 1], b)
            planes = [left, right]
        whole = np.stack(planes, 2)
        for lane, i in enumerate(own):
            if good[lane]:
                out[i] = whole[: size[lane], lane]
    return out


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian signed samples in the fewest whole bytes."""
    width = (bits + 7) // 8
    if width == 1:
        return samples.astype(np.int8).tobytes()
    return samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def blocks(media: list[bytes]) -> Iterator[tuple[int, int, int, int, np.ndarray | None, Stream | None]]:
    """(value number, block number, first sample, samples, samples by channel or None, stream) of all frames of some streams, in order."""
    waiting: list[tuple[int, int, Frame, Stream]] = []
    bases, held, at = {}, [], 0

    def drain():
        nonlocal waiting, held, at
        data = np.concatenate([np.frombuffer(h, np.uint8) for h in held])
        for a in range(0, len(waiting), LANES):
            part = waiting[a : a + LANES]
            moved = [Frame(f.start + bases[v], f.body + bases[v], f.end + bases[v], f.number, f.variable, f.size, f.layout, f.bits) for v, _, f, _ in part]
            for (v, no, f, s), samples in zip(part, decode_frames(data, moved), strict=True):
                yield v, no, f.number if f.variable else f.number * s.block, f.size, samples, s
        waiting, held, at = [], [], 0
        bases.clear()

    for v, m in enumerate(media):
        try:
            s = metadata(m)
            own = frames(m, s)
        except (ValueError, IndexError):
            own, s = [], None
        if not own and (s is None or s.samples):
            if waiting:
                yield from drain()
            yield v, 0, 0, 0, None, s
            continue
        bases[v] = at
        held.append(m)
        at += len(m)
        waiting += [(v, no, f, s) for no, f in enumerate(own)]
        if len(waiting) >= LANES:
            yield from drain()
    if waiting:
        yield from drain()


PCM = "block_no int, first_sample long, n_samples int, channels int, bits int, sample_rate int, ok boolean, pcm binary"


def decoded(table: DataFrame, key: str, media: str) -> DataFrame:
    """A row a block of each stream: the key and block_no, first_sample, n_samples, channels, bits, sample_rate, ok and pcm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

        def batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            columns = [keys.take(pa.array([r[0] for r in rows]))] + [pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays(columns, names=[key, *(c.split()[0] for c in PCM.split(", "))])

        for b in batches:
            b = b.filter(b.column(1).is_valid())
            rows = []
            for v, no, first, n, samples, s in blocks([m.as_py() for m in b.column(1)]):
                info = (s.channels, s.bits, s.rate) if s else (None, None, None)
                rows.append((v, no, first, n, *info, samples is not None, None if samples is None else pcm_bytes(samples, s.bits)))
                if len(rows) >= 4096:
                    yield batch(b.column(0), rows)
                    rows = []
            if rows:
                yield batch(b.column(0), rows)

    kind = dict(table.dtypes)[key]
    return table.select(key, media).mapInArrow(run, f"{key} {kind}, {PCM}")


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with 255 to a positive multiple of BLOCK, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column(1))
            raw, sizes = data.tobytes(), np.diff(at)
            whole = np.maximum(-(-sizes // BLOCK), 1)
            cuts = [0]
            while cuts[-1] < len(sizes):  # about two groups of lanes at a time, or one value
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(np.cumsum(whole), whole[: cuts[-1]].sum() + 2 * LANES, "right"))))
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                payloads = [raw[at[i] : at[i + 1]].ljust(int(whole[i]) * BLOCK, b"\xff") for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sizes[lo:hi]), pa.array(encode(payloads), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """What encoded() stored, read back: sizes, digests and a feature string (sums of samples, squares and sign changes). A stream that
    fails a checksum, or whose samples differ from its MD5, is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            stored = [m.as_py() for m in b.column(2)]
            rows, parts, at = [], [], 0

            def close(v: int, s: Stream) -> None:
                x = np.concatenate(parts)[:, 0]
                raw = x.astype(np.int8)
                if hashlib.md5(raw.tobytes()).digest() != s.md5:
                    raise ValueError(f"the samples of value {v} are not those that were stored")
                payload = (raw.view(np.uint8) ^ 0x80).tobytes()
                sign = x < 0
                feature = f"sum={int(x.sum())};squares={int((x * x).sum())};crossings={int((sign[1:] != sign[:-1]).sum())};peak={int(np.abs(x).max())}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored[v]), hashlib.sha256(stored[v]).hexdigest(), feature))
                parts.clear()

            before = None
            for v, _, first, n, samples, s in blocks(stored):
                if before is not None and v != before[0]:
                    close(*before)
                    at = 0
                if samples is None or first != at:
                    raise ValueError(f"block at sample {first} of value {v} is broken")
                at += n
                parts.append(samples)
                before = (v, s)
            if before is not None:
                close(*before)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=[c.split()[0] for c in DIGESTS.split(", ")])

    return media.mapInArrow(run, DIGESTS)


def text_media(docs: DataFrame) -> DataFrame:
    """Every text through the codec and back; the streams are written to the shared folder and read from there."""
    return digests(materialise(encoded(docs), "media"))
