"""Media columns: progressive JPEG, written and read with numpy.

Writer.  A payload becomes the coefficients of a 4:2:0 colour image, one byte a coefficient: byte b is
b where it is 128 or more and b - 255 elsewhere, so each coefficient has eight bits and a sign and
none is zero.  Blocks fill the luma plane first, then the two chroma planes; the rest of the grid is
filled with byte 0, and a comment segment holds the payload's length.  DC goes in one scan for each
component; AC goes by spectral selection (two luma bands) and successive approximation (all but the
last bit first, then a refinement scan), with restart markers.

Reader.  Any progressive Huffman stream with three or one components is read: scans are accumulated
into coefficient arrays, and the restart intervals of all images of a batch are decoded side by
side, one symbol of each at a time.  Coefficients are then inverse-transformed, chroma is brought to
full resolution by repetition, and the RGB tensor is made.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, rows, small_batches, spread, tidy

RESTART = 8
#: Spectral bands of the first AC scans: (component, first, last).
BANDS = ((0, 1, 20), (0, 21, 63), (1, 1, 63), (2, 1, 63))
CHUNK_PAYLOAD = 1 << 22


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Natural index of each place in the zigzag order, by rule: along the anti-diagonals, turning."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


@lru_cache(1)
def _inverse() -> np.ndarray:
    """64 x 64: coefficients in zigzag order to samples in natural order."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, math.sqrt(1 / 8), 0.5)[:, None]
    return np.einsum("ui,vj->uvij", basis, basis).reshape(64, 64)[zigzag()]


def grid_of(blocks: int) -> tuple[int, int]:
    """Columns and rows of 16 x 16 units for that many payload blocks."""
    units = max(1, -(-blocks // 6))
    wide = math.isqrt(units - 1) + 1
    return wide, -(-units // wide)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, lengths: list[int], symbols: bytes) -> bytes:
    return bytes([kind]) + bytes(lengths + [0] * (16 - len(lengths))) + symbols


#: Huffman tables: DC has category 8 alone; AC 0 has (run 0, size 7) and end of block; AC 1 (refinement) end of block.
_TABLES = _segment(0xC4, _table(0x00, [1], b"\x08") + _table(0x10, [1, 1], b"\x07\x00") + _table(0x11, [1], b"\x00"))


def _scan(component: int, dc: int, ac: int, first: int, last: int, approx: int) -> bytes:
    return _segment(0xDA, bytes([1, component + 1, dc << 4 | ac, first, last, approx]))


def _with_restarts(data: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """Data (images, blocks, bytes) with a restart marker after every `per` blocks; and which bytes are data."""
    g, n, size = data.shape
    full = -(-n // per)
    padded = np.zeros((g, full * per, size), np.uint8)
    padded[:, :n] = data
    marks = np.stack([np.full(full, 0xFF), 0xD0 + np.arange(full) % 8], 1).astype(np.uint8)
    out = np.concatenate([padded.reshape(g, full, per * size), np.broadcast_to(marks, (g, full, 2))], 2)
    is_data = np.ones((full, per * size + 2), bool)
    is_data[:, -2:] = False
    keep = (full - 1) * (per * size + 2) + (n - (full - 1) * per) * size
    return out.reshape(g, -1)[:, :keep], is_data.reshape(-1)[:keep]


def _write_group(payload: np.ndarray, lengths: np.ndarray, wide: int, high: int) -> list[bytes]:
    """JPEG files of payloads (images, blocks, 64) that share a grid."""
    g, units = len(payload), wide * high
    parts: list[tuple[np.ndarray, np.ndarray | None]] = []

    def fixed(raw: bytes) -> None:
        parts.append((np.broadcast_to(np.frombuffer(raw, np.uint8), (g, len(raw))), None))

    fixed(b"\xff\xd8")
    parts.append((np.concatenate([np.broadcast_to(np.frombuffer(b"\xff\xfe\x00\x0a", np.uint8), (g, 4)), lengths.astype(">u8").view(np.uint8).reshape(g, 8)], 1), None))
    frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    fixed(_segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC2, frame) + _TABLES + _segment(0xDD, struct.pack(">H", 1)))
    planes = (payload[:, : 4 * units], payload[:, 4 * units : 5 * units], payload[:, 5 * units :])
    for c, plane in enumerate(planes):  # code 0, eight bits, seven filling ones; the value is its own category's bits
        b = plane[:, :, 0]
        fixed(_scan(c, 0, 0, 0, 0, 0))
        parts.append(_with_restarts(np.stack([b >> 1, (b << 7) | 0x7F], 2).astype(np.uint8), 1))
    fixed(_segment(0xDD, struct.pack(">H", RESTART)))
    for c, first, last in BANDS:  # code 0 and seven bits; one's complement for negatives is the byte's upper part
        fixed(_scan(c, 0, 0, first, last, 0x01))
        parts.append(_with_restarts(planes[c][:, :, first : last + 1] >> 1, RESTART))
    for c, plane in enumerate(planes):  # end of block, then the last bit of every magnitude
        low = np.where(plane >= 128, plane, 255 - plane) & 1
        low[:, :, 0] = 0
        fixed(_scan(c, 0, 1, 1, 63, 0x10))
        parts.append(_with_restarts(np.packbits(low, axis=2), RESTART))
    fixed(b"\xff\xd9")
    whole = np.concatenate([p for p, _ in parts], 1)
    data = np.concatenate([np.zeros(p.shape[1], bool) if d is None else d for p, d in parts])
    stuff = (whole == 0xFF) & data
    sizes = whole.shape[1] + stuff.sum(1)
    flat = np.repeat(whole.ravel(), 1 + stuff.ravel())
    at = np.flatnonzero(stuff.ravel())
    flat[at + np.arange(1, len(at) + 1)] = 0
    raw, ends = flat.tobytes(), np.cumsum(sizes)
    return [raw[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def padded_length(n: np.ndarray) -> np.ndarray:
    return np.maximum(-(-n // 64), 1) * 64


def write_jpegs(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One progressive JPEG for each row of bytes, padded by zeros to a positive multiple of 64."""
    n = np.diff(offsets)
    padded = padded_length(n)
    grids = [grid_of(b) for b in (padded // 64).tolist()]
    groups: dict[tuple[int, int], list[int]] = {}
    for i, grid in enumerate(grids):
        groups.setdefault(grid, []).append(i)
    out: list[bytes] = [b""] * len(n)
    for (wide, high), own in groups.items():
        own = np.array(own)
        body = np.zeros((len(own), wide * high * 6 * 64), np.uint8)
        owner, place = spread(n[own])
        body[owner, place] = data[offsets[own][owner] + place]
        for i, raw in zip(own.tolist(), _write_group(body.reshape(len(own), -1, 64), padded[own], wide, high), strict=True):
            out[i] = raw
    return out


@lru_cache(64)
def _lookup(table: bytes) -> np.ndarray:
    """code length << 8 | symbol for every 16 bits that may come next; length 0: no such code."""
    lengths, symbols = table[:16], table[16:]
    out, code, at = np.zeros(1 << 16, np.uint16), 0, 0
    for size, many in enumerate(lengths, 1):
        for _ in range(many):
            out[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class Image:
    """What the segments of one file say; scans: (component, first, last, high, low, restart, DC table, AC table, start, end)."""

    def __init__(self, raw: np.ndarray, start: int, end: int, marks: list[int], held: bytes):
        self.scans, self.quant, self.payload = [], {}, None
        tables: dict[int, bytes] = {}
        restart, at = 0, start + 2
        while at < end:
            marker = held[at + 1]
            if marker == 0xD9:
                break
            size = held[at + 2] << 8 | held[at + 3]
            body = held[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE and len(body) == 8:
                self.payload = int.from_bytes(body, "big")
            elif marker == 0xDB:
                while body:
                    self.quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int32)
                    body = body[65:]
            elif marker == 0xC2:
                self.height, self.width, n = struct.unpack(">HHB", body[1:6])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker == 0xC4:
                while body:
                    size = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:size]
                    body = body[size:]
            elif marker == 0xDD:
                restart = body[0] << 8 | body[1]
            elif marker == 0xDA:
                if body[0] != 1:
                    raise ValueError("scans of several components are not read")
                component = next(i for i, p in enumerate(self.parts) if p[0] == body[1])
                stop = marks[bisect_left(marks, at)]
                self.scans.append((component, body[3], body[4], body[5] >> 4, body[5] & 15, restart, tables.get(body[2] >> 4), tables.get(16 | (body[2] & 15)), at, stop))
                at = stop
            elif marker in (0xC0, 0xC1):
                raise ValueError("not a progressive JPEG")
        most_h, most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.sampling = (most_h, most_v)
        mcu_w, mcu_h = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        self.planes = [(mcu_w * p[1], mcu_h * p[2]) for p in self.parts]  # blocks across and down


class _Bits:
    """Bit access at many places of one buffer."""

    def __init__(self, clean: np.ndarray):
        self.bytes = np.concatenate([clean, np.full(8, 0xFF, np.uint8)])
        d = self.bytes.astype(np.uint32)
        self.word = d[:-3] << np.uint32(24) | d[1:-2] << np.uint32(16) | d[2:-1] << np.uint32(8) | d[3:]

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        return (self.word[at >> 3] >> (16 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)

    def take(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The next `size` bits, up to 16."""
        return (self.peek(at) >> (16 - size).astype(np.uint32)).astype(np.int64)

    def one(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((value >> np.maximum(size - 1, 0)) & 1, value, value - (1 << size) + 1)


def _symbol(bits: _Bits, table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = table[bits.peek(at)].astype(np.int64)
    if not found.all():
        raise ValueError("broken JPEG stream")
    return found & 0xFF, at + (found >> 8)


def _dc(bits, table, at, base, blocks, coef, high, low):
    before = np.zeros(len(at), np.int64)
    for j in range(int(blocks.max(initial=0))):
        own = np.flatnonzero(blocks > j)
        if high:
            coef[base[own] + j, 0] |= (bits.one(at[own]).astype(np.int16) << low).astype(np.int16)
            at[own] += 1
            continue
        size, here = _symbol(bits, table, at[own])
        before[own] += np.where(size > 0, _extend(bits.take(here, size), size), 0)
        at[own] = here + size
        coef[base[own] + j, 0] = before[own] << low


def _ac_first(bits, table, at, base, blocks, coef, first, last, low):
    own = np.flatnonzero(blocks > 0)
    at, row, stop = at[own], base[own].copy(), (base + blocks)[own]
    k = np.full(len(own), first)
    flat = coef.reshape(-1)
    while len(at):
        symbol, at = _symbol(bits, table, at)
        size, run = symbol & 15, symbol >> 4
        value = bits.take(at, size)
        plain = size > 0
        if plain.all():
            k += run
            flat[(row << 6) + k] = _extend(value, size) << low
            at += size
            k += 1
        else:
            k += np.where(plain, run, 0)
            flat[((row << 6) + k)[plain]] = (_extend(value, size) << low)[plain]
            at += size
            k += np.where(plain, 1, np.where(run == 15, 16, 0))
            ends = ~plain & (run < 15)
            many = (1 << run) + bits.take(at, np.where(ends, run, 0))
            at += np.where(ends, run, 0)
            row += np.where(ends, many, 0)
            k[ends] = first
        over = k > last
        if over.any():
            row += over
            k[over] = first
        done = row >= stop
        if done.any():
            at, row, stop, k = (x[~done] for x in (at, row, stop, k))


def _ac_refine(bits, table, at, base, blocks, coef, first, last, low):
    skip = np.zeros(len(at), np.int64)  # blocks that an end-of-band run still covers
    columns = np.arange(first, last + 1)

    def correct(rows_, mask, where):
        """Read a bit for each coefficient of mask (lanes x columns) and apply it."""
        r, c = np.nonzero(mask)
        count = np.bincount(r, minlength=len(rows_))
        start = np.cumsum(count) - count
        bit = bits.one(where[r] + np.arange(len(r)) - start[r]).astype(np.int16) << low
        cell = (rows_[r], c + first)
        now = coef[cell]
        coef[cell] = now + np.where(now > 0, bit, -bit)
        return where + count

    for j in range(int(blocks.max(initial=0))):
        own = np.flatnonzero(blocks > j)
        k = np.full(len(own), first)
        held = coef[base[own] + j, first : last + 1] != 0
        while len(own):
            resting = skip[own] > 0
            fresh = np.flatnonzero(~resting)
            if len(fresh):
                lane = own[fresh]
                symbol, here = _symbol(bits, table, at[lane])
                size, run = symbol & 15, symbol >> 4
                ends = (size == 0) & (run < 15)
                more = np.where(ends, run, 0)
                skip[lane] = np.where(ends, (1 << run) + bits.take(here, more), 0)
                here = here + more
                sign = np.where(size > 0, bits.one(here), 0)
                at[lane] = here + (size > 0)
                going = ~ends
                if going.any():
                    f = fresh[going]
                    open_ = ~held[f] & (columns[None, :] >= k[f][:, None])
                    order = np.cumsum(open_, 1)
                    target = np.where(open_ & (order == run[going][:, None] + 1), columns[None, :], last + 1).min(1)
                    mask = held[f] & (columns[None, :] >= k[f][:, None]) & (columns[None, :] < target[:, None])
                    lanes = own[f]
                    at[lanes] = correct(base[lanes] + j, mask, at[lanes])
                    new = (size[going] > 0) & (target <= last)
                    coef[(base[lanes] + j)[new], target[new]] = np.where(sign[going][new] == 1, 1 << low, -(1 << low))
                    k[f] = target + 1
            rest = np.flatnonzero(skip[own] > 0)
            if len(rest):
                lanes = own[rest]
                at[lanes] = correct(base[lanes] + j, held[rest] & (columns[None, :] >= k[rest][:, None]), at[lanes])
                skip[lanes] -= 1
                k[rest] = last + 1
            go = k <= last
            own, k, held = own[go], k[go], held[go]


def read_coefficients(data: np.ndarray, offsets: np.ndarray) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """(images, coefficients (blocks, 64) in zigzag order, first block of each image) of JPEG files in one buffer."""
    held = data.tobytes()
    follows = np.append(data[1:], 0)
    ff = data == 0xFF
    restarts = ff & (follows >= 0xD0) & (follows <= 0xD7)
    marks = np.flatnonzero(ff & (follows != 0) & (follows != 0xFF) & ~restarts).tolist()
    images = [Image(data, a, b, marks, held) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    counts = [[w * h for w, h in x.planes] for x in images]
    total = np.array([sum(c) for c in counts])
    base = np.cumsum(total) - total
    coef = np.zeros((int(total.sum()), 64), np.int16)
    # drop the zeros stuffed after FF; `moved` maps a place in the files to the buffer without them
    stuffed = np.zeros(len(data), bool)
    stuffed[1:] = ff[:-1] & (data[1:] == 0)
    inside = np.zeros(len(data) + 1, np.int32)
    kinds: dict[tuple, list[tuple[int, int, int, int, int]]] = {}
    for i, x in enumerate(images):
        for order, (c, first, last, high, low, restart, dc, ac, a, b) in enumerate(x.scans):
            inside[a] += 1
            inside[b] -= 1
            start = int(base[i]) + sum(counts[i][:c])
            # the scans of one image are taken in their order, those of all images side by side
            kinds.setdefault((order, first, last, high, low, dc if not first else ac), []).append((a, b, start, counts[i][c], restart or counts[i][c]))
    stuffed &= np.cumsum(inside[:-1]) > 0
    moved = np.concatenate([[0], np.cumsum(~stuffed)])
    bits = _Bits(data[~stuffed])
    rst = np.flatnonzero(restarts)
    for (_, first, last, high, low, table), scans in sorted(kinds.items(), key=lambda x: x[0][0]):
        a, b, start, n, per = (np.array(v) for v in zip(*scans, strict=True))
        lo, hi = np.searchsorted(rst, a), np.searchsorted(rst, b)
        lanes = hi - lo + 1
        owner, place = spread(lanes)
        begin = np.where(place == 0, a[owner], rst[np.minimum(lo[owner] + place - 1, max(len(rst) - 1, 0))] + 2 if len(rst) else a[owner])
        at = moved[begin].astype(np.int64) * 8
        row = start[owner] + place * per[owner]
        blocks = np.minimum(per[owner], n[owner] - place * per[owner])
        look = _lookup(table) if table is not None else None
        if first == 0:
            _dc(bits, look, at, row, blocks, coef, high, low)
        elif high:
            _ac_refine(bits, look, at, row, blocks, coef, first, last, low)
        else:
            _ac_first(bits, look, at, row, blocks, coef, first, last, low)
    return images, coef, base


def tensors(images: list[Image], coef: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """Full-resolution RGB (height, width, 3) of each image."""
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        groups.setdefault((x.width, x.height, tuple(x.planes), x.sampling, tuple(x.quant[p[3]].tobytes() for p in x.parts)), []).append(i)
    out: list = [None] * len(images)
    for (width, height, planes, (most_h, most_v), _), own in groups.items():
        x, at, full = images[own[0]], base[own], []
        for c, (wide, high) in enumerate(planes):
            n = wide * high
            block = coef[(at[:, None] + np.arange(n)[None, :]).ravel()].astype(np.float64) * x.quant[x.parts[c][3]]
            samples = np.clip(np.rint(block @ _inverse() + (128 + 1e-6)), 0, 255)
            plane = samples.reshape(len(own), high, wide, 8, 8).transpose(0, 1, 3, 2, 4).reshape(len(own), high * 8, wide * 8).astype(np.float32)
            v, h = most_v // x.parts[c][2], most_h // x.parts[c][1]
            plane = plane.repeat(v, 1).repeat(h, 2) if v > 1 or h > 1 else plane
            full.append(plane[:, :height, :width])
            at = at + n
        if len(full) == 3:
            y, cb, cr = full[0], full[1] - 128, full[2] - 128
            rgb = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], 3)
        else:
            rgb = np.repeat(full[0][..., None], 3, 3)
        rgb = np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
        for i, one in zip(own, rgb, strict=True):
            out[i] = one
    return out


def payload_of(image: Image, coef: np.ndarray, first: int) -> bytes:
    """The payload bytes of a file that write_jpegs made."""
    if image.payload is None:
        raise ValueError("this JPEG holds no payload")
    value = coef[first : first + -(-image.payload // 64)].reshape(-1)[: image.payload]
    return (value + np.where(value < 0, 255, 0)).astype(np.uint8).tobytes()


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a progressive JPEG) of docs(doc_id, text), one row for each row.

    A null text is empty, and an empty one still makes a file.  Repeated rows give equal media; a null
    doc_id stays null; other columns are left out.  An empty table gives an empty result.  A text is
    one image, so a worker holds some twenty times the bytes of its longest text.
    """

    def run(batches):
        for batch in batches:
            data, offsets = rows(batch.column("text"))
            for a, b in chunks(offsets, CHUNK_PAYLOAD):
                part = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(part[1])), pa.array(write_jpegs(*part), pa.binary())], ["doc_id", "n_bytes", "media"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, tensor: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload, and with `tensor` height, width, rgb (height * width * 3 bytes) of media(doc_id, n_bytes, media).

    A null medium gives nulls.  A broken one raises: a lossless store must not lose a row.
    """
    schema = "doc_id long, n_bytes long, payload binary, height int, width int, rgb binary"

    def run(batches):
        for batch in batches:
            for one, images, coef, base, have in _decoded(batch):
                n = len(have)
                rgb = dict(zip(have, tensors(images, coef, base), strict=True)) if tensor else {}
                place = {i: k for k, i in enumerate(have)}
                size = one.num_rows
                yield pa.record_batch(
                    [one.column("doc_id"), one.column("n_bytes"), pa.array([payload_of(images[place[i]], coef, int(base[place[i]])) if i in place else None for i in range(size)], pa.binary())]
                    + [pa.array([images[place[i]].height if i in place else None for i in range(size)], pa.int32()), pa.array([images[place[i]].width if i in place else None for i in range(size)], pa.int32()), pa.array([rgb[i].tobytes() if i in rgb else None for i in range(size)], pa.binary())],
                    ["doc_id", "n_bytes", "payload", "height", "width", "rgb"],
                )
                del n

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), schema)


def _decoded(batch):
    column = batch.column("media")
    data, offsets = rows(column)
    for a, b in chunks(offsets, CHUNK_PAYLOAD):
        have = [i for i in range(b - a) if offsets[a + i + 1] > offsets[a + i]]
        at = np.append(offsets[a + np.array(have, np.int64)], offsets[b]) - offsets[a]
        images, coef, base = read_coefficients(data[offsets[a] : offsets[b]], at.astype(np.int64)) if have else ([], np.zeros((0, 64), np.int16), np.zeros(0, np.int64))
        yield batch.slice(a, b - a), images, coef, base, have


def feature_of(rgb: np.ndarray) -> str:
    """Size, means of the three channels and CRC-32 of the tensor."""
    means = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // max(rgb.shape[0] * rgb.shape[1], 1)
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{means[0]},{means[1]},{means[2]}:{zlib.crc32(rgb.tobytes()):08x}"


def media_digests(media: DataFrame) -> DataFrame:
    """What is read back from media(doc_id, n_bytes, media), as digests, one row for each row.

    Repeated rows give equal digests; other columns are left out.  A broken or null medium raises: a
    lossless store must not lose a row.  An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for one, images, coef, base, _ in _decoded(batch):
                stored = one.column("media")
                back = [payload_of(x, coef, int(f)) for x, f in zip(images, base, strict=True)]
                raw = [x.as_buffer() for x in stored]
                digest = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.record_batch(
                    [
                        one.column("doc_id"), one.column("n_bytes"), pa.array([len(x) for x in back]), pa.array([digest(x) for x in back], pa.string()), pa.array([zlib.crc32(x[-64:]) for x in back], pa.int64()),
                        pa.array([x.size for x in raw]), pa.array([digest(x) for x in raw], pa.string()), pa.array([feature_of(x) for x in tensors(images, coef, base)], pa.string()),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return media.mapInArrow(tidy(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
