"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Bytes stand in a linked list.  Pairs wait in buckets by merge rank; a three-level bitmap over the
ranks gives the lowest bucket that holds anything (find first set); an entry whose pair has changed
since is stale and skipped.

A pre-token of LONG bytes or more goes through the queue alone: a bucket is a heap of places, the
leftmost one merges, and so it costs about as much per byte whatever its length.  The shorter
different pre-tokens of a batch go through one queue together: all pairs of the popped rank merge at
once, left to right, unless the merged token can form a pair of a lower rank: then only the first
pair of each pre-token merges before the queue is asked again.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, prefix_sums, rows, small_batches, span_hash, spread, tidy

#: Fixed value: the pre-token pattern that `boundaries` follows; another one runs through `regex`.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What may follow an apostrophe in that pattern.
SHORT_FORMS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = range(4)
NO_PAIR = np.iinfo(np.int32).max
#: Bytes of text whose different pre-tokens are encoded together; bounds a worker's memory.
PIECE_BYTES = 1 << 21
#: Bytes from which a pre-token has a queue of its own.
LONG = 512


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    patterns = [(kind, regex.compile(p)) for kind, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+"))]
    for first in range(0, 0x110000, 0x1000):
        if 0xD800 <= first < 0xE000:  # surrogates are no characters
            continue
        block = "".join(map(chr, range(first, first + 0x1000)))
        for kind, pattern in patterns:
            for m in pattern.finditer(block):
                out[first + m.start() : first + m.end()] = kind
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of the pre-tokens of every row; they cover the rows."""
    if pattern != PATTERN:
        return _by_regex(data, offsets, pattern)
    n_bytes = len(data)
    if not n_bytes:
        none = np.zeros(0, np.int64)
        return none, none
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), n_bytes)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    n = len(points)
    row_start = np.zeros(n + 1, bool)
    row_start[np.searchsorted(at, offsets)] = True
    new = row_start[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    what, opens = kind[begin], row_start[begin]
    length, space = end - begin, kind[begin] == SPACE
    last_in_row = np.append(opens[1:], True)
    # a space run gives its last character to what follows, if that is a plain space
    gives = space & ~last_in_row & (points[end - 1] == 32)
    takes = np.append(False, gives[:-1]) & ~opens
    start = np.zeros(n + 1, bool)
    plain = ~space
    start[begin[plain] - takes[plain]] = True
    start[begin[space & ((length > 1) | ~gives)]] = True
    start[end[space & ~last_in_row & ~gives] - 1] = True
    mark = np.flatnonzero((what == OTHER) & (length == 1) & ~takes & (points[begin] == 39) & ~last_in_row)
    mark = mark[what[mark + 1] == LETTER] if len(mark) else mark
    for run in mark.tolist():
        a, b = int(begin[run + 1]), int(end[run + 1])
        head = "".join(map(chr, points[a : min(b, a + 2)].tolist()))
        form = next((x for x in SHORT_FORMS if head.startswith(x)), None)
        if form:
            start[a] = False
            if a + len(form) < b:
                start[a + len(form)] = True
    first = np.flatnonzero(start[:n])
    return at[first], at[np.append(first[1:], n)]


def _by_regex(data, offsets, pattern):
    compiled, starts, ends = regex.compile(pattern), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for m in compiled.finditer(data[a:b].tobytes().decode("utf-8")):
            size = len(m[0].encode())
            starts.append(a)
            a += size
            ends.append(a)
    return np.array(starts, np.int64), np.array(ends, np.int64)


class Ranks:
    """A rank file as arrays: what a pair merges to, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ids = self.ids
        self.size = max(ids.values()) + 1
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ids.items():
            for i in range(1, len(token)):
                left, right = ids.get(token[:i]), ids.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        # a token that can form a pair of a lower rank than its own
        self.sinks = np.zeros(self.size, bool)
        for side in (self.keys // self.size, self.keys % self.size):
            self.sinks[side[self.merged < side]] = True
        self.bytes_of = [b""] * self.size
        for token, rank in ids.items():
            self.bytes_of[rank] = token
        flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        ends = np.cumsum([len(x) for x in self.bytes_of])
        starts = np.append(0, ends[:-1])
        sums = prefix_sums(flat)
        hashes = span_hash(sums, starts, ends)
        have = np.flatnonzero(ends > starts)
        by = have[np.argsort(hashes[have])]
        self.whole_hash, self.whole_id = hashes[by], by.astype(np.int32)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NO_PAIR)


class RankBits:
    """A set of ranks under a three-level bitmap of 64-bit words."""

    def __init__(self, size: int):
        self.low, self.mid, self.top = [0] * (size // 64 + 1), [0] * (size // 4096 + 1), 0

    def add(self, rank: int) -> None:
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def first(self) -> int:
        """The lowest rank, or -1."""
        if not self.top:
            return -1
        low = lambda x: (x & -x).bit_length() - 1
        t = low(self.top)
        m = t << 6 | low(self.mid[t])
        return m << 6 | low(self.low[m])

    def remove(self, rank: int) -> None:
        m, t = rank >> 6, rank >> 12
        self.low[m] &= ~(1 << (rank & 63))
        if not self.low[m]:
            self.mid[t] &= ~(1 << (m & 63))
            if not self.mid[t]:
                self.top &= ~(1 << t)


class RankQueue:
    """Buckets by rank; a bucket holds arrays of places."""

    def __init__(self, size: int):
        self.buckets: list[list[np.ndarray] | None] = [None] * size
        self.bits = RankBits(size)

    def push(self, ranks: np.ndarray, nodes: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, nodes = ranks[order], nodes[order]
        at = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])).tolist()
        for a, b, rank in zip(at, [*at[1:], len(ranks)], ranks[at].tolist(), strict=True):
            held = self.buckets[rank]
            if held is None:
                self.buckets[rank] = [nodes[a:b]]
                self.bits.add(rank)
            else:
                held.append(nodes[a:b])

    def pop(self) -> tuple[int, np.ndarray] | None:
        rank = self.bits.first()
        if rank < 0:
            return None
        held, self.buckets[rank] = self.buckets[rank], None
        self.bits.remove(rank)
        return rank, held[0] if len(held) == 1 else np.concatenate(held)


def encode_long(ranks: Ranks, piece: bytes) -> list[int]:
    """Ids of one pre-token: the leftmost pair of the lowest rank merges, one after the other."""
    own, bytes_of = ranks.ids, ranks.bytes_of
    if piece in own:
        return [own[piece]]
    n = len(piece)
    ids = array("i", ranks.byte_id[np.frombuffer(piece, np.uint8)].tolist())
    after, before, pair = array("q", range(1, n + 1)), array("q", range(-1, n - 1)), array("i", [-1]) * n
    buckets: dict[int, list[int]] = {}
    bits = RankBits(ranks.size)
    known: dict[tuple[int, int], int] = {}  # the different pairs of this pre-token

    def offer(i: int) -> None:
        j = after[i]
        if j == n:
            pair[i] = -1
            return
        two = ids[i], ids[j]
        rank = known.get(two)
        if rank is None:
            rank = known[two] = own.get(bytes_of[two[0]] + bytes_of[two[1]], -1)
        pair[i] = rank
        if rank >= 0:
            held = buckets.get(rank)
            if held:
                heappush(held, i)
            else:
                buckets[rank] = [i]
                bits.add(rank)

    for i in range(n - 1):
        offer(i)
    while (rank := bits.first()) >= 0:
        held = buckets[rank]
        i = heappop(held)
        if not held:
            bits.remove(rank)
        if pair[i] != rank:
            continue  # stale
        j = after[i]
        ids[i] = rank
        pair[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def encode_pieces(ranks: Ranks, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in a row, number of ids of each piece) of non-empty byte strings."""
    lengths = ends - starts
    far = np.flatnonzero(lengths >= LONG)
    if len(far):
        alone = [np.array(encode_long(ranks, data[a:b].tobytes()), np.int32) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
        near = np.flatnonzero(lengths < LONG)
        ids, counts = encode_pieces(ranks, data, starts[near], ends[near], hashes[near]) if len(near) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        many = np.zeros(len(starts), np.int64)
        many[near], many[far] = counts, [len(x) for x in alone]
        at, out = np.cumsum(many) - many, np.empty(int(many.sum()), np.int32)
        owner, place = spread(counts)
        out[at[near][owner] + place] = ids
        for a, x in zip(at[far].tolist(), alone, strict=True):
            out[a : a + len(x)] = x
        return out, many
    owner, place = spread(lengths)
    body = data[starts[owner] + place]
    n = len(body)
    ids = ranks.byte_id[body].astype(np.int32)
    alive = np.ones(n, bool)
    first = np.cumsum(lengths) - lengths
    at = np.minimum(np.searchsorted(ranks.whole_hash, hashes), len(ranks.whole_hash) - 1)
    whole = ranks.whole_hash[at] == hashes
    alive[whole[owner]] = False
    ids[first[whole]] = ranks.whole_id[at[whole]]
    alive[first[whole]] = True
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[first + lengths - 1] = -1
    before[first] = -1
    pair = np.full(n, NO_PAIR, np.int32)
    open_ = np.flatnonzero((after >= 0) & ~whole[owner])
    pair[open_] = ranks.pair_rank(ids[open_], ids[open_ + 1])
    queue = RankQueue(ranks.size)
    ready = open_[pair[open_] != NO_PAIR]
    if len(ready):
        queue.push(pair[ready], ready)
    while (top := queue.pop()) is not None:
        rank, nodes = top
        nodes = nodes[pair[nodes] == rank]
        if not len(nodes):
            continue
        if len(nodes) > 1:
            nodes = np.unique(nodes)
            if ranks.sinks[rank]:
                one = np.append(True, owner[nodes[1:]] != owner[nodes[:-1]])
                if not one.all():
                    queue.push(np.full((~one).sum(), rank, np.int32), nodes[~one])
                    nodes = nodes[one]
            else:
                touch = after[nodes[:-1]] == nodes[1:]
                if touch.any():  # of pairs that overlap in a row, every second one is gone
                    index = np.arange(len(nodes))
                    run = np.maximum.accumulate(np.where(np.append(True, ~touch), index, 0))
                    nodes = nodes[(index - run) % 2 == 0]
        gone = after[nodes]
        ids[nodes] = rank
        alive[gone] = False
        pair[gone] = NO_PAIR
        rest = after[gone]
        after[nodes] = rest
        more = rest >= 0
        before[rest[more]] = nodes[more]
        pair[nodes] = NO_PAIR
        left = before[nodes]
        left = left[left >= 0]
        touched = np.unique(np.concatenate([nodes, left])) if len(nodes) > 1 else np.append(left, nodes)
        touched = touched[alive[touched] & (after[touched] >= 0)]
        if len(touched):
            new = ranks.pair_rank(ids[touched], ids[after[touched]])
            pair[touched] = new
            have = new != NO_PAIR
            if have.any():
                queue.push(new[have], touched[have])
    return ids[alive], np.bincount(owner[alive], minlength=len(starts))


@lru_cache(2)
def load(path: str) -> Ranks:
    return Ranks(path)


def encode_rows(ranks: Ranks, data: np.ndarray, offsets: np.ndarray, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets of the rows in them).  Each different pre-token of the batch is encoded once."""
    starts, ends, hashes = [], [], []
    for first, last in chunks(offsets):
        a, b = offsets[first], offsets[last]
        part = data[a:b]
        s, e = boundaries(part, offsets[first : last + 1] - a, pattern)
        hashes.append(span_hash(prefix_sums(part), s, e))
        starts.append(s + a)
        ends.append(e + a)
    n = len(offsets) - 1
    if not starts or not sum(map(len, starts)):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    starts, ends, hashes = map(np.concatenate, (starts, ends, hashes))
    different, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    ids, counts = encode_pieces(ranks, data, starts[index], ends[index], different)
    from_ = np.cumsum(counts) - counts
    row_of = np.searchsorted(offsets, starts, "right") - 1
    edges = np.searchsorted(row_of, np.arange(n + 1))
    out, at = [], [0]
    for first, last in chunks(offsets):  # the ids of a few rows at a time
        of = inverse[edges[first] : edges[last]]
        many = counts[of]
        owner, place = spread(many)
        out.append(ids[from_[of][owner] + place])
        per_row = np.bincount(row_of[edges[first] : edges[last]] - first, weights=many, minlength=last - first).astype(np.int64)
        at.extend((at[-1] + np.cumsum(per_row)).tolist())
    return np.concatenate(out), np.array(at, np.int64)


def _pieces(batch):
    """A batch in pieces of whole rows: (piece, bytes, offsets)."""
    data, offsets = rows(batch.column("text"))
    for a, b in chunks(offsets, PIECE_BYTES):
        yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def encode(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """docs with a column `ids` (the ids as little-endian unsigned 32-bit integers, one binary).

    A null text is empty and has no ids; repeated rows give the same ids; other columns stay, and a
    column already named `ids` is replaced.  The path must be readable where tasks run.
    """
    kept = [c for c in docs.columns if c != "ids"]
    schema = docs.select(*kept).schema.add("ids", "binary")

    def run(batches):
        ranks = load(path)
        for batch, data, offsets in (x for one in batches for x in _pieces(one)):
            ids, at = encode_rows(ranks, data, offsets, pattern)
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=[*kept, "ids"])

    return small_batches(docs).select(*kept).mapInArrow(tidy(run), schema)


def decode_ids(ranks: Ranks, ids: np.ndarray) -> bytes:
    return b"".join(map(ranks.bytes_of.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column `decoded` (bytes) made from `ids`; null ids give null."""
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*kept).schema.add("decoded", "binary")

    def run(batches):
        ranks = load(path)
        for batch in batches:
            out = [None if x is None else decode_ids(ranks, np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return small_batches(encoded).select(*kept).mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode, keeping digests only."""

    def run(batches):
        ranks = load(path)
        for batch, data, offsets in (x for one in batches for x in _pieces(one)):
            ids, at = encode_rows(ranks, data, offsets, pattern)
            raw = ids.astype("<u4")
            digest = lambda x: hashlib.sha256(x).hexdigest()
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array([digest(raw[a:b].tobytes()) for a, b in spans], pa.string()), pa.array([digest(decode_ids(ranks, raw[a:b])) for a, b in spans], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
