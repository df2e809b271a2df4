"""Exact substring dedup by suffix grouping (linear grouping construction).

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller doc_id.

1. Every LENGTH-byte string picks one anchor in itself: its GRAM-byte piece of the lowest hash, the
   leftmost of equals.  The choice depends on the string alone, so equal strings pick equal anchors.
   Strings with the same anchor at one place are neighbours; they form one context.  Contexts are
   keyed by the anchor and the SIDE bytes on that side of it which all their strings hold.
2. Keys are counted over the whole table; those of one document are left out.  What is left goes into
   a bitmap, whose size follows the number of shared keys up to MOST_FILTER_BITS.  It is a filter only:
   a wrong hit costs work and changes no result.
3. The contexts of shared keys meet by key, each different one once.  Where a key has several, their
   suffixes are put in order by `grouped_suffixes`; strings that stand side by side there and are
   equal in LENGTH bytes share their smallest document.  A key with one context needs no order.
4. A key of very many documents would gather them all in one task.  The strings of such common keys
   are keyed by PART_CORE bytes instead, so that few different contexts of a key are possible however
   large the corpus is.  Only the smallest document of each context is sent to be put in order; the
   occurrences look their contexts up, in a table of HOT rows at most that every task has (contexts of
   more than a HOT-th of all occurrences) or in the bucket of the context's hash (the others).
5. The strings with a smaller document give spans, which go back to their documents by a join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import chunks, cut, mix, powers, prefix_sums, rows, small_batches, span_hash, spread, tidy

LENGTH, GRAM = 50, 16
SIDE = (LENGTH - GRAM) // 2
CORE = GRAM + SIDE
#: Bytes that a context of n strings has besides n and its core.
REST = LENGTH - 1 - CORE
#: A key of about so many documents, counted once a batch, is common.
COMMON_DOCS = 1024
#: Strings that a context of a common key has at most, and the bytes that all of them hold.
PART = 4
PART_CORE = LENGTH + 1 - PART
PART_REST = LENGTH - 1 - PART_CORE
#: Most contexts that are sent to every task; 48 bytes each, so 6 MB.
HOT = 1 << 17
MOST_FILTER_BITS = 29
#: Bytes of text whose keys a bucket counts, about.
COUNT_BYTES = 1 << 26
#: Shared keys that a bucket of the last shuffle holds, about.
BUCKET_KEYS, LEAST_BUCKETS = 60_000, 64
#: Symbols of contexts whose suffixes are put in order together, about; a few keys at a time stay in cache.
BLOCK_SYMBOLS = 4000
#: Bytes of text that are hashed at a time; so few stay in cache.
HASH_BYTES = 1 << 17
#: Occurrences, and keys to count, that are held before they are sent.
HOLD, HOLD_KEYS = 1 << 18, 1 << 20
#: Bits of a place in a piece of text; longer texts are taken in pieces that overlap.
PLACE_BITS = 26
_rng = np.random.Generator(np.random.PCG64(5))
_FACTORS = _rng.integers(0, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _groups(flat: bytes, first: list[int]) -> list[tuple[int, list[int]]]:
    """(length of the prefix, places) of the groups of suffixes of equal Lyndon prefix, in descending order.

    Groups are numbers in a linked list.  The highest group that has not been taken is taken: each of
    its suffixes leaves the list of open places, and the nearest open place on its left, the previous
    smaller suffix, takes the group's prefix over, k times after k taken neighbours.  It moves to a
    new group right above its own, the higher the larger k is.  Every place is taken once and moves at
    most as often as places point to it, so the work is linear.
    """
    n = len(flat)
    before, after = list(range(-1, n)), list(range(1, n + 2))
    held: list[list[int]] = [[] for _ in range(256)]
    for i, c in enumerate(flat):
        held[c].append(i)
    ends = {a - 1 for a in first[1:]}
    held[0] = [i for i in held[0] if i not in ends]
    for a in first:
        before[a] = -1
    rank, members = [0] * 256, []
    for c in range(256):
        if held[c]:
            rank[c] = len(members)
            members.append(held[c])
    of, size = [rank[c] for c in flat], [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    taken, now = [], len(members) - 1
    while now >= 0:
        own = members[now]
        if len(own) > 1:
            own = [i for i in own if of[i] == now]  # the others have moved on
        elif not own or of[own[0]] != now:
            now = below[now]
            continue
        u = size[now]
        taken.append((u, own))
        moved: list[int] = []  # previous smaller suffixes, once for each that they take over
        for i in own:
            p, q = before[i], after[i]
            before[q] = p
            if p >= 0:
                after[p] = q
                moved.append(p)
        by = {1: moved}
        if len(moved) > 1 and len(set(moved)) < len(moved):
            runs: dict[int, int] = {}
            for p in moved:
                runs[p] = runs.get(p, 0) + 1
            by = {k: [] for k in set(runs.values())}
            for p, k in runs.items():
                by[k].append(p)
        top: dict[int, int] = {}
        for k in sorted(by):
            fresh: dict[int, int] = {}
            for p in by[k]:
                v = of[p]
                g = fresh.get(v)
                if g is None:
                    g = fresh[v] = of[p] = len(size)
                    low = top.get(v, v)
                    high = above[low]  # there is one: the group that is being taken is above
                    size.append(size[v] + k * u)
                    members.append([p])
                    below.append(low)
                    above.append(high)
                    above[low] = below[high] = top[v] = g
                else:
                    of[p] = g
                    members[g].append(p)
        now = below[now]
    return taken


def grouped_suffixes(flat: bytes, first: list[int]) -> list[int]:
    """Places of all suffixes in order, of texts that start at `first` and have one place for their end.

    first ends with the length of flat; equal suffixes stand in order of their texts.  The suffixes
    after which nothing comes are the smallest; going up the groups, each suffix puts those whose
    Lyndon prefix ends where it starts next in their groups.
    """
    n = len(flat)
    taken = _groups(flat, first)
    taken.reverse()
    group, head, more = [0] * n, [-1] * (n + 1), [-1] * n
    for g, (size, members) in enumerate(taken):
        for i in members:
            group[i] = g
            more[i] = head[i + size]
            head[i + size] = i
    placed: list[list[int]] = [[] for _ in taken]
    for a in first[1:]:
        j = head[a - 1]
        while j >= 0:
            placed[group[j]].append(j)
            j = more[j]
    out: list[int] = []
    for own in placed:
        for i in own:  # grows as it is read
            j = head[i]
            while j >= 0:
                placed[group[j]].append(j)
                j = more[j]
        out += own
    return out


def suffix_order(texts: list[bytes]) -> list[tuple[int, int]]:
    """(text, place) of every suffix of all texts in order; equal suffixes in order of the texts."""
    first = [0]
    for t in texts:
        first.append(first[-1] + len(t) + 1)
    out = np.array(grouped_suffixes(b"\x00".join([*texts, b""]), first), np.int64)
    starts = np.array(first[:-1], np.int64)
    text = np.searchsorted(starts, out, "right") - 1
    return list(zip(text.tolist(), (out - starts[text]).tolist(), strict=True)) if len(out) else []


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number."""
    out = np.empty(len(data) - 7, np.uint64)
    for k in range(8):
        many = (len(data) - k) // 8
        out[k::8] = data[k : k + 8 * many].view("<u8")
    return out


def _blend(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of 8 * n bytes from each place on."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(31)) ^ words[at + 8 * k]) * _FACTORS[k]
    return out


def contexts(data: np.ndarray, offsets: np.ndarray):
    """(row, key, first string, last string, core, anchor) of the contexts of a chunk; places are in the chunk.

    The core is the place in the context of the CORE bytes that make its key.
    """
    n, none = len(data), np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none.astype(np.uint64), none, none, none, none
    words, place = _eights(data), np.uint64((1 << PLACE_BITS) - 1)
    least = words[:-8] * _FACTORS[0]
    least ^= words[8:] * _FACTORS[1]
    least ^= least >> np.uint64(29)
    least *= _FACTORS[2]
    least &= ~place
    least |= np.arange(len(least), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    valid = np.ones(len(least), bool)  # places where a string starts
    for a, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[max(e - LENGTH + 1, a) : e] = False
    anchor = (least & place).astype(np.int64)
    side = np.arange(len(least)) > anchor - SIDE  # 1: the string holds the bytes after the anchor, 0: those before it
    part = 2 * anchor + side
    new = np.append(True, part[1:] != part[:-1])
    new[offsets[:-1][offsets[:-1] < len(new)]] = True
    first = np.flatnonzero(new & valid)
    last = np.flatnonzero(np.append(new[1:] | ~valid[1:], True) & valid)
    anchor, side = anchor[first], side[first]
    a = np.where(side, anchor, anchor - SIDE)
    key = mix(_blend(words, a, CORE // 8) + (data[a + CORE - 1].astype(np.uint64) << np.uint64(1) | side.astype(np.uint64)) * _FACTORS[5])
    return np.searchsorted(offsets, first, "right") - 1, key, first, last, a - first, anchor


def _batch_contexts(batch):
    """(first row, bytes, starts of the rows in them, contexts ...) of the chunks of a batch."""
    data, offsets = rows(batch.column("text"))
    for first, last in chunks(offsets, HASH_BYTES):
        a, b = int(offsets[first]), int(offsets[last])
        if b - a < 1 << PLACE_BITS:
            own = offsets[first : last + 1] - a
            yield first, data[a:b], own[:-1], *contexts(data[a:b], own)
            continue
        step = (1 << PLACE_BITS) - LENGTH  # one long text; each of its strings is in one piece
        for at in range(a, b - LENGTH + 1, step):
            part = data[at : min(at + step + LENGTH - 1, b)]
            yield first, part, np.array([a - at]), *contexts(part, np.array([0, len(part)]))


def _split(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def _shrink(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as compressed differences, first bytes first."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _grow(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _send_keys(count_bits: int):
    """(bucket, keys of one document, keys of more documents, how many) of HOLD_KEYS contexts; 32 bits of a key go."""

    def send(held):
        key, doc_of = np.concatenate(held, 1)
        order = np.lexsort((doc_of, key))
        key, doc_of = key[order], doc_of[order]
        key = key[np.append(True, (key[1:] != key[:-1]) | (doc_of[1:] != doc_of[:-1]))]
        u, n = np.unique(key, return_counts=True)
        bucket = _split(u, count_bits)
        low = ((u >> np.uint64(32 - count_bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for k in np.unique(bucket).tolist():
            own = slice(*np.searchsorted(bucket, [k, k + 1]))
            one, more, many = low[own][n[own] == 1], low[own][n[own] > 1], n[own][n[own] > 1].astype(np.uint32)
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([len(one)], pa.int32()), *(pa.array([x], pa.binary()) for x in (_shrink(one), more.tobytes(), many.tobytes()))], ["bucket", "n_once", "once", "more", "many"])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False).view(np.uint64)
            for first, _, _, row, key, *_ in _batch_contexts(batch):
                held.append(np.stack([key, docs[first + row]]))
                total += len(key)
            if total >= HOLD_KEYS:
                yield from send(held)
                held, total = [], 0
        if total:
            yield from send(held)

    return run


def _by_bucket(batches, columns):
    """The rows of each bucket; buckets come one after the other."""
    now, held = None, []
    for batch in batches:
        for values in zip(*(batch.column(c).to_pylist() for c in ("bucket", *columns)), strict=True):
            if values[0] != now:
                if held:
                    yield now, held
                now, held = values[0], []
            held.append(values[1:])
    if held:
        yield now, held


def _count_keys(common_docs: int):
    def run(batches):
        for bucket, held in _by_bucket(batches, ["n_once", "once", "more", "many"]):
            once = np.sort(np.concatenate([_grow(x[1], x[0]) for x in held]))
            more, many = (np.frombuffer(b"".join(x[i] for x in held), np.uint32) for i in (2, 3))
            again = once[1:][once[1:] == once[:-1]]
            # a key seen once in a batch and more often in another is among `more` already
            shared, which = np.unique(np.concatenate([again, more]), return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([np.ones(len(again)), many]), minlength=len(shared))
            common = shared[n >= common_docs - 1]
            yield pa.record_batch(
                [pa.array([bucket], pa.int32()), pa.array([len(shared)], pa.int64()), pa.array([len(common)], pa.int64()), pa.array([shared.tobytes()], pa.binary()), pa.array([common.tobytes()], pa.binary())],
                ["bucket", "n_shared", "n_common", "shared", "common"],
            )

    return run


def _slices(column: str, bits: int, count_bits: int):
    def run(batches):
        for batch in batches:
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column(column).to_pylist(), strict=True):
                if raw:
                    out = np.zeros(1 << (bits - count_bits), bool)
                    out[np.frombuffer(raw, np.uint32) >> np.uint32(32 - (bits - count_bits))] = True
                    yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([np.packbits(out).tobytes()], pa.binary())], ["bucket", "map"])

    return run


def _bitmap(keys: DataFrame, column: str, n: int, count_bits: int) -> tuple[int, bytes]:
    """(bits, bitmap) of n counted keys: one place in about 32 to 64 is taken, up to MOST_FILTER_BITS."""
    bits = min(max(int(32 * n).bit_length(), count_bits + 6), MOST_FILTER_BITS)
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (bits - count_bits - 3)
    for r in keys.mapInArrow(tidy(_slices(column, bits, count_bits)), "bucket int, map binary").collect():
        out[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["map"], np.uint8)
    return bits, out.tobytes()


def _among(bitmap: tuple[int, bytes], key: np.ndarray) -> np.ndarray:
    place = _split(key, bitmap[0])
    return (np.frombuffer(bitmap[1], np.uint8)[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


_PACKED = (np.uint64, np.uint8, np.uint8, np.uint8, np.uint8, np.int64, np.int64, np.int32, np.int32)


def _pack(arrays, kinds) -> tuple[bytes, int]:
    """(arrays in one compressed blob, its size before)."""
    raw = np.array([len(x) for x in arrays], "<i8").tobytes() + b"".join(x.astype(k, copy=False).tobytes() for x, k in zip(arrays, kinds, strict=True))
    return pa.compress(raw, "zstd", asbytes=True), len(raw)


def _unpack(blob: bytes, size: int, kinds) -> list[np.ndarray]:
    raw, at, out = pa.decompress(blob, size, "zstd", asbytes=True), 8 * len(kinds), []
    for n, k in zip(np.frombuffer(raw, "<i8", len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _send_contexts(filters, n_buckets: int):
    """(bucket, packed contexts with their occurrences); each different context of HOLD occurrences once, without its core."""

    def pack(held, docs, prints):
        row, key, context, n, core, start = (np.concatenate([h[i] for h in held]) for i in range(6))
        body = np.concatenate([h[6] for h in held])
        size = n + REST
        begin = np.cumsum(size) - size
        bucket = (mix(key) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((context, bucket))
        at = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        buckets, blobs, sizes = bucket[order][at].tolist(), [], []
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
            own = order[a:b]
            c = context[own]
            new = np.append(True, c[1:] != c[:-1])
            lead = own[new]
            o, p = spread(size[lead])
            used, of_row = np.unique(row[own], return_inverse=True)
            blob, raw = _pack((key[lead], n[lead], core[lead], body[begin[lead][o] + p], new, docs[used], prints[used], of_row, start[own]), _PACKED)
            blobs.append(blob)
            sizes.append(raw)
        return pa.record_batch([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary()), pa.array(sizes, pa.int64())], ["bucket", "blob", "size"])

    def run(batches):
        shared, common = filters.value
        held, docs, prints, n_rows, many = [], [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            docs.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
            prints.append(batch.column("print").to_numpy(zero_copy_only=False))
            for first, part, starts, row, key, a, b, core, _ in _batch_contexts(batch):
                hit = np.flatnonzero(_among(shared, key) & ~_among(common, key))
                if not len(hit):
                    continue
                row, key, a, b, core = row[hit], key[hit], a[hit], b[hit], core[hit]
                context = mix(span_hash(prefix_sums(part), a, b + LENGTH) ^ key)
                o, p = spread(b - a + 1 + REST)
                held.append((n_rows + first + row, key, context, b - a + 1, core, a - starts[row], part[a[o] + p + np.where(p >= core[o], CORE, 0)]))
                many += len(hit)
            n_rows += batch.num_rows
            if many >= HOLD:
                yield pack(held, np.concatenate(docs), np.concatenate(prints))
                held, docs, prints, n_rows, many = [], [], [], 0, 0
        if many:
            yield pack(held, np.concatenate(docs), np.concatenate(prints))

    return run


def _owners(keys, n_strings, core, body, first_byte, least, core_size: int = CORE):
    """Smallest document of every string of every context; contexts are sorted by key.

    All contexts of a key hold the same core_size bytes at one place, and so does every string of theirs.
    The core is put as one symbol above all bytes; strings are equal if what is left of them and
    their keys are.  A key with one context has nothing to order: its strings differ, as they have
    their anchor at different places, and their smallest document is the context's.
    """
    many = np.ones(len(keys), bool)
    many[1:-1] = (keys[1:-1] == keys[:-2]) | (keys[1:-1] == keys[2:])
    if len(keys):
        many[0], many[-1] = len(keys) > 1 and keys[0] == keys[1], len(keys) > 1 and keys[-1] == keys[-2]
    if not many.all():
        owner = np.repeat(least, n_strings)
        at = np.flatnonzero(many)
        if len(at):
            owner[np.repeat(many, n_strings)] = _owners(keys[at], n_strings[at], core[at], body, first_byte[at], least[at], core_size)[0]
        return owner, np.cumsum(n_strings) - n_strings
    size, rest = LENGTH - core_size + 1, LENGTH - 1 - core_size
    strings = np.cumsum(n_strings) - n_strings
    owner = np.full(int(n_strings.sum()), np.iinfo(np.int64).max)
    length = n_strings + size  # with one place for the end
    starts = np.append(0, np.cumsum(length))
    o, p = spread(length)
    inside = p != core[o]
    symbols = np.full(len(o), 0xFF, np.uint8)
    place = first_byte[o] + p - (p > core[o])
    symbols[inside] = body[np.minimum(place[inside], len(body) - 1)] if len(body) else 0
    symbols[starts[1:] - 1] = 0
    last = np.append(np.flatnonzero(keys[1:] != keys[:-1]), len(keys) - 1) + 1  # ends of keys
    edges, at = [0], 0
    while at < len(keys):
        k = int(np.searchsorted(starts[last], starts[at] + BLOCK_SYMBOLS))
        at = int(last[min(k, len(last) - 1)])
        edges.append(at)
    windows = np.lib.stride_tricks.sliding_window_view(np.append(symbols, np.zeros(size, np.uint8)), size)
    group = np.cumsum(np.append(True, keys[1:] != keys[:-1]))
    for lo in range(0, len(edges) - 1, 1024):
        order = []
        for a, b in zip(edges[lo : lo + 1024], edges[lo + 1 : lo + 1025], strict=False):
            x = int(starts[a])
            order.append(np.array(grouped_suffixes(symbols[x : starts[b]].tobytes(), (starts[a : b + 1] - x).tolist()), np.int64) + x)
        every = np.concatenate(order)
        if not len(every):
            continue
        which = o[every]
        string = p[every] < n_strings[which]
        every, which = every[string], which[string]
        here = windows[every]
        run = np.cumsum(np.append(True, (here[1:] != here[:-1]).any(axis=1)))
        # equal strings of different keys stand mixed: each key's are taken together
        own = run * (int(group[-1]) + 1) + group[which]
        by = np.argsort(own, kind="stable")
        new = np.flatnonzero(np.append(True, own[by][1:] != own[by][:-1]))
        best = np.minimum.reduceat(least[which[by]], new)
        owner[strings[which[by]] + p[every[by]]] = np.repeat(best, np.diff(np.append(new, len(by))))
    return owner, strings


def _span_rows(o, p, owner, doc, prints, start):
    """Spans of each document, merged; string p of occurrence o goes if its owner is a smaller document."""
    gone = owner < doc[o]
    edge = p == 0
    s = np.flatnonzero(gone & (edge | ~np.append(False, gone[:-1])))
    e = np.flatnonzero(gone & (np.append(edge[1:], True) | ~np.append(gone[1:], False)))
    if not len(s):
        return
    which = o[s]
    x, y = start[which] + p[s], start[which] + p[e] + LENGTH
    d, t = doc[which], prints[which]
    order = np.lexsort((x, t, d))
    x, y, d, t = x[order], y[order], d[order], t[order]
    lead = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))
    far = (np.cumsum(lead) - 1) << 36  # one range of places for each document
    reach = np.maximum.accumulate(y + far)
    new = np.flatnonzero(np.append(True, (x + far)[1:] > reach[:-1]))
    y = (reach - far)[np.append(new[1:], len(x)) - 1]
    raw = np.stack([x[new], y], 1).astype("<i8").tobytes()
    first = np.flatnonzero(lead[new])
    ends = np.append(first[1:], len(new)).tolist()
    d, t = d[new][first], t[new][first]
    yield pa.record_batch([pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array([raw[16 * i : 16 * j] for i, j in zip(first.tolist(), ends, strict=True)], pa.binary())], ["of", "of_print", "spans"])


def _find_spans(batches):
    """(doc_id, print, spans): pairs of first and last + 1 byte that go, of the strings of one bucket."""
    for _, held in _by_bucket(batches, ["blob", "size"]):
        parts = [_unpack(raw, size, _PACKED) for raw, size in held]
        key = np.concatenate([p[0] for p in parts])
        n_strings, core = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2))
        flat = np.concatenate([p[3] for p in parts])
        shift = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        of = np.concatenate([np.cumsum(p[4], dtype=np.int64) - 1 + s for p, s in zip(parts, shift, strict=True)])
        doc, prints = (np.concatenate([p[i][p[7]] for p in parts]) for i in (5, 6))
        start = np.concatenate([p[8] for p in parts]).astype(np.int64)
        del parts, held
        edges = np.append(0, np.cumsum(n_strings + REST))
        first_byte = edges[:-1]
        # merge equal contexts of different batches
        context = np.empty(len(key), np.uint64)
        for a, b in chunks(edges, HASH_BYTES):
            context[a:b] = span_hash(prefix_sums(flat[edges[a] : edges[b]]), edges[a:b] - edges[a], edges[a + 1 : b + 1] - edges[a])
        context = mix(context ^ ((core << 8) | n_strings).astype(np.uint64))
        order = np.lexsort((context, key))
        new = np.append(True, (context[order][1:] != context[order][:-1]) | (key[order][1:] != key[order][:-1]))
        lead = order[new]
        merged = np.empty(len(order), np.int64)
        merged[order] = np.cumsum(new) - 1
        of = merged[of]
        least = np.full(len(lead), np.iinfo(np.int64).max)
        most = np.full(len(lead), np.iinfo(np.int64).min)
        np.minimum.at(least, of, doc)
        np.maximum.at(most, of, doc)
        # keys of one document only (wrong hits of the filter) take nothing from it
        at = np.flatnonzero(np.append(True, key[lead][1:] != key[lead][:-1]))
        alive = np.repeat(np.minimum.reduceat(least, at) < np.maximum.reduceat(most, at), np.diff(np.append(at, len(lead))))
        here = alive[of]
        of, doc, prints, start = (np.cumsum(alive) - 1)[of[here]], doc[here], prints[here], start[here]
        lead, least = lead[alive], least[alive]
        if not len(lead):
            continue
        owner, strings = _owners(key[lead], n_strings[lead], core[lead], flat, first_byte[lead], least)
        n = n_strings[lead][of].astype(np.int64)
        for a in range(0, len(of), 1 << 18):  # occurrences
            o, p = spread(n[a : a + (1 << 18)])
            yield from _span_rows(o, p, owner[strings[of[a + o]] + p], doc[a:], prints[a:], start[a:])


def _cut_parts(part, row, a, b, anchor):
    """(row, key, shape, first string, number of strings) of the parts of contexts, PART neighbours at most.

    The strings of a part have the anchor within PART bytes of one place, so they share PART_CORE
    bytes.  The shape is all that a part has besides: its other bytes, their number and the core's place.
    """
    far, near = (anchor - a) // PART, (anchor - b) // PART
    o, p = spread(far - near + 1)
    q = far[o] - p
    core = anchor[o] - q * PART
    first, last = np.maximum(a[o], core - (PART - 1)), np.minimum(b[o], core)
    key = mix(span_hash(prefix_sums(part), core, core + PART_CORE) + q.astype(np.uint64)).view(np.int64)
    n, before = last - first + 1, core - first
    shape = n << 48 | before << 52
    for j in range(PART + PART_REST):
        at = np.minimum(first + j + np.where(j >= before, PART_CORE, 0), len(part) - 1)
        shape |= np.where(j < n + PART_REST, part[at].astype(np.int64), 0) << (8 * j)
    return row[o], key, shape, first, n


def _common_parts(batch, filters):
    shared, common = filters
    for first, part, offsets, row, key, a, b, _, anchor in _batch_contexts(batch):
        hit = np.flatnonzero(_among(common, key) & _among(shared, key))
        if len(hit):
            row, key, shape, at, n = _cut_parts(part, row[hit], a[hit], b[hit], anchor[hit])
            yield first + row, key, shape, at - offsets[row], n


def _merge_parts(parts: np.ndarray) -> np.ndarray:
    """Rows key, shape, least, most, times: one column for each different part, sorted by key."""
    order = np.lexsort((parts[1], parts[0]))
    key, shape, least, most, times = parts[:, order]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (shape[1:] != shape[:-1])))
    return np.stack([key[new], shape[new], np.minimum.reduceat(least, new), np.maximum.reduceat(most, new), np.add.reduceat(times, new)])


def _send_parts(filters, n_buckets: int):
    """(bucket, packed parts of common keys); each part of HOLD occurrences once, with its least and most document and times."""

    def pack(parts):
        for bucket, own in _dealt(mix(parts[0].view(np.uint64)), n_buckets):
            blob, size = _pack([parts[:, own].ravel()], (np.int64,))
            yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), pa.array([size], pa.int64())], ["bucket", "blob", "size"])

    def run(batches):
        held, total = [], 0
        for batch in batches:
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for row, key, shape, _, _ in _common_parts(batch, filters.value):
                held.append(np.stack([key, shape, docs[row], docs[row], np.ones(len(key), np.int64)]))
                total += len(key)
            if total >= HOLD:
                held = [_merge_parts(np.concatenate(held, 1))]
                total = held[0].shape[1]
                if total >= HOLD // 2:
                    yield from pack(held[0])
                    held, total = [], 0
        if total:
            yield from pack(_merge_parts(np.concatenate(held, 1)))

    return run


_OWNERS = [f"owner{i}" for i in range(PART)]


def _settle_parts(batches):
    """(key, shape, times, owner of each string) of the parts of a bucket of which a document loses bytes."""
    for _, held in _by_bucket(batches, ["blob", "size"]):
        parts = np.concatenate([_unpack(blob, size, (np.int64,))[0].reshape(5, -1) for blob, size in held], 1)
        key, shape, least, most, times = _merge_parts(parts)
        n, before = shape >> 48 & 15, shape >> 52
        place = np.arange(PART + PART_REST)
        body = (shape[:, None] >> (8 * place) & 255).astype(np.uint8)[place < (n + PART_REST)[:, None]]
        owner, strings = _owners(key, n, before, body, np.cumsum(n + PART_REST) - (n + PART_REST), least, PART_CORE)
        out = np.full((len(key), PART), np.iinfo(np.int64).max)
        o, p = spread(n)
        out[o, p] = owner
        lost = np.flatnonzero((out < most[:, None]).any(axis=1))
        if len(lost):
            yield pa.record_batch([pa.array(x[lost]) for x in (key, shape, times, *out.T)], ["key", "shape", "times", *_OWNERS])


CODE_BITS = 6


def _part_codes(key: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return mix(key.view(np.uint64) ^ mix(shape.view(np.uint64)))


def _send_codes(batches):
    for batch in batches:
        code = _part_codes(*(batch.column(c).to_numpy() for c in ("key", "shape")))
        bucket = _split(code, CODE_BITS)
        low = ((code >> np.uint64(32 - CODE_BITS)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for k in np.unique(bucket).tolist():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([low[bucket == k].tobytes()], pa.binary())], ["bucket", "codes"])


def _join_codes(batches):
    for bucket, held in _by_bucket(batches, ["codes"]):
        yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([b"".join(x[0] for x in held)], pa.binary())], ["bucket", "codes"])


_SETTLED = (np.uint64, np.int64, np.int64, np.int64)
_OCCURRED = (np.uint64, np.int64, np.int64, np.int64, np.int64)


def _dealt(code: np.ndarray, n_buckets: int):
    """(bucket, places) of the codes by bucket."""
    bucket = (code % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))[: len(order)]
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _send_settled(n_buckets: int):
    """(bucket, 0, packed codes, shapes and owners) of settled parts."""

    def run(batches):
        for batch in batches:
            key, shape, *owners = (batch.column(c).to_numpy() for c in ("key", "shape", *_OWNERS))
            code, owners = _part_codes(key, shape), np.stack(owners, 1)
            for bucket, own in _dealt(code, n_buckets):
                blob, size = _pack((code[own], key[own], shape[own], owners[own].ravel()), _SETTLED)
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([0], pa.int32()), pa.array([blob], pa.binary()), pa.array([size], pa.int64())], ["bucket", "kind", "blob", "size"])

    return run


def _look_up(filters, hot, n_buckets: int):
    """Spans by the hot parts, and packed occurrences (kind 1) of the other parts that the bitmap of settled parts lets by."""
    columns = ["of", "of_print", "spans", "bucket", "kind", "blob", "size"]
    none = pa.nulls

    def pack(held):
        code, key, shape, doc, prints, start = (np.concatenate([h[i] for h in held]) for i in range(6))
        for bucket, own in _dealt(code, n_buckets):
            blob, size = _pack((key[own].view(np.uint64), shape[own], doc[own], prints[own], start[own]), _OCCURRED)
            yield pa.record_batch([none(1, pa.int64()), none(1, pa.int64()), none(1, pa.binary()), pa.array([bucket], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary()), pa.array([size], pa.int64())], columns)

    def run(batches):
        keys, shapes, owners, settled = hot.value
        codes = _part_codes(keys, shapes)
        order = np.argsort(codes)
        codes, keys, shapes, owners = codes[order], keys[order], shapes[order], owners[order]
        held, many = [], 0
        for batch in batches:
            docs, prints = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "print"))
            for row, key, shape, start, n in _common_parts(batch, filters.value):
                code = _part_codes(key, shape)
                which = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = (keys[which] == key) & (shapes[which] == shape) if len(codes) else np.zeros(len(code), bool)
                if hit.any():
                    o, p = spread(n[hit])
                    for out in _span_rows(o, p, owners[which[hit][o], p], docs[row[hit]], prints[row[hit]], start[hit]):
                        m = out.num_rows
                        yield pa.record_batch([*out.columns, none(m, pa.int32()), none(m, pa.int32()), none(m, pa.binary()), none(m, pa.int64())], columns)
                rest = ~hit & _among(settled, code)
                if rest.any():
                    held.append((code[rest], key[rest], shape[rest], docs[row[rest]], prints[row[rest]], start[rest]))
                    many += int(rest.sum())
            if many >= HOLD:
                yield from pack(held)
                held, many = [], 0
        if many:
            yield from pack(held)

    return run


def _spans_of_buckets(batches):
    """Spans of the occurrences of a bucket, whose settled parts (kind 0) come first."""
    now, parts, table = None, [], None
    for batch in batches:
        for bucket, kind, blob, size in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "blob", "size")), strict=True):
            if bucket != now:
                now, parts, table = bucket, [], None
            if kind == 0:
                parts.append(_unpack(blob, size, _SETTLED))
                continue
            if not parts:
                continue
            if table is None:
                code, key, shape, owners = (np.concatenate([p[i] for p in parts]) for i in range(4))
                order = np.argsort(code)
                table = code[order], key[order], shape[order], owners.reshape(-1, PART)[order]
            key, shape, doc, prints, start = _unpack(blob, size, _OCCURRED)
            key = key.view(np.int64)
            which = np.minimum(np.searchsorted(table[0], _part_codes(key, shape)), len(table[0]) - 1)
            hit = np.flatnonzero((table[1][which] == key) & (table[2][which] == shape))
            if len(hit):
                o, p = spread(shape[hit] >> 48 & 15)
                yield from _span_rows(o, p, table[3][which[hit]][o, p], doc[hit], prints[hit], start[hit])


def _common_spans(texts: DataFrame, filters, n_common: int) -> DataFrame:
    """of, of_print, spans by the strings of common keys."""
    n_parts = max(LEAST_BUCKETS, -(-n_common // BUCKET_KEYS))
    parts = texts.mapInArrow(tidy(_send_parts(filters, n_parts)), "bucket int, blob binary, size long")
    settled = parts.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_settle_parts), "key long, shape long, times long, " + ", ".join(f"{c} long" for c in _OWNERS))
    settled = cut(settled)
    n, total = (x or 0 for x in settled.agg(F.count("key"), F.sum("times")).first())
    codes = settled.select("key", "shape").mapInArrow(tidy(_send_codes), "bucket int, codes binary")
    codes = codes.repartition(1 << CODE_BITS, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_join_codes), "bucket int, codes binary")
    hot = settled.where(F.col("times") * HOT >= total).toArrow()  # HOT rows at most
    key, shape, *owners = (hot.column(c).to_numpy() for c in ("key", "shape", *_OWNERS))
    hot_table = texts.sparkSession.sparkContext.broadcast((key, shape, np.stack(owners, 1), _bitmap(codes, "codes", n, CODE_BITS)))
    n_buckets, packed = max(LEAST_BUCKETS, -(-n // BUCKET_KEYS)), "bucket int, kind int, blob binary, size long"
    found = cut(texts.mapInArrow(tidy(_look_up(filters, hot_table, n_buckets)), f"of long, of_print long, spans binary, {packed}"))
    others = settled.where(F.col("times") * HOT < total).mapInArrow(tidy(_send_settled(n_buckets)), packed)
    others = others.unionByName(found.where("spans is null").select("bucket", "kind", "blob", "size"))
    others = others.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(tidy(_spans_of_buckets), "of long, of_print long, spans binary")
    return found.where("spans is not null").select("of", "of_print", "spans").unionByName(others)


def merge_spans(parts: list[bytes]) -> list[tuple[int, int]]:
    """Union of the spans, in order."""
    every = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)
    if not len(every):
        return []
    every = every[np.argsort(every[:, 0], kind="stable")]
    reach = np.maximum.accumulate(every[:, 1])
    new = np.flatnonzero(np.append(True, every[1:, 0] > reach[:-1]))
    return list(zip(every[new, 0].tolist(), reach[np.append(new[1:], len(every)) - 1].tolist(), strict=True))


def _print(docs: DataFrame) -> Column:
    """What tells texts of one doc_id apart: a hash of the text, or 0 where no doc_id stands twice and none is needed."""
    alone = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    return F.lit(0).cast("long") if alone else F.xxhash64("text")


def find_repeats(docs: DataFrame, common_docs: int = COMMON_DOCS, print_: Column | None = None) -> DataFrame:
    """of, of_print, parts (array of packed spans) for each different (doc_id, text) that loses bytes."""
    spark = docs.sparkSession
    texts = small_batches(docs).where("doc_id is not null and octet_length(text) >= " + str(LENGTH)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", (_print(docs) if print_ is None else print_).alias("print"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count_bits = min(max((size // COUNT_BYTES).bit_length(), 6), 20)
    keys = texts.select("doc_id", "text").mapInArrow(tidy(_send_keys(count_bits)), "bucket int, n_once int, once binary, more binary, many binary")
    keys = cut(keys.repartition(1 << count_bits, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_count_keys(common_docs)), "bucket int, n_shared long, n_common long, shared binary, common binary"))
    n, n_common = (x or 0 for x in keys.agg(F.sum("n_shared"), F.sum("n_common")).first())
    filters = spark.sparkContext.broadcast((_bitmap(keys, "shared", n, count_bits), _bitmap(keys, "common", n_common, count_bits)))
    n_buckets = max(LEAST_BUCKETS, -(-n // BUCKET_KEYS))
    sent = texts.mapInArrow(tidy(_send_contexts(filters, n_buckets)), "bucket int, blob binary, size long")
    spans = sent.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_find_spans), "of long, of_print long, spans binary")
    if n_common:
        spans = spans.unionByName(_common_spans(texts, filters, n_common))
    return spans.groupBy("of", "of_print").agg(F.collect_list("spans").alias("parts"))


def _with_parts(docs: DataFrame, common_docs: int) -> DataFrame:
    print_ = _print(docs)
    found = find_repeats(docs, common_docs, print_)
    return docs.join(found, (F.col("doc_id") == F.col("of")) & (print_ == F.col("of_print")), "left").drop("of", "of_print")


def _cut_bytes(raw: bytes, spans) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def dedup_digests(docs: DataFrame, common_docs: int = COMMON_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs(doc_id, text).

    A null text is empty.  A row with a null doc_id has no rank: it loses nothing and takes nothing.
    Rows with the same doc_id take nothing from each other.  An empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            data, offsets = rows(batch.column("text"))
            raw, out = data.tobytes(), []
            for a, b, parts in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("parts").to_pylist(), strict=True):
                spans = merge_spans(parts or [])
                out.append((b - a, sum(y - x for x, y in spans), len(spans), hashlib.sha256(_cut_bytes(raw[a:b], spans)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), common_docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, common_docs: int = COMMON_DOCS) -> DataFrame:
    """docs with the repeated bytes cut out of `text`; a character that is cut through goes whole."""
    columns = docs.columns

    def run(batches):
        for batch in batches:
            out = []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                out.append(text if text is None or not parts else _cut_bytes(text.encode(), merge_spans(parts)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in columns], names=columns)

    return _with_parts(docs, common_docs).select(*columns, "parts").mapInArrow(tidy(run), docs.schema)
