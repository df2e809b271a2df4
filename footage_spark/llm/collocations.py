"""Phrase collocations: phrases of 2 to 4 words that come more often together than their parts do apart.

Two passes over the texts.  The first gives every n-gram a 64-bit hash; its first bits name a partition and
its last 32 bits stand for it there.  Each partition keeps a Misra-Gries summary of more counters than its
mass divided by the threshold, so what is subtracted stays under the threshold and every n-gram
that is frequent keeps a counter; summaries merge, so blocks of keys are merged into it as they come, in
any order.  A hash that two n-grams share only lets a needless one through.  The survivors become a
bitmap of at most FILTER_BITS, each partition its own slice.  The second pass counts what passes the
bitmap exactly; an n-gram passes only if its shorter parts do.  Repeated n-grams are summed up before any
shuffle, so one phrase may hold any share of the corpus; what is shuffled are blocks of phrases by hash
partition.  Phrases are told apart by 64-bit hashes there (a billion of them: a chance of 3 % that two are one).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import LOWER, cut, join_hot, mix, prefix_sums, rows, small_batches, span_hash, tidy

LEAST, MOST_WORDS, TOP, DOMINANCE, SCALE = 30, 4, 2000, 80, 2_000_000
#: Expected n-grams of a hash partition, and the largest bitmap (64 MB).
PARTITION_MASS, FILTER_BITS = 1 << 23, 1 << 29
#: N-gram keys that a task sorts at a time in the first pass; bytes of text that it counts at a time in the second.
HOLD_KEYS, HOLD_BYTES, CHUNK = 1 << 22, 6 << 20, 1 << 20
#: What divides pieces, and words within them.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_STEP = np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64(0xFFFFFFFF)


def _cuts(data: np.ndarray, offsets: np.ndarray, limit: int):
    """(start, end of own n-grams, end of the bytes to look at, first row): ranges of about `limit` bytes.

    A range ends at the end of a row or piece, or, in a long piece, before a word; then the three words
    after it are looked at too.
    """
    at, n = 0, len(data)
    while at < n:
        end = min(at + limit, n)
        seen = end
        if end < n and not (row_end := offsets[np.searchsorted(offsets, end, "right") - 1]) > at:
            back = np.flatnonzero(KIND[data[at:end]] == 2)
            end = seen = at + int(back[-1]) + 1 if len(back) else end
            if not len(back):
                stop = int(offsets[np.searchsorted(offsets, end, "left")])
                end, seen = _in_piece(data, end, stop)
        elif end < n:
            end = seen = int(row_end)
        yield at, end, seen
        at = end


def _in_piece(data: np.ndarray, at: int, stop: int) -> tuple[int, int]:
    """From place `at` in a long piece: the end of the word there, and of the next three words (or the piece)."""
    ends, here, inside = [], at, True
    while here < stop and len(ends) < MOST_WORDS:
        kinds = KIND[data[here : min(here + 4096, stop)]]
        for k in np.flatnonzero(np.diff(np.concatenate([[0 if inside else 1], kinds])) != 0):
            if kinds[k] == 2 or kinds[k] == 1:
                ends += [here + int(k)] if inside else []
                inside = False
                if kinds[k] == 2:
                    return (ends[0], here + int(k)) if ends else (here + int(k), here + int(k))
            else:
                inside = True
            if len(ends) == MOST_WORDS:
                break
        here += len(kinds)
    if len(ends) < MOST_WORDS:
        ends += [stop] * (MOST_WORDS - len(ends))
    return ends[0], ends[-1]


class Grams:
    """N-grams of a range of rows' bytes: hashes g[n] by first word, ok[n] where one begins, words' places."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, at: int, end: int, seen: int):
        part = LOWER[data[at:seen]]
        kinds = KIND[part]
        inside = kinds == 0
        edges = offsets[(offsets > at) & (offsets < seen)] - at
        first, last = inside.copy(), inside.copy()
        edge = np.zeros(len(part) + 1, bool)
        edge[edges] = True
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.part, self.inside = part, inside
        self.row = np.searchsorted(offsets, self.starts + at, "right") - 1
        splits = np.cumsum(kinds == 2)
        piece = splits[self.starts] if len(part) else self.starts
        together = (piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1])
        word = span_hash(prefix_sums(part), self.starts, self.ends)
        own = self.starts + at < end
        self.words = int(own.sum())
        self.g, self.ok = [mix(word ^ codes[self.row])], [own]
        for n in range(1, MOST_WORDS):
            m = max(len(word) - n, 0)
            self.g.append(mix(self.g[-1][:m] * _STEP + word[n : n + m]))
            self.ok.append(self.ok[-1][:m] & together[n - 1 : n - 1 + m])

    def normal(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words with one blank after each, and their starts and ends there."""
        keep = self.inside.copy()
        keep[1:] |= self.inside[:-1]
        place = np.cumsum(keep) - 1
        out = np.where(self.inside, self.part, 32)[keep]
        return out, place[self.starts], place[self.ends - 1] + 1


def _codes(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode(), 7) for x in langs], np.uint64)


def _grams(batch, limit: int = CHUNK):
    """(Grams, languages by row) of the texts of a batch(lang, text)."""
    data, offsets = rows(batch.column("text"))
    langs = ["und" if x is None else x for x in batch.column("lang").to_pylist()]
    known = list(dict.fromkeys(langs))
    number = {x: i for i, x in enumerate(known)}
    index = np.array([number[x] for x in langs], np.int32)
    codes = _codes(known)[index] if known else np.zeros(0, np.uint64)
    for at, end, seen in _cuts(data, offsets, limit):
        yield Grams(data, offsets, codes, at, end, seen), known, index


def places(key: np.ndarray, bits: int) -> np.ndarray:
    """The partition (first `bits` bits) and the last 32 bits of hashes, as one number."""
    first = (key >> np.uint64(32)) >> np.uint64(32 - bits)
    return (first << np.uint64(32)) | (key & _LOW)


def pack(keys: np.ndarray) -> bytes:
    """Sorted different 32-bit keys: halves apart where that is smaller, the upper ones as a bit vector."""
    if len(keys) < 8192:
        return b"\0" + keys.astype("<u4").tobytes()
    upper = np.zeros(len(keys) + 65536, np.uint8)
    upper[(keys >> 16) + np.arange(len(keys))] = 1
    return b"\1" + np.packbits(upper).tobytes() + (keys & 0xFFFF).astype("<u2").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if raw[0] == 0:
        return np.frombuffer(raw, "<u4", offset=1).astype(np.int64)
    n = (8 * (len(raw) - 1) - 65536) // 17  # 17 bits a key and 65536, in whole bytes
    head = (n + 65536 + 7) // 8
    n = (len(raw) - 1 - head) // 2
    upper = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, head, 1))) - np.arange(n)
    return (upper << 16) | np.frombuffer(raw, "<u2", n, 1 + head)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with their counts added up (each of up to 2**32 - 1 before)."""
    both = np.sort((keys.astype(np.uint64) << np.uint64(32)) | np.minimum(counts, 0xFFFFFFFF).astype(np.uint64))
    keys = (both >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat((both & _LOW).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


class Summary:
    """A Misra-Gries summary of `capacity` counters over integer keys; keys of `least` or more survive.

    When there are more counters than that, the next largest count is taken off all of them.  With a
    capacity over mass / least all that is ever taken off stays under least; were it to reach that, as the mass was
    more than stated, no more is taken off and the counters grow: a key of `least` is never lost.
    """

    def __init__(self, capacity: int, least: int, buffer: int = 1 << 19):
        self.capacity, self.least, self.buffer = capacity, least, max(buffer, capacity)
        self.keys, self.counts, self.taken, self.mass = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Take in exact counts of different keys."""
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        self.mass += int(counts.sum())
        if self.n_waiting >= self.buffer:
            self.settle()

    def merge(self, other: Summary) -> None:
        """Take in another summary of the same capacity: what either took off counts, and together stays under their mass / capacity."""
        other.settle()
        self.mass += other.mass - int(other.counts.sum())
        self.taken += other.taken
        self.add(other.keys, other.counts)

    def settle(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        self.keys, self.counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        self.waiting, self.n_waiting = [], 0
        if len(self.keys) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            off = min(int(np.partition(self.counts, at)[at]), self.least - 1 - self.taken)
            if off > 0:
                keep = self.counts > off
                self.keys, self.counts, self.taken = self.keys[keep], self.counts[keep] - off, self.taken + off

    def survivors(self) -> np.ndarray:
        """Keys that may have a count of least or more: the counter and all that was taken off reach it."""
        self.settle()
        return self.keys[self.counts + self.taken >= self.least]


def key_blocks(docs: DataFrame, bits: int) -> DataFrame:
    """bucket, ones, many, counts: packed keys of n-grams, those that a task saw once and those with counts."""

    def blocks(held):
        both = np.concatenate(held)
        held.clear()
        both.sort()
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        keys, counts = both[first], np.diff(first, append=len(both))
        del both, first
        edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32)).tolist() + [len(keys)]
        for bucket, (a, b) in enumerate(itertools.pairwise(edges)):
            if a < b:
                low, more = (keys[a:b] & _LOW).astype(np.int64), counts[a:b] > 1
                yield bucket, pack(low[~more]), pack(low[more]), np.minimum(counts[a:b][more], 0xFFFFFFFF).astype("<u4").tobytes()

    def table(held):
        made = list(zip(*blocks(held), strict=True))
        return pa.record_batch([pa.array(made[0], pa.int32()), *(pa.array(x, pa.binary()) for x in made[1:])], ["bucket", "ones", "many", "counts"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for grams, _, _ in _grams(batch):
                for g, ok in zip(grams.g, grams.ok, strict=True):
                    held.append(places(g[ok], bits))
                    n += len(held[-1])
                if n >= HOLD_KEYS:
                    yield table(held)
                    n = 0
        if n:
            yield table(held)

    return docs.mapInArrow(tidy(run), "bucket int, ones binary, many binary, counts binary")


def summaries(blocks: DataFrame, capacity: int, least: int, partitions: int) -> DataFrame:
    """bucket, keys (packed), n, taken: what survives of each hash partition."""

    def run(batches):
        held: dict[int, Summary] = {}
        for batch in batches:
            for bucket, ones, many, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ones", "many", "counts")), strict=True):
                one = held.setdefault(bucket, Summary(capacity, least))
                keys = unpack(ones)
                one.add(keys, np.ones(len(keys), np.int64))
                one.add(unpack(many), np.frombuffer(counts, "<u4").astype(np.int64))
        for bucket in list(held):
            one = held.pop(bucket)
            keys = one.survivors()
            if len(keys):
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([pack(keys)], pa.binary()), pa.array([len(keys)]), pa.array([one.taken])], ["bucket", "keys", "n", "taken"])

    return blocks.repartition(partitions, "bucket").mapInArrow(tidy(run), "bucket int, keys binary, n long, taken long")


def bitmap(found: DataFrame, bits: int, size: int) -> np.ndarray:
    """The survivors as a bitmap of 2**size bits; each hash partition gives its own slice, the driver lays them side by side."""
    part = size - bits

    def run(batches):
        for batch in batches:
            for bucket, keys in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                here = np.zeros(1 << part, np.uint8)
                here[unpack(keys) >> (32 - part)] = 1
                yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([np.packbits(here, bitorder="little").tobytes()], pa.binary())], ["bucket", "slice"])

    out = np.zeros(1 << (size - 3), np.uint8)
    for r in found.mapInArrow(tidy(run), "bucket int, slice binary").toLocalIterator():
        at = r["bucket"] << (part - 3)
        out[at : at + (1 << (part - 3))] = np.frombuffer(r["slice"], np.uint8)
    return out


def gathered(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces of text end to end; places of a few pieces at a time are held."""
    ends = np.cumsum(length, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for a in range(0, len(start), 1 << 15):
        some, to = slice(a, a + (1 << 15)), int(ends[a]) - int(length[a])
        n = int(ends[min(a + (1 << 15), len(ends)) - 1]) - to
        at = np.repeat(start[some] - (ends[some] - length[some] - to), length[some])
        at += np.arange(n)
        out[to : to + n] = text[at]
    return out


class Phrases:
    """Different phrases with their counts, in order of their hashes: columns side by side, texts end to end."""

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.key, self.count, self.lang, self.k, self.length, self.text = none.astype(np.uint64), none, none.astype(np.int32), none.astype(np.int8), none.astype(np.int32), np.zeros(0, np.uint8)
        self.waiting, self.n_waiting = [], 0

    def add(self, key, count, lang, k, start, length, text) -> None:
        """Take in phrases that stand in text at start, repeated ones too; counts of equal hashes are added up."""
        own = np.cumsum(self.length) - self.length
        key, count, lang, k, length = (np.concatenate([x, y]) for x, y in ((self.key, key), (self.count, count), (self.lang, lang), (self.k, k), (self.length, length)))
        start = np.concatenate([own, start + len(self.text)])
        text = np.concatenate([self.text, text])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        one = order[first]
        self.key, self.count = key[first], np.add.reduceat(count[order], first) if len(first) else count
        self.lang, self.k, self.length = lang[one], k[one], length[one]
        self.text = gathered(text, start[one], self.length)

    def blocks(self, bits: int, langs: list[str]):
        """Rows of BLOCKS, one for each hash partition."""
        if not len(self.key):
            return
        bucket = (places(self.key, bits) >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        at = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            used, lang = np.unique(self.lang[a:b], return_inverse=True)
            parts = (self.count[a:b].astype("<i8"), lang.astype("<i4"), self.k[a:b], self.length[a:b].astype("<i4"), self.text[at[a] : at[b]])
            raw = b"".join(x.tobytes() for x in parts)
            yield {"bucket": int(bucket[a]), "n": int(b - a), "langs": [langs[i] for i in used], "size": len(raw), "body": pa.compress(raw, "zstd", asbytes=True)}

    def add_block(self, n: int, size: int, body: bytes, langs: list[str], number: dict[str, int]) -> None:
        raw = pa.decompress(body, size, "zstd", asbytes=True)
        count, lang = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i4", n, 8 * n)
        k, length, text = np.frombuffer(raw, np.int8, n, 12 * n), np.frombuffer(raw, "<i4", n, 13 * n), np.frombuffer(raw, np.uint8, -1, 17 * n)
        mine = np.array([number.setdefault(x, len(number)) for x in langs], np.int32)
        ends = np.cumsum(length, dtype=np.int64)
        key = mix(span_hash(prefix_sums(text), ends - length, ends) ^ _codes(langs)[lang])
        self.waiting.append((key, count, mine[lang], k, ends - length, length, text))
        self.n_waiting += n
        if self.n_waiting >= max(len(self.key), 1 << 18):  # so each phrase is merged a few times only
            self.settle()

    def settle(self) -> None:
        """Merge the blocks that wait."""
        if self.waiting:
            sizes = np.cumsum([0, *(len(x[-1]) for x in self.waiting)])
            parts = [(*x[:4], x[4] + s, *x[5:]) for x, s in zip(self.waiting, sizes, strict=False)]
            self.waiting, self.n_waiting = [], 0
            self.add(*(np.concatenate(x) for x in zip(*parts, strict=True)))


BLOCKS = "bucket int, n long, langs array<string>, size long, body binary"
#: Different phrases that a task holds before it passes them on.
HOLD_PHRASES = 1 << 20


def phrase_blocks(docs: DataFrame, found: np.ndarray, bits: int, size: int) -> DataFrame:
    """BLOCKS of the n-grams that pass the bitmap, summed up by each task; a phrase without words has a language's number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(found.tobytes())
    shift = np.uint64(bits + 32 - size)
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("langs", pa.list_(pa.string())), ("size", pa.int64()), ("body", pa.binary())])

    def passing(grams, have):
        """Where n-grams begin that may be frequent: they pass and so do the two that are a word shorter."""
        before = None
        for g, ok in zip(grams.g, grams.ok, strict=True):
            at = places(g, bits) >> shift
            hit = (have[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            whole = hit if before is None else hit & before[: len(hit)] & before[1 : len(hit) + 1]
            # words after a range's end have only their place in the longer ones, so `own` is asked for last
            yield whole & ok
            before = whole

    def merge(phrases, held):
        sizes = np.cumsum([0, *(len(h[0]) for h in held)])
        held[:] = [(h[0], h[1], h[2] + s, *h[3:]) for h, s in zip(held, sizes, strict=False)]
        text, key, start, length, k, lang = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        phrases.add(key, np.ones(len(key), np.int64), lang, k, start, length, text)

    def run(batches):
        have = np.frombuffer(shared.value, np.uint8)
        phrases, held, size_held, number, words = Phrases(), [], 0, {}, {}
        for batch in batches:
            for grams, langs, index in _grams(batch):
                mine = np.array([number.setdefault(x, len(number)) for x in langs], np.int32)[index]
                if not len(grams.starts):
                    continue
                for i, c in enumerate(np.bincount(mine[grams.row[grams.ok[0]]]).tolist()):
                    words[i] = words.get(i, 0) + c
                text, starts, ends = grams.normal()
                parts = []
                for n, hit in enumerate(passing(grams, have)):
                    at = np.flatnonzero(hit)
                    parts.append((grams.g[n][at], starts[at].astype(np.int32), (ends[at + n] - starts[at]).astype(np.int32), np.full(len(at), n + 1, np.int8), mine[grams.row[at]]))
                held.append((text, *(np.concatenate(x) for x in zip(*parts, strict=True))))
                size_held += len(text)
                if size_held >= HOLD_BYTES:
                    merge(phrases, held)
                    size_held = 0
                    if len(phrases.key) >= HOLD_PHRASES:
                        yield from tables(phrases, number)
                        phrases = Phrases()
        if held:
            merge(phrases, held)
        yield from tables(phrases, number)
        total = Phrases()
        names, zero = list(number), np.zeros(len(words), np.int32)
        total.add(_codes([names[i] for i in words]), np.array(list(words.values()), np.int64), np.array(list(words), np.int32), zero.astype(np.int8), zero, zero, np.zeros(0, np.uint8))
        yield from tables(total, number)

    def tables(phrases, number):
        for row in phrases.blocks(bits, list(number)):
            yield pa.RecordBatch.from_pylist([row], schema)

    return docs.mapInArrow(tidy(run), BLOCKS)


def summed_phrases(blocks: DataFrame, least: int, partitions: int) -> DataFrame:
    """lang, phrase, k, c of phrases of `least` or more; phrase null: all words of the language."""

    def run(batches):
        held: dict[int, Phrases] = {}
        number: dict[str, int] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["bucket"], Phrases()).add_block(r["n"], r["size"], r["body"], r["langs"], number)
        names = pa.array(list(number), pa.string())
        for bucket in list(held):
            got = held.pop(bucket)
            got.settle()
            ends = np.cumsum(got.length, dtype=np.int64)
            kept = np.flatnonzero((got.count >= least) | (got.k == 0))
            for a in range(0, len(kept), 1 << 16):
                some = kept[a : a + (1 << 16)]
                to = np.concatenate([[0], np.cumsum(got.length[some], dtype=np.int64)])
                text = gathered(got.text, ends[some] - got.length[some], got.length[some])
                phrase = pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(to), pa.py_buffer(text)]).cast(pa.string())
                phrase = pc.if_else(pa.array(got.k[some] == 0), pa.scalar(None, pa.string()), phrase)
                yield pa.record_batch([names.take(pa.array(got.lang[some])), phrase, pa.array(got.k[some].astype(np.int32)), pa.array(got.count[some])], ["lang", "phrase", "k", "c"])

    return blocks.repartition(partitions, "bucket").mapInArrow(tidy(run), "lang string, phrase string, k int, c long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, partition_mass: int = PARTITION_MASS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, k, c of all phrases of 1 to 4 words with c >= least occurrences in their language, exact; and
    for each language a row with a null phrase: all its words.  Kept in the shared folder."""
    docs = small_batches(docs.select("lang", "text"))
    mass = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    # a word is a byte and a blank at least; six bytes a word are usual
    most, usual = MOST_WORDS * (mass[0] + mass[1]) // 2 + 1, MOST_WORDS * mass[0] // 6 + 1
    bits = min(max((usual - 1) // partition_mass, 0).bit_length(), 16)
    capacity = most // (least << bits) + 1
    found = cut(summaries(key_blocks(docs, bits), capacity, least, 1 << bits))
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = min(max((256 * n).bit_length(), bits + 13), filter_bits.bit_length() - 1, bits + 32)
    size = max(size, bits + 3)  # a slice is a byte at least
    return cut(summed_phrases(phrase_blocks(docs, bitmap(found, bits, size), bits, size), least, 1 << bits))


def _parts(phrase: str, k: int) -> tuple[Column, Column]:
    """The first k words, and the others."""
    return F.substring_index(phrase, " ", k), F.expr(f"substring({phrase}, char_length(substring_index({phrase}, ' ', {k})) + 2)")


def score_phrases(counts: DataFrame, scale: int = SCALE, but: DataFrame | None = None) -> DataFrame:
    """Of all phrases but those of `but`: lang, phrase, k, a, l, r, score of phrases of 2 words or more: the cut of the lowest score, the shortest first part on ties."""
    known = counts.where("phrase is not null").select("lang", F.col("phrase").alias("part"), F.col("c").alias("f"))
    long = counts.where("k >= 2") if but is None else counts.where("k >= 2").join(but, ["lang", "phrase"], "left_anti")
    asked = []
    for k in range(1, MOST_WORDS):
        l, r = _parts("phrase", k)
        asked += [F.when(F.col("k") > k, F.struct(F.lit(k).alias("cut"), F.lit(side).alias("side"), part.alias("part"))) for side, part in ((0, l), (1, r))]
    wants = cut(long.select("lang", "phrase", "k", F.col("c").alias("a"), F.explode(F.array_compact(F.array(*asked))).alias("x")).select("lang", "phrase", "k", "a", "x.*"))
    got = join_hot(wants, known, ["lang", "part"])
    at = lambda cut_, side: F.max(F.when((F.col("cut") == cut_) & (F.col("side") == side), F.col("f")))
    wide = got.groupBy("lang", "phrase", "k", "a").agg(*(at(k, s).alias(f"f{k}{s}") for k in range(1, MOST_WORDS) for s in (0, 1)))
    # 38 digits hold the product; the quotient is at most scale / 2
    cuts = [F.when(F.col("k") > k, F.struct(F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(19,0))) div (cast(f{k}0 as decimal(19,0)) + cast(f{k}1 as decimal(19,0)))").alias("score"), F.lit(k).alias("cut"), F.col(f"f{k}0").alias("l"), F.col(f"f{k}1").alias("r"))) for k in range(1, MOST_WORDS)]
    return wide.select("lang", "phrase", "k", "a", F.array_min(F.array_compact(F.array(*cuts))).alias("x")).select("lang", "phrase", "k", "a", "x.l", "x.r", "x.score")


def dominated(counts: DataFrame, percent: int = DOMINANCE) -> DataFrame:
    """lang, phrase of those that stand in a longer phrase with percent of their occurrences or more."""
    inner = []
    word = F.split("phrase", " ")
    for n in range(2, MOST_WORDS):
        for at in range(MOST_WORDS - n + 1):
            inner.append(F.when((F.col("k") > n) & (F.col("k") >= at + n), F.array_join(F.slice(word, at + 1, n), " ")))
    longer = counts.where("k > 2").select("lang", F.explode(F.array_compact(F.array(*inner))).alias("phrase"), F.col("c").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    return counts.where("k >= 2").join(longer, ["lang", "phrase"]).where(F.lit(100) * F.col("f") >= F.lit(percent) * F.col("c")).select("lang", "phrase")


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, percent: int = DOMINANCE, partition_mass: int = PARTITION_MASS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score.

    A null text is empty, a null lang is `und`; repeated rows count as often as they stand there, other columns are
    not looked at, an empty table (or one without frequent phrases) gives no rows.  Texts of any length are taken in ranges.
    """
    counts = frequent_phrases(docs, least, partition_mass, filter_bits)
    kept = score_phrases(counts, but=dominated(counts, percent))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language is cut to `top` in parts first, so that no task sorts all its phrases
    parts = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = parts.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top).drop("place", "part")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("phrase is null").select("lang", F.col("c").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
