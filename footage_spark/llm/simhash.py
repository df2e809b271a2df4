"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within RADIUS bits share a variant within RADIUS / 2 bits of both, and two
fingerprints that share such a variant are within RADIUS bits.  Every different fingerprint has all
2,081 variants within 2 bits made for it, the variants are brought together by value, and those of
one value are linked to the smallest fingerprint there (a star, never all pairs).

The variants are shuffled by their first bits, their cell.  A fingerprint has variants in only a few
cells (with 7 bits in 29 of 128, with 20 in 211 of a million), so it is sent once to each of them
and the variants of a cell are made where the cell is.  The cells are made narrow enough for the
number of fingerprints that a task holds about CELL_ROWS of them however large the corpus is.  Links
of a cell become a spanning forest there, and the forests become components by large-star /
small-star joins.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import cut, small_batches, tidy

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Links that a task of a step of components reads, about.
PART_EDGES = 1 << 14
#: Least bits of a cell, and about the most fingerprints that are sent to one.
CELL_BITS, CELL_ROWS = 7, 1 << 20
#: Variants that a task holds at a time, about.
PART_VARIANTS = 1 << 21
_U = np.uint64


def fingerprint_of(words: list[bytes], size: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one word list; a bit is 1 if set in over half of the shingles' hashes."""
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), _U, n)
    ones = np.zeros(64, np.int64)
    for first in range(0, n, 4096):
        bits = np.unpackbits(hashes[first : first + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of every row of ready hashes (counts of them a row): a bit is 1 if set in over half; zero without any."""
    ones, owner = np.zeros((len(counts), 64), np.int64), np.repeat(np.arange(len(counts)), counts)
    for first in range(0, len(hashes), 1 << 15):
        own = owner[first : first + (1 << 15)]
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        bits = np.unpackbits(hashes[first : first + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[own[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > counts[:, None], axis=1).view(">u8").ravel().astype(_U)


def _fingerprints(batches):
    for batch in batches:
        out = []
        for text in batch.column("text").cast(pa.large_binary()):
            value = fingerprint_of((text.as_py() or b"").lower().split())
            out.append(value - (1 << 64) if value >> 63 else value)
        yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_fingerprints), "doc_id long, fp long")


@lru_cache(256)
def _flips(bits: int, most: int) -> np.ndarray:
    """All masks of up to `most` ones among the lowest `bits` bits."""
    return np.array([sum(1 << b for b in at) for k in range(most + 1) for at in combinations(range(bits), k)], _U)


def cell_bits(n: int, half: int, least: int = CELL_BITS, most_rows: int = CELL_ROWS) -> int:
    """Bits of a cell by which n fingerprints give about most_rows to each."""
    share = lambda b: sum(comb(b, k) for k in range(half + 1)) / 2**b
    return next(b for b in range(least, 33) if n * share(b) <= most_rows or b == 32)


def _send(bits: int, half: int):
    """(cell, fingerprints) of a batch, for each cell in which they have variants."""
    flips = _flips(bits, half).astype(np.int64)

    def send(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(_U)
            for first in range(0, len(fps), 1 << 14):
                own = fps[first : first + (1 << 14)]
                cell = ((own >> _U(64 - bits)).astype(np.int64)[:, None] ^ flips[None, :]).ravel()
                order = np.argsort(cell, kind="stable")
                cell, sent = cell[order], own[order // len(flips)]
                at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                ends = np.append(at[1:], len(cell))
                yield pa.record_batch([pa.array(cell[at]), pa.array([sent[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary())], ["cell", "fps"])

    return send


def _links_of_cells(bits: int, radius: int):
    def links(batches):
        """All rows of a few whole cells -> the links of each, as a spanning forest."""
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for cell, block in zip(batch.column("cell").to_pylist(), batch.column("fps").to_pylist(), strict=True):
                held.setdefault(cell, []).append(block)
        while held:
            cell, blocks = held.popitem()
            fps = np.unique(np.frombuffer(b"".join(blocks), _U))
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *_links_of_part(fps, np.arange(len(fps)), cell, bits, radius)])
            if not len(pairs):
                continue
            root = forest(len(fps), pairs)
            member = np.flatnonzero(root != np.arange(len(fps)))
            yield pa.record_batch([pa.array(fps[member].view(np.int64)), pa.array(fps[root[member]].view(np.int64))], ["a", "b"])

    return links


def _links_of_part(fps, at, prefix: int, bits: int, radius: int):
    """Star links (places in fps) by the variants that begin with the bits of prefix; at: the places that have any."""
    half, low = (radius + 1) // 2, 64 - bits
    far = np.bitwise_count((fps[at] >> _U(low)) ^ _U(prefix)).astype(np.int64)
    at, far = at[far <= half], far[far <= half]
    many = np.bincount(far, minlength=half + 1)
    if not len(at) or not low:
        return
    if sum(int(many[d]) * sum(comb(low, k) for k in range(half - d + 1)) for d in range(half + 1)) > PART_VARIANTS:
        for bit in (0, 1):
            yield from _links_of_part(fps, at, prefix << 1 | bit, bits + 1, radius)
        return
    variants, owners = [], []
    for d in range(half + 1):
        own = at[far == d]
        flips = _flips(low, half - d)
        base = fps[own] & _U((1 << low) - 1)  # the first bits of all variants here are those of prefix
        variants.append((base[:, None] ^ flips[None, :]).ravel())
        owners.append(np.repeat(own, len(flips)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    by = np.argsort(v)
    v, o = v[by], o[by]
    firsts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    if len(firsts) == len(v):
        return
    lead = np.repeat(np.minimum.reduceat(o, firsts), np.diff(np.append(firsts, len(o))))
    linked = lead != o
    pairs = np.unique(np.stack([lead[linked], o[linked]], 1), axis=0)
    yield pairs[np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= radius]  # the verification


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
        pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
    return root


def components(links: DataFrame) -> DataFrame:
    """member, root (smallest of its component) for every node of links(a, b) but the roots themselves.

    Alternating large-star and small-star steps: each is one aggregate and one equi-join on the
    node, and no node ever gathers its neighbours as a list.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last, many = None, edges.count()
    while True:
        # every task of a shuffle leaves files of its own, however little it sends
        edges = edges.coalesce(max(1, many // PART_EDGES))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        again = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = cut(again.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            return edges.select(F.col("u").alias("member"), F.col("v").alias("root"))
        last, many = state, state[0]


def ball_links(nodes: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) by which the different fingerprints of nodes(fp) within radius bits are connected; read twice: cut it before."""
    half = (radius + 1) // 2
    bits = cell_bits(nodes.count(), half, most_rows=cell_rows)
    sent = nodes.select("fp").mapInArrow(tidy(_send(bits, half)), "cell long, fps binary")
    return sent.repartition(1 << min(bits, 15), "cell").mapInArrow(tidy(_links_of_cells(bits, radius)), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs(doc_id, text).

    A null or empty text has fingerprint zero and links like any other.  Rows with a null doc_id
    stay and link others, and take part in no component's name; a component of such rows alone has a
    null one.  Repeated rows share a component.  Other columns are left out.  An empty table gives an
    empty result.
    """
    prints = cut(fingerprints(docs))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = components(ball_links(nodes, radius, cell_rows))
    named = cut(nodes.join(member, nodes["fp"] == member["member"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    # kept by itself, so that the rows of one root with very many members can be dealt to several tasks
    lowest = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    names = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
