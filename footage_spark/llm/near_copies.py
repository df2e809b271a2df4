"""Near copies by SimHash, confirmed by exact Jaccard similarity of word shingles, with MinHash bands for what SimHash cannot reach.

A text is the set of its shingles (SHINGLE words, A-Z in lower case).  Rows of equal sets are one
node.  A node has a SimHash fingerprint of its set, and the ball hashing of simhash.py links the
fingerprints within RADIUS bits: those nodes are candidates.  Most pairs at similarity 0.8 to 0.95 are
further apart (10 bits on average at 0.8), so a node also has BANDS keys, each of ROWS minima of its hashed shingles, so two nodes at similarity
s share a key with a chance of 1 - (1 - s**ROWS)**BANDS: they are missed with a chance of 5e-6 at
0.8 and less above.  Nodes that share a key are candidates, and each candidate pair is confirmed by
the exact similarity of the two sets.  A key of more than SMALL nodes is first settled by stars and rings, and
then by every pair that the links so far leave in different groups: a large group of near copies
needs few pairs, and no pair of a key is left out that could join two groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .simhash import components
from .text import LOWER, chunks, cut, join_hot, mix, prefix_sums, rows, small_batches, span_hash, spread, tidy, word_spans

SHINGLE = 5
#: Least similarity, as a fraction of two whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 40, 6
#: Nodes of one key that are all compared with each other at once.
SMALL = 24
#: Nodes of a block of a larger key: two blocks meet in a task.
BLOCK = 4096
#: Bytes of text whose minima are made at a time.
MINIMA_BYTES = 1 << 18
_rng = np.random.Generator(np.random.PCG64(11))
_FACTORS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(0, 2**63, max(SHINGLE, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the different shingles of every row, sorted in a row; a shorter text is one shingle."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    data = LOWER[data]
    starts, ends, owner = word_spans(data, offsets)
    words = span_hash(prefix_sums(data), starts, ends)
    have = np.bincount(owner, minlength=n)
    row, place = spread(np.where(have > 0, np.maximum(have - size + 1, 1), 0))
    first = (np.cumsum(have) - have)[row] + place
    length = np.minimum(have, size)[row]
    out = length.astype(np.uint64)
    for k in range(size):
        inside = k < length
        out[inside] += mix(words[first[inside] + k]) * _PLACES[k]
    out = mix(out)
    by = np.lexsort((out, row))
    out, row = out[by], row[by]
    new = np.append(True, (out[1:] != out[:-1]) | (row[1:] != row[:-1]))[: len(out)]
    return out[new], np.bincount(row[new], minlength=n)


def _keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS keys of every row with shingles; counts has no zeros."""
    at = np.cumsum(counts) - counts
    out = np.zeros((len(counts), BANDS), np.uint64)
    for i, factor in enumerate(_FACTORS):
        out[:, i // ROWS] += mix(np.minimum.reduceat(hashes * factor, at)) * _PLACES[i % ROWS]
    return mix(out + np.arange(BANDS, dtype=np.uint64))


def _node_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit name of every row's set; zero without shingles."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        at = (np.cumsum(counts) - counts)[some]
        out[some] = mix(np.add.reduceat(mix(hashes ^ _PLACES[0]), at) + counts[some].astype(np.uint64))
    return out


def _describe(batches):
    for batch in batches:
        data, offsets = rows(batch.column("text"))
        for first, last in chunks(offsets, MINIMA_BYTES):
            hashes, counts = shingles(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            keys: list = [None] * len(counts)
            some = np.flatnonzero(counts)
            if len(some):
                for i, k in zip(some.tolist(), _keys(hashes, counts[some]), strict=True):
                    keys[i] = k.tobytes()
            columns = [batch.column("row")[first:last], batch.column("doc_id")[first:last], pa.array(_node_of(hashes, counts).view(np.int64)), pa.array(counts), pa.array(simhash.majority(hashes, counts).view(np.int64)), pa.array(keys, pa.binary())]
            yield pa.record_batch(columns, ["row", "doc_id", "node", "n", "fp", "keys"])


def _sets(batches):
    for batch in batches:
        data, offsets = rows(batch.column("text"))
        for first, last in chunks(offsets):
            hashes, counts = shingles(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.record_batch([pa.array(_node_of(hashes, counts).view(np.int64)), lists], ["node", "set"])


def _bands(batches):
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part = batch.slice(first, 1024)
            keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.int64)
            each = [pa.array(np.repeat(part.column(x).to_numpy(), BANDS)) for x in ("node", "n")]
            yield pa.record_batch([pa.array(keys), *each], ["key", "node", "n"])


def _like(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """If sets of these sizes can be similar enough."""
    return np.minimum(n, m) * LEAST[1] >= np.maximum(n, m) * LEAST[0]


def _candidates(small: int):
    def candidates(batches):
        """Rows of whole keys -> pairs (key null), and the rows of keys of over `small` nodes (b null)."""
        held = [np.stack([b.column(x).to_numpy() for x in ("key", "node", "n")]) for b in batches if b.num_rows]
        if not held:
            return
        key, node, n = np.concatenate(held, 1)
        by = np.lexsort((node, key))
        key, node, n = key[by], node[by], n[by]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(first, len(key)))
        found, large = [], []
        # small keys: places k and k + gap of a key, for every gap
        few = np.repeat(sizes <= small, sizes)
        for gap in range(1, small):
            at = np.flatnonzero(few[: len(key) - gap] & (key[: len(key) - gap] == key[gap:]))
            found.append(np.stack([at, at + gap]))
        for start, size in zip(first[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            at = np.arange(start, start + size)
            # four orders, so that most keys of a group agree on a lead and no lead has all pairs
            order = mix(node[at].view(np.uint64) ^ _FACTORS[int(key[start]) & 3])
            lead = start + int(np.argmin(order))
            others = at[at != lead]
            # and a ring in an order of the key's own: the rings of a group's keys leave few of it apart
            ring = at[np.argsort(mix(node[at].view(np.uint64) ^ key[start : start + 1].view(np.uint64)))]
            found += [np.stack([np.full(len(others), lead), others]), np.stack([ring, np.roll(ring, 1)])]
            large.append(at)
        pairs = np.concatenate(found, 1)
        pairs = pairs[:, _like(n[pairs[0]], n[pairs[1]])]
        both = np.sort(np.stack([node[pairs[0]], node[pairs[1]]]), axis=0)
        both = np.unique(both, axis=1)
        for i in range(0, both.shape[1], 1 << 16):
            a, b = both[:, i : i + (1 << 16)]
            none = pa.nulls(len(a), pa.int64())
            yield pa.record_batch([none, pa.array(a), pa.array(b), none], ["key", "a", "b", "n"])
        for at in large:
            yield pa.record_batch([pa.array(key[at]), pa.array(node[at]), pa.nulls(len(at), pa.int64()), pa.array(n[at])], ["key", "a", "b", "n"])

    return candidates


def _alike(prints: DataFrame) -> DataFrame:
    """Pairs (a < b) that connect the nodes of prints(node, fp) whose fingerprints are linked by SimHash; one fingerprint's nodes as a star."""
    prints = cut(prints)
    lead = cut(prints.groupBy("fp").agg(F.min("node").alias("lead")))
    one, two = (lead.select(F.col("fp").alias(x), F.col("lead").alias(f"of_{x}")) for x in "ab")
    linked = simhash.ball_links(lead).distinct().join(one, "a").join(two, "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    star = join_hot(prints, lead, ["fp"]).where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return linked.unionByName(star)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("either"))
    return joined.where(F.col("both") * LEAST[1] >= F.col("either") * LEAST[0]).select("a", "b")


def _groups(batches):
    """Arrays of columns of each run of rows of one (key, low, high), from batches in that order."""
    names, held, now = ("key", "low", "high"), [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(x).to_numpy() for x in names])
        edges = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if now is not None and now != tuple(ids[:, a]):
                yield held
                held = []
            now = tuple(ids[:, a])
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _across(batches):
    """Rows (key, low, high, block, node, root, set) in order -> the pairs of two blocks of a key (or of one block) that are similar enough and have different roots."""
    for held in _groups(batches):
        low, high = (held[0].column(x)[0].as_py() for x in ("low", "high"))
        node, own_root, block = (np.concatenate([b.column(x).to_numpy() for b in held]) for x in ("node", "root", "block"))
        n = np.concatenate([b.column("set").value_lengths().to_numpy() for b in held]).astype(np.int64)
        names, each = np.unique(own_root, return_counts=True)
        if len(names) < 2:
            continue
        flat = np.concatenate([b.column("set").flatten().to_numpy() for b in held])
        _, ids = np.unique(flat, return_inverse=True)
        ends, owner = np.cumsum(n), np.repeat(np.arange(len(n)), n)
        by = np.argsort(ids, kind="stable")
        edges = np.searchsorted(ids[by], np.arange(ids.max() + 2))
        holders = owner[by]
        # within a block those of the largest group are met from the other side; of two blocks the first asks
        asking = own_root != names[each.argmax()] if low == high else block == low
        for i in np.flatnonzero(asking).tolist():
            mine = ids[ends[i] - n[i] : ends[i]]
            both = np.bincount(np.concatenate([holders[x:y] for x, y in zip(edges[mine].tolist(), edges[mine + 1].tolist(), strict=True)]), minlength=len(n))
            like = (both * LEAST[1] >= (n[i] + n - both) * LEAST[0]) & (own_root != own_root[i])
            like = np.flatnonzero(like if low == high else like & (block == high))
            if len(like):
                yield pa.record_batch([pa.array(np.full(len(like), node[i])), pa.array(node[like])], ["a", "b"])


def _paired_blocks(placed: DataFrame, size: int) -> DataFrame:
    """key, low, high, block, node, root: placed(key, node, root), each node once for every pair of blocks that its own is in.

    A key's nodes are dealt into blocks of about `size`, so what meets in a task is two blocks, however large the key.
    """
    blocks = placed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("blocks"))
    dealt = join_hot(placed, blocks, ["key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return pairs.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root")


def first_of_groups(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """row of the one row that stays of each group of docs(row, doc_id, text); row (a text) must be unique and stable.

    Groups are the components of the pairs at Jaccard similarity LEAST or more.  The row with the
    smallest doc_id stays; a null doc_id comes after all others, and rows that are alike in it are
    ranked by row.  Null texts and texts without words are copies of each other.  An empty table
    gives an empty result.
    """
    described = cut(small_batches(docs).select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_describe), "row string, doc_id long, node long, n long, fp long, keys binary"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best")
    nodes = cut(described.groupBy("node").agg(best, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    bands = nodes.where("n > 0").select("node", "n", "keys").mapInArrow(tidy(_bands), "key long, node long, n long")
    found = cut(bands.repartition("key").mapInArrow(tidy(_candidates(small)), "key long, a long, b long, n long"))
    pairs = cut(_alike(nodes.where("n > 0").select("node", "fp")).unionByName(found.where("key is null").select("a", "b")).distinct())
    large = found.where("key is not null").select("key", F.col("a").alias("node"), "n")
    involved = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(large.select("node")).distinct()
    wanted = nodes.join(involved, "node", "left_semi").select(F.col("best.row").alias("row"))
    sets = cut(docs.select("row", "text").join(wanted, "row", "left_semi").select("text").mapInArrow(tidy(_sets), "node long, set array<long>"))
    links = cut(_confirm(pairs, sets))
    member = components(links)
    if large.limit(1).count():
        # pairs of large keys that the stars and rings leave in different groups
        placed = large.join(member.withColumnRenamed("member", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        placed = cut(placed.join(mixed, "key", "left_semi"))
        met = _paired_blocks(placed, BLOCK).join(sets, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
        more = met.mapInArrow(tidy(_across), "a long, b long")
        # a member and its root connect what the links did, in fewer rows and rounds
        member = components(cut(member.select(F.col("member").alias("a"), F.col("root").alias("b")).unionByName(more.distinct())))
    named = nodes.join(member, nodes["node"] == member["member"], "left").select(F.coalesce("root", "node").alias("root"), "best")
    return named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
