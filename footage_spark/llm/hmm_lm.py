"""Hidden Markov language model over word classes, trained by Baum-Welch across partitions.

Words are counted over all training texts (64-bit word hashes, map-side sums).  The HEAD most
frequent words are classes of their own; every other word belongs to one of TAILS classes by its
last three bytes.  A text's probability is that of its class sequence under the HMM (scaled forward
recursion, exact) times, for each token, the word's share of its class in the base model; so with
one state the model is the base model itself.

Sizes that leave the executors are bounded: HEAD + TAILS classes times STATES, and KNOWN head counts
that are sent to every task; all other counts reach the documents by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import LOWER, chunks, cut, prefix_sums, rows, small_batches, span_hash, tidy, word_spans

HEAD, TAILS, KNOWN, STATES, ROUNDS = 1 << 14, 1024, 1 << 18, 6, 3
#: Rows whose class counts seed the states before the rounds over all training rows.
SEED_ROWS = 384
#: The hash that stands for the end of a text.
END = np.uint64(1)
#: Tokens of a block of sequences in the forward-backward recursion.
LANE_TOKENS = 1 << 19
SMOOTH = 200.0


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """(hash, tail class, row) of every token but the ends."""
    data = LOWER[data]
    s, e, row = word_spans(data, offsets)
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), row
    h = span_hash(prefix_sums(data), s, e)
    h[h <= END] += np.uint64(2)
    n = e - s
    a, b, c = data[e - 1].astype(np.uint32), np.where(n > 1, data[e - 2], 0).astype(np.uint32), np.where(n > 2, data[np.maximum(e - 3, 0)], 0).astype(np.uint32)
    tail = ((a + (b << 8) + (c << 16)) * np.uint32(2654435761)) >> np.uint32(22)
    return h, (tail % TAILS).astype(np.int32), row


def _count(batches):
    for batch in batches:
        data, offsets = rows(batch.column("text"))
        held = []
        for first, last in chunks(offsets):
            h, tail, _ = _tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            u, index, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, tail[index], n))
        h, tail, n = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        u, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        n, tail = np.bincount(inverse, weights=n, minlength=len(u)).astype(np.int64), tail[index]
        u, tail, n = np.append(u, END), np.append(tail, 0), np.append(n, batch.num_rows)
        yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(n)], ["h", "tail", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """h, tail, c of every different token of docs(text), the end of text included."""
    return docs.select("text").mapInArrow(tidy(_count), "h long, tail int, c long").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def _least_count(histogram: list, most: int) -> int:
    """Smallest count such that at most `most` words have it or more; histogram: (count, words)."""
    held, least = 0, 1 << 62
    for c, words in sorted(histogram, reverse=True):
        held += words
        if held > most:
            break
        least = c
    return least


class Base:
    """Bounded parts of the base model: totals, head counts and the mass of each class."""

    def __init__(self, counts: DataFrame):
        # counts of counts, finer than a power of two; bounded by the number of such steps
        step = F.floor(F.log2("c") * 64)
        by_step = counts.groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("tokens"), F.min("c").alias("c"))
        found = by_step.collect()
        self.n, self.v = sum(r["tokens"] for r in found), sum(r["words"] for r in found)
        pairs = [(r["c"], r["words"]) for r in found]
        self.known_from, head_from = _least_count(pairs, KNOWN), _least_count(pairs, HEAD - 1)
        head = counts.where(F.col("c") >= self.known_from).select("h", "c").toPandas()
        h, c = head["h"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        own = (self.c >= head_from) | (self.h == END)
        self.heads = int(own.sum())
        self.classes = self.heads + TAILS + 1  # the last one: an end of text that no training text has
        self.own_class = np.where(own, np.cumsum(own) - 1, -1).astype(np.int32)
        self.total = self.n + 0.5 * (self.v + 1)
        tails = counts.where((F.col("c") < head_from) & (F.col("h") != int(END))).groupBy("tail").agg((F.sum("c") + 0.5 * F.count(F.lit(1))).alias("m")).collect()
        mass = np.full(self.classes, 0.5 / TAILS)
        mass[: self.heads] = self.c[own] + 0.5
        mass[-1] = 1e-9
        for r in tails:
            mass[self.heads + r["tail"]] += r["m"]
        self.mass = mass / self.total

    def log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / self.total)


def _prepare(shared):
    """Per row: tokens, head part of the base score, class sequence, and the words left to the join."""

    def run(batches):
        base: Base = shared.value
        for batch in batches:
            data, offsets = rows(batch.column("text"))
            n_tokens, known, score, sequences, rest = [], [], [], [], []
            for first, last in chunks(offsets):
                h, tail, row = _tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                n = last - first
                edges = np.searchsorted(row, np.arange(n + 1))
                u, index, inverse = np.unique(h, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(base.h, u), max(len(base.h) - 1, 0))
                found = base.h[at] == u if len(base.h) else np.zeros(len(u), bool)
                value = np.where(found, base.log10(base.c[at] if len(base.c) else 0), 0.0)
                own = np.where(found, base.own_class[at] if len(base.c) else -1, -1)
                of = np.where(own >= 0, own, base.heads + tail[index])[inverse].astype("<u2")
                end_at = int(np.searchsorted(base.h, END))
                has_end = end_at < len(base.h) and base.h[end_at] == END
                end_score = base.log10(base.c[end_at]) if has_end else np.log10(0.5 / base.total)
                end_class = np.array([base.own_class[end_at] if has_end else base.classes - 1], "<u2").tobytes()
                n_tokens.append(np.diff(edges) + 1)
                known.append(np.bincount(row, weights=found[inverse], minlength=n).astype(np.int64) + int(has_end))
                score.append(np.bincount(row, weights=value[inverse], minlength=n) + end_score)
                raw = of.tobytes()
                sequences += [raw[2 * a : 2 * b] + end_class for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                left = ~found[inverse]
                lh, lr = h[left].tobytes(), np.searchsorted(row[left], np.arange(n + 1)).tolist()
                rest += [lh[8 * a : 8 * b] for a, b in zip(lr[:-1], lr[1:], strict=True)]
            flat = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), batch.column("row_key"), flat(n_tokens, np.int64), flat(known, np.int64), flat(score, np.float64), pa.array(sequences, pa.binary()), pa.array(rest, pa.binary())], ["doc_id", "held_out", "row_key", "n_tokens", "known", "head_score", "classes", "rest"])

    return run


def _rest(batches):
    """(row_key, h, times) of the words that are not among the known heads."""
    for batch in batches:
        raw = batch.column("rest").cast(pa.large_binary())
        _, offsets = rows(raw)
        keys = batch.column("row_key").to_numpy()
        h = np.frombuffer(rows(raw)[0].tobytes(), np.uint64)
        row = np.repeat(np.arange(len(keys)), np.diff(offsets) // 8)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
        yield pa.record_batch([pa.array(keys[row[new]]), pa.array(h[new].view(np.int64)), pa.array(np.diff(np.append(new, len(h))))], ["row_key", "h", "times"])


class Hmm:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: classes x states


def _lanes(sequences: list[np.ndarray]):
    """Blocks of sequences, longest first, so that long ones share a block: (flat, first, lengths, order)."""
    lengths = np.array([len(x) for x in sequences])
    order = np.argsort(-lengths, kind="stable")
    a = 0
    while a < len(order):
        total = np.cumsum(lengths[order[a : a + (1 << 16)]])
        b = a + max(1, int(np.searchsorted(total, LANE_TOKENS, "right")))
        own = order[a:b]
        n = lengths[own]
        yield np.concatenate([sequences[i] for i in own]).astype(np.int64), np.cumsum(n) - n, n, own
        a = b


def forward(model: Hmm, flat, first, n, keep: bool = False):
    """log10 probability of each sequence, and with keep the scaled forward values in order of time."""
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), "right")  # sequences longer than t
    log = np.zeros(len(n))
    alphas, scales = [], []
    alpha = None
    for t in range(longest):
        k = int(active[t])
        e = model.emit[flat[first[:k] + t]]
        alpha = e * model.start if t == 0 else (alpha[:k] @ model.move) * e
        scale = alpha.sum(1)
        alpha = alpha / scale[:, None]
        log[:k] += np.log10(scale)
        if keep:
            alphas.append(alpha)
            scales.append(scale)
    return log, alphas, scales, active


def _expect(shared, classes: int):
    def run(batches):
        model: Hmm = shared.value
        states = len(model.start)
        emit, move, start = np.zeros((classes, states)), np.zeros((states, states)), np.zeros(states)
        log, tokens = 0.0, 0
        sequences = []

        def absorb():
            nonlocal log, tokens, move, start
            for flat, first, n, _ in _lanes(sequences):
                part, alphas, scales, active = forward(model, flat, first, n, keep=True)
                log += part.sum()
                tokens += len(flat)
                beta = np.ones((0, states))
                for t in range(len(alphas) - 1, -1, -1):
                    k = int(active[t])
                    if len(beta) < k:  # sequences that end here
                        beta = np.concatenate([beta, np.ones((k - len(beta), states))])
                    gamma = alphas[t] * beta
                    alphas[t] = gamma
                    if t:
                        own = flat[first[:k] + t]
                        later = model.emit[own] * beta / scales[t][:, None]
                        before = previous(alphas, t, k)
                        move += model.move * (before.T @ later)
                        beta = later @ model.move.T
                start += alphas[0].sum(0)
                every = np.concatenate(alphas)
                at = np.concatenate([flat[first[: int(k)] + t] for t, k in enumerate(active)])
                for s in range(states):
                    emit[:, s] += np.bincount(at, weights=every[:, s], minlength=classes)

        def previous(alphas, t, k):
            return alphas[t - 1][:k]

        for batch in batches:
            raw, at = rows(batch.column("classes"))
            whole = np.frombuffer(raw.tobytes(), "<u2")
            sequences = [whole[a // 2 : b // 2] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            absorb()
        if tokens:
            have = np.flatnonzero(emit.sum(1) > 0)
            extra = [*move, start, np.append([log, tokens], np.zeros(max(0, states - 2)))[:states]]
            yield pa.record_batch([pa.array(np.append(have, -1 - np.arange(states + 2)).astype(np.int32)), pa.array([*emit[have].tolist(), *(x.tolist() for x in extra)], pa.list_(pa.float64()))], ["k", "x"])

    return run


def _round(prepared: DataFrame, model: Hmm, base: Base) -> tuple[Hmm, float]:
    """One Baum-Welch round over all training rows; returns the new model and the old one's log10 a token."""
    states = len(model.start)
    shared = prepared.sparkSession.sparkContext.broadcast(model)
    counted = prepared.where(~F.col("held_out")).select("classes").mapInArrow(tidy(_expect(shared, base.classes)), "k int, x array<double>")
    got = counted.groupBy("k").agg(F.array(*[F.sum(F.element_at("x", i + 1)) for i in range(states)]).alias("x")).collect()
    emit, move, start, log = np.zeros((base.classes, states)), np.zeros((states, states)), np.zeros(states), [0.0, 1.0]
    for r in got:
        if r["k"] >= 0:
            emit[r["k"]] = r["x"]
        elif r["k"] >= -states:
            move[-1 - r["k"]] = r["x"]
        elif r["k"] == -1 - states:
            start[:] = r["x"]
        else:
            log = r["x"]
    return _model(start, move, emit, base), log[0] / max(log[1], 1.0)


def _model(start, move, emit, base: Base) -> Hmm:
    emit = emit + SMOOTH * base.mass[:, None]
    return Hmm((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))


def _seed(prepared: DataFrame, base: Base, states: int) -> Hmm:
    """First values from SEED_ROWS training rows (the lowest hashes), grouped by the classes they use."""
    some = prepared.where(~F.col("held_out") & (F.col("n_tokens") > 20)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SEED_ROWS).select("classes").toPandas()["classes"]
    hist = np.zeros((max(len(some), 1), base.classes))
    for i, raw in enumerate(some):
        hist[i] = np.bincount(np.frombuffer(bytes(raw), "<u2"), minlength=base.classes)
    unit = np.sqrt(hist / np.maximum(hist.sum(1, keepdims=True), 1))
    centres = [unit[0]]
    for _ in range(states - 1):
        centres.append(unit[np.argmin(np.max(unit @ np.array(centres).T, 1))])
    centres = np.array(centres)
    for _ in range(8):
        own = np.argmax(unit @ centres.T, 1)
        for s in range(states):
            if (own == s).any():
                centres[s] = np.sqrt(hist[own == s].sum(0) / max(hist[own == s].sum(), 1))
    emit = np.array([hist[own == s].sum(0) for s in range(states)]).T
    stay = np.full((states, states), 0.15 / max(states - 1, 1))
    np.fill_diagonal(stay, 0.85)
    return _model(np.ones(states), stay * 1e4, emit, base)


def _score(shared_model, shared_base):
    def run(batches):
        model, base = shared_model.value, shared_base.value
        share = -np.log10(base.mass)
        for batch in batches:
            raw, at = rows(batch.column("classes"))
            whole = np.frombuffer(raw.tobytes(), "<u2")
            sequences = [whole[a // 2 : b // 2] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            gain = np.zeros(len(sequences))
            for flat, first, n, own in _lanes(sequences):
                gain[own] = forward(model, flat, first, n)[0] + np.add.reduceat(share[flat], first)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "row_key", "n_tokens", "known", "head_score")), pa.array(gain)], names=["doc_id", "held_out", "row_key", "n_tokens", "known", "head_score", "gain"])

    return run


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    A null text is empty: one token, the end.  A null doc_id counts as training.  Repeated rows each
    count and get the same scores.  With no training rows the counts are all 0 and the model is the
    base model over nothing.  Other columns are left out.  An empty table gives an empty result.  The
    forward and backward values of one text are held whole, some 24 bytes a token and state.
    """
    spark = docs.sparkSession
    wide = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wide = wide.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("row_key", F.monotonically_increasing_id())
    counts = cut(word_counts(wide.where(~F.col("held_out"))))
    base = Base(counts)
    context = spark.sparkContext
    shared_base = context.broadcast(base)
    prepared = cut(wide.mapInArrow(tidy(_prepare(shared_base)), "doc_id long, held_out boolean, row_key long, n_tokens long, known long, head_score double, classes binary, rest binary"))
    rest = prepared.where(F.length("rest") > 0).select("row_key", "rest").mapInArrow(tidy(_rest), "row_key long, h long, times long")
    rare = counts.where(F.col("c") < base.known_from).select("h", "c")
    worth = F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.5) / F.lit(base.total))
    late = rest.join(rare, "h", "left").groupBy("row_key").agg(F.sum(F.col("times") * worth).alias("late_score"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("late_known"))
    model = _seed(prepared, base, states)
    for _ in range(rounds):
        model, _log = _round(prepared, model, base)
    scored = prepared.drop("rest").mapInArrow(tidy(_score(context.broadcast(model), shared_base)), "doc_id long, held_out boolean, row_key long, n_tokens long, known long, head_score double, gain double")
    out = scored.join(late, "row_key", "left")
    base_score = F.col("head_score") + F.coalesce("late_score", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("late_known", F.lit(0))).alias("n_known"), F.lit(base.n).cast("long").alias("train_tokens"), base_score.alias("base_score"), (base_score + F.col("gain")).alias("score"))
