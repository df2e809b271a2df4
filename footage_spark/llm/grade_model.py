"""Quality classifier: cumulative-link (ordered logit) regression on graded ratings.

Grades: 0 poor text, 1 readable but toxic, 2 good.  One weight per hashed word or beginning of a word
(presence in the text) and a few text shares serve all grades; ordered thresholds t_1 < t_2 give
P(grade >= k) = sigmoid(w.x - t_k), hence the expected grade and the tail probability by which
documents are chosen.  The fit uses at most FIT_ROWS labelled rows, those of the lowest hashes; each
of them is whole.  Every document is scored.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, WHITE_SPACE, chunks, mix, prefix_sums, rows, small_batches, span_hash, tidy, word_spans

FIT_ROWS, BITS, LEAST_ROWS, ROUNDS, RATE, GRADES, SHRINK = 12288, 20, 8, 200, 0.2, 3, 0.7
#: Bytes of the beginnings of longer words; they find a stem under many endings.
BEGINNINGS = (5, 7)
#: Bytes of text whose features are made together; bounds a worker's memory.
FEATURE_BYTES = 1 << 20
#: Least tail probability P(grade = 2) of a kept document.
LEAST_TAIL = 0.75
_STOP = np.isin(np.arange(256), list(b".,;:!?\"')("))
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>!"))
#: Shares of a text that stand beside its words, each cut into STEPS of presence features.
STEPS = 10
SHARES = 5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of a chunk, each once; features are below 2**BITS."""
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1)
    upper = np.bincount(of, weights=(data >= 65) & (data <= 90), minlength=n) / size
    symbol = np.bincount(of, weights=_SYMBOL[data], minlength=n) / size
    digit = np.bincount(of, weights=(data >= 48) & (data <= 57), minlength=n) / size
    low = LOWER[data]
    s, e, row = word_spans(low, offsets)
    for _ in range(2):
        e = np.where((e - s > 1) & _STOP[low[e - 1]], e - 1, e) if len(s) else e
    sums = prefix_sums(low)
    bucket = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique((row << BITS) | bucket(span_hash(sums, s, e)))
    words = np.bincount(row, minlength=n)
    distinct = np.bincount(key >> BITS, minlength=n)
    blank = np.bincount(of, weights=WHITE_SPACE[data], minlength=n)
    shares = [upper, symbol * 2, digit * 2, 1 - distinct / np.maximum(words, 1), np.minimum((size - blank) / np.maximum(words, 1) / 20, 1)]
    step = [np.minimum((np.clip(x, 0, 1) * STEPS).astype(np.int64), STEPS - 1) + i * STEPS for i, x in enumerate(shares)]
    keys = [key]
    for n_bytes in BEGINNINGS:
        a, r = s[e - s > n_bytes], row[e - s > n_bytes]
        keys.append((r << BITS) | bucket(mix(span_hash(sums, a, a + n_bytes) + np.uint64(1))))
    key = np.unique(np.concatenate(keys))
    # the share features take the first places; words that fall there move on
    key = np.where((key & ((1 << BITS) - 1)) < SHARES * STEPS, key + SHARES * STEPS, key)
    return np.concatenate([key >> BITS, *[np.arange(n)] * SHARES]), np.concatenate([key & ((1 << BITS) - 1), *step])


def _collect_features(batches):
    for batch in batches:
        data, offsets = rows(batch.column("text"))
        out = []
        for first, last in chunks(offsets, FEATURE_BYTES):
            row, feature = features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            order = np.argsort(row, kind="stable")
            edges = np.searchsorted(row[order], np.arange(last - first + 1)).tolist()
            raw = feature[order].astype("<u4").tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.record_batch([batch.column("grade"), pa.array(out, pa.binary())], ["grade", "features"])


#: Rows of the fit that are added up at a time.
PART_ROWS = 1024


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Grader:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2 ... of each row."""
        return _sigmoid(z[:, None] - self.thresholds[None, :])


def fit_grades(grades: np.ndarray, lists: list[np.ndarray], rounds: int = ROUNDS, rate: float = RATE, shrink: float = SHRINK) -> Grader:
    """Log likelihood of the ordered grades, by proximal steps along averaged gradients over all rows.

    Each word's weight is pulled to 0 by `shrink` times the noise of its gradient, so that words that
    tell nothing have no weight, however long a text is.  Steps are scaled by each weight's recent
    gradients, which lets rare words gain the weight they need, and shrink to nothing in the end.
    Without rows nothing can be told: the model gives every text the top grade, with a warning.
    """
    size, m = 1 << BITS, len(lists)
    w, t = np.zeros(size), np.linspace(-3.0, -1.0, GRADES - 1)
    if not m:
        warnings.warn("no graded rows: every document gets the top grade and is kept", stacklevel=2)
        return Grader(w, np.full(GRADES - 1, -np.inf))
    rows_of = np.zeros(size, np.int64)
    for x in lists:  # a row has a feature once
        rows_of[x] += 1
    use = rows_of >= LEAST_ROWS  # rarer features tell nothing that the pull below would leave
    use[: SHARES * STEPS] = True
    lists = [x[use[x]] for x in lists]
    flat, sizes = np.concatenate(lists), np.array([len(x) for x in lists])
    del lists
    edges, parts = np.append(0, np.cumsum(sizes)), [(a, min(a + PART_ROWS, m)) for a in range(0, m, PART_ROWS)]
    held = np.flatnonzero(use & (rows_of > 0))
    place = np.zeros(size, np.int64)
    place[held] = np.arange(len(held))
    flat = place[flat]
    noise = np.sqrt(rows_of[held]) / m
    pull = shrink * np.where(held < SHARES * STEPS, 0.0, noise)
    v, every = np.zeros(len(held)), np.arange(m)
    mean, square = np.zeros(len(held)), np.zeros(len(held))
    t_mean, t_square = np.zeros(GRADES - 1), np.zeros(GRADES - 1)
    for k in range(rounds):
        # some rows at a time: fewer arrays as long as flat are held
        z = np.concatenate([np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), weights=v[flat[edges[a] : edges[b]]], minlength=b - a) for a, b in parts])
        p = np.hstack([np.ones((m, 1)), _sigmoid(z[:, None] - t), np.zeros((m, 1))])
        slope = p * (1 - p)
        mine = np.maximum(p[every, grades] - p[every, grades + 1], 1e-9)
        low, high = slope[every, grades] / mine, slope[every, grades + 1] / mine
        grad = np.bincount(flat, weights=np.repeat(low - high, sizes), minlength=len(held)) / m
        dt = np.zeros((m, GRADES + 1))
        dt[every, grades] -= low
        dt[every, grades + 1] += high
        t_grad = dt[:, 1:-1].mean(0)
        # running means over about 5 and 20 rounds, made whole for the first rounds
        now, whole, whole_square = rate * (1 - k / rounds), 1 - 0.8 ** (k + 1), 1 - 0.95 ** (k + 1)
        mean, square = 0.8 * mean + 0.2 * grad, 0.95 * square + 0.05 * grad**2
        t_mean, t_square = 0.8 * t_mean + 0.2 * t_grad, 0.95 * t_square + 0.05 * t_grad**2
        step = now / (np.sqrt(square / whole_square) + noise)
        v += step * mean / whole
        v = np.sign(v) * np.maximum(np.abs(v) - step * pull, 0)
        t = np.sort(t + now * (t_mean / whole) / (np.sqrt(t_square / whole_square) + 1e-3))
    w[held] = v
    return Grader(w, t)


def _fit(batches):
    """All rows of the fit in one order, whatever order they came in -> the model as one row; no row without rows."""
    grades, lists = [], []
    for batch in batches:
        grades += batch.column("grade").to_pylist()
        lists += [np.frombuffer(x, "<u4") for x in batch.column("features").to_pylist()]
    if not lists:
        return
    order = sorted(range(len(lists)), key=lambda i: (grades[i], len(lists[i]), lists[i].tobytes()))
    model = fit_grades(np.array(grades, np.int64)[order], [lists[i] for i in order])
    held = np.flatnonzero(model.weights)
    made = (held.astype("<i8"), model.weights[held].astype("<f8"), model.thresholds.astype("<f8"))
    yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in made], ["feature", "weight", "thresholds"])


def grade_of(quality, toxic):
    """0 poor, 1 toxic, 2 good; null where both labels are null."""
    return F.when(quality.isNull() & toxic.isNull(), None).when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Grader:
    """Fit on at most fit_rows labelled documents, the lowest by hash of doc_id.

    Labels of one doc_id are taken together (the highest of each); a label without a document, and one
    whose values are all null, tells nothing.  Without any the model keeps every document.
    """
    graded = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    graded = graded.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")).where("grade is not null")
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("grade", "text")
    rows_of_fit = small_batches(some).mapInArrow(tidy(_collect_features), "grade int, features binary")
    # the rows are few and bounded: one task fits them, and the driver gets the weights that are not 0
    fitted = rows_of_fit.repartition(1).mapInArrow(tidy(_fit), "feature binary, weight binary, thresholds binary").collect()
    if not fitted:
        return fit_grades(np.zeros(0, np.int64), [])
    weights = np.zeros(1 << BITS)
    weights[np.frombuffer(bytes(fitted[0]["feature"]), "<i8")] = np.frombuffer(bytes(fitted[0]["weight"]), "<f8")
    return Grader(weights, np.frombuffer(bytes(fitted[0]["thresholds"]), "<f8"))


def _grade(shared, least_tail: float, keep_columns: list[str]):
    def run(batches):
        model: Grader = shared.value
        for batch in batches:
            data, offsets = rows(batch.column("text"))
            z = []
            for first, last in chunks(offsets, FEATURE_BYTES):
                row, feature = features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                z.append(np.bincount(row, weights=model.weights[feature], minlength=last - first))
            tails = model.tails(np.concatenate(z) if z else np.zeros(0))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep_columns), pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least_tail)], names=[*keep_columns, "expected_grade", "p_tail", "kept"]
            )

    return run


def grade(docs: DataFrame, model: Grader, least_tail: float = LEAST_TAIL) -> DataFrame:
    """docs with expected_grade, p_tail = P(grade = 2) and kept = p_tail >= least_tail.

    A null text is empty and is graded by its shares alone; repeated rows get equal grades; columns
    of docs that have these names are replaced.  An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("expected_grade", "p_tail", "kept")]
    schema = docs.select(*kept).schema.add("expected_grade", "double").add("p_tail", "double").add("kept", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return small_batches(docs).select(*kept).mapInArrow(tidy(_grade(shared, least_tail, kept)), schema)
