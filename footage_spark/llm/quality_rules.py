"""Quality rules by distribution divergence.

References are made from the whole table: for each language, the histogram of character classes and
of its common words (every word that is at least 1 / COMMON of the language's words, so at most
COMMON of them).  A document is compared with its language by Jensen-Shannon distance (square root,
base 2), and only where it is long enough for its histogram to mean something.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WHITE_SPACE, chunks, cut, mix, prefix_sums, rows, small_batches, span_hash, tidy, word_spans

COMMON, WINDOW = 256, 8
#: A language needs that many words to have a reference; a document needs that many words or characters.
MIN_LANGUAGE_WORDS, MIN_LANGUAGE_CHARS, MIN_WORDS, MIN_CHARS = 2000, 16_000, 60, 300
#: Most languages with a reference of their own: each has this share of all characters at least.
MOST_LANGUAGES = 4096
#: Most distance to the language of a kept document.
MAX_CHAR, MAX_WORD = 0.315, 0.42

#: Fixed value: the symbols that are counted.
SYMBOLS = b"#*$%&|<>"
LOWER_, UPPER, DIGIT, BLANK, LINE, SYMBOL, STOP, MARK, LATIN, WIDE, REST = range(11)
_CLASS = np.full(256, REST, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = LOWER_, UPPER, DIGIT
_CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = BLANK, LINE
_CLASS[list(b".,;:?")] = STOP
_CLASS[list(b"!\"'()-/@[]^_`{}~+=\\")] = MARK
_CLASS[list(SYMBOLS)] = SYMBOL
_CLASS[0xC2:0xD0], _CLASS[0xD0:0xF8] = LATIN, WIDE
N_CLASSES, SKIP = 11, 11
_CLASS[0x80:0xC0] = SKIP  # the later bytes of a character
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _measure(data: np.ndarray, offsets: np.ndarray):
    """(words' hashes, their rows, character-class counts, dict of counts) of the rows of a chunk."""
    n = len(offsets) - 1
    s, e, row = word_spans(data, offsets)
    sums = prefix_sums(data)
    h = span_hash(sums, s, e)
    of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(of * (N_CLASSES + 1) + _CLASS[data], minlength=n * (N_CLASSES + 1)).reshape(n, N_CLASSES + 1)[:, :N_CLASSES]
    in_word = ~WHITE_SPACE[data] & ((data & 0xC0) != 0x80)
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": np.bincount(of[in_word], minlength=n), "n_symbols": np.bincount(of[_SYMBOL[data]], minlength=n)}
    # lines with a word that equal an earlier one of the row
    breaks = np.flatnonzero(data == 0x0A)
    a = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    b = np.sort(np.concatenate([offsets[1:], breaks]))
    full = np.searchsorted(s, a) < np.searchsorted(s, b)
    a, b = a[full], b[full]
    line_row = np.searchsorted(offsets, a, "right") - 1
    key = mix(span_hash(sums, a, b) + line_row.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=n)
    # words in windows that a row has twice or more
    many = len(h) - WINDOW + 1
    if many > 0:
        key = row[:many].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        for j in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + many]
        key = mix(key)
        inside = np.flatnonzero(row[:many] == row[WINDOW - 1 :])
        key = key[inside]
        order = np.argsort(key)
        same = np.append(False, key[order][1:] == key[order][:-1])[: len(key)]
        same |= np.append(same[1:], False)[: len(key)]
        starts = inside[order[same]]
        cover = np.zeros(len(h) + 1, np.int32)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + WINDOW, -1)
        covered = np.cumsum(cover[:-1]) > 0
        out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return h, row, kinds, out


def _pool(batches):
    """(lang, kind, key, n): word counts (kind 0) and character-class counts (kind 1) of a batch by language."""
    for batch in batches:
        data, offsets = rows(batch.column("text"))
        lang = batch.column("lang").dictionary_encode()
        code = np.asarray(lang.indices)
        names = lang.dictionary.to_pylist()
        held = []
        pooled = np.zeros((len(names), N_CLASSES), np.int64)
        for first, last in chunks(offsets):
            h, row, kinds, _ = _measure_words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            own = code[first:last]
            np.add.at(pooled, own, kinds)
            for k in np.unique(own):
                u, n = np.unique(h[own[row] == k], return_counts=True)
                held.append((np.full(len(u), k), u, n))
        if not held:
            continue
        k, u, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((u, k))
        k, u, n = k[order], u[order], n[order]
        at = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (k[1:] != k[:-1])))[: len(u)]
        n = np.add.reduceat(n, at) if len(u) else n
        k, u = k[at], u[at]
        ks, cs = np.nonzero(pooled)
        name = pa.array(names, pa.string())
        yield pa.record_batch(
            [name.take(pa.array(np.concatenate([k, ks]))), pa.array(np.repeat([0, 1], [len(u), len(ks)]).astype(np.int32)), pa.array(np.concatenate([u.view(np.int64), cs])), pa.array(np.concatenate([n, pooled[ks, cs]]))],
            ["lang", "kind", "key", "n"],
        )


def _measure_words(data, offsets):
    n = len(offsets) - 1
    s, e, row = word_spans(data, offsets)
    h = span_hash(prefix_sums(data), s, e)
    of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(of * (N_CLASSES + 1) + _CLASS[data], minlength=n * (N_CLASSES + 1)).reshape(n, N_CLASSES + 1)[:, :N_CLASSES]
    return h, row, kinds, None


def references(docs: DataFrame) -> dict[str | None, tuple[np.ndarray, np.ndarray | None, np.ndarray]]:
    """lang -> (hashes of its common words, their shares and the rest's, character-class shares).

    A language without common words (a script without spaces, or too few words) has its character
    classes alone.  Under None stand the classes of all languages that are too small for their own.
    """
    pooled = small_batches(docs).select("text", F.coalesce("lang", F.lit("")).alias("lang")).mapInArrow(tidy(_pool), "lang string, kind int, key long, n long")
    counts = cut(pooled.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    classes, words = counts.where("kind = 1"), counts.where("kind = 0")
    chars = classes.groupBy("lang").agg(F.sum("n").alias("chars"))
    every = chars.agg(F.sum("chars")).first()[0] or 0
    own = chars.where(F.col("chars") >= max(MIN_LANGUAGE_CHARS, every / MOST_LANGUAGES)).select("lang")  # MOST_LANGUAGES rows at most
    kinds: dict[str | None, np.ndarray] = {}
    for x in classes.join(F.broadcast(own), "lang").collect():
        kinds.setdefault(x["lang"], np.zeros(N_CLASSES))[x["key"]] = x["n"]
    for x in classes.join(F.broadcast(own), "lang", "left_anti").groupBy("key").agg(F.sum("n").alias("n")).collect():
        kinds.setdefault(None, np.zeros(N_CLASSES))[x["key"]] = x["n"]
    if None in kinds and kinds[None].sum() < MIN_LANGUAGE_CHARS:
        del kinds[None]
    words = words.join(F.broadcast(own), "lang")
    total = words.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= MIN_LANGUAGE_WORDS)
    common: dict[str, tuple[dict[int, int], int]] = {}
    for x in words.join(F.broadcast(total), "lang").where(F.col("n") * COMMON >= F.col("total")).collect():  # COMMON rows a language at most
        common.setdefault(x["lang"], ({}, x["total"]))[0][x["key"] & (2**64 - 1)] = x["n"]
    made: dict = {}
    for lang, k in kinds.items():
        held, size = common.get(lang, ({}, 0))
        h = np.array(sorted(held), np.uint64)
        n = np.array([held[int(x)] for x in h], np.float64)
        made[lang] = (h, np.append(n, size - n.sum()) / size if held else None, k / max(k.sum(), 1))
    return made


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p from q; rows sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _judge(shared, max_char: float, max_word: float):
    def run(batches):
        refs = shared.value
        for batch in batches:
            data, offsets = rows(batch.column("text"))
            lang = batch.column("lang").dictionary_encode()
            code, names = np.asarray(lang.indices), lang.dictionary.to_pylist()
            parts = []
            for first, last in chunks(offsets):
                h, row, kinds, out = _measure(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                n = last - first
                chars = kinds.sum(1)
                js_char, js_word = np.zeros(n), np.zeros(n)
                for k in np.unique(code[first:last]):
                    ref = refs.get(names[k], refs.get(None))
                    if ref is None:
                        continue
                    words, share, kind_share = ref
                    own = np.flatnonzero(code[first:last] == k)
                    place = np.full(n, -1)
                    place[own] = np.arange(len(own))
                    js_char[own] = js_distance(kinds[own] / np.maximum(chars[own], 1)[:, None], kind_share)
                    if share is None:
                        continue
                    at = place[row]
                    here = at >= 0
                    slot = np.minimum(np.searchsorted(words, h[here]), len(words) - 1)
                    slot = np.where(words[slot] == h[here], slot, len(words))
                    counts = np.bincount(at[here] * (len(words) + 1) + slot, minlength=len(own) * (len(words) + 1)).reshape(len(own), -1)
                    js_word[own] = js_distance(counts / np.maximum(counts.sum(1), 1)[:, None], share)
                js_char[chars < MIN_CHARS] = 0
                js_word[out["n_words"] < MIN_WORDS] = 0
                parts.append(out | {"js_char": js_char, "js_word": js_word})
            get = lambda x: np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64)
            words, again = get("n_words"), get("n_repeat_words")
            failed = (words < 20) | (100 * again > 30 * words)
            kept = ~failed & (get("js_char") <= max_char) & (get("js_word") <= max_word)
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(get(x).astype(np.int64)) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed.astype(bool)), pa.array(kept.astype(bool)), pa.array(get("js_char").astype(float)), pa.array(get("js_word").astype(float))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_char", "js_word"],
            )

    return run


def judge(docs: DataFrame, max_char: float = MAX_CHAR, max_word: float = MAX_WORD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, js_char, js_word.

    A null text has no words and fails.  A null language counts as a language of its own.  A language
    of under MIN_LANGUAGE_WORDS words, or without common words, is held against its character classes
    alone; those of under MIN_LANGUAGE_CHARS characters (or a MOST_LANGUAGES-th of all) are held
    against the classes of all such languages together, and by the base rules alone where these are
    too few.  Repeated rows each get the same result.  An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(references(docs))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_char double, js_word double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang")).mapInArrow(tidy(_judge(shared, max_char, max_word)), schema)
