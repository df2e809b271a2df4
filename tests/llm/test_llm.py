"""Brute-force versions, exact round trips and the odd cases of the training-data operators."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footage_spark.llm import bpe, chat, grade_model, hmm_lm, line_dedup, media, mixing, near_copies, quality_rules, simhash, suffix_dedup
from footage_spark.llm.queries import rank_path
from footage_spark.llm.text import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, taken string, kept string"


def words_of(rng, n):
    return " ".join(rng.choice(["the", "of", "Éa", "tion", "house", "aa", "x", "zebra's", "2,000", "ñ"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    base = [words_of(rng, 40) for _ in range(12)]
    texts = [None, "", "  \n\t", "a", *base, *base[:4], base[0] + " more", "before " + base[1] + " after", base[2] + "\n" + base[3] + "\n" + base[2], "x" * 3000, "ab" * 2000, words_of(rng, 6000), "same", "same", "A\n\nA\n" * 30]
    made = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S3", None]), len(t or ""), "clash", "clash", None) for i, t in enumerate(texts)]
    made += [(None, base[5], "en", "s1", 3, None, None, None), made[4]]  # a null id and a repeated row
    return spark.createDataFrame(made, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def local(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lines_by_hand(local, least_words):
    """{(doc_id, text): spans that go}, units in order of doc_id; texts of one doc_id are given once here."""
    seen, out = set(), {}
    for i, t in sorted((x for x in set(local) if None not in x), key=lambda x: x[0]):
        spans = []
        for m in re.finditer(r"[^\n]*?(?:\n|[.!?](?=\s)|$)", t):
            words = tuple(m[0].lower().encode().split())
            if m[0] and len(words) >= least_words:
                spans += [m.span()] if words in seen else []
                seen.add(words)
        out[i, t] = spans
    return out


def check_lines(got, local, least_words):
    want = lines_by_hand(local, least_words)
    assert len(got) == len(local)
    for r in got:
        t = next(t for (i, t) in local if i == r["doc_id"]) if r["doc_id"] is not None else r["text"]
        spans = want.get((r["doc_id"], t), [])
        assert [(x["start"], x["start"] + x["length"]) for x in r["removed"]] == spans and r["n_removed"] == len(spans)
        assert r["text"] == (None if t is None else "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in spans)))


@pytest.mark.parametrize("least_words", [line_dedup.LEAST_WORDS, 1])
def test_lines(docs, local, empty, least_words):
    check_lines(line_dedup.dedup_units(docs, least_words).collect(), local, least_words)
    assert line_dedup.dedup_units(empty).count() == 0


def test_lines_of_repeated_rows(spark):
    long = "A passage of more than sixteen words that stands in several texts of this table, and no shorter than it must be."
    rows_ = [(1, f"Head.\n{long}\nTail."), (2, f"Other {long.lower()} x"), (3, f"Before. {long} After."), (3, f"Before. {long} After."), (4, f"{long}\n{long}"), (5, "é😀 " * 20 + f". {long}")]
    check_lines(line_dedup.dedup_units(spark.createDataFrame(rows_, "doc_id long, text string")).collect(), rows_, 16)
    # one doc_id with two texts: each keeps what only it has, and one of them keeps what both have
    two = spark.createDataFrame([(7, f"{long} Only here."), (7, f"Only there. {long}")], "doc_id long, text string")
    got = [r["text"] for r in line_dedup.dedup_units(two, 1).collect()]
    assert sorted(long in t for t in got) == [False, True] and sum("Only here." in t for t in got) == sum("Only there." in t for t in got) == 1


def joined_by_hand(local, least_words):
    """{(doc_id, text): spans that go} where units stand in a row; texts of one doc_id are given once here."""
    seen, out = set(), {}
    for i, t in sorted((x for x in set(local) if None not in x), key=lambda x: x[0]):
        units = [(*m.span(), m[0].lower().encode().split()) for m in re.finditer(r"[^\n]*?(?:\n|[.!?](?=\s)|$)", t) if m[0].split()]
        gone = set()
        for k in range(len(units)):
            end = next((j for j in range(k + 1, len(units) + 1) if sum(len(u[2]) for u in units[k:j]) >= least_words), None)
            if end is not None:
                words = tuple(w for u in units[k:end] for w in u[2])
                gone |= set(range(units[k][0], units[end - 1][1])) if words in seen else set()
                seen.add(words)
        starts = [c for c in sorted(gone) if c - 1 not in gone]
        out[i, t] = [(c, next(e for e in itertools.count(c) if e not in gone)) for c in starts]
    return out


@pytest.mark.parametrize("least_words", [16, 32])
def test_lines_joined(spark, docs, least_words):
    """Passages of over 50 words in sentences of at most 12: single units find none of them, joined ones all."""
    rng = random.Random(5)
    own = itertools.count()
    sentence = lambda n: " ".join(f"w{next(own)}" for _ in range(n)) + "."
    passages = [" ".join(sentence(rng.randint(4, 12)) for _ in range(12)) for _ in range(6)]
    made = [(k, f"{sentence(9)}\n{p} {sentence(9)}") for k, p in enumerate(passages)]
    made += [(10 + k, f"{sentence(20)} {p.upper()}\n\n{sentence(20)}") for k, p in enumerate(passages)]
    made += [(20 + k, " ".join(sentence(10) for _ in range(8)) + "\nAll rights reserved.\n") for k in range(6)]  # clean, but for a short line
    made += [(30, "a b.\n" * 40), (31, None), (32, ""), made[0], (33, passages[0]), (34, passages[0].replace(". ", ".\n"))]
    made += [(i + 100, t) for i, t in {(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None}]
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_units(table, least_words, joined=True).collect()
    want = joined_by_hand(made, least_words)
    assert len(got) == len(made)
    for r in got:
        t, lost = dict(made)[r["doc_id"]], {c for x in r["removed"] for c in range(x["start"], x["start"] + x["length"])}
        assert lost == {c for a, b in want.get((r["doc_id"], t), []) for c in range(a, b)}
        assert r["text"] == (None if t is None else "".join(c for k, c in enumerate(t) if k not in lost)) and r["n_removed"] == len(r["removed"])
    hit = {r["doc_id"] for r in got if r["n_removed"] and r["doc_id"] < 100}
    assert hit == {*range(10, 16), 30, 33, 34}
    single = {r["doc_id"] for r in line_dedup.dedup_units(table).collect() if r["n_removed"]}
    assert not single & hit


def test_lines_are_made_in_linear_time():
    import time

    took = []
    for n in (20_000, 200_000):
        began = time.time()
        assert len(line_dedup.split_units("a b.\n" * n)) == 2 * n
        took.append(time.time() - began)
    assert took[1] < 40 * took[0]


def test_mix(docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count() and mixing.mix_sources(empty).count() == 0
    total = sum(r["size"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sum(x["size"] for x in got if x["source"] == r["source"])
    assert abs(sum(x[0]["target"] for x in by.values()) - min(1.5 * total, 2 * total)) < 1e-6
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_mix_meets_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"))
    for r in mixing.mix_sources(docs, block=16).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert abs(r["t"] - r["n"]) <= 49


def test_mix_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    ids = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.col("id") % 50).otherwise(F.col("id"))
    docs = spark.range(3000).select(ids.alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"), F.col("id").alias("n_chars"))
    got = mixing.mix_sources(docs, block=16)
    for r in got.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.countDistinct("row").alias("rows")).collect():
        assert abs(r["t"] - r["n"]) <= 49 and r["rows"] == 600
    targets = {r["source"]: r["target"] for r in got.select("source", "target").distinct().collect()}
    out = corpus_pipeline.mix(spark, docs, None).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("w"))).alias("n"), F.sum(F.col("doc_id").isNull().cast("int")).alias("nulls")).collect()
    assert all(abs(targets[r["source"]] - r["n"]) <= 49 and r["nulls"] > 0 for r in out) and len(out) == 5


def test_suffix_order():
    rng = random.Random(1)
    for alphabet in (b"ab", b"abc\x00\xff", bytes(range(97, 110))):
        for _ in range(150):
            texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 4))]
            got = suffix_dedup.suffix_order(texts)
            every = [t[i:] for t in texts for i in range(len(t))]
            assert [texts[a][b:] for a, b in got] == sorted(every) and len(set(got)) == len(every)


@pytest.mark.parametrize("common_docs, hot", [(suffix_dedup.COMMON_DOCS, suffix_dedup.HOT), (2, suffix_dedup.HOT), (2, 12), (2, 0)])
def test_suffix_dedup(docs, local, empty, monkeypatch, common_docs, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = collections.defaultdict(list)
    for r in suffix_dedup.dedup_digests(docs, common_docs).collect():
        got[r["doc_id"]].append(r)
    first = {}
    for i, t in sorted((x for x in set(local) if x[0] is not None), key=lambda x: x[0]):
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    for i, t in local:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49 if i is not None else 0):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        kept = hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()
        assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), sum(gone), spans, kept) for r in got[i])
    assert suffix_dedup.dedup_digests(empty).count() == 0
    assert suffix_dedup.dedup_texts(docs).columns == docs.columns


def test_suffix_dedup_needs_the_suffix_groups(docs, monkeypatch):
    """Strings of keys with several contexts have their owners by the order of the suffixes alone."""
    bodies = [suffix_dedup.rows(pa.array([r["text"] for r in docs.select("text").collect()]))]
    for data, offsets in bodies:
        row, key, a, b, core, _ = suffix_dedup.contexts(data, offsets)
        order = np.argsort(key, kind="stable")
        key, a, n, core = key[order], a[order], (b - a + 1)[order], core[order]
        length = n + suffix_dedup.REST
        body = np.concatenate([np.delete(data[x : x + m + suffix_dedup.LENGTH - 1], np.s_[c : c + suffix_dedup.CORE]) for x, m, c in zip(a, n, core)])
        make = lambda: suffix_dedup._owners(key, n, core, body, np.cumsum(length) - length, row[order])[0]
        first: dict = {}
        want = []
        for x, m, k in zip(a, n, row[order]):
            for q in range(x, x + m):
                w = data[q : q + 50].tobytes()
                first[w] = min(first.get(w, k), k)
                want.append(w)
        assert make().tolist() == [first[w] for w in want]
        monkeypatch.setattr(suffix_dedup, "grouped_suffixes", lambda flat, first: [])
        several = np.repeat(np.isin(key, np.unique(key)[np.unique(key, return_counts=True)[1] > 1]), n)
        assert several.sum() > 100 and ((make() == np.iinfo(np.int64).max) == several).all()


def test_suffix_order_takes_linear_time():
    import time

    for make in (lambda n: b"a" * (n - 1) + b"b", lambda n: b"ab" * (n // 2), lambda n: bytes(random.Random(n).choices(b"abc", k=n))):
        took = []
        for n in (8_000, 64_000):
            began = time.time()
            assert len(suffix_dedup.grouped_suffixes(make(n) + b"\0", [0, n + 1])) == n
            took.append(time.time() - began)
        assert took[1] < 24 * took[0]


def test_a_text_longer_than_a_piece(monkeypatch):
    rng = random.Random(5)
    long = bytes(rng.choice(b"ab") for _ in range(5000)) * 2
    strings = lambda: sorted((int(k), int(p)) for _, _, starts, row, key, a, b, _, _ in suffix_dedup._batch_contexts(pa.record_batch([pa.array([long.decode()])], ["text"])) for k, x, y, t in zip(key, a, b, row) for p in range(x - starts[t], y + 1 - starts[t]))
    whole = strings()
    assert len(whole) == len(long) - 49
    monkeypatch.setattr(suffix_dedup, "HASH_BYTES", 100)
    real = suffix_dedup.contexts
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 12)
    pieces = [p for _, p in strings()]
    assert sorted(pieces) == list(range(len(long) - 49)) and real is suffix_dedup.contexts


def test_hmm(docs, local, empty):
    got = {(r["doc_id"]): r for r in hmm_lm.score_texts(docs, states=2, rounds=1).collect()}
    counts = collections.Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in local:
        if not held(i):
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in local:
        tokens = [*(t or "").encode().lower().split(), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(tokens), sum(counts[x] > 0 for x in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), rel_tol=1e-9)
    assert hmm_lm.score_texts(empty).count() == 0


def test_forward_is_exact():
    rng = np.random.default_rng(3)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm_lm.Hmm(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 4))).T)
    seqs = [np.array([0, 3, 2, 1, 1]), np.array([2]), np.array([1, 0, 2])]
    for flat, first, n, own in hmm_lm._lanes(seqs):
        for value, k in zip(hmm_lm.forward(model, flat, first, n)[0], own):
            s = seqs[k]
            total = sum(model.start[p[0]] * math.prod(model.move[a, b] for a, b in zip(p, p[1:])) * math.prod(model.emit[o, q] for o, q in zip(s, p)) for p in itertools.product(range(2), repeat=len(s)))
            assert math.isclose(value, math.log10(total), rel_tol=1e-9)


def test_rules(docs, local, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for i, t in local:
        t = t or ""
        w = t.encode().split()
        grams = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {j + k for j in range(len(w) - 7) if grams[tuple(w[j : j + 8])] > 1 for k in range(8)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                again += line in seen
                seen.add(line)
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), again, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(empty).count() == 0


def test_simhash(docs, local, empty):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    import xxhash

    prints = {}
    for i, t in local:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 4]), 42) for j in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert int(got[i]["fingerprint"], 16) == prints[i]
    comp = {i: i for i in prints if i is not None}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.product(comp, comp):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and comp[b] < comp[a]:
                comp[a], changed = comp[b], True
    assert all(got[i]["component_id"] == c for i, c in comp.items())
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius, part", [(4, simhash.PART_VARIANTS), (4, 3000), (2, 3000), (3, 500)])
def test_ball_hashing_links(monkeypatch, radius, part):
    """Every pair within the radius is linked, chains too, and no other pair, whatever the cells."""
    monkeypatch.setattr(simhash, "PART_VARIANTS", part)
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for x in list(fps)[:40]:
        for _ in range(12):  # a chain
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    values = np.array(sorted(fps), np.uint64)
    near = [(i, j) for i, j in itertools.combinations(range(len(values)), 2) if int(values[i] ^ values[j]).bit_count() <= radius]
    half = (radius + 1) // 2
    for bits in (1, 3, 7):
        sent = [b for b in simhash._send(bits, half)([pa.record_batch([pa.array(values.view(np.int64))], ["fp"])])]
        place, pairs = {int(v): i for i, v in enumerate(values)}, []
        for b in simhash._links_of_cells(bits, radius)(sent):
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                pairs.append((place[x % 2**64], place[y % 2**64]))
        got = simhash.forest(len(values), np.array(pairs or np.zeros((0, 2)), np.int64))
        want = simhash.forest(len(values), np.array(near, np.int64))
        assert (got == want).all()
    assert simhash.cell_bits(10**5, 2) == 7 and simhash.cell_bits(10**9, 2) > 12


@pytest.mark.parametrize("small", [near_copies.SMALL, 2])
def test_near_copies(spark, monkeypatch, small):
    import corpus_pipeline

    rng = random.Random(21)
    made = []
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 5])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(3000)}"
            made.append(" ".join(w))
    made += [" ".join(made[0].split() + [f"x{i}"] * 3) for i in range(40)] + [None, "", " \n", "one two", "One  two"]
    rng.shuffle(made)
    ids = [rng.randrange(5000) if rng.random() < 0.7 else None for _ in made[:-2]] + [7, 7]
    monkeypatch.setattr(near_copies, "first_of_groups", lambda d, f=near_copies.first_of_groups: f(d, small))
    made_rows = [(i, t, "en", "s", k) for k, (i, t) in enumerate(zip(ids, made, strict=True))]
    docs = spark.createDataFrame(made_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    sets = []
    for t in made:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(made)))
    near = [(a, b) for a, b in itertools.combinations(range(len(made)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in near * 2:
        low, high = sorted((group[a], group[b]))
        group = [low if x == high else x for x in group]
    got = collections.Counter(group[r["n_chars"]] for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect())
    assert got == collections.Counter(set(group))
    kept = {group[r["n_chars"]]: r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect()}
    for g, i in kept.items():
        assert i == min((x for x, y in zip(ids, group) if y == g and x is not None), default=None)


def test_near_copies_of_nothing(empty):
    assert near_copies.first_of_groups(empty.select("doc_id", "text", F.lit("0").alias("row"))).count() == 0


def test_bpe(docs, local, empty):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load(rank_path()).ids, special_tokens={})
    got = bpe.decode(bpe.encode(docs, rank_path()), rank_path()).collect()
    assert len(got) == len(local)
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(empty, rank_path()).count() == 0
    rng = random.Random(5)
    odd = ["".join(rng.choice("ab' \n\t9é中😀sxretvmld' ") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    ids, at = bpe.encode_rows(bpe.load(rank_path()), *rows(pa.array(odd)))
    assert all(ids[a:b].tolist() == enc.encode_ordinary(t) for a, b, t in zip(at, at[1:], odd))


def test_bpe_of_very_long_pre_tokens():
    import time

    import tiktoken

    ranks = bpe.load(rank_path())
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    rng = random.Random(8)
    sinks = [ranks.bytes_of[i].decode() for i in np.flatnonzero(ranks.sinks).tolist() if ranks.bytes_of[i].isalpha()]
    texts = ["il" * 900, "ilo" * 700, "x" * 3000, *(("".join(rng.sample(sinks, 3))) * 300 for _ in range(12)), "".join(rng.choice("abcdeilot") for _ in range(4000))]
    ids, at = bpe.encode_rows(ranks, *rows(pa.array(texts)))
    assert all(ids[a:b].tolist() == enc.encode_ordinary(t) for a, b, t in zip(at, at[1:], texts))
    took = []
    for n in (4_000, 128_000):  # time per byte stays about the same
        began = time.time()
        bpe.encode_long(ranks, b"il" * (n // 2))
        took.append((time.time() - began) / n)
    assert took[1] < 3 * took[0]


def test_jpeg(docs, local, empty):
    for r in media.media_digests(media.encode_media(docs)).collect():
        raw = (dict(local)[r["doc_id"]] or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert media.media_digests(media.encode_media(empty)).count() == 0


def test_jpeg_against_another_reader(spark, tmp_path):
    raw = np.random.default_rng(2).integers(0, 256, 6000, dtype=np.uint8)
    file = media.write_jpegs(raw, np.array([0, len(raw)]))[0]
    (tmp_path / "a.jpg").write_bytes(file)
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "a.jpg")))
    w, h = image.getWidth(), image.getHeight()
    px = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64) & 0xFFFFFF
    theirs = np.stack([px >> 16, (px >> 8) & 255, px & 255], 1).reshape(h, w, 3)
    data = np.frombuffer(file, np.uint8)
    ours = media.tensors(*media.read_coefficients(data, np.array([0, len(data)])))[0]
    assert ours.shape == theirs.shape and np.corrcoef(ours.ravel(), theirs.ravel())[0, 1] > 0.8  # chroma is smoothed there


def test_grades(spark, docs, empty):
    rng = random.Random(9)
    made = [(i, " ".join(rng.choice(["junk", "zz", "##"] if i % 4 == 0 else ["good", "fine", "text", "bad"] if i % 4 == 1 else ["good", "fine", "text"]) for _ in range(30))) for i in range(400)]
    some = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 1)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = grade_model.train(some, labels)
    held = grade_model.grade(some, model).where("doc_id >= 300").collect()
    assert sum(r["kept"] == (r["doc_id"] % 4 > 1) for r in held) / len(held) > 0.95
    assert grade_model.grade(docs, model).count() == docs.count() and grade_model.grade(empty, model).count() == 0
    for none in (grade_model.train(empty, labels), grade_model.train(some, labels.where("false"))):  # nothing is known: all stay
        assert grade_model.grade(some, none).where("kept and p_tail > 0.999").count() == 400
    clash = grade_model.grade(docs.withColumn("p_tail", F.lit("clash")), model)
    assert sorted(clash.columns) == sorted([*docs.columns, "expected_grade", "p_tail"]) and dict(clash.dtypes)["p_tail"] == "double"


def test_grades_are_fitted_in_a_task(spark, monkeypatch):
    """The driver holds no rows of the fit, and the model is that of a fit of all rows at once."""
    texts = [f"word{i % 3} other{i % 7} {'junk' if i % 3 == 0 else 'fine'}" for i in range(90)]
    some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 1)) for i in range(90)], "doc_id long, quality int, toxic int")
    lists = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        lists.append(np.sort(grade_model.features(raw, np.array([0, len(raw)]))[1]).astype("<u4"))
    grades = np.array([min(i % 3, 1) + (i % 3 == 2) for i in range(90)])
    order = sorted(range(90), key=lambda i: (grades[i], len(lists[i]), lists[i].tobytes()))
    whole = grade_model.fit_grades(grades[order], [lists[i] for i in order])

    def none(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(grade_model, "fit_grades", none)
    model = grade_model.train(some, labels)
    assert np.allclose(model.weights, whole.weights, atol=1e-9) and np.allclose(model.thresholds, whole.thresholds, atol=1e-9) and (model.weights != 0).any()


def test_grades_fit_is_at_the_least_loss():
    """The gradient of the pulled log likelihood, by differences, is about nothing where the fit ends."""
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(100, 130, rng.integers(3, 12))) for _ in range(600)]
    true = np.zeros(1 << grade_model.BITS)
    true[100:130] = rng.normal(0, 1.5, 30)
    z = np.array([true[x].sum() for x in lists])
    grades = (rng.logistic(z) > 0).astype(int) + (rng.logistic(z) > 1.5)
    model = grade_model.fit_grades(grades, lists)
    rows_of = np.bincount(np.concatenate(lists), minlength=130)
    pull = grade_model.SHRINK * np.sqrt(rows_of[100:130]) / len(lists)

    def loss(w, t):
        s = np.array([w[x].sum() for x in lists])
        p = np.hstack([np.ones((600, 1)), 1 / (1 + np.exp(t - s[:, None])), np.zeros((600, 1))])
        return -np.log(p[np.arange(600), grades] - p[np.arange(600), grades + 1]).mean() + (pull * np.abs(w[100:130])).sum()

    here = loss(model.weights, model.thresholds)
    for k in range(100, 130):
        for step in (-0.05, 0.05):
            w = model.weights.copy()
            w[k] += step
            assert loss(w, model.thresholds) > here - 2e-5
    for k in range(2):
        for step in (-0.05, 0.05):
            t = model.thresholds.copy()
            t[k] += step
            assert loss(model.weights, t) > here - 2e-5


def test_chat(spark):
    turns = [(c, t, ["user", "assistant"][t % 2], f"hello {c} {t}?" if t % 2 == 0 else "A long answer.\nWith lines. " * 3) for c in range(60) for t in range(4)]
    turns += [(900, 0, None, None), (900, 1, "user", ""), (901, 0, "system", "Be kind.")]
    written = chat.transcripts_of(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    model = chat.train_roles(written)
    got = chat.format_chats(written.withColumn("rendered", F.lit("clash")), model).collect()
    right = sum([t["role"] for t in r["turns"]] == ["user", "assistant"] * 2 for r in got if r["conv_id"] < 60)
    assert right >= 50 and len(got) == 62
    assert chat.parse(model, "") == [] and chat.parse(model, None) == []


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(7)
    n = chat.N_STATES
    model = chat.RoleModel(rng.random(n) * 9, rng.random((n, n)) * 9, rng.random((n, chat.N_MARKS)) * 9, rng.random((n, chat.N_LENGTHS)) * 9, rng.random((n, chat.N_ENDS)) * 9)
    for length in (1, 2, 4):
        for _ in range(4):
            shown = np.stack([rng.integers(0, chat.N_MARKS, length), rng.integers(0, chat.N_LENGTHS, length), rng.integers(0, chat.N_ENDS, length)], 1)
            seen = lambda t, s: model.mark[s, shown[t, 0]] + model.length[s, shown[t, 1]] + model.ends[s, shown[t, 2]]  # noqa: E731, B023
            value = lambda path: model.start[path[0]] + seen(0, path[0]) + sum(model.move[a, b] + seen(t + 1, b) for t, (a, b) in enumerate(zip(path, path[1:])))
            best = max(value(p) for p in itertools.product(range(n), repeat=length))
            assert math.isclose(value(model.viterbi(shown).tolist()), best, rel_tol=1e-12)


def test_chat_without_ids_and_with_other_roles(spark, empty):
    turns = [(None, 0, "user", "One?"), (None, 1, "assistant", "Two."), (None, 0, "user", "One?"), (5, 0, "narrator", "Then it rained."), (5, 1, "user", "Hm?")]
    made = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    written = chat.transcripts_of(made)
    assert written.count() == 4 and written.where("conv_id is null").where("size(turns) = 1").count() == 3
    got = chat.format_chats(written, chat.train_roles(written)).collect()
    assert len(got) == 4 and all(t["role"] in chat.ROLES for r in got for t in r["turns"])
    none = chat.transcripts_of(made.where("false"))
    assert none.count() == 0 and chat.format_chats(none, chat.train_roles(none)).count() == 0


def test_js_distance_and_verdict(spark):
    def by_hand(p, q):
        kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x > 0)
        m = [(x + y) / 2 for x, y in zip(p, q)]
        return math.sqrt(max((kl(p, m) + kl(q, m)) / 2, 0))

    rng = np.random.default_rng(2)
    p, q = rng.dirichlet(np.ones(6), 5), rng.dirichlet(np.ones(6))
    p[0] = [1, 0, 0, 0, 0, 0]
    assert np.allclose(quality_rules.js_distance(p, q), [by_hand(x, q) for x in p.tolist()])
    pick = random.Random(3)
    say = lambda words, n: " ".join(pick.choice(words) for _ in range(n))
    usual = ["the", "of", "and", "house", "stone", "river", "walks", "under"]
    made = [(i, say(usual, 80), "en") for i in range(60)] + [(i, say(["".join(pick.choice("这是没有空格的一种文字") for _ in range(90))], 1), "zh") for i in range(100, 420)]
    made += [(900, say(["X9#7", "Q$2", "%%8", "ZZ&1"], 80), "en"), (901, say(["zyx", "wvu", "tsr"], 80), "en"), (902, say(usual, 80), "xx"), (903, None, "en")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()}
    # character classes and common words of "en", by hand
    texts = [(i, t) for i, t, lang in made if lang == "en" and t]
    all_words = collections.Counter(w for _, t in texts for w in t.split())
    total = sum(all_words.values())
    common = {w: n for w, n in all_words.items() if n * quality_rules.COMMON >= total}
    hist = lambda c: [*(c.get(w, 0) / max(sum(c.values()), 1) for w in common), sum(n for w, n in c.items() if w not in common) / max(sum(c.values()), 1)]
    for i, t in texts:
        assert math.isclose(got[i]["js_word"], by_hand(hist(collections.Counter(t.split())), hist(all_words)), abs_tol=1e-9)
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["js_char"] <= quality_rules.MAX_CHAR and got[i]["js_word"] <= quality_rules.MAX_WORD)
    assert all(got[i]["kept"] for i in range(60)) and not got[900]["kept"] and not got[903]["kept"] and got[902]["kept"]
    refs = quality_rules.references(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    assert refs["zh"][1] is None and math.isclose(refs["zh"][2].sum(), 1) and "xx" not in refs


def test_baum_welch_raises_the_likelihood():
    """A round is the expectation over all paths, by hand, and no round makes the training texts less likely."""
    rng = np.random.default_rng(5)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm_lm.Hmm(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 4))).T)
    seqs = [np.array(s, "<u2") for s in ([0, 3, 2, 1, 1], [2], [1, 0, 2], [3, 3])]
    batch = pa.record_batch([pa.array([s.tobytes() for s in seqs], pa.binary())], ["classes"])

    def counts(m):
        out = next(iter(hmm_lm._expect(type("B", (), {"value": m}), 4)(iter([batch]))))
        return dict(zip(out.column("k").to_pylist(), out.column("x").to_pylist()))

    emit, move, start, log = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2), 0.0
    for s in seqs:
        paths = {p: model.start[p[0]] * math.prod(model.move[a, b] for a, b in zip(p, p[1:])) * math.prod(model.emit[o, q] for o, q in zip(s, p)) for p in itertools.product(range(2), repeat=len(s))}
        whole = sum(paths.values())
        log += math.log10(whole)
        for p, v in paths.items():
            start[p[0]] += v / whole
            for o, q in zip(s, p):
                emit[o, q] += v / whole
            for a, b in zip(p, p[1:]):
                move[a, b] += v / whole
    got = counts(model)
    assert all(np.allclose(got[k], emit[k]) for k in range(4)) and np.allclose([got[-1], got[-2]], move) and np.allclose(got[-3], start) and math.isclose(got[-4][0], log)
    before = log
    for _ in range(6):
        got = counts(model)
        emit = np.array([got[k] for k in range(4)])
        model = hmm_lm.Hmm(norm(np.array(got[-3])), norm(np.array([got[-1], got[-2]])), emit / emit.sum(0))
        now = counts(model)[-4][0]
        assert now >= before - 1e-9
        before = now


def test_mix_targets_by_hand(spark):
    """Water filling, step by step: full sources give what is over to the others by weight, until none is above."""
    sizes = {"a": 10, "b": 400, "c": 30, "d": 1000, None: 55, "e": 0}
    made = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2 * sizes[s] if over else level * weight[s]
            left -= target[s] if over else 0
        open_ = open_ - over if over else set()
    got = {r["source"]: r for r in mixing.mix_sources(spark.createDataFrame(made, "doc_id long, text string, source string")).collect()}
    assert all(math.isclose(got[s]["target"], target[s], abs_tol=1e-9) for s in sizes)


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    """Null, repeated and empty rows and clashing columns go through every stage; nothing but the stage's work is lost."""
    import corpus_pipeline

    labels = f"{tmp_path}/labels.parquet"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(labels)  # nothing is known: all stay
    for table in (docs, docs.limit(0)):
        now = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            path = f"{tmp_path}/{name}-{table.count()}"
            now.write.parquet(path)
            now = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert tuple(now.columns) == corpus_pipeline.COLUMNS
            if name == "classifier":
                assert now.count() == table.count()
            if name == "near_duplicates" and table is docs:
                assert now.where("text is null or trim(text) = ''").count() == 1 and now.where("doc_id is null").count() == 0
            if name == "repeated_bytes":
                kept = now.select("doc_id", "text").collect()
        if table is docs:
            assert {r["doc_id"] for r in now.collect()} <= {r["doc_id"] for r in kept} and now.count() > 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, source)
    assert set(corpus_pipeline.COLUMNS) < set(out.columns) and 0 < out.count() < 2 * spark.read.parquet(f"{source}/documents.parquet").count()
