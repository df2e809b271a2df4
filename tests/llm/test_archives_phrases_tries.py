"""Brute-force versions, fault cases and odd rows of the archive, phrase and trie operators."""

import collections
import gzip
import hashlib
import io
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footage_spark.llm import chat, line_dedup, mixing
from footage_spark.llm import collocations as co
from footage_spark.llm import near_copies as nc
from footage_spark.llm import prefix_trie as pt
from footage_spark.llm import text as tx
from footage_spark.llm import warc

# archives


def pages_of(spark, many=30):
    made = [(i, f"http://h/{i}", f"<p>{i % 7}" * (i % 7) if i % 4 else "same page ñ", "x", 1) for i in range(many)]
    made += [(None, None, "same page ñ", "x", 1), (None, "http://a b\r\nX: 1", None, "x", 1), (77, "u", None, None, None), (77, "u", "", None, None), (78, "é", "\r\n\r\nWARC/1.1\r\n\r\n", None, None), made[3], (79, "u", "long" * 500_000, None, None)]
    return spark.createDataFrame(made, "page_id long, url string, html string, row string, keeper int").repartition(3)


def archive_by_hand(rows):
    groups = collections.defaultdict(list)
    for page_id, html in rows:
        groups[html or ""].append(page_id)
    out = collections.Counter()
    for html, ids in groups.items():
        best = max(ids, key=lambda x: -math.inf if x is None else x)
        digest = warc.base32_sha1(html.encode())
        out[best, len(html.encode()), digest, "response", None] += 1
        ids.remove(best)
        for i in ids:
            out[i, len(html.encode()), digest, "revisit", best] += 1
    return out


@pytest.mark.parametrize("most", [100_000, 3])  # 3: keepers of few pages meet by a join
def test_warc_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_KEEPERS", most)
    pages = pages_of(spark)
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert got == archive_by_hand([(r["page_id"], r["html"]) for r in pages.collect()])


def test_warc_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_files_are_what_they_say(spark, tmp_path):
    """One gzip member before, a member for each record after; the sidecar's places cut out whole records; rolling files."""
    folder = f"file://{tmp_path}/a"
    raw = warc.write_archives(warc.with_roles(pages_of(spark).coalesce(1)), f"{folder}/raw", file_bytes=3000)
    assert raw.count() > 2 and raw.agg(F.sum("records")).first()[0] == 37
    for r in raw.collect():
        with open(r["archive"].removeprefix("file://"), "rb") as file:
            body = file.read()
        one = zlib.decompressobj(31)
        text = one.decompress(body)
        assert one.eof and not one.unused_data and text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    normal = warc.normalise(raw, f"{folder}/normal")
    whole = {gzip.decompress(open(r["archive"].removeprefix("file://"), "rb").read()) for r in raw.collect()}
    for r in normal.collect():
        path = r["archive"].removeprefix("file://")
        with open(path, "rb") as file:
            body = file.read()
        assert gzip.decompress(body) in whole and r["error"] is None
        at = 0
        for line in map(json.loads, open(f"{path}.index.jsonl")):
            assert line["offset"] == at
            record = gzip.decompress(body[at : at + line["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"WARC-Record-ID: {line['id']}".encode() in record
            at += line["length"]
        assert at == len(body)
    read = warc.read_records(warc.read_index(normal, f"{folder}/normal"), payload=True)
    kept = {r["page_id"]: bytes(r["payload"]) for r in read.where("type = 'response'").collect()}
    assert kept[78] == b"\r\n\r\nWARC/1.1\r\n\r\n" and kept[79] == b"long" * 500_000 and kept[77] == b""
    assert read.where("error is not null").count() == 0
    text = b"".join(whole)
    assert b"http://a%20b%0D%0AX:%201" in text and text.count(b"WARC-Refers-To: ") == read.where("type = 'revisit'").count()
    ids = set(re.findall(rb"WARC-Record-ID: (\S+)", text))
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", text)) <= ids


def test_normaliser_takes_any_gzip_and_keeps_what_stands_before_a_fault():
    records = [warc.page_record(i, "u", str(i), "response", b"x" * (i * 5000), hashlib.sha1(b"x" * (i * 5000)).hexdigest(), i * 5000, None, None) for i in range(9)]
    one = gzip.compress(b"".join(records))
    members = b"".join(gzip.compress(r) for r in records) + b"\0" * 9

    def run(raw):
        out, index = io.BytesIO(), io.BytesIO()
        n, error = warc.normalise_stream(io.BytesIO(raw), out, index)
        return n, error, gzip.decompress(out.getvalue()[: json.loads(index.getvalue().splitlines()[-1])["offset"]]) if n else b"", out.getvalue()

    assert run(one)[:2] == (9, None) and run(members)[:2] == (9, None) and run(one)[3] == run(members)[3]
    cut = run(one[: len(one) // 2])
    assert 0 < cut[0] < 9 and "short" in cut[1] and b"".join(records).startswith(cut[2]) and b"".join(records).startswith(gzip.decompress(cut[3]))
    bad = run(gzip.compress(b"".join(records[:3]) + b"no record here\r\n\r\n" + b"".join(records[3:])))
    assert bad[0] == 3 and bad[1] == "not a WARC record"
    assert run(b"plain text")[0] == 0 and run(b"plain text")[1]
    assert run(b"")[:2] == (0, None) and run(gzip.compress(b""))[:2] == (0, None)
    broken = gzip.compress(records[2].replace(b"xxxx", b"yyyy", 1))
    assert warc.read_member(broken)["error"] and warc.read_member(gzip.compress(records[2]))["error"] is None


def test_a_missing_archive_stops_no_other(spark, tmp_path):
    raw = warc.write_archives(warc.with_roles(pages_of(spark)), f"file://{tmp_path}/raw")
    both = raw.select("archive").unionByName(spark.createDataFrame([(f"file://{tmp_path}/none.warc.gz",)], "archive string"))
    normal = warc.normalise(both, f"file://{tmp_path}/normal")
    assert normal.where("error is not null").count() == 1 and normal.agg(F.sum("records")).first()[0] == 37 + raw.count()


# phrases


def phrases_by_hand(docs, least, top=2000, percent=80):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    long = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, words), a in long.items():
        cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(o == lang and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w))) and 100 * b >= percent * a for (o, w), b in long.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    ranked, seen = [], collections.Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return ranked


def phrase_docs(seed=4, many=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "Éa", "new york", "in new york city", "x", "zz.", "a,b", "q\tq", "\n", "  ", "?!", "ñ", "one two three four five"]
    made = [(rng.choice(["en", "fr", None, ""]), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 150)))) for _ in range(many)]
    return [*made, ("en", None), ("en", ""), (None, " \t "), ("fr", "w" * 5000), ("en", "abc de f " * 2000), ("de", "once only"), made[0], made[0]]


@pytest.mark.parametrize("mass, bits, chunk, hold", [(1 << 24, 1 << 29, 1 << 20, 1 << 22), (2000, 1 << 17, 700, 3000)])  # many partitions, a bitmap that fills, ranges within pieces
def test_phrases_by_brute_force(spark, monkeypatch, mass, bits, chunk, hold):
    grams = co._grams
    monkeypatch.setattr(co, "HOLD_KEYS", hold)
    monkeypatch.setattr(co, "_grams", lambda batch: grams(batch, chunk))
    docs = phrase_docs()
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "lang string, text string, phrase string, k int").repartition(3)
    for least, top in ((30, 2000), (3, 7)):
        got = sorted(tuple(r) for r in co.mine_phrases(frame, least, top, partition_mass=mass, filter_bits=bits).collect())
        assert got == sorted(phrases_by_hand(docs, least, top)) and len(got) > 5


def test_phrases_of_nothing(spark):
    assert co.mine_phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert co.mine_phrases(spark.createDataFrame([(None, None), ("en", "a b c")], "lang string, text string")).count() == 0


def test_ranges_of_long_texts_lose_nothing():
    docs = [(x, t) for x, t in phrase_docs(9, 30)]
    batch = pa.record_batch([pa.array([x for x, _ in docs]), pa.array([t for _, t in docs])], ["lang", "text"])

    def counted(limit):
        found, words = collections.Counter(), collections.Counter()
        for grams, known, index in co._grams(batch, limit):
            text, starts, ends = grams.normal()
            words.update(known[i] for i in index[grams.row[grams.ok[0]]])
            for k in range(co.MOST_WORDS):
                found.update((known[index[grams.row[i]]], text[starts[i] : ends[i + k]].tobytes(), int(grams.g[k][i])) for i in np.flatnonzero(grams.ok[k]))
        return found, words

    whole = counted(1 << 20)
    assert all(counted(limit) == whole for limit in (40, 501, 3000))
    assert len({x[2] for x in whole[0]}) == len(whole[0])  # hashes are apart here


def test_summaries_never_lose_a_frequent_key():
    rng = np.random.default_rng(1)
    rare, often, hot = rng.integers(0, 2**32, 200_000), np.repeat(rng.integers(0, 2**32, 100), 30), np.full(100_000, 7)
    keys = np.concatenate([rare, often, hot])
    rng.shuffle(keys)
    counts = dict(zip(*np.unique(keys, return_counts=True), strict=True))
    frequent = {k for k, c in counts.items() if c >= 30}
    for capacity in (len(keys) // 30 + 1, 4000, 1):  # the last two are too few for this mass: counters grow, nothing is lost
        one = co.Summary(capacity, 30, buffer=3000)
        for a in range(0, len(keys), 2500):
            one.add(*np.unique(keys[a : a + 2500], return_counts=True))
        kept = set(one.survivors().tolist())
        assert frequent <= kept and one.taken < 30 and one.mass == len(keys)
        if capacity > len(keys) / 30:
            assert len(one.keys) <= capacity
    merged = [co.Summary(len(keys) // 30 + 1, 30) for _ in range(3)]
    for part, one in zip(np.array_split(keys, 3), merged, strict=True):
        one.add(*np.unique(part, return_counts=True))
    for one in merged[1:]:
        merged[0].merge(one)
    assert frequent <= set(merged[0].survivors().tolist()) and merged[0].taken < 30 and merged[0].mass == len(keys)


def test_packed_keys():
    for n in (0, 1, 8191, 8192, 8193, 150_001):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**32, n))
        assert (co.unpack(co.pack(keys)) == keys).all()


def test_scores_past_64_bits(spark):
    big = 3 * 10**18
    counts = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 5), ("en", "b", 1, big), ("en", None, 0, 4 * 10**18)], "lang string, phrase string, k int, c long")
    got = co.score_phrases(counts).first()
    assert got["score"] == 2_000_000 * big // (2 * big + 5) and (got["l"], got["r"]) == (big + 5, big)


def test_hot_keys_meet_by_broadcast(spark):
    big = tx.cut(spark.range(5000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), "id"))
    small = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    got = tx.join_hot(big, small, ["k"])
    assert got.count() == 5000 and got.where("v <> 3 * k").count() == 0 and "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


# tries


def trie_by_hand(turns):
    own = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    key = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0], key(x[1], x[2])))] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seq = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = collections.defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) if kids[s] else 1
        saved[s] = sum(saved[k] for k in kids[s]) + ((len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, m in members.items())


def shared_turns(seed, convs, longest, ids=None):
    rng = random.Random(seed)
    lines = [[f"line {k} of {d} é" for k in range(2)] for d in range(longest)]
    made = []
    for c in ids or range(convs):
        made += [(c, d if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]) if d % 5 == 0 else "user", None if rng.random() < 0.03 else rng.choice(lines[d])) for d in range(rng.randrange(1, longest))]
    return made


def rows_of(spark, made, **options):
    frame = spark.createDataFrame([(*m, "clash", 1) for m in made], "conv_id long, turn long, role string, text string, id string, depth int").repartition(3)
    return sorted((tuple(r) for r in pt.prefix_trie(frame, **options).collect()), key=repr)


def by_repr(rows):
    return sorted(rows, key=repr)


def test_trie_by_brute_force(spark):
    made = shared_turns(1, 90, 9)
    made += [(None, 1, "user", "nobody's"), (-3, 0, "user", "line 0 of 0 é"), (-5, 0, "user", "x"), (4999, 1, "user", "one turn, and its base is absent"), made[0], made[0]]
    made += [(c, d, "user", f"copy {d}") for c in range(5000, 5030) for d in range(4)]
    assert rows_of(spark, made) == by_repr(trie_by_hand(made))


def test_trie_with_one_very_long_conversation(spark, monkeypatch):
    """A chain of 600 turns (spread over all tasks) beside a root with many children: rounds stay few."""
    rounds = []
    cut = pt.cut
    monkeypatch.setattr(pt, "cut", lambda df: rounds.append(1) or cut(df))
    made = [(10, d, "user", f"turn {d}") for d in range(600)] + [(11, d, "user", f"turn {d}") for d in range(300)] + [(20 + c, 0, "user", f"other {c}") for c in range(200)]
    assert rows_of(spark, made) == by_repr(trie_by_hand(made))
    assert len(rounds) < 120


@pytest.mark.parametrize("run", [pt.RUN, 7])
def test_trie_is_contracted_chain_by_chain(spark, monkeypatch, run):
    """Every chain of nodes is one node of what is contracted, so long chains add no rounds (and no plans on the driver)."""
    monkeypatch.setattr(pt, "RUN", run)
    rounds = []
    cut = pt.cut
    monkeypatch.setattr(pt, "cut", lambda df: rounds.append(1) or cut(df))
    made = [(10 * c, d, "user", f"turn {d}" if d < 40 * (7 - c) else f"own {c} {d}") for c in range(7) for d in range(300)]
    assert rows_of(spark, made) == by_repr(trie_by_hand(made))
    assert len(rounds) < 40


def test_trie_of_nothing(spark):
    assert rows_of(spark, []) == []
    assert rows_of(spark, [(None, 0, "user", "x")]) == []
    assert rows_of(spark, [(7, None, None, None)]) == by_repr(trie_by_hand([(7, None, None, None)]))


def test_parts_of_a_conversation_are_in_order(spark):
    made = [(c, d, "u", f"{d}") for c in (1, 2) for d in range(500)]
    rows = pt.ordered_turns(spark.createDataFrame(made, "conv_id long, turn long, role string, text string").repartition(3), 7)
    assert rows.select("pid").distinct().count() > 3
    parts = collections.defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: (r["conv_id"], r["pid"], r["i"])):
        parts[r["conv_id"]].append(r["digest"])
    want = [hashlib.md5(f"1:u{d}".encode()).hexdigest() for d in range(500)]
    assert parts == {1: want, 2: want}


def test_contraction_of_random_trees(spark):
    rng = random.Random(5)
    for shape in (lambda i: rng.randrange(i), lambda i: max(0, i - rng.choice([1, 1, 1, 2])), lambda i: 0):
        n = 150
        parent = {i: shape(i) if i else None for i in range(n)}
        kids = collections.Counter(p for p in parent.values() if p is not None)
        tree = spark.createDataFrame([(i, parent[i], kids[i], int(kids[i] == 0), i * i) for i in range(n)], "id long, parent long, kids long, leaves long, saved long")
        want = {i: [int(kids[i] == 0), i * i] for i in range(n)}
        for i in range(n - 1, 0, -1):
            for k in (0, 1):
                want[parent[i]][k] += want[i][k]
        assert {r["id"]: [r["leaves"], r["saved"]] for r in pt.subtree_totals(tree).collect()} == want


def test_end_digests_over_several_ranges(spark):
    ids = [-5000, -1, 0, 3, 4095, 4096, 9000, 123456789]
    got = pt.end_digests(spark.createDataFrame([(2, 1, 1, i) for i in ids] + [(2, 1, 0, 9)], "depth long, k1 long, k2 long, conv_id long").repartition(3)).collect()
    digest = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert {(r["k2"], r["ends_sha256"]) for r in got} == {(1, digest(ids)), (0, digest([9]))}


# earlier operators


def odd_mix_rows():
    """Null and repeated ids, repeated rows, a source with a third of all."""
    rng = random.Random(8)
    made = [(rng.choice([None, k, k % 40]), " ".join(["w"] * rng.randrange(0, 30)) if k % 50 else None, rng.choice(["hot", "s1", "s2", None])) for k in range(900)]
    return [*made, *made[:60], *[(None, "w w w", "hot")] * 40]


def test_mix_is_the_same_however_rows_are_split(spark):
    made = odd_mix_rows()
    frame = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = []
    for k, rows in enumerate((made, made[::-1], random.Random(1).sample(made, len(made)))):
        out = mixing.mix_sources(spark.createDataFrame(rows, frame.schema).repartition(2 * k + 1), block=16)
        got.append(collections.Counter(tuple(r) for r in out.select("doc_id", "size", "source", "target", "taken").collect()))
    assert got[0] == got[1] == got[2] and sum(got[0].values()) == len(made)


def test_mix_plans_no_exchange_by_source_and_joins_beyond_the_limit(spark, monkeypatch):
    frame = spark.createDataFrame(odd_mix_rows(), "doc_id long, text string, source string")
    few = mixing.mix_sources(frame)
    assert "hashpartitioning(source" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mixing, "MOST_SOURCES", 0)
    names = ["doc_id", "size", "source", "target", "taken"]
    assert collections.Counter(map(tuple, mixing.mix_sources(frame).select(names).collect())) == collections.Counter(map(tuple, few.select(names).collect()))


def test_rows_are_named_alike_in_every_run(spark, tmp_path):
    import corpus_pipeline

    made = [(None if k % 3 else k % 20, f"text {k % 7} of several words that are shared by all of its group", "en", f"s{k % 2}", k % 5) for k in range(60)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    runs = []
    for k in (1, 4):
        frame.orderBy(F.rand(k)).repartition(k).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept = corpus_pipeline.drop_near_copies(spark, docs.withColumn("row", F.lit("clash")), None)
        runs.append([collections.Counter(map(tuple, x.collect())) for x in (kept, corpus_pipeline.mix(spark, docs, None))])
        assert tx.with_row(docs).select("row").distinct().count() == 60
    assert runs[0] == runs[1]


def chats(spark):
    turns = [(c, t, ["user", "assistant"][t % 2], f"hello {c} {t}?" if t % 2 == 0 else "A long answer.\nWith lines. " * 3) for c in range(60) for t in range(4)]
    return chat.transcripts_of(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))


def test_lines_that_go_on_with_a_turn_stay_whole(spark):
    model = chat.train_roles(chats(spark))
    text = "User: hello 1 2?\nAssistant: A long answer.\nQ: Two plus two?\nWith lines. A long answer."
    turns = chat.parse(model, text)
    states = model.viterbi(np.array([chat.line_features(x)[:3] for x in text.split("\n")]))
    said = "\n".join(x[1] for x in turns)
    for state, line in zip(states.tolist(), text.split("\n"), strict=True):
        assert (line if state % 2 else chat.line_features(line)[3]) in said
    going_on = chat.RoleModel([1, 0, 1, 0, 1, 0], np.tile([0, 1e6], (6, 3)), np.ones((6, 4)), np.ones((6, 5)), np.ones((6, 3)))
    assert chat.parse(going_on, text)[0][1] == text.removeprefix("User: ")


def test_rendered_turns_parse_to_the_same_turns():
    rng = random.Random(2)
    for _ in range(300):
        turns = [(rng.choice(chat.ROLES), "".join(rng.choice(["<|", "|>", "<", "|", "\\", "system", "<|user|>\n", "\n", "x", "<\\|"]) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(5))]
        assert chat.parse_rendered(chat.render(turns)) == turns
    assert chat.render([("user", "say <|system|>")]) == "<|user|>\nsay <\\|system|>\n"


def test_roles_of_a_style_that_was_not_trained(spark, monkeypatch):
    right = []
    for held_out in range(len(chat.STYLES)):
        every = chats(spark).withColumn("style", F.pmod(F.xxhash64("conv_id"), F.lit(len(chat.STYLES))))
        model = chat.train_roles(every.where(F.col("style") != held_out))
        got = chat.format_chats(every.where(F.col("style") == held_out).select("conv_id", "transcript"), model).collect()
        right += [[t["role"] for t in r["turns"]] == ["user", "assistant"] * 2 for r in got]
    assert len(right) == 60 and sum(right) >= 50


def test_passages_in_scripts_without_blanks(spark):
    """A Chinese, a Thai and a Japanese passage in three texts each; short sentences, and texts with blanks, are as before."""
    passages = ["这是一段没有空格的文字，它在许多文件里重复出现，所以应该只留下一份。第二句话也很长，它同样在别的文件里出现过很多次！短句。", "ข้อความนี้ไม่มีช่องว่างระหว่างคำและปรากฏในเอกสารหลายฉบับ\n", "この文章には単語の間に空白がありませんので、文字を数えます。"]
    made = [(k * 10 + i, f"第{i}号。{p}尾{i}") for k, p in enumerate(passages) for i in range(3)] + [(90, "Ça va? Oui, très bien — merci.\n" * 2), (91, None), (92, "")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_units(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for i, text in made:
        if i >= 90 or i % 10 == 0:
            assert got[i]["text"] == text and got[i]["n_removed"] == 0
    assert got[1]["text"] == "第1号。短句。尾1" and got[1]["n_removed"] == 2 and got[12]["text"] == "第2号。尾2" and got[21]["text"] == "第1号。尾1"
    # the SQL says the same
    import duckdb
    import pandas as pd

    from footage_spark.llm.queries import OP1_SQL

    documents = pd.DataFrame(made, columns=["doc_id", "text"])  # noqa: F841
    want = {r[0]: (r[1], r[3]) for r in duckdb.sql(OP1_SQL).fetchall()}
    assert {i: (r["n_removed"], r["text"]) for i, r in got.items()} == want


@pytest.mark.parametrize("size", [3, 40, 1000])
def test_pairs_of_a_large_key_meet_block_by_block(spark, size):
    rng = np.random.default_rng(6)
    bases = [rng.integers(0, 2**62, 30) for _ in range(6)]
    made = []
    for i in range(90):
        own = bases[i % 6].copy()
        own[: rng.integers(0, 6)] = rng.integers(0, 2**62)
        made.append((i % 2, i, i // 9, sorted(set(own.tolist()))))
    frame = spark.createDataFrame(made, "key long, node long, root long, set array<long>")
    placed = tx.cut(frame.drop("set").repartition(3))
    met = nc._paired_blocks(placed, size).join(frame.select("node", "set"), "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    got = {tuple(sorted(r)) for r in met.mapInArrow(nc._across, "a long, b long").collect()}
    like = lambda x, y: 5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y))
    want = {(a[1], b[1]) for a in made for b in made if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and like(a[3], b[3])}
    # those of the largest root of a block are asked from the other side, so no pair is left out
    assert got == want and len(want) > 100


def test_a_key_of_very_many_texts_is_dealt_to_bounded_groups(spark):
    placed = tx.cut(spark.range(40_000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("node"), F.col("id").alias("root")))
    groups = nc._paired_blocks(placed, 4000).groupBy("key", "low", "high").count().collect()
    assert len(groups) == 55 and max(r["count"] for r in groups) < 9000 and sum(r["count"] for r in groups) == 400_000


def test_near_copies_come_through_simhash(spark, monkeypatch):
    """Fingerprints are the majority of the shingles' bits; without any MinHash candidate the copies within 4 bits are still found, and confirmed."""
    from footage_spark.llm import simhash

    rng = np.random.default_rng(12)
    counts = np.array([0, 1, 7, 70_000, 2, 0])
    hashes = rng.integers(0, 2**64, counts.sum(), np.uint64)
    got, at = simhash.majority(hashes, counts), np.append(0, np.cumsum(counts))
    for k in range(len(counts)):
        mine = hashes[at[k] : at[k + 1]]
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * int(((mine >> np.uint64(b)) & np.uint64(1)).sum()) > len(mine))

    base = [[f"w{x}" for x in rng.integers(0, 5000, 800)] for _ in range(20)]
    made = [" ".join(w) for w in base] + [" ".join(w[:400] + ["new"] + w[401:]) for w in base] + ["no copy of any other text here"]
    docs = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(made)], "doc_id long, text string, row string")
    sets = [set(nc.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].tolist()) for t in made]
    prints = [int(simhash.majority(np.array(sorted(s), np.uint64), np.array([len(s)]))[0]) for s in sets]
    near = [i for i in range(20) if (prints[i] ^ prints[i + 20]).bit_count() <= 4]
    monkeypatch.setattr(nc, "_candidates", lambda small: lambda batches: iter(()))
    kept = {int(r["row"]) for r in nc.first_of_groups(docs).collect()}
    assert len(near) > 10 and kept == set(range(41)) - {i + 20 for i in near}
    # the exact check follows: alike in bits alone is no copy
    monkeypatch.setattr(nc, "LEAST", (1, 1))
    assert nc.first_of_groups(docs).count() == 41
