"""The thin queries op1 ... op13 over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, grade_model, hmm_lm, line_dedup, media, mixing, prefix_trie, quality_rules, simhash, suffix_dedup, warc

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE)


def op1_line_dedup(spark, sf_dir):
    """Every row of documents with its repeated units cut out, and their places as start:length."""
    places = F.transform("removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["length"].cast("string")))
    return line_dedup.dedup_units(table(spark, sf_dir, "documents")).withColumn("removed", F.concat_ws(",", places))


def op2_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op4_hmm_lm(spark, sf_dir):
    return hmm_lm.score_texts(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), rank_path())


def op8_progressive_jpeg(spark, sf_dir):
    return media.media_digests(media.encode_media(table(spark, sf_dir, "documents")))


def op9_grade_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = grade_model.train(docs, table(spark, sf_dir, "labels"))
    return grade_model.grade(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "p_tail", "kept")


def op10_chat_format(spark, sf_dir):
    """Transcripts written from conversations, parsed again: roles of the turns and the canonical text."""
    written = chat.transcripts_of(table(spark, sf_dir, "conversations"))
    held_out = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 5 == 1, F.lit(False))
    model = chat.train_roles(written.where(~held_out))
    parsed = chat.format_chats(written.select("conv_id", "transcript"), model)
    roles = F.concat_ws(",", F.transform("turns", lambda t: t["role"]))
    return parsed.select("conv_id", F.size("turns").alias("n_turns"), roles.alias("roles"), "rendered")


def op11_warc(spark, sf_dir):
    """Pages as WARC records, written as whole-file gzip streams, made seekable and read back by the index."""
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op12_collocations(spark, sf_dir):
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries():
    return {
        f.__name__: f
        for f in (op1_line_dedup, op2_mix_sources, op3_suffix_dedup, op4_hmm_lm, op5_quality_rules, op6_simhash, op7_bpe, op8_progressive_jpeg, op9_grade_model, op10_chat_format, op11_warc, op12_collocations, op13_prefix_trie)
    }


#: op1: the units, their normal form and the rank are plain SQL; chr(1) marks the ends of units.
OP1_SQL = r"""
WITH u AS (
  SELECT doc_id, i AS place, parts[i] AS unit, trim(regexp_replace(lower(parts[i]), '[ \t\n\r\f\v]+', ' ', 'g')) AS norm
  FROM (
    SELECT doc_id, string_split(regexp_replace(replace(regexp_replace(text, '([.!?])([ \t\n\r\f\v])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), '([\x{3002}\x{FF01}\x{FF1F}])', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents
  ) d, unnest(range(1, len(parts) + 1)) t(i)
), p AS (
  SELECT *, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u
), k AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) AS rank FROM p
  WHERE norm <> '' AND len(string_split(norm, ' ')) + length(regexp_replace(unit, '[^\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{3134F}]', '', 'g')) >= 16
), gone AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(CAST(start AS INTEGER) AS VARCHAR) || ':' || CAST(length(unit) AS VARCHAR), ',' ORDER BY place) AS removed
  FROM k WHERE rank > 1 GROUP BY doc_id
), kept AS (
  SELECT p.doc_id, string_agg(p.unit, '' ORDER BY p.place) AS text
  FROM p LEFT JOIN k ON p.doc_id = k.doc_id AND p.place = k.place
  WHERE k.rank IS NULL OR k.rank = 1 GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(coalesce(gone.n, 0) AS INTEGER) AS n_removed, coalesce(gone.removed, '') AS removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


#: op11: base 32 of the SHA-1, four letters of each five hexadecimal digits.
OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((('0x' || substr(d, CAST(k // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM h
"""


#: op12: pieces, words and all phrases of 1 to 4 words; products as HUGEINT.
OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, list_aggregate(ws[i:i + k - 1], 'string_agg', ' ') AS phrase FROM w, unnest(range(1, 5)) x(k), unnest(range(1, len(ws) - k + 2)) y(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cuts AS (SELECT c.*, j, fl.a AS l, fr.a AS r, CAST(2000000::HUGEINT * c.a // (fl.a + fr.a) AS BIGINT) AS score
  FROM c, unnest(range(1, k)) x(j)
  JOIN f fl ON fl.lang = c.lang AND fl.phrase = list_aggregate(ws[1:j], 'string_agg', ' ')
  JOIN f fr ON fr.lang = c.lang AND fr.phrase = list_aggregate(ws[j + 1:], 'string_agg', ' ')),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT DISTINCT c.lang, list_aggregate(ws[i:i + m - 1], 'string_agg', ' ') AS phrase, c.a AS f FROM c, unnest(range(2, k)) x(m), unnest(range(1, k - m + 2)) y(i)),
top AS (SELECT lang, phrase, max(f) AS f FROM inner_ GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN top ON s.lang = top.lang AND s.phrase = top.phrase WHERE top.f IS NULL OR 100 * top.f < 80 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN t ON t.lang = ranked.lang WHERE rank <= 2000
"""


#: op13: CRC-32 bit by bit; a node is the list of its turns, and its subtree the nodes whose first conversation passes it.
OP13_SQL = """
WITH o AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS BIGINT) % 9 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[1:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, d AS depth, ts[1:d] AS key, d = len(ts) AS is_end FROM r, unnest(range(0, len(ts) + 1)) x(d)),
n AS (SELECT min(conv_id) AS conv_id, depth, key, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '') AS ends FROM m GROUP BY depth, key),
p AS (SELECT n.*, u.conv_id AS parent_conv_id, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.key[n.depth].t) END AS saved FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.key = n.key[1:n.depth - 1]),
k AS (SELECT p.*, (SELECT count(*) FROM p c WHERE c.depth = p.depth + 1 AND c.parent_conv_id = p.conv_id) AS n_children FROM p),
a AS (SELECT m.depth, m.key, sum(k.saved) AS saved, count(*) FILTER (k.n_children = 0) AS leaves FROM k JOIN m ON m.conv_id = k.conv_id AND m.depth <= k.depth GROUP BY m.depth, m.key)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(k.ends) AS ends_sha256
FROM k JOIN a ON a.depth = k.depth AND a.key = k.key
"""


def oracle_sql():
    return {"op13_prefix_trie": OP13_SQL, "op12_collocations": OP12_SQL, "op1_line_dedup": OP1_SQL, "op11_warc": OP11_SQL}
