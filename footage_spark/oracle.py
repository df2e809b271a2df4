"""DuckDB SQL for the queries, straight from the given tables."""

from __future__ import annotations

FRAMES = """f AS (
  SELECT 'cam_' || label AS recording, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index,
         list_transform(embedding, lambda e: CAST(least(greatest(floor((CAST(e AS DOUBLE) + 0.5) * 256.0), 0), 255) AS INTEGER)) AS raws
  FROM embeddings)"""
HEX = "list_aggregate(list_transform({0}, lambda r: printf('%02x', r)), 'string_agg', '')"
LEVEL = "CAST(least(greatest(floor((r + 49.0) * 1.36 + 0.5), 0), 255) AS INTEGER)"
RAW_MD5 = f"md5(unhex({HEX.format('raws')}))"
MAPPED = f"list_transform(raws, lambda r: {LEVEL})"
MAPPED_MD5 = f"md5(unhex({HEX.format(MAPPED)}))"
TICKS = "t AS (SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_index, epoch_us(ts) AS tick FROM events)"
PIXELS = f"{FRAMES}, p AS (SELECT recording, frame_index, i AS pos, raws[i + 1] AS r FROM f, unnest(range(0, 64)) u(i))"
COUNTED = "SELECT 'cam_' || label AS recording, count(*) AS n FROM embeddings GROUP BY label"
FX4 = """ref AS (SELECT doc_id, text FROM documents),
  o AS (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN text || 'x' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0),
  d AS (SELECT coalesce(ref.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'only_ref' WHEN ref.doc_id IS NULL THEN 'only_out' WHEN ref.text = o.text THEN 'equal' ELSE 'mismatch' END AS outcome
        FROM ref FULL OUTER JOIN o ON ref.doc_id = o.doc_id)"""
CATALOG = """c AS (
  SELECT p_partkey, p_brand, p_size AS w, p_size + 1 AS h, 8 + CAST(p_size AS BIGINT) * (p_size + 1) AS stride, p_partkey * 1000 + 10 AS size,
         CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS n, p_partkey % 11 <> 0 AS has FROM part),
  k AS (SELECT *, size // stride AS cap, least(coalesce(CASE WHEN n > 0 THEN n END, size // stride), size // stride) AS total FROM c),
  s AS (SELECT *, CASE WHEN total <= 0 THEN 'no frames' WHEN NOT has THEN 'no processing settings' ELSE 'ok' END AS status FROM k)"""

SQL: dict[str, str] = {
    "s1_discover_recordings": f"SELECT recording AS stem, recording AS out_name, n * 72 AS file_size FROM ({COUNTED})",
    "s2_parse_footage": """SELECT p_partkey, p_size AS xml_width, p_size + 1 AS xml_height, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS num_images, 500.0::DOUBLE AS framerate,
      CASE WHEN p_partkey % 11 <> 0 THEN p_size::DOUBLE END AS brightness, CASE WHEN p_partkey % 11 <> 0 THEN 18::DOUBLE END AS contrast, CASE WHEN p_partkey % 11 <> 0 THEN 1::DOUBLE END AS gamma,
      p_brand AS camera_name, p_partkey % 11 <> 0 AS has_processing FROM part""",
    "s3_recordings": f"""SELECT recording AS stem, 8 AS width, 8 AS height, n AS num_images, 72::BIGINT AS frame_stride, n AS capacity_frames, n AS frames_total, 0::BIGINT AS trailing_bytes,
      true AS verified_operating_point, 'ok' AS status FROM ({COUNTED})""",
    "s4_resolve_geometry": f"WITH {CATALOG} SELECT p_partkey, w AS width, h AS height, stride AS frame_stride, cap AS capacity_frames, size % stride AS trailing_bytes FROM s",
    "s5_resolve_frame_count": f"WITH {CATALOG} SELECT p_partkey, total AS frames_total, status FROM s",
    "s6_footage": f"WITH {FRAMES} SELECT recording, frame_index, 10000000 + 2000 * frame_index AS tick, 8 AS width, 8 AS height, {RAW_MD5} AS md5 FROM f",
    "s7_frame_range": f"WITH {FRAMES} SELECT recording, frame_index, {RAW_MD5} AS md5 FROM f WHERE frame_index BETWEEN 10 AND 24",
    "s8_read_timestamps": f"WITH {FRAMES} SELECT recording, frame_index, 10000000 + 2000 * frame_index AS timestamp_raw, printf('0x%016X', 10000000 + 2000 * frame_index) AS timestamp_hex FROM f",
    "s9_frame_lookup": f"WITH {FRAMES}, n AS ({COUNTED}) SELECT f.recording, frame_index, {MAPPED_MD5} AS md5 FROM f JOIN n ON f.recording = n.recording AND frame_index = n // 2",
    "s10_list_frame_images": "SELECT printf('shot_%05d.Png', o_orderkey) AS file_name, o_orderkey AS frame_index FROM orders WHERE o_orderkey % 5 <> 0",
    "s11_read_frame_images": f"WITH {FRAMES} SELECT recording, frame_index, 8 AS width, 8 AS height, 16 AS bit_depth, 6 AS color_type, CAST(NULL AS VARCHAR) AS error, {MAPPED_MD5} AS md5 FROM f",
    "t1_build_lut": """WITH g AS (SELECT DISTINCT p_size AS b FROM part), r AS (SELECT b, CAST(i AS INTEGER) AS raw, least(greatest(floor((i + b) * 1.36 + 0.5), 0), 255) AS l FROM g, unnest(range(0, 256)) u(i))
      SELECT b, raw, CAST(CASE WHEN b % 2 = 0 THEN floor(255.0 * pow(l / 255.0, 1.0 / 2.2::DOUBLE) + 0.5) ELSE l END AS INTEGER) AS level FROM r""",
    "t2_apply_display_transform": f"WITH {FRAMES} SELECT recording, frame_index, {MAPPED_MD5} AS md5 FROM f",
    "t3_resolve_mode": f"WITH {CATALOG} SELECT p_partkey, 'reference' AS mode, CASE WHEN has THEN w::DOUBLE END AS mode_b, CASE WHEN has THEN 18::DOUBLE END AS mode_c, CASE WHEN has THEN 1::DOUBLE END AS mode_g, status FROM s",
    "t4_expand_layout": f"WITH {FRAMES} SELECT recording, frame_index, 512 AS n_bytes, md5(unhex(list_aggregate(list_transform({MAPPED}, lambda v: repeat(printf('%02x', v), 6) || 'ffff'), 'string_agg', ''))) AS md5 FROM f",
    "t5_explode_pixels": f"WITH {PIXELS} SELECT recording, frame_index, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y, r AS raw, {LEVEL} AS mapped FROM p",
    "t6_frame_names": "SELECT o_orderkey, printf('shot_%05d.Png', o_orderkey) AS file_name, 'cam_' || (o_orderkey // 10) || '_' || (o_orderkey % 10) AS out_name FROM orders",
    "t7_playback_timeline": f"WITH {FRAMES} SELECT recording, frame_index, (frame_index - 5) / 25.0::DOUBLE AS pts, {MAPPED_MD5} AS md5 FROM f WHERE frame_index BETWEEN 5 AND 24",
    "j1_sidecar_pairing": "SELECT p_partkey, p_partkey % 3 > 0 AS paired, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS xml_width FROM part",
    "j2_verify_pairing": f"WITH {FRAMES} SELECT recording || printf('/cam_%05d.Png', frame_index) AS file_name, frame_index, CASE WHEN frame_index % 2 = 0 THEN 'equal' ELSE 'only_ref' END AS outcome FROM f",
    "j3_params_to_frames": f"""WITH {FRAMES}, b AS (SELECT *, 10.0::DOUBLE * CAST(substr(recording, 5) AS INTEGER) AS mode_b FROM f)
      SELECT recording, frame_index, mode_b, md5(unhex({HEX.format("list_transform(raws, lambda r: CAST(least(greatest(floor((r + mode_b) * 1.36 + 0.5), 0), 255) AS INTEGER))")})) AS md5 FROM b""",
    "a1_recording_metadata": f"""WITH {TICKS}, g AS (SELECT recording, count(*) AS frames, arg_min(tick, frame_index) AS first_tick, arg_max(tick, frame_index) AS last_tick FROM t GROUP BY recording)
      SELECT *, CASE WHEN frames > 1 AND last_tick > first_tick THEN round((frames - 1) / ((last_tick - first_tick) / 1e6), 3) END AS effective_fps FROM g""",
    "a2_effective_fps": f"""WITH {TICKS}, g AS (SELECT recording, count(*) AS n, arg_min(tick, frame_index) AS a, arg_max(tick, frame_index) AS b FROM t GROUP BY recording)
      SELECT recording, CASE WHEN n > 1 AND b > a THEN round((n - 1) / ((b - a) / 1e6), 3) END AS effective_fps FROM g""",
    "a3_extract_report": f"SELECT recording, n AS frames_written, n AS frames_total, n * 72 AS input_bytes, n * 1142 AS output_bytes, 1142.0::DOUBLE AS bytes_a_frame FROM ({COUNTED})",
    "a4_pixel_histogram": f"WITH {PIXELS} SELECT recording, r AS raw, count(*) AS n FROM p GROUP BY recording, r",
    "a5_saturation_report": f"""WITH {PIXELS} SELECT recording, count(*) AS n_pixels, count(*) FILTER (floor((r + 49.0) * 1.36 + 0.5) > 255) AS n_clipped,
      round(count(*) FILTER (floor((r + 49.0) * 1.36 + 0.5) > 255) / count(*)::DOUBLE, 6) AS clipped_share, count(DISTINCT r) AS raw_levels, count(DISTINCT {LEVEL}) AS mapped_levels FROM p GROUP BY recording""",
    "a6_verify_report": f"""WITH {FX4}, n AS (SELECT count(*) FILTER (outcome <> 'only_out') AS files_ref, count(*) FILTER (outcome <> 'only_ref') AS files_out, count(*) FILTER (outcome IN ('equal', 'mismatch')) AS compared,
      count(*) FILTER (outcome = 'mismatch') AS mismatched, count(*) FILTER (outcome = 'only_ref') AS only_ref, count(*) FILTER (outcome = 'only_out') AS only_out, min(doc_id) FILTER (outcome = 'mismatch') AS first_mismatch FROM d)
      SELECT *, CASE WHEN only_ref = 0 AND only_out = 0 THEN 'EQUAL' WHEN only_out = 0 THEN 'SUBSET-OK' ELSE 'DIFFER' END AS names, mismatched = 0 AND only_ref = 0 AND only_out = 0 AND files_out > 0 AS passed FROM n""",
    "a7_batch_summary": f"""WITH {CATALOG} SELECT p_brand AS camera_dir, count(*) AS recordings, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed,
      CAST(coalesce(sum(total) FILTER (status = 'ok'), 0) AS BIGINT) AS frames FROM s GROUP BY ROLLUP (p_brand)""",
    "w1_tick_delta": f"""WITH {TICKS}, d AS (SELECT *, tick - lag(tick) OVER (PARTITION BY recording ORDER BY frame_index) AS delta FROM t)
      SELECT recording, frame_index, tick, delta, coalesce(delta <= 0, false) AS not_monotonic, coalesce(delta > 1.5e9, false) AS gap,
      CASE WHEN delta > 1.5e9 THEN CAST(greatest(floor(delta / 1e9 + 0.5) - 1, 0) AS BIGINT) ELSE 0 END AS dropped FROM d""",
    "w3_time_marker_check": f"""WITH {TICKS} SELECT recording, tick AS first_tick, tick + CASE WHEN recording % 3 = 0 THEN 1 ELSE 0 END AS time_marker_reference, recording % 3 <> 0 AS matches FROM t WHERE frame_index = 0""",
    "o1_first_mismatch": f"WITH {FX4} SELECT doc_id, outcome FROM d WHERE outcome = 'mismatch' ORDER BY doc_id LIMIT 5",
    "v1_verify_frames": f"WITH {FX4} SELECT doc_id, outcome FROM d",
    "v2_name_set_compare": f"WITH {FX4}, n AS (SELECT count(*) FILTER (outcome = 'only_ref') AS only_ref, count(*) FILTER (outcome = 'only_out') AS only_out FROM d) SELECT *, CASE WHEN only_ref = 0 AND only_out = 0 THEN 'EQUAL' WHEN only_out = 0 THEN 'SUBSET-OK' ELSE 'DIFFER' END AS verdict FROM n",
    "v3_fingerprint_set_equal": f"WITH {FX4}, a AS (SELECT md5(text) AS m FROM ref EXCEPT ALL SELECT md5(text) FROM o), b AS (SELECT md5(text) AS m FROM o EXCEPT ALL SELECT md5(text) FROM ref) SELECT *, only_a = 0 AND only_b = 0 AS equal FROM (SELECT (SELECT count(*) FROM a) AS only_a, (SELECT count(*) FROM b) AS only_b)",
    "x1_write_timestamps": f"WITH {TICKS} SELECT 'cam_' || recording || '_timestamps' AS name, frame_index, tick AS timestamp_raw, printf('0x%016X', tick) AS timestamp_hex FROM t",
    "x2_encode_frames": f"WITH {FRAMES} SELECT recording, frame_index, layout, {MAPPED_MD5} AS md5, CAST(NULL AS VARCHAR) AS error FROM f, (VALUES ('gray8'), ('gray16'), ('rgba8'), ('rgba16')) l(layout)",
    "x3_bmp_tiff": f"WITH {FRAMES} SELECT recording, frame_index, format, n_bytes, {MAPPED_MD5} AS md5 FROM f, (VALUES ('bmp', 1142), ('tiff', 198)) l(format, n_bytes)",
    "x4_write_frame_files": f"WITH {FRAMES} SELECT recording, frame_index, 198::BIGINT AS bytes FROM f",
    "x5_write_metadata": f"SELECT recording AS out_name, 8 AS width, n AS frames, 10000000 + 2000 * (n - 1) AS last_tick, 500.0::DOUBLE AS effective_fps, recording AS camera FROM ({COUNTED})",
    "x6_extract": f"SELECT recording, n AS frames_written, n AS frames_total, n * 72 AS input_bytes FROM ({COUNTED}) WHERE recording = 'cam_3'",
    "x7_batch_extract": f"SELECT recording, n AS frames_written, n AS frames_total, n * 72 AS input_bytes FROM ({COUNTED})",
    "f1_frame_fingerprint": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents",
    "st1_ingest_new_recordings": f"SELECT recording AS stem, 1::BIGINT AS times, n AS frames_total, 'ok' AS status FROM ({COUNTED})",
    "st1_late_recordings": f"""WITH n AS ({COUNTED}) SELECT recording AS stem, 'ok' AS status, 1::BIGINT AS times FROM n WHERE recording <> 'cam_5'
      UNION ALL SELECT recording, s, 1 FROM n, (VALUES ('incomplete'), ('expired')) v(s) WHERE recording = 'cam_5' OR (recording = 'cam_3' AND s = 'incomplete')""",
    "s7_source_options": f"WITH {FRAMES} SELECT recording, frame_index, 10000000 + 2000 * frame_index AS tick, 8 AS width, 8 AS height, {RAW_MD5} AS md5 FROM f WHERE frame_index BETWEEN 10 AND 19 AND recording IN ('cam_0', 'cam_1', 'cam_2', 'cam_3', 'cam_4', 'cam_9')",
    "t6_name_register": """WITH b AS (SELECT p_partkey, replace(p_brand, '#', '_') AS base FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey % 2, p_partkey) AS k FROM b)
      SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS out_name FROM k""",
    "v1_verify_images": f"""WITH {FRAMES} SELECT layout, recording || printf('/cam_%05d.Png', frame_index) AS file_name, frame_index, CASE WHEN frame_index % 5 = 1 OR frame_index % 7 = 3 THEN 'mismatch' ELSE 'equal' END AS outcome
      FROM f, (VALUES ('gray8'), ('gray16'), ('rgba8'), ('rgba16')) l(layout)""",
    "a4_grouped_histograms": f"""WITH {PIXELS}, m AS (SELECT *, CASE WHEN CAST(substr(recording, 5) AS INTEGER) % 2 = 0 THEN 'raw' ELSE 'reference' END AS mode FROM p)
      SELECT 'frame' AS level, recording, frame_index, mode, r AS raw, count(*) AS n FROM m GROUP BY ALL
      UNION ALL SELECT 'recording', recording, NULL, NULL, r, count(*) FROM m GROUP BY recording, r
      UNION ALL SELECT 'mode', NULL, NULL, mode, r, count(*) FROM m GROUP BY mode, r""",
    "a7_batch_status": f"""WITH {CATALOG}, g AS (SELECT grouping_id(p_brand, p_partkey) AS g, p_brand AS camera_dir, p_partkey, count(*) AS recordings, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS failed,
        CAST(coalesce(sum(total) FILTER (status = 'ok'), 0) AS BIGINT) AS frames, min(status) AS own FROM s GROUP BY GROUPING SETS ((p_brand, p_partkey), (p_brand), ()))
      SELECT CASE g WHEN 0 THEN 'recording' WHEN 1 THEN 'camera' ELSE 'batch' END AS level, camera_dir, p_partkey, recordings, ok, failed, frames, CASE WHEN g = 0 THEN own WHEN failed > 0 THEN 'failed' ELSE 'ok' END AS status FROM g""",
}
SQL["j3_curve_table"] = SQL["j3_params_to_frames"]
SQL["flagship"] = SQL["a5_saturation_report"]
