"""DuckDB SQL for the media queries."""

from __future__ import annotations

from .fixtures import BARRED_SQL, CACHE_SQL, FILES_SQL, KEY_SQL, NOW, PIXELS_SQL, PROBES_SQL, SIGNATURES_SQL

EXT = "regexp_matches(lower(regexp_extract(path, '[^/]+\\.([^./]+)$', 1)), '^(mp4|mkv|avi|mov|wmv|flv|webm|m4v|mpg|mpeg|ts|mts|m2ts|vob|3gp|ogv|rm|rmvb|divx)$')"
KEY = KEY_SQL.format(size="size")
TEXT = {
    "hit": f"hit AS (SELECT f.path, f.k AS cache_key, c.last_used FROM (SELECT *, {KEY} AS k FROM files) f JOIN cache c ON f.k = c.cache_key)",
    "miss": f"miss AS (SELECT path, k AS cache_key FROM (SELECT *, {KEY} AS k FROM files) WHERE k NOT IN (SELECT cache_key FROM cache))",
}
OUTCOMES = f"""WITH {FILES_SQL}, {CACHE_SQL}, {TEXT['hit']}, {TEXT['miss']},
o AS (SELECT path, 'Cached' AS outcome, NULL::VARCHAR AS error FROM hit
 UNION ALL SELECT path, CASE WHEN contains(path, '.') THEN 'Computed' ELSE 'Error' END, CASE WHEN contains(path, '.') THEN NULL ELSE 'ERROR: ' || path || ' - no decoder' END FROM miss)"""


def tenths(top: str, unit: int) -> str:
    """Half to even with one decimal."""
    t = f"(({top})::HUGEINT * 10)"
    n = f"({t} // {unit} + (CASE WHEN {t} % {unit} * 2 > {unit} OR ({t} % {unit} * 2 = {unit} AND ({t} // {unit}) % 2 = 1) THEN 1 ELSE 0 END))"
    return f"(({n} // 10)::VARCHAR || '.' || ({n} % 10)::VARCHAR)"


NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def num(e: str) -> str:
    return f"(CASE WHEN regexp_matches({e}, '{NUM}') THEN try_cast({e} AS DOUBLE) END)"


def dur(e: str) -> str:
    t = f"trim({e})"
    p = [num(f"string_split({t}, ':')[{k}]") for k in (1, 2, 3)]
    n = f"len(string_split({t}, ':'))"
    return f"(CASE WHEN {num(t)} IS NOT NULL THEN CASE WHEN {num(t)} >= 0 THEN {num(t)} END WHEN {n} = 3 THEN {p[0]} * 3600 + {p[1]} * 60 + {p[2]} WHEN {n} = 2 THEN {p[0]} * 60 + {p[1]} END)"


def fps(e: str) -> str:
    a, b = (num(f"trim(string_split({e}, '/')[{k}])") for k in (1, 2))
    v = f"({a} / nullif({b}, 0))"
    return f"(CASE WHEN {v} > 0 AND {v} < 1000 THEN {v} END)"


def string_at(path: str) -> str:
    return f"(CASE WHEN json_type(json, '{path}') = 'VARCHAR' THEN json_extract_string(json, '{path}') END)"


S = "$.streams[0]."
META = f"""{PROBES_SQL}, raw AS (SELECT file_id, group_id, coalesce({string_at(S + 'duration')}, {string_at('$.format.duration')}) AS d, coalesce({string_at(S + 'avg_frame_rate')}, {string_at(S + 'r_frame_rate')}) AS r,
  {string_at(S + 'codec_name')} AS codec, coalesce({string_at(S + 'bit_rate')}, {string_at('$.format.bit_rate')}) AS b,
  CAST(json_extract(json, '{S}width') AS BIGINT) AS w, CAST(json_extract(json, '{S}height') AS BIGINT) AS h FROM probe),
meta AS (SELECT file_id, group_id, duration_secs, CASE WHEN ok THEN fps END AS fps, CASE WHEN ok THEN codec END AS codec, CASE WHEN ok THEN bitrate_bps END AS bitrate_bps, CASE WHEN ok THEN width END AS width, CASE WHEN ok THEN height END AS height
  FROM (SELECT *, duration_secs IS NOT NULL AS ok FROM (SELECT file_id, group_id, {dur('d')} AS duration_secs, {fps('r')} AS fps, codec, try_cast(b AS BIGINT) AS bitrate_bps, CASE WHEN w IS NOT NULL THEN least(w, 16384) END::INT AS width, CASE WHEN h IS NOT NULL THEN least(h, 16384) END::INT AS height FROM raw)))"""
RANK = "CASE WHEN c LIKE '%av1%' THEN 4 WHEN regexp_matches(c, 'hevc|h265|265|vp9') THEN 3 WHEN regexp_matches(c, 'h264|264|avc|vp8') THEN 2 WHEN regexp_matches(c, 'mpeg|xvid|divx|wmv') THEN 1 ELSE 0 END"
TIERS = f"""{META}, scored AS (SELECT *, (coalesce(width, 0)::HUGEINT * coalesce(height, 0)) * 1000000000000 + ({RANK}) * 100000000000 + coalesce(bitrate_bps, 0) AS score FROM (SELECT *, lower(coalesce(codec, '')) AS c FROM meta)),
tiers AS (SELECT *, CASE WHEN max(score) OVER g = min(score) OVER g OR score = 0 THEN 'unknown' WHEN score = max(score) OVER g THEN 'best' ELSE 'worse' END AS tier FROM scored WINDOW g AS (PARTITION BY group_id))"""
DURATIONS = "d AS (SELECT o_orderkey AS file_id, ((o_orderkey * 37) % 4000) / 8.0::DOUBLE AS secs FROM orders)"
SIZES = "z AS (SELECT o_orderkey AS file_id, (o_orderkey * o_orderkey * 9973) % 5000000000 AS n FROM orders)"
FMT_DURATION = "CASE WHEN {t} // 3600 > 0 THEN ({t} // 3600)::VARCHAR || ':' || lpad(({t} % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({t} % 60)::VARCHAR, 2, '0') ELSE ({t} // 60)::VARCHAR || ':' || lpad(({t} % 60)::VARCHAR, 2, '0') END"
FMT_BITRATE = "CASE WHEN {n} >= 1048576 THEN " + tenths("{n}", 1048576).replace("{n}", "{n}") + " || ' Mb/s' ELSE ({n} // 1024)::VARCHAR || ' kb/s' END"


def fmt_size(n: str) -> str:
    out = ""
    for k, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        out += f"WHEN {n} >= {1 << 10 * k} THEN regexp_replace(CAST(CAST(round({n} / {float(1 << 10 * k)}::DOUBLE, 2) AS DECIMAL(20,2)) AS VARCHAR), '\\.?0+$', '') || ' {unit}' "
    return f"CASE {out}ELSE {n}::VARCHAR || ' B' END"


# Recursive members come first in a WITH RECURSIVE list that also holds plain ones.
BUCKETS = f"""{SIGNATURES_SQL},
anchors AS (SELECT min(duration_ms) AS a FROM sig
  UNION ALL SELECT min(s.duration_ms) FROM anchors, sig s WHERE s.duration_ms > a AND abs(s.duration_ms - a) / greatest(a, 1.0)::DOUBLE > 20.0::DOUBLE / 100.0::DOUBLE HAVING min(s.duration_ms) IS NOT NULL),
bucketed AS (SELECT s.*, (SELECT count(*) FROM anchors WHERE a <= s.duration_ms) - 1 AS bucket_id FROM sig s)"""
DIST = "CAST(bit_count(xor({a}, {b})) / 16.0::DOUBLE AS FLOAT)"
PAIRS = f"""{BUCKETS},
pairs AS (SELECT * FROM (SELECT a.bucket_id, a.input_pos AS a_pos, b.input_pos AS b_pos, a.path AS a_path, b.path AS b_path, a.duration_ms AS a_ms, b.duration_ms AS b_ms, a.h AS ha, b.h AS hb,
    {DIST.format(a='a.h[len(a.h) // 2 + 1].bits', b='b.h[len(b.h) // 2 + 1].bits')} AS d_mid
  FROM bucketed a JOIN bucketed b ON a.bucket_id = b.bucket_id AND (a.duration_ms < b.duration_ms OR (a.duration_ms = b.duration_ms AND a.input_pos < b.input_pos)))
  WHERE d_mid <= 0.3::FLOAT * 1.5::FLOAT)"""
ALIGNED = f"list_transform(range(1, len(ha) + 1), lambda k: {DIST.format(a='ha[k].bits', b='hb[k].bits')})"
MEAN = "(list_reduce(list_transform({d}, lambda x: 1::FLOAT - x), lambda s, x: s + x) / len({d})::FLOAT)"


def alignment(clip: str, source: str) -> str:
    """The list of scores by offset, 0 where too few windows match."""
    d = f"list_transform(range(1, len({clip}) + 1), lambda k: {DIST.format(a=f'{clip}[k].bits', b=f'{source}[k + o].bits')})"
    enough = f"(len(list_filter({d}, lambda y: y <= 0.3::FLOAT))::FLOAT / len({clip})::FLOAT) >= 0.5::FLOAT"
    return f"CASE WHEN len({source}) >= len({clip}) THEN list_transform(range(0, len({source}) - len({clip}) + 1), lambda o: CASE WHEN {enough} THEN {MEAN.format(d=d)} ELSE 0::FLOAT END) END"


EDGES = f"""{PAIRS},
step1 AS (SELECT *, CASE WHEN len(ha) = len(hb) THEN {ALIGNED} END AS d, least(a_ms, b_ms)::DOUBLE / greatest(a_ms, b_ms, 1) >= 0.1 AS fits FROM pairs),
step2 AS (SELECT *, CASE WHEN d IS NOT NULL AND (len(list_filter(d, lambda x: x <= 0.3::FLOAT))::FLOAT / len(d)::FLOAT) >= 0.6::FLOAT THEN {MEAN.format(d='d')} END AS mean,
  {alignment('ha', 'hb')} AS offs FROM step1),
step3 AS (SELECT *, CASE WHEN mean IS NULL AND fits AND list_max(offs) > 0 THEN list_max(offs) END AS sub FROM step2),
edges AS (SELECT *, coalesce(mean, sub, 1::FLOAT - d_mid) AS visual_score,
  CASE WHEN mean IS NOT NULL THEN CASE WHEN mean >= 0.97::FLOAT THEN 'Identical' ELSE 'SameContent' END WHEN sub IS NOT NULL THEN 'SubClip' WHEN 1::FLOAT - d_mid >= 1::FLOAT - 0.3::FLOAT THEN 'Similar' END AS kind,
  CASE WHEN mean IS NULL AND sub IS NOT NULL THEN hb[list_position(offs, sub)].start_ms END AS offset_ms,
  CASE WHEN mean IS NULL AND sub IS NOT NULL THEN 'A' END AS clip_is FROM step3)"""
CLUSTER = f"""{EDGES},
matches AS MATERIALIZED (SELECT bucket_id, a_pos, b_pos, a_path, b_path, a_ms, b_ms, kind, offset_ms, clip_is FROM edges WHERE kind IS NOT NULL),
items AS MATERIALIZED (SELECT bucket_id, b_pos, row_number() OVER (PARTITION BY bucket_id ORDER BY b_ms, b_pos) AS k, list(a_pos) AS nbrs FROM matches GROUP BY bucket_id, b_pos, b_ms),
walk AS (SELECT DISTINCT bucket_id, 0::BIGINT AS k, []::BIGINT[] AS m FROM items
  UNION ALL SELECT w.bucket_id, i.k, CASE WHEN len(list_filter(i.nbrs, lambda x: NOT list_contains(w.m, x))) > 0 THEN list_append(w.m, i.b_pos) ELSE w.m END FROM walk w JOIN items i ON i.bucket_id = w.bucket_id AND i.k = w.k + 1),
follows AS (SELECT unnest(m) AS id FROM (SELECT arg_max(m, k) AS m FROM walk GROUP BY bucket_id)),
members AS (SELECT b_pos, b_path, b_ms, arg_min({{'pos': a_pos, 'path': a_path, 'ms': a_ms, 'kind': kind, 'offset_ms': offset_ms, 'clip_is': clip_is}}, (a_ms, a_pos)) AS l
  FROM matches WHERE b_pos IN (SELECT id FROM follows) AND a_pos NOT IN (SELECT id FROM follows) GROUP BY ALL),
grp AS (SELECT l.pos AS leader_pos, l.path AS leader_path, l.ms AS leader_ms, list(b_path ORDER BY b_ms, b_pos) AS rest, arg_min({{'kind': l.kind, 'offset_ms': l.offset_ms, 'clip_is': l.clip_is}}, (b_ms, b_pos)) AS kind FROM members GROUP BY ALL)"""
FILLED = f"""{PIXELS_SQL}, flags AS (SELECT video, f, avg((p <= 32)::INT) >= 0.8 AS is_black FROM pix GROUP BY video, f),
source AS (SELECT g.video, g.f, coalesce((SELECT min(o.f) FROM flags o WHERE o.video = g.video AND NOT o.is_black AND o.f >= g.f), (SELECT max(o.f) FROM flags o WHERE o.video = g.video AND NOT o.is_black AND o.f <= g.f), g.f) AS src FROM flags g)"""
STRIPS = f"""{BARRED_SQL}, lines AS (SELECT video, f, 'row' AS axis, y AS "at", p FROM bar UNION ALL SELECT video, f, 'col', x, p FROM bar),
hist AS (SELECT video, f, axis, "at", p, count(*) AS c FROM lines GROUP BY ALL), modes AS (SELECT video, f, axis, "at", arg_max(p, c * 1000 + p) AS mode FROM hist GROUP BY ALL),
strips AS (SELECT m.video, m.f, m.axis, m."at", m.mode, m.mode <= 32 AND sum(CASE WHEN abs(h.p - m.mode) <= 16 THEN h.c ELSE 0 END) / sum(h.c)::DOUBLE >= 0.9 AS is_strip
  FROM modes m JOIN hist h ON h.video = m.video AND h.f = m.f AND h.axis = m.axis AND h."at" = m."at" GROUP BY m.video, m.f, m.axis, m."at", m.mode)"""
CROPS = f"""{STRIPS}, scan AS (SELECT video, f,
  coalesce(min(CASE WHEN axis = 'col' AND NOT is_strip AND "at" < 16 THEN "at" END), 16) AS l, coalesce(min(CASE WHEN axis = 'col' AND NOT is_strip AND 31 - "at" < 16 THEN 31 - "at" END), 16) AS r,
  coalesce(min(CASE WHEN axis = 'row' AND NOT is_strip AND "at" < 12 THEN "at" END), 12) AS t, coalesce(min(CASE WHEN axis = 'row' AND NOT is_strip AND 23 - "at" < 12 THEN 23 - "at" END), 12) AS b FROM strips GROUP BY video, f),
crops AS (SELECT video, f, CASE WHEN ok THEN l ELSE 0 END AS "left", CASE WHEN ok THEN r ELSE 0 END AS "right", CASE WHEN ok THEN t ELSE 0 END AS top, CASE WHEN ok THEN b ELSE 0 END AS bottom FROM (SELECT *, l + r < 32 AND t + b < 24 AS ok FROM scan)),
united AS (SELECT video, min("left") AS "left", min("right") AS "right", min(top) AS top, min(bottom) AS bottom FROM crops GROUP BY video)"""
SEGMENTS = """segs AS (SELECT l_orderkey AS pair, min(round(l_discount * 100)) FILTER (WHERE l_quantity::FLOAT > 5::FLOAT AND round(l_discount * 100) < 3.0) AS best FROM lineitem GROUP BY 1),
scored AS (SELECT pair, CASE WHEN best IS NULL THEN 0::FLOAT ELSE (1.0::DOUBLE - least(best / 3.0::DOUBLE, 1.0::DOUBLE))::FLOAT END AS score FROM segs)"""
FOUR = "CAST(CAST(({0}) AS DECIMAL(12,4)) AS VARCHAR)"


def w(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


ORACLE_SQL = {
    "ext_filter": w(FILES_SQL, f"SELECT path, size FROM files WHERE {EXT}"),
    "scan_union_dedup": w(FILES_SQL, f"SELECT DISTINCT path FROM files WHERE {EXT}"),
    "path_sort": w(FILES_SQL, "SELECT path, other, string_split(path, '/') < string_split(other, '/') AS before FROM (SELECT path FROM files UNION ALL VALUES ('/a/b'), ('/a-b')), (VALUES ('/a/b'), ('/a-b')) t(other)"),
    "cache_key": w(FILES_SQL, f"SELECT path, {KEY} AS cache_key FROM files"),
    "cache_hits": w(f"{FILES_SQL}, {CACHE_SQL}, {TEXT['hit']}", "SELECT path, cache_key, last_used FROM hit"),
    "cache_misses": w(f"{FILES_SQL}, {CACHE_SQL}, {TEXT['miss']}", "SELECT path, cache_key FROM miss"),
    "cache_union": OUTCOMES + " SELECT path, outcome FROM o WHERE error IS NULL",
    "cache_expire": w(f"{FILES_SQL}, {CACHE_SQL}", f"SELECT path, last_used FROM cache WHERE last_used >= {NOW} - 30 * 86400"),
    "outcome_split": OUTCOMES + " SELECT outcome, count(*) AS n, count(error) AS errors, min(error) AS first_error FROM o GROUP BY outcome",
    "scan_stats": OUTCOMES + " SELECT count(*) AS found, count(*) FILTER (WHERE outcome = 'Cached') AS cached, count(*) FILTER (WHERE outcome <> 'Cached') AS uncached, count(error) AS errors, count(*) FILTER (WHERE error IS NULL) AS signatures FROM o",
    "log_line": w(FILES_SQL, f"SELECT path, path || ' - ' || {tenths('size * 1000', 1 << 20)} || ' MB, ' || CASE WHEN doc_id % 2 = 0 THEN '1280x720' ELSE '?x?' END || ', ' || {tenths('mtime % 100000', 1000)} || 's duration' AS line FROM files"),
    "metadata_parse": w(META, "SELECT file_id, round(duration_secs, 6) AS duration_secs, round(fps, 6) AS fps, codec, bitrate_bps, width, height, round(coalesce(CASE WHEN height > 0 THEN (width::DOUBLE / height)::FLOAT END, (16/9.0::DOUBLE)::FLOAT)::DOUBLE, 6) AS aspect_ratio FROM meta"),
    "parse_duration": f"SELECT file_id, round({dur('r')}, 6) AS secs FROM (SELECT k AS file_id, CASE k % 7 WHEN 0 THEN t WHEN 1 THEN '01:02:03.500' WHEN 2 THEN '02:30.000' WHEN 3 THEN 'N/A' WHEN 5 THEN '-' || t WHEN 6 THEN ' 12.5 ' END AS r FROM (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS t FROM orders))",
    "parse_fps": f"SELECT file_id, round({fps('r')}, 6) AS fps FROM (SELECT k AS file_id, CASE k % 6 WHEN 0 THEN '30000/1001' WHEN 1 THEN (k % 120)::VARCHAR || '/1' WHEN 2 THEN '0/0' WHEN 3 THEN 'abc' WHEN 4 THEN '25' END AS r FROM (SELECT o_orderkey AS k FROM orders))",
    "timeout_policy": f"WITH {DURATIONS} SELECT file_id, round(least(greatest(secs * 5 + 10, 20), 120)::DOUBLE, 6) AS limit_secs, round(least(greatest(secs * 0, 30), 30)::DOUBLE, 6) AS inverted FROM d",
    "window_positions": f"""WITH {DURATIONS}, a AS (SELECT file_id, secs, least(15.0::DOUBLE, secs * 0.15::DOUBLE) AS us FROM d), b AS (SELECT *, greatest(secs - 0.5::DOUBLE, us + 1.0::DOUBLE) AS ue FROM a), c AS (SELECT *, least(6.0::DOUBLE, ue - us) AS wd FROM b)
 SELECT file_id, i AS win, round(s, 9) AS start_secs, round(greatest(least(s + wd, secs - 0.1::DOUBLE), s + 0.5::DOUBLE), 9) AS end_secs FROM (SELECT file_id, secs, wd, i, us + i::DOUBLE * ((ue - us - wd) / 4.0::DOUBLE) AS s FROM c, (SELECT unnest(range(5)) AS i))""",
    "thumb_seek": f"WITH {DURATIONS} SELECT file_id, round(greatest(secs::FLOAT * 0.2::FLOAT, 1.0::FLOAT)::DOUBLE, 3) AS seek FROM d",
    "frame_pad": w(PIXELS_SQL, "SELECT video, least(16, 4 + video % 16) AS had, 16::BIGINT AS n_frames, 16 - least(16, 4 + video % 16) + count(*) FILTER (WHERE m = 0) AS n_zero FROM (SELECT video, f, max(p) AS m FROM pix WHERE f < 4 + video % 16 GROUP BY video, f) GROUP BY video"),
    "frame_sample": "SELECT video, pos FROM (SELECT p_partkey AS video, p_size AS total, unnest(range(p_size)) AS pos FROM part) WHERE pos % greatest(1, total // 8) = 0 AND pos < 8 * greatest(1, total // 8)",
    "black_frames": w(PIXELS_SQL, "SELECT video, f, avg((p <= 32)::INT) >= 0.8 AS is_black FROM pix GROUP BY video, f"),
    "black_frame_fill": w(FILLED, "SELECT s.video, s.f, sum(p * (x * 16 + y + 1))::BIGINT AS checksum FROM source s JOIN pix q ON q.video = s.video AND q.f = s.src GROUP BY s.video, s.f"),
    "letterbox_strip": w(STRIPS, 'SELECT video, f, axis, "at", mode, is_strip FROM strips'),
    "letterbox_scan": w(CROPS, 'SELECT video, f, "left", "right", top, bottom FROM crops'),
    "crop_combine": w(CROPS, 'SELECT video, "left", "right", top, bottom FROM united'),
    "crop_filter_string": w(CROPS, f"""SELECT video, CASE WHEN "left" + "right" + top + bottom > 0 THEN 'crop=iw*' || {FOUR.format('1.0::DOUBLE - ("left" + "right") / 32.0::DOUBLE')} || ':ih*' || {FOUR.format('1.0::DOUBLE - (top + bottom) / 24.0::DOUBLE')} || ':iw*' || {FOUR.format('"left" / 32.0::DOUBLE')} || ':ih*' || {FOUR.format('top / 24.0::DOUBLE')} || ',' ELSE '' END AS vf FROM united"""),
    "dct_hash": w(
        PIXELS_SQL + ", c AS (SELECT k, i, cos(pi() * k * (2 * i + 1) / 32) AS v FROM (SELECT unnest(range(16)) AS k), (SELECT unnest(range(16)) AS i)), cc AS (SELECT a.k, b.i, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.i = b.k GROUP BY a.k, b.i),"
        " one AS (SELECT video, f, x, cc.k AS l, sum((p - 128) * cc.v) AS v FROM pix JOIN cc ON cc.i = y WHERE cc.k < 10 AND f < 10 GROUP BY ALL), two AS (SELECT video, f, c.k, l, sum(one.v * c.v) AS v FROM one JOIN c ON c.i = x WHERE c.k < 10 GROUP BY ALL)",
        "SELECT video, f, string_agg(CASE WHEN v > 0 THEN '1' ELSE '0' END, '' ORDER BY k, l) AS bits FROM two GROUP BY video, f",
    ),
    "hamming": w(SIGNATURES_SQL, "SELECT a.input_pos // 6 AS vec, b.input_pos % 6 AS v, array_to_string(list_transform(range(1, 5), lambda k: bit_count(xor(a.h[k].bits, b.h[k].bits))::VARCHAR), ',') AS d FROM sig a JOIN sig b ON a.input_pos // 6 = b.input_pos // 6 WHERE a.input_pos % 6 = 0 AND b.input_pos % 6 BETWEEN 1 AND 4"),
    "duration_buckets": w(BUCKETS, "SELECT path, duration_ms, bucket_id FROM bucketed"),
    "prefilter_pairs": w(PAIRS, "SELECT a_path, b_path, round(d_mid::DOUBLE, 6) AS d_mid FROM pairs"),
    "window_match_count": w(PAIRS, f"SELECT a_path, b_path, len(list_filter({ALIGNED}, lambda x: x <= 0.3::FLOAT)) AS n_matching, len(ha) AS n_windows FROM pairs WHERE len(ha) = len(hb)"),
    "pair_classify": w(EDGES, "SELECT a_path, b_path, round(visual_score::DOUBLE, 6) AS visual_score, kind, offset_ms, clip_is FROM edges WHERE kind IS NOT NULL"),
    "subclip_align": w(SIGNATURES_SQL, f"SELECT vec, v, CASE WHEN list_max(o) > 0 THEN round(list_max(o)::DOUBLE, 6) END AS score, CASE WHEN list_max(o) > 0 THEN src[list_position(o, list_max(o))].start_ms END AS offset_ms FROM (SELECT *, {alignment('clip', 'src')} AS o FROM (SELECT a.input_pos // 6 AS vec, b.input_pos % 6 AS v, a.h AS clip, b.h AS src FROM sig a JOIN sig b ON a.input_pos // 6 = b.input_pos // 6 WHERE a.input_pos % 6 = 5 AND b.input_pos % 6 < 5))"),
    "groups": w(CLUSTER, "SELECT leader_pos, kind.kind AS kind, kind.offset_ms AS offset_ms, len(rest) + 1 AS n_files, leader_path || '|' || array_to_string(rest, '|') AS files FROM grp"),
    "group_members": w(CLUSTER, "SELECT l.path AS leader_path, b_path AS path, l.kind AS kind FROM members"),
    "audio_silence": "SELECT user_id, round(rms, 6) AS rms, round(peak, 6) AS peak, rms < 0.001 AND peak < 0.01 AS silent FROM (SELECT user_id, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak FROM (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE floor(value * 10) END / 32767.0::DOUBLE AS v FROM events) GROUP BY user_id)",
    "audio_segments": f"WITH {SEGMENTS} SELECT pair, round(score::DOUBLE, 6) AS score FROM scored",
    "audio_pairs": f"WITH {SEGMENTS} SELECT pair, CASE WHEN score >= 0.95::FLOAT THEN 'Identical' ELSE 'SameContent' END AS kind FROM scored WHERE score > 0",
    "codec_rank": w(META, f"SELECT file_id, {RANK} AS codec_rank FROM (SELECT file_id, lower(coalesce(codec, '')) AS c FROM meta)"),
    "quality_tier": w(TIERS, "SELECT file_id, tier FROM tiers"),
    "keep_one": w(TIERS, "SELECT file_id, row_number() OVER (PARTITION BY group_id ORDER BY (tier = 'best') DESC, file_id) <> 1 AND count(*) OVER (PARTITION BY group_id) >= 2 AS checked FROM tiers"),
    "report_rows": w(
        META + f""", known AS (SELECT file_id, group_id, (file_id % 10 <> 9 AND duration_secs IS NOT NULL) AS kn, duration_secs, fps, codec, bitrate_bps, width, height FROM meta),
 m2 AS (SELECT file_id, group_id, CASE WHEN kn THEN duration_secs END AS duration_secs, CASE WHEN kn THEN fps END AS fps, CASE WHEN kn THEN codec END AS codec, CASE WHEN kn THEN bitrate_bps END AS bitrate_bps, CASE WHEN kn THEN width END AS width, CASE WHEN kn THEN height END AS height FROM known),
 scored AS (SELECT *, (coalesce(width, 0)::HUGEINT * coalesce(height, 0)) * 1000000000000 + ({RANK}) * 100000000000 + coalesce(bitrate_bps, 0) AS score FROM (SELECT *, lower(coalesce(codec, '')) AS c FROM m2)),
 tiers AS (SELECT *, CASE WHEN max(score) OVER g = min(score) OVER g OR score = 0 THEN 'unknown' WHEN score = max(score) OVER g THEN 'best' ELSE 'worse' END AS tier FROM scored WINDOW g AS (PARTITION BY group_id))""",
        f"""SELECT file_id AS pos, tier, file_id || '.mkv' AS name, {fmt_size('(file_id * 7919)')} AS size_text, coalesce(width || '×' || height, '') AS dimensions,
 coalesce({FMT_DURATION.replace('{t}', 'floor(duration_secs)::BIGINT')}, '') AS duration, coalesce({FMT_BITRATE.replace('{n}', 'bitrate_bps')}, '') AS bitrate, coalesce(codec, '') AS codec,
 strftime(make_timestamp((1700000000 + file_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS mod_date, round(coalesce(duration_secs, 0), 6) AS duration_secs, group_id, '/m/' || file_id || '.mkv' AS path, coalesce(printf('%.1f', fps), '') AS fps FROM tiers""",
    ),
    "report_text": w(CLUSTER, "SELECT no AS group_no, '--- Group ' || no || ' [' || CASE kind.kind WHEN 'Identical' THEN 'IDENTICAL' WHEN 'SameContent' THEN 'SAME CONTENT' WHEN 'SubClip' THEN 'SUB-CLIP' ELSE 'SIMILAR' END || '] ---' || chr(10) || '  ' || leader_path || chr(10) || '  ' || array_to_string(rest, chr(10) || '  ') AS text FROM (SELECT *, row_number() OVER (ORDER BY leader_ms, leader_pos) AS no FROM grp)"),
    "report_json": w(CLUSTER, """SELECT leader_pos, '{"files":["' || leader_path || '","' || array_to_string(rest, '","') || '"],"kind":' || CASE WHEN kind.kind = 'SubClip' THEN '{"SubClip":{"offset_ms":' || kind.offset_ms || ',"clip_is":"' || kind.clip_is || '"}}' ELSE '"' || kind.kind || '"' END || '}' AS json FROM grp"""),
    "format_duration": f"WITH {DURATIONS} SELECT file_id, {FMT_DURATION.replace('{t}', 'floor(secs * 20)::BIGINT')} AS text FROM d",
    "format_bitrate": f"WITH {SIZES} SELECT file_id, {FMT_BITRATE.replace('{n}', '(n % 50000000)')} AS text FROM z",
    "format_size": f"WITH {SIZES} SELECT file_id, {fmt_size('n')} AS text FROM z",
    "format_date": f"WITH {SIZES} SELECT file_id, strftime(make_timestamp((n % 2000000000) * 1000000), '%Y-%m-%d %H:%M:%S') AS text FROM z",
}
