"""SQL of the core queries, for an independent engine."""

from __future__ import annotations

from ..functions.text import WS_SQL as WS

# Clean tables, as `clean_cues`, `clean_segments` and `words_of` make them.
CUES = """c AS (SELECT media_id, CAST(cue_index AS BIGINT) AS cue_index, start_ms, end_ms, text FROM (
  SELECT media_id, cue_index, start_ms, end_ms, coalesce(text, '') AS text, row_number() OVER (PARTITION BY media_id, cue_index ORDER BY ingested_at, start_ms, end_ms, text) AS rn
  FROM cues WHERE media_id IS NOT NULL AND cue_index IS NOT NULL) WHERE rn = 1 AND start_ms >= 0 AND end_ms >= start_ms)"""
SEGMENTS = """s AS (SELECT media_id, CAST(seg_idx AS BIGINT) AS seg_idx, start_ms, end_ms, text, confidence FROM (
  SELECT media_id, seg_idx, CAST(round(start_sec * 1000) AS BIGINT) AS start_ms, CAST(round(end_sec * 1000) AS BIGINT) AS end_ms, coalesce(text, '') AS text, confidence,
  row_number() OVER (PARTITION BY media_id, seg_idx ORDER BY ingested_at, start_sec, end_sec, text) AS rn
  FROM segments WHERE media_id IS NOT NULL AND seg_idx IS NOT NULL) WHERE rn = 1 AND start_ms >= 0 AND end_ms >= start_ms)"""
WORDS = f"""tok AS (SELECT *, list_filter(string_split_regex(text, '{WS}+'), lambda t: t <> '') AS tokens FROM s),
off AS (SELECT *, len(tokens) AS n, CAST(coalesce(sum(len(tokens)) OVER (PARTITION BY media_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM tok WHERE len(tokens) > 0),
w AS (SELECT media_id, seg_idx, o + k AS word_idx, start_ms + (end_ms - start_ms) * k // n AS start_ms, start_ms + (end_ms - start_ms) * (k + 1) // n AS end_ms,
  CASE WHEN o + k > 0 THEN ' ' ELSE '' END || tokens[k + 1] AS word FROM (SELECT *, unnest(range(n)) AS k FROM off))"""
METRICS = f"""ln AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{WS}', '', 'g') <> '') AS lines FROM c),
m AS (SELECT media_id, cue_index, start_ms, end_ms, text, end_ms - start_ms AS duration_ms, CAST(length(regexp_replace(text, '{WS}', '', 'g')) AS BIGINT) AS char_count,
  CAST(coalesce(list_max(list_transform(lines, lambda x: length(x))), 0) AS BIGINT) AS max_line_len, CAST(len(lines) AS BIGINT) AS line_count,
  lag(start_ms) OVER p AS prev_start_ms, lag(end_ms) OVER p AS prev_end_ms FROM ln WINDOW p AS (PARTITION BY media_id ORDER BY cue_index)),
mm AS (SELECT *, CAST(char_count AS DOUBLE) / greatest(CAST(duration_ms AS DOUBLE) / CAST(1000 AS DOUBLE), CAST(0.000001 AS DOUBLE)) AS cps FROM m)"""


def _violations(cps: float = 16.0, line: int = 18, lines: int = 1, least: int = 900, most: int = 6500, overlap: int = 0) -> str:
    def rule(phase: int, name: str, cond: str, value: str, limit: str) -> str:
        severity = "minor" if name == "TOO_LONG_DURATION" else "major"
        return f"SELECT media_id, cue_index, {phase} AS phase, '{name}' AS type, '{severity}' AS severity, CAST({value} AS DOUBLE) AS value, CAST({limit} AS DOUBLE) AS threshold FROM mm WHERE {cond}"

    return " UNION ALL ".join([
        rule(0, "BAD_TIMECODE_ORDER", "start_ms < coalesce(prev_start_ms, -1)", "start_ms", "prev_start_ms"),
        rule(1, "EMPTY_TEXT", "char_count = 0", "0", "0"),
        rule(1, "TOO_SHORT_DURATION", f"duration_ms < {least}", "duration_ms", str(least)),
        rule(1, "TOO_LONG_DURATION", f"duration_ms > {most}", "duration_ms", str(most)),
        rule(1, "TOO_FAST_CPS", f"cps > {cps}", "cps", str(cps)),
        rule(1, "LINE_TOO_LONG", f"max_line_len > {line}", "max_line_len", str(line)),
        rule(1, "TOO_MANY_LINES", f"line_count > {lines}", "line_count", str(lines)),
        rule(2, "OVERLAP", f"prev_end_ms - start_ms > {overlap} AND prev_end_ms > start_ms", "prev_end_ms - start_ms", str(overlap)),
    ])


def _profile(name: str, *limits: float) -> str:
    return f"SELECT '{name}' AS profile, (SELECT count(*) FROM c) AS total_cues, count(*) AS violation_count, count(*) FILTER (severity = 'major') AS major_count FROM ({_violations(*limits)})"


def _stretch(skip: str, need: str, short: str) -> str:
    """Recursive form of the fold that gives cues more time: one step per cue, with the end of the cue before and the push it got."""
    return f"""WITH RECURSIVE {CUES},
o AS (SELECT *, CAST(length(regexp_replace(text, '{WS}', '', 'g')) AS BIGINT) AS chars, row_number() OVER p AS rn, lead(start_ms) OVER p AS ns, lead(end_ms) OVER p AS ne FROM c WINDOW p AS (PARTITION BY media_id ORDER BY start_ms, end_ms, cue_index)),
f(media_id, rn, out_start, out_end, push) AS (
  SELECT media_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT media_id FROM o)
  UNION ALL
  SELECT media_id, rn, CASE WHEN idle THEN s ELSE st4 END, CASE WHEN idle THEN e ELSE e4 END, CASE WHEN idle THEN 0 ELSE d4 END FROM (
   SELECT *, CASE WHEN moved THEN greatest(least(st3 + need, ns + d4), st3 + 1) ELSE e3 END AS e4, st3 AS st4 FROM (
    SELECT *, ns IS NOT NULL AND {short.format(a="st3", b="e3")} AND st3 + need - e3 > 0 AND st3 + need - e3 <= 1000 AND ns + st3 + need - e3 <= ne - 1 AS moved, CASE WHEN ns IS NOT NULL AND {short.format(a="st3", b="e3")} AND st3 + need - e3 > 0 AND st3 + need - e3 <= 1000 AND ns + st3 + need - e3 <= ne - 1 THEN st3 + need - e3 ELSE 0 END AS d4 FROM (
     SELECT *, CASE WHEN {short.format(a="st2", b="e2")} THEN greatest(e2 - need, coalesce(before, 0), 0) ELSE st2 END AS st3, CASE WHEN {short.format(a="st2", b="e2")} THEN greatest(e2, greatest(e2 - need, coalesce(before, 0), 0) + 1) ELSE e2 END AS e3 FROM (
      SELECT *, greatest(s, 0) AS st2, greatest(greatest(e, least(s + need, coalesce(ns, s + need))), greatest(s, 0) + 1) AS e2 FROM (
       SELECT *, {skip} AS idle, CAST({need} AS BIGINT) AS need FROM (
        SELECT o.media_id, o.rn, o.start_ms + f.push AS s, o.end_ms AS e, o.chars, f.out_end AS before, o.ns, o.ne FROM f JOIN o ON o.media_id = f.media_id AND o.rn = f.rn + 1)))))))
SELECT o.media_id, o.cue_index, f.out_start AS start_ms, f.out_end AS end_ms, o.text FROM f JOIN o ON o.media_id = f.media_id AND o.rn = f.rn"""


_FAST = "chars / ((CAST({b} AS DOUBLE) - {a}) / CAST(1000 AS DOUBLE)) > 16"
_STRIP = f"regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g')"
_REPAIR = f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g'), '{WS}*-{WS}*', '-', 'g'), '{WS}+', ' ', 'g'), '[。.！!？?…։؛、，,;:]+$', ''), '^{WS}+|{WS}+$', '', 'g'))"
_ZH = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g'), ' *([，。！？；：、]) *', '\\1', 'g'), ' +([,.!?;:])', '\\1', 'g')"
_CJK = r"length(regexp_replace(text, '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]', '', 'g'))"
_NUMBERS = r"len(regexp_extract_all(text, '(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:%|％)?'))"
_HITS = "(CAST(contains(text, '话筒') AS BIGINT) + CAST(contains(text, '胶片') AS BIGINT) + 2 * CAST(contains(text, 'studio') AS BIGINT))"
_STIFF = f"(regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]{WS}+[\\x{{4e00}}-\\x{{9fff}}]') OR regexp_matches(text, '{WS}{{2,}}') OR contains(text, '， ') OR contains(text, '。 ') OR contains(text, '！ ') OR contains(text, '？ ') OR (length(text) >= 40 AND NOT regexp_matches(text, '[，。！？；：]')))"
_KIND = "CASE upper(job_kind) WHEN 'GENERATE' THEN 'subtitles.generate' WHEN 'FIX' THEN 'subtitles.fix' WHEN 'BURN' THEN 'subtitles.burn' WHEN 'SUBTITLES_GENERATE' THEN 'subtitles.generate' WHEN 'SUBTITLES_FIX' THEN 'subtitles.fix' WHEN 'SUBTITLES_BURN' THEN 'subtitles.burn' ELSE lower(job_kind) END"
_RANK = "row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, CASE WHEN job_state IN ('succeeded', 'failed', 'canceled') THEN 1 ELSE 0 END DESC, coalesce(progress, -1) DESC, job_state DESC, coalesce(attempt, 0) DESC, error_code DESC NULLS LAST)"


def _timecode(x: str) -> str:
    pad = lambda v, n: f"CASE WHEN length(CAST({v} AS VARCHAR)) >= {n} THEN CAST({v} AS VARCHAR) ELSE lpad(CAST({v} AS VARCHAR), {n}, '0') END"
    return f"({pad(f'({x} // 3600000)', 2)} || ':' || {pad(f'({x} % 3600000 // 60000)', 2)} || ':' || {pad(f'({x} % 60000 // 1000)', 2)} || ',' || {pad(f'({x} % 1000)', 3)})"


_INLINE = WS.replace('\\x{09}-\\x{0d}', '\\x{09}\\x{0b}-\\x{0d}')
_BLOCK = f"CAST(number AS VARCHAR) || chr(10) || {_timecode('start_ms')} || ' --> ' || {_timecode('end_ms')} || CASE WHEN regexp_replace(text, '{WS}', '', 'g') <> '' THEN chr(10) || regexp_replace(text, '\n+$', '') ELSE '' END"
_COVER = f"""WITH {CUES}, {SEGMENTS}, {WORDS},
cov AS (SELECT c.media_id, c.cue_index AS seg_idx, c.end_ms - c.start_ms AS dur_ms, CAST(coalesce(sum(least(w.end_ms, c.end_ms) - greatest(w.start_ms, c.start_ms)) FILTER (w.start_ms IS NOT NULL), 0) AS BIGINT) AS covered_ms, any_value(c.end_ms) AS e
  FROM c LEFT JOIN w ON w.media_id = c.media_id AND w.start_ms < c.end_ms AND c.start_ms < w.end_ms GROUP BY c.media_id, c.cue_index, c.end_ms, c.start_ms)"""

ORACLES = {
    "p3_found": """
WITH iv AS (
  SELECT 'cue' AS record_kind, media_id, start_ms AS a, end_ms AS b FROM cues
  UNION ALL SELECT 'segment', media_id, CAST(round(start_sec * 1000) AS BIGINT), CAST(round(end_sec * 1000) AS BIGINT) FROM segments),
ok AS (SELECT * FROM iv WHERE a < b),
reach AS (SELECT *, max(b) OVER (PARTITION BY record_kind, media_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
isl AS (SELECT *, count(*) FILTER (before IS NULL OR a > before) OVER (PARTITION BY record_kind, media_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM reach),
per AS (SELECT record_kind, media_id, min(a) AS from_ms, max(b) AS to_ms FROM isl GROUP BY record_kind, media_id, island)
SELECT record_kind, media_id, 'period' AS interval_kind, from_ms, to_ms FROM per
UNION ALL
SELECT record_kind, media_id, 'gap', prev, from_ms FROM (SELECT *, lag(to_ms) OVER (PARTITION BY record_kind, media_id ORDER BY from_ms) AS prev FROM per)
WHERE prev IS NOT NULL AND from_ms - prev <= 600000""",
}

ORACLES |= {
    "cue_metrics": f"WITH {CUES}, {METRICS} SELECT media_id, cue_index, start_ms, end_ms, duration_ms, char_count, cps, max_line_len, line_count FROM mm",
    "pair_metrics": f"WITH {CUES}, {METRICS} SELECT media_id, cue_index, prev_end_ms, start_ms AS cur_start_ms, start_ms - prev_end_ms AS gap_ms, greatest(prev_end_ms - start_ms, 0) AS overlap_ms FROM mm WHERE prev_end_ms IS NOT NULL",
    "bad_timecode_order": f"WITH {CUES}, {METRICS} SELECT media_id, cue_index, prev_start_ms, start_ms AS cur_start_ms FROM mm WHERE start_ms < coalesce(prev_start_ms, -1)",
    "violations": f"WITH {CUES}, {METRICS} {_violations()}",
    "quality_summary": f"""WITH {CUES}, {METRICS}, v AS ({_violations()})
SELECT c.media_id, c.n AS total_cues, coalesce(v.n, 0) AS violation_count, coalesce(v.major, 0) AS major_count, coalesce(v.minor, 0) AS minor_count, coalesce(v.major, 0) = 0 AS ok
FROM (SELECT media_id, count(*) AS n FROM c GROUP BY media_id) c LEFT JOIN (SELECT media_id, count(*) AS n, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor FROM v GROUP BY media_id) v USING (media_id)""",
    "violations_by_type": f"WITH {CUES}, {METRICS}, v AS ({_violations()}) SELECT media_id, type, severity, count(*) AS n FROM v GROUP BY media_id, type, severity",
    "quality_by_profile": f"WITH {CUES}, {METRICS} {_profile('default')} UNION ALL {_profile('loose', 22.0, 42, 2, 700, 8000, 50)} UNION ALL {_profile('strict', 12.0, 16, 1, 1200, 6000, 0)}",
    "fix_overlaps": f"""WITH {CUES}, {METRICS}, f AS (SELECT media_id, cue_index, start_ms AS s, end_ms, CASE WHEN start_ms < prev_end_ms THEN CASE WHEN prev_end_ms >= end_ms THEN greatest(end_ms - 1, 0) ELSE prev_end_ms END ELSE start_ms END AS start_ms FROM mm)
SELECT media_id, cue_index, start_ms, end_ms, start_ms <> s AS changed FROM f""",
    "fix_cps": _stretch(f"NOT (chars > 0 AND e > s AND {_FAST.format(a='s', b='e')})", "ceil(chars / CAST(16 AS DOUBLE) * CAST(1000 AS DOUBLE))", _FAST),
    "fix_duration": _stretch("e - s >= 900", "900", "{b} - {a} < 900"),
    "wrap_two_lines": f"""WITH {CUES}, k AS (SELECT media_id, cue_index, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '') AS w FROM c),
p AS (SELECT *, array_to_string(w[1:i], ' ') AS a, array_to_string(w[i + 1:], ' ') AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM k WHERE len(w) >= 2))
SELECT media_id, cue_index, a AS line_1, b AS line_2 FROM (SELECT *, row_number() OVER (PARTITION BY media_id, cue_index ORDER BY greatest(length(a), length(b)), a, b) AS rn FROM p WHERE length(a) <= 42 AND length(b) <= 42) WHERE rn = 1""",
    "timecode_format": f"WITH {CUES} SELECT media_id, cue_index, {_timecode('start_ms')} AS start_tc, {_timecode('end_ms')} AS end_tc FROM c",
    "srt_render": f"WITH {CUES}, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, cue_index) AS number FROM c) SELECT media_id, number, {_BLOCK} AS block FROM n",
    "srt_roundtrip": f"WITH {CUES}, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, cue_index) AS number FROM c) SELECT media_id, number - 1 AS cue_index, start_ms, end_ms, regexp_replace(regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '(?:(?:^|\\n){_INLINE}*)+$', ''), '^\\n+', '') AS text FROM n",
    "bilingual_zip": f"WITH {CUES}, {SEGMENTS} SELECT c.media_id, c.cue_index, c.start_ms, c.end_ms, c.text || chr(10) || s.text AS text FROM c JOIN s ON s.media_id = c.media_id AND s.seg_idx = c.cue_index",
    "words_from_text": f"WITH {SEGMENTS}, {WORDS} SELECT media_id, seg_idx, word_idx, start_ms, end_ms, word FROM w",
    "pause_and_mark_flags": f"""WITH {SEGMENTS}, {WORDS}, x AS (SELECT *, lead(start_ms) OVER (PARTITION BY media_id ORDER BY word_idx) - end_ms AS gap_ms, right(word, 1) AS mk FROM w)
SELECT media_id, word_idx, gap_ms, gap_ms >= 650 AS pause, contains('。.!?？！', mk) AS strong, NOT contains('。.!?？！', mk) AND contains('，,、；;:：…', mk) AS soft FROM x WHERE gap_ms IS NOT NULL""",
    "segments_from_cuts": f"""WITH {SEGMENTS}, {WORDS}, x AS (SELECT *, CAST(coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_no FROM w)
SELECT media_id, seg_no, min(start_ms) AS start_ms, arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_words FROM x GROUP BY media_id, seg_no""",
    "words_in_segments": f"WITH {SEGMENTS}, {WORDS} SELECT w.media_id, s.seg_idx, w.word_idx FROM w JOIN s ON s.media_id = w.media_id AND w.start_ms < s.end_ms AND s.start_ms < w.end_ms",
    "segment_word_coverage": f"{_COVER} SELECT media_id, seg_idx, dur_ms, covered_ms FROM cov",
    "coverage_holes": f"""{_COVER}, g AS (SELECT media_id, count(*) FILTER (dur_ms >= 1500) AS qualifying, CAST(coalesce(sum(dur_ms) FILTER (dur_ms >= 1500 AND CAST(covered_ms AS DOUBLE) / dur_ms < 0.15), 0) AS BIGINT) AS hole_ms, max(e) AS total_ms FROM cov GROUP BY media_id)
SELECT *, hole_ms > 0 AND (hole_ms >= 3000 OR hole_ms >= CAST(0.05 AS DOUBLE) * total_ms) AS has_holes FROM g""",
    "clip_to_range": f"WITH {SEGMENTS} SELECT media_id, seg_idx, greatest(start_ms, 20000) AS start_ms, least(end_ms, 90000) AS end_ms FROM s WHERE least(end_ms, 90000) > greatest(start_ms, 20000)",
    "word_reliability": f"""WITH {SEGMENTS}, {WORDS}, g AS (SELECT media_id, count(*) AS words, count(*) FILTER (end_ms - start_ms <= 0 OR end_ms - start_ms > 8000) AS bad_words, CAST(median(CASE WHEN end_ms - start_ms > 0 AND end_ms - start_ms <= 8000 THEN end_ms - start_ms END) AS DOUBLE) AS median_ms FROM w GROUP BY media_id)
SELECT *, words >= 30 AND CAST(bad_words AS DOUBLE) / words <= 0.2 AND coalesce(median_ms, 1e9) <= 1200 AS reliable FROM g""",
    "punct_split": f"""WITH {SEGMENTS}, {WORDS},
mt AS (SELECT w.media_id, s.seg_idx, w.word_idx, w.start_ms AS w0, w.end_ms AS w1, w.word, s.start_ms AS s0 FROM w JOIN s ON s.media_id = w.media_id AND w.start_ms < s.end_ms AND s.start_ms < w.end_ms WHERE s.end_ms > s.start_ms),
d AS (SELECT *, CAST(coalesce(sum(length(regexp_replace(word, '{WS}', '', 'g'))) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS tail, count(*) OVER q AS n, max(w1) OVER q AS last, lead(word_idx) OVER o IS NULL AS is_last FROM mt WINDOW q AS (PARTITION BY media_id, seg_idx), o AS (PARTITION BY media_id, seg_idx ORDER BY word_idx)),
k AS (SELECT *, CAST(regexp_matches(word, '[。！？!?；;…]') AND NOT is_last AND w1 - s0 >= 2500 AND last - w1 >= 2500 AND tail >= 4 AS INTEGER) AS cut FROM d),
z AS (SELECT *, CAST(coalesce(sum(cut) OVER (PARTITION BY media_id, seg_idx ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS piece, sum(cut) OVER (PARTITION BY media_id, seg_idx) AS cuts FROM k),
pc AS (SELECT media_id, seg_idx, piece, min(w0) AS start_ms, arg_max(w1, word_idx) AS end_ms, regexp_replace(string_agg(word, '' ORDER BY word_idx), '^{WS}+|{WS}+$', '', 'g') AS text FROM z WHERE n >= 2 AND cuts > 0 GROUP BY media_id, seg_idx, piece)
SELECT media_id, seg_idx, piece, start_ms, end_ms, text FROM pc WHERE end_ms > start_ms AND end_ms - start_ms <= 15000
UNION ALL SELECT media_id, seg_idx, 0, start_ms, end_ms, text FROM s WHERE end_ms > start_ms AND regexp_replace(text, '{WS}', '', 'g') <> '' AND (media_id, seg_idx) NOT IN (SELECT (media_id, seg_idx) FROM z WHERE n >= 2 AND cuts > 0)""",
    "range_replace": f"""WITH {CUES}, {SEGMENTS}
SELECT media_id, seg_idx, 'kept' AS part, start_ms, end_ms, text FROM s WHERE NOT (start_ms < 60000 AND end_ms > 30000)
UNION ALL SELECT media_id, seg_idx, 'left', start_ms, 30000, text FROM s WHERE start_ms < 60000 AND end_ms > 30000 AND start_ms < 30000
UNION ALL SELECT media_id, seg_idx, 'right', 60000, end_ms, text FROM s WHERE start_ms < 60000 AND end_ms > 30000 AND end_ms > 60000
UNION ALL SELECT media_id, cue_index, 'new', greatest(start_ms, 30000), least(end_ms, 60000), text FROM c WHERE least(end_ms, 60000) > greatest(start_ms, 30000) AND regexp_replace(text, '{WS}', '', 'g') <> ''""",
    "risk_flags": f"""WITH {SEGMENTS} SELECT media_id, seg_idx, CAST({_NUMBERS} AS BIGINT) AS numbers, {_HITS} AS hits, {_STIFF} AS stiff, coalesce(confidence < 0.35, false) OR {_NUMBERS} >= 2 OR {_HITS} >= 1 OR {_STIFF} AS high_risk FROM (SELECT * REPLACE ({_STRIP % 'text'} AS text) FROM s)""",
    "glossary_apply": "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, 'studio', 'atelier'), 'atelier near', 'atelier by'), 'camera', 'camera unit'), 'OpenAI', 'OpenAI'), 'Tokyo', '东京')) AS text_md5 FROM documents",
    "normalized_texts": f"""WITH {SEGMENTS} SELECT media_id, seg_idx, {_REPAIR % 'text'} AS repair_form, {_ZH % 'text'} AS zh_form, CAST(len(list_filter(string_split_regex(text, '{WS}+'), lambda t: t <> '')) AS BIGINT) AS words,
CAST(length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS BIGINT) AS letters, {_CJK} >= 4 AND {_CJK} >= length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS cjk FROM s""",
    "zh_sentence_pieces": f"""WITH {SEGMENTS}, p AS (SELECT media_id, seg_idx, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;…]*[。！？!?；;…]|[^。！？!?；;…]+$'), lambda x: {_STRIP % 'x'}), lambda x: x <> '') AS ps FROM s)
SELECT media_id, seg_idx, k AS piece, ps[k + 1] AS text FROM (SELECT *, unnest(range(len(ps))) AS k FROM p)""",
    "translate_context": f"""WITH {SEGMENTS}, x AS (SELECT *, lag(text, 1) OVER p AS b1, lag(text, 2) OVER p AS b2, lead(text) OVER p AS nx FROM s WINDOW p AS (PARTITION BY media_id ORDER BY seg_idx))
SELECT media_id, seg_idx, CASE WHEN b2 IS NOT NULL AND regexp_replace(b2, '{WS}', '', 'g') <> '' AND regexp_replace(b1, '{WS}', '', 'g') <> '' THEN b2 || chr(10) || b1 WHEN b2 IS NOT NULL AND regexp_replace(b2, '{WS}', '', 'g') <> '' THEN b2 WHEN b1 IS NOT NULL AND regexp_replace(b1, '{WS}', '', 'g') <> '' THEN b1 ELSE '' END AS before, substring(coalesce(nx, ''), 1, 80) AS after FROM x""",
    "segment_stats": f"""WITH {SEGMENTS} SELECT media_id, CAST(sum(end_ms - start_ms) AS DOUBLE) / count(*) AS avg_ms, CAST(count(*) FILTER (end_ms - start_ms < 1200) AS DOUBLE) / count(*) AS short_share,
CAST(count(*) FILTER (end_ms - start_ms < 2000 AND length({_STRIP % 'text'}) <= 6) AS DOUBLE) / count(*) AS tiny_share FROM s GROUP BY media_id""",
    "translator_routes": """SELECT doc_id, CASE WHEN starts_with(lower(coalesce(lang, 'unknown')), 'en') THEN 'nllb' ELSE 'openai' END AS translator,
CASE lower(coalesce(lang, '')) WHEN 'en' THEN 'eng_Latn' WHEN 'ja' THEN 'jpn_Jpan' WHEN 'ko' THEN 'kor_Hang' WHEN 'fr' THEN 'fra_Latn' WHEN 'de' THEN 'deu_Latn' WHEN 'es' THEN 'spa_Latn' WHEN 'pt' THEN 'por_Latn' WHEN 'it' THEN 'ita_Latn' WHEN 'ru' THEN 'rus_Cyrl' WHEN 'ar' THEN 'arb_Arab'
 WHEN 'th' THEN 'tha_Thai' WHEN 'vi' THEN 'vie_Latn' WHEN 'id' THEN 'ind_Latn' WHEN 'tr' THEN 'tur_Latn' WHEN 'hi' THEN 'hin_Deva' WHEN 'zh' THEN 'zho_Hans' WHEN 'zh-cn' THEN 'zho_Hans' WHEN 'zh-tw' THEN 'zho_Hant' ELSE 'eng_Latn' END AS code FROM documents""",
    "kb_topk": """WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS score FROM embeddings, q ORDER BY list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), vec_id LIMIT 6""",
    "kb_topk_all": """WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) AS rank FROM d) SELECT query_id, vec_id, round(s, 6) AS score, rank FROM r WHERE rank <= 6""",
    "asr_cache_key": "SELECT media_id, sha1(concat_ws('|', sha1(source_path), 'model=small', 'lang=' || coalesce(lang, 'auto'), 'pre=' || coalesce(nullif(channel_code, ''), 'none'), 'dev=auto', 'ct=auto', 'beam=' || length(media_id), 'best_of=1', 'vad=' || CASE WHEN duration_ms > 600000 THEN '1' ELSE '0' END)) AS cache_key FROM media",
    "job_latest": f"SELECT job_id, {_KIND} AS job_kind, job_state, progress, coalesce(attempt, 0) AS attempt, error_code FROM (SELECT *, {_RANK} AS rn FROM job_status WHERE job_id IS NOT NULL AND updated_at IS NOT NULL) WHERE rn = 1",
    "job_status_reconcile": f"""WITH k AS (SELECT job_id, job_state AS s FROM (SELECT *, {_RANK} AS rn FROM job_status WHERE job_id IS NOT NULL AND updated_at IS NOT NULL AND worker_id IS NOT NULL) WHERE rn = 1),
q AS (SELECT job_id, max(CASE WHEN finished_at IS NOT NULL THEN 'finished' WHEN started_at IS NOT NULL THEN 'started' ELSE 'queued' END) AS q FROM job_status WHERE enqueued_at IS NOT NULL AND job_id IS NOT NULL GROUP BY job_id)
SELECT job_id, CASE WHEN s IS NULL THEN CASE WHEN q = 'finished' THEN 'succeeded' WHEN q IN ('started', 'failed', 'canceled') THEN q ELSE 'queued' END WHEN s IN ('succeeded', 'failed', 'canceled') THEN s WHEN q = 'queued' THEN 'queued' WHEN q = 'started' AND s = 'queued' THEN 'started' WHEN q = 'failed' THEN 'failed' WHEN q = 'canceled' THEN 'canceled' ELSE s END AS job_state,
CASE WHEN s IS NULL THEN 'queue' WHEN q IS NULL THEN 'disk' ELSE 'both' END AS origin FROM k FULL JOIN q USING (job_id)""",
    "counters_prometheus": f"SELECT row_number() OVER (ORDER BY k, s) AS number, 'jobs_total{{kind=\"' || k || '\",state=\"' || s || '\"}} ' || CAST(n AS VARCHAR) AS line FROM (SELECT coalesce({_KIND}, '') AS k, coalesce(job_state, '') AS s, count(*) AS n FROM job_status GROUP BY ALL)",
    "newest_candidate": "SELECT channel_code, source_path FROM (SELECT *, row_number() OVER (PARTITION BY channel_code ORDER BY created_at DESC NULLS LAST, media_id DESC, source_path DESC) AS rn FROM media WHERE channel_code IS NOT NULL) WHERE rn = 1",
    "emit_routing": """SELECT mode, CASE WHEN mode IN ('all', 'bilingual', 'bilingual-only') THEN 'bilingual' WHEN mode = 'literal' THEN 'literal' WHEN mode = 'zh-only' THEN 'zh' ELSE 'literal_json' END AS primary_output,
CASE mode WHEN 'all' THEN 'zh,bilingual' WHEN 'literal' THEN 'literal' WHEN 'zh-only' THEN 'zh' WHEN 'bilingual-only' THEN 'bilingual' WHEN 'bilingual' THEN 'bilingual' ELSE '' END AS outputs FROM (VALUES ('all'), ('literal'), ('zh-only'), ('bilingual-only'), ('bilingual'), ('none'), ('other')) t(mode)""",
}

_TOKENS = f"list_filter(string_split({_REPAIR % 'text'}, ' '), lambda t: t <> '')"
_TOP = "list_max(list_transform(list_distinct({w}), lambda x: len(list_filter({w}, lambda y: y = x))))"
_STUCK = (
    "(len(w) >= 3 AND len(list_filter(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] = w[i + 1] AND w[i + 1] = w[i + 2])) > 0"
    f" OR coalesce(len(w) >= 6 AND {_TOP.format(w='w')} >= 6 AND CAST({_TOP.format(w='w')} AS DOUBLE) / len(w) >= 0.70, false)"
    f" OR coalesce(len(w) >= 12 AND CAST({_TOP.format(w='w[1:80]')} AS DOUBLE) / least(len(w), 80) >= 0.45, false))"
)
_COUNT = f"len(list_filter(string_split_regex(text, '{WS}+'), lambda t: t <> ''))"
_DUR = "(end_ms - start_ms)"
_LOW = f"({_DUR} >= 6000 AND ({_COUNT} <= 1 OR length(regexp_replace(text, '\\P{{L}}', '', 'g')) <= 2 OR CAST({_COUNT} * 1000 AS DOUBLE) / {_DUR} <= 0.2))"
_SUSPECT = f"({_DUR} >= 10000 AND (regexp_replace(text, '{WS}', '', 'g') = '' OR CAST(length({_STRIP % 'text'}) AS DOUBLE) * 1000 / {_DUR} <= 6))"
_PREFIX = "coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substring(a, i, 1) <> substring(b, i, 1))) - 1, least(length(a), length(b)))"
_REPEAT = f"""(length({_STRIP % 'before'}) >= 12 AND length({_STRIP % 'text'}) >= 12 AND a <> '' AND b <> '' AND (((contains(a, b) OR contains(b, a)) AND least(length(a), length(b)) >= 50)
 OR (start_ms - prev_end <= 2000 AND CASE WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN CAST(least(length(a), length(b)) AS DOUBLE) / greatest(length(a), length(b)) ELSE CAST({_PREFIX} AS DOUBLE) / least(length(a), length(b)) END >= 0.92)))"""
_ORDERED = "x AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY word_idx) AS k FROM w)"
_JOINED = "regexp_replace(regexp_replace(string_agg(x.word, '' ORDER BY x.k), '" + WS + "+', ' ', 'g'), '^ | $', '', 'g')"
_DENSITY = f"CAST(length(regexp_replace(text, '{WS}', '', 'g')) AS DOUBLE) / greatest(CAST(0.000001 AS DOUBLE), CAST(end_ms - start_ms AS DOUBLE) / 1000)"
_QUEUE = f"q AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, seg_idx) AS rn, {_DENSITY} AS d FROM s)"
_RATIO = "CAST(greatest(0, least(f.e, q.end_ms) - greatest(f.s, q.start_ms)) AS DOUBLE) / greatest(CAST(0.000001 AS DOUBLE), least(f.e - f.s, q.end_ms - q.start_ms))"
_SAME = f"((abs(q.start_ms - f.s) <= 50 AND {_RATIO} >= 0.85) OR {_RATIO} >= 0.95)"
_WINS = "(q.d > f.d * 1.05 OR (q.end_ms - q.start_ms > f.e - f.s + 50 AND q.d >= f.d * 0.95))"
_CUT = "(q.end_ms <= f.e OR (f.e > q.start_ms AND CAST(f.e - q.start_ms AS DOUBLE) / greatest(CAST(0.000001 AS DOUBLE), q.end_ms - q.start_ms) >= 0.60))"
_LATE = "greatest(q.start_ms, f.e)"
_GONE = f"((f.e > q.start_ms AND q.end_ms - {_LATE} < 200) OR regexp_replace(q.text, '{WS}', '', 'g') = '')"
_WEAK_Q = f"(q.end_ms - q.start_ms < 2500 OR length({_STRIP % 'q.text'}) < 8)"
_WEAK_F = f"(f.e - f.s < 2500 OR length({_STRIP % 'f.t'}) < 8)"
_JOIN = f"(f.alive AND ({_WEAK_Q} OR {_WEAK_F}) AND f.e - f.s + q.end_ms - q.start_ms <= 15000)"
_BLANK_Q = f"regexp_replace(q.text, '{WS}', '', 'g') = ''"
_GLUED = f"CASE WHEN {_STRIP % 'f.t'} = '' THEN {_STRIP % 'q.text'} WHEN {_STRIP % 'q.text'} = '' THEN {_STRIP % 'f.t'} ELSE {_STRIP % 'f.t'} || ' ' || {_STRIP % 'q.text'} END"

ORACLES |= {
    "repair_flags": f"WITH {SEGMENTS}, t AS (SELECT *, {_TOKENS} AS w FROM s) SELECT media_id, seg_idx, {_LOW} AS low_info, {_SUSPECT} AS suspect, {_STUCK} AS stuck FROM t",
    "repair_candidates": f"""WITH {SEGMENTS}, n AS (SELECT *, lag(start_ms) OVER p AS prev_start, lag(end_ms) OVER p AS prev_end, lag(text) OVER p AS before, lead(start_ms) OVER p AS nxt, max(end_ms) OVER (PARTITION BY media_id) AS total FROM s WINDOW p AS (PARTITION BY media_id ORDER BY seg_idx)),
t AS (SELECT *, {_TOKENS} AS w, {_REPAIR % 'before'} AS a, {_REPAIR % 'text'} AS b FROM n WHERE prev_end IS NOT NULL),
g AS (SELECT *, CASE WHEN {_STUCK} OR contains(text, chr(65533)) THEN 'STUCK_OR_INVALID' WHEN {_REPEAT} THEN 'REPEAT' WHEN {_LOW} THEN 'SHORT_LOW_INFO' WHEN {_SUSPECT} THEN 'SUSPECT' END AS trigger FROM t)
SELECT media_id, seg_idx, trigger, greatest(prev_end - 1000, 0) AS from_ms, least(greatest(end_ms + 1500, coalesce(nxt + 200, 0)), total) AS to_ms FROM g WHERE trigger IS NOT NULL""",
    "rule_segments": f"""WITH RECURSIVE {SEGMENTS}, {WORDS}, {_ORDERED},
y AS (SELECT *, lead(start_ms) OVER p - end_ms >= 650 AS pause, lead(k) OVER p IS NOT NULL AND contains('。.!?？！', right(word, 1)) AS strong, lead(k) OVER p IS NOT NULL AND NOT contains('。.!?？！', right(word, 1)) AND contains('，,、；;:：…', right(word, 1)) AS soft, count(*) OVER (PARTITION BY media_id) AS n FROM x WINDOW p AS (PARTITION BY media_id ORDER BY k)),
f(media_id, seg_no, lo, hi, n) AS (
  SELECT DISTINCT media_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), n FROM y
  UNION ALL
  SELECT media_id, seg_no + 1, lo, coalesce(max(CASE WHEN ok AND strong THEN k END), max(CASE WHEN ok AND pause THEN k END), max(CASE WHEN ok AND soft AND near THEN k END), max(target)), n FROM (
    SELECT *, k <= target AND end_ms - t0 >= 2500 AS ok, max(CASE WHEN k = target THEN end_ms END) OVER g - t0 >= 5500 AS near FROM (
      SELECT *, CASE WHEN soft_far > lo THEN soft_far ELSE hard_far END AS target FROM (
        SELECT *, greatest(coalesce(min(CASE WHEN end_ms - t0 > 15000 THEN k END) OVER g - 1, n), lo) AS hard_far, greatest(coalesce(min(CASE WHEN end_ms - t0 > 7000 THEN k END) OVER g - 1, n), lo) AS soft_far FROM (
          SELECT f.media_id, f.seg_no, f.hi + 1 AS lo, f.n, y.k, y.end_ms, y.strong, y.pause, y.soft, y0.start_ms AS t0 FROM f JOIN y y0 ON y0.media_id = f.media_id AND y0.k = f.hi + 1 JOIN y ON y.media_id = f.media_id AND y.k > f.hi)
        WINDOW g AS (PARTITION BY media_id)))
    WINDOW g AS (PARTITION BY media_id))
  GROUP BY media_id, seg_no, lo, n)
SELECT f.media_id, f.seg_no, min_by(x.start_ms, x.k) AS start_ms, max_by(x.end_ms, x.k) AS end_ms, {_JOINED} AS text FROM f JOIN x ON x.media_id = f.media_id AND x.k BETWEEN f.lo AND f.hi WHERE f.seg_no >= 0 GROUP BY f.media_id, f.seg_no""",
    "greedy_units": f"""WITH RECURSIVE {SEGMENTS}, {WORDS}, x AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, word_idx) AS k, count(*) OVER (PARTITION BY media_id) AS n FROM w),
f(media_id, seg_no, lo, hi, n) AS (
  SELECT DISTINCT media_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), n FROM x
  UNION ALL
  SELECT media_id, seg_no + 1, lo, coalesce(min(CASE WHEN k > lo AND d >= 7000 THEN CASE WHEN d > 15000 THEN k - 1 ELSE k END END), max(n)), n FROM (
    SELECT f.media_id, f.seg_no, f.hi + 1 AS lo, f.n, x.k, x.end_ms - x0.start_ms AS d FROM f JOIN x x0 ON x0.media_id = f.media_id AND x0.k = f.hi + 1 JOIN x ON x.media_id = f.media_id AND x.k > f.hi)
  GROUP BY media_id, seg_no, lo, n)
SELECT f.media_id, f.seg_no, min_by(x.start_ms, x.k) AS start_ms, max_by(x.end_ms, x.k) AS end_ms, regexp_replace(string_agg(x.word, '' ORDER BY x.k), '^{WS}+|{WS}+$', '', 'g') AS text FROM f JOIN x ON x.media_id = f.media_id AND x.k BETWEEN f.lo AND f.hi WHERE f.seg_no >= 0 GROUP BY f.media_id, f.seg_no""",
    "time_overlap_dedupe": f"""WITH RECURSIVE {SEGMENTS}, {_QUEUE},
f(media_id, rn, slot, s, e, d, pick) AS (
  SELECT media_id, rn, CAST(1 AS BIGINT), start_ms, end_ms, d, rn FROM q WHERE rn = 1
  UNION ALL
  SELECT q.media_id, q.rn, CASE WHEN {_SAME} THEN f.slot ELSE f.slot + 1 END, CASE WHEN {_SAME} AND NOT {_WINS} THEN f.s ELSE q.start_ms END, CASE WHEN {_SAME} AND NOT {_WINS} THEN f.e ELSE q.end_ms END, CASE WHEN {_SAME} AND NOT {_WINS} THEN f.d ELSE q.d END, CASE WHEN {_SAME} AND NOT {_WINS} THEN f.pick ELSE q.rn END
  FROM f JOIN q ON q.media_id = f.media_id AND q.rn = f.rn + 1)
SELECT q.media_id, q.seg_idx, q.start_ms, q.end_ms, q.text, q.confidence FROM (SELECT media_id, slot, max_by(pick, rn) AS pick FROM f GROUP BY media_id, slot) g JOIN q ON q.media_id = g.media_id AND q.rn = g.pick""",
    "no_overlap_clamp": f"""WITH RECURSIVE {SEGMENTS}, {_QUEUE},
f(media_id, rn, slot, s, e, d, pick) AS (
  SELECT media_id, rn, CAST(1 AS BIGINT), start_ms, end_ms, d, rn FROM q WHERE rn = 1
  UNION ALL
  SELECT media_id, rn, slot + CASE WHEN what = 'new' THEN 1 ELSE 0 END, CASE what WHEN 'keep' THEN s ELSE qs END, CASE what WHEN 'keep' THEN e ELSE qe END, CASE what WHEN 'keep' THEN d ELSE qd END, CASE what WHEN 'keep' THEN pick ELSE rn END FROM (
    SELECT q.media_id, q.rn, f.slot, f.s, f.e, f.d, f.pick, CASE WHEN {_CUT} THEN q.start_ms ELSE {_LATE} END AS qs, q.end_ms AS qe,
    CASE WHEN {_CUT} OR f.e <= q.start_ms THEN q.d ELSE CAST(length(regexp_replace(q.text, '{WS}', '', 'g')) AS DOUBLE) / greatest(CAST(0.000001 AS DOUBLE), CAST(q.end_ms - {_LATE} AS DOUBLE) / 1000) END AS qd,
    CASE WHEN {_CUT} THEN CASE WHEN q.d > f.d * 1.10 THEN 'swap' ELSE 'keep' END WHEN {_GONE} THEN 'keep' ELSE 'new' END AS what
    FROM f JOIN q ON q.media_id = f.media_id AND q.rn = f.rn + 1))
SELECT g.media_id, q.seg_idx, g.s AS start_ms, g.e AS end_ms, q.text, q.confidence FROM (SELECT media_id, slot, max_by(pick, rn) AS pick, max_by(s, rn) AS s, max_by(e, rn) AS e FROM f GROUP BY media_id, slot) g JOIN q ON q.media_id = g.media_id AND q.rn = g.pick""",
    "coalesce_absorb": f"""WITH RECURSIVE {SEGMENTS}, {_QUEUE},
f(media_id, rn, slot, alive, first, s, e, t) AS (
  SELECT DISTINCT media_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM q
  UNION ALL
  SELECT q.media_id, q.rn, f.slot + CASE WHEN NOT {_JOIN} AND NOT ({_BLANK_Q}) THEN 1 ELSE 0 END, f.alive OR NOT ({_BLANK_Q}), CASE WHEN {_JOIN} OR {_BLANK_Q} THEN f.first ELSE q.rn END, CASE WHEN {_JOIN} OR {_BLANK_Q} THEN f.s ELSE q.start_ms END,
  CASE WHEN {_JOIN} THEN q.end_ms WHEN {_BLANK_Q} THEN f.e ELSE q.end_ms END, CASE WHEN {_JOIN} THEN {_GLUED} WHEN {_BLANK_Q} THEN f.t ELSE q.text END
  FROM f JOIN q ON q.media_id = f.media_id AND q.rn = f.rn + 1)
SELECT g.media_id, q.seg_idx, g.s AS start_ms, g.e AS end_ms, g.t AS text, q.confidence FROM (SELECT media_id, slot, max_by(first, rn) AS first, max_by(s, rn) AS s, max_by(e, rn) AS e, max_by(t, rn) AS t FROM f WHERE slot > 0 GROUP BY media_id, slot) g JOIN q ON q.media_id = g.media_id AND q.rn = g.first""",
    "alloc_times": f"""WITH {SEGMENTS}, p AS (SELECT media_id, seg_idx, start_ms, end_ms, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;…]*[。！？!?；;…]|[^。！？!?；;…]+$'), lambda x: {_STRIP % 'x'}), lambda x: x <> '') AS ps FROM s WHERE end_ms > start_ms),
e AS (SELECT *, ps[k + 1] AS part, length(regexp_replace(ps[k + 1], '{WS}', '', 'g')) AS n FROM (SELECT *, unnest(range(len(ps))) AS k FROM p)),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY media_id, seg_idx ORDER BY k) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY media_id, seg_idx) AS BIGINT) AS total FROM e)
SELECT media_id, seg_idx, k AS piece, start_ms + (end_ms - start_ms) * (upto - n) // total AS start_ms, start_ms + (end_ms - start_ms) * upto // total AS end_ms, part AS text FROM r""",
    "zh_naturalize": f"""WITH {SEGMENTS}, a AS (SELECT media_id, seg_idx, regexp_replace({_STRIP % 'text'}, '{WS}+', ' ', 'g') AS t FROM s),
b AS (SELECT media_id, seg_idx, regexp_replace(regexp_replace(t, '([\\x{{4e00}}-\\x{{9fff}}]) ([\\x{{4e00}}-\\x{{9fff}}])', '\\1\\2', 'g'), '([\\x{{4e00}}-\\x{{9fff}}]) ([\\x{{4e00}}-\\x{{9fff}}])', '\\1\\2', 'g') AS t FROM a)
SELECT media_id, seg_idx, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '。+', '。', 'g'), '！+', '！', 'g'), '？+', '？', 'g'), '[,，]{{2,}}', '，', 'g'), ' *([，。！？；：]) *', '\\1', 'g') AS text FROM b""",
    "quality_report": f"""WITH {CUES}, {METRICS}, v AS ({_violations()}),
k AS (SELECT media_id, type, severity, count(*) AS n FROM v GROUP BY media_id, type, severity),
g AS (SELECT media_id, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (severity = 'major'), 0) AS BIGINT) AS major, CAST(coalesce(sum(n) FILTER (severity = 'minor'), 0) AS BIGINT) AS minor, string_agg('{{"type":"' || type || '","n":' || n || '}}', ',' ORDER BY type) AS kinds FROM k GROUP BY media_id)
SELECT c.media_id, '{{"version":"1.1","profile":"default","total_cues":' || c.n || ',"violation_count":' || coalesce(g.n, 0) || ',"major_count":' || coalesce(g.major, 0) || ',"minor_count":' || coalesce(g.minor, 0) || ',"ok":' || CASE WHEN coalesce(g.major, 0) = 0 THEN 'true' ELSE 'false' END || ',"by_type":[' || coalesce(g.kinds, '') || ']}}' AS report
FROM (SELECT media_id, count(*) AS n FROM c GROUP BY media_id) c LEFT JOIN g USING (media_id)""",
    "device_decisions": """WITH v AS (SELECT a.i * 8 + b.i * 2 + g.i AS id, a.x AS device, b.x AS compute, g.x AS gpu FROM (VALUES (0, ' CuDa:0 '), (1, 'cpu'), (2, 'auto'), (3, NULL)) a(i, x), (VALUES (0, ' FP16 '), (1, 'float16'), (2, 'int8'), (3, NULL)) b(i, x), (VALUES (0, true), (1, false)) g(i, x)),
n AS (SELECT id, gpu, lower(trim(coalesce(device, 'auto'))) AS d, lower(trim(coalesce(compute, 'float16'))) AS t FROM v),
m AS (SELECT id, CASE WHEN d IN ('', 'auto') THEN CASE WHEN gpu THEN 'cuda' ELSE 'cpu' END WHEN starts_with(d, 'cuda') AND NOT gpu THEN 'cpu' ELSE d END AS device, CASE WHEN t IN ('fp16', 'half') THEN 'float16' WHEN t = 'fp32' THEN 'float32' ELSE t END AS t FROM n)
SELECT CAST(id AS BIGINT) AS id, device, CASE WHEN device = 'cpu' AND t = 'float16' THEN 'int8' ELSE t END AS compute FROM m""",
    "path_helpers": """SELECT media_id, regexp_replace(regexp_replace(regexp_replace(source_path || '.fixed.fixed.srt', '^.*/', ''), '\\.[^.]*$', ''), '(\\.fixed)+$', '') AS stem,
regexp_replace(replace('C:' || source_path, '\\', '/'), '([:'',\\[\\]])', '\\\\\\1', 'g') AS escaped, CAST(CASE WHEN TRY_CAST(regexp_extract(media_id, '(\\d\\d)$', 1) AS INTEGER) > 0 THEN TRY_CAST(regexp_extract(media_id, '(\\d\\d)$', 1) AS INTEGER) ELSE 5400 END AS BIGINT) AS timeout FROM media""",
}

_ORDER = "CASE job_state WHEN 'queued' THEN 0 WHEN 'started' THEN 1 WHEN 'running' THEN 2 ELSE 3 END"
_VALID = "(json_valid(payload) AND starts_with(trim(payload), '{'))"


def _field(path: str) -> str:
    return f"CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.{path}') END"


ORACLES |= {
    "job_transitions": f"""WITH d AS (SELECT DISTINCT job_id, updated_at, job_state FROM job_status WHERE job_id IS NOT NULL AND updated_at IS NOT NULL AND job_state IS NOT NULL),
l AS (SELECT *, lag(job_state) OVER (PARTITION BY job_id ORDER BY updated_at, {_ORDER}, job_state) AS f FROM d)
SELECT job_id, epoch_us(updated_at) AS updated_us, f AS from_state, job_state AS to_state, CASE f WHEN 'queued' THEN true WHEN 'started' THEN job_state <> 'queued' WHEN 'running' THEN job_state NOT IN ('queued', 'started') ELSE job_state = f END AS allowed FROM l WHERE f IS NOT NULL""",
    "job_specs": f"""WITH r AS (SELECT * FROM raw_job_docs WHERE doc_type = 'job_spec' AND payload IS NOT NULL), x AS (SELECT file_id, line_no, {_VALID} AS valid, {_field('job_id')} AS job_id, {_field('kind')} AS job_kind, {_field('job_root')} AS job_root, {_field('inputs.pipeline_args.timeout_sec')} AS t FROM r)
SELECT file_id, line_no, CASE WHEN valid THEN job_id END AS job_id, CASE WHEN valid THEN {_KIND} END AS kind, CASE WHEN valid THEN job_root END AS job_root, CASE WHEN valid THEN CAST(CASE WHEN TRY_CAST(t AS INTEGER) > 0 THEN TRY_CAST(t AS INTEGER) ELSE 5400 END AS BIGINT) END AS timeout_sec, valid FROM x""",
    "quality_counts": f"""WITH r AS (SELECT * FROM raw_job_docs WHERE doc_type = 'quality_report' AND payload IS NOT NULL)
SELECT file_id, line_no, {", ".join(f"TRY_CAST({_field('summary.' + c)} AS BIGINT) AS {c}" for c in ('total_cues', 'violation_count', 'major_count', 'minor_count'))} FROM r""",
    "path_policy": """SELECT media_id, coalesce(starts_with(source_path, '/data/media/') AND NOT regexp_matches(source_path, '(^|/)\\.{1,2}(/|$)'), false) AS allowed,
coalesce(starts_with(replace(source_path, '/main', '/../main'), '/data/') AND NOT regexp_matches(replace(source_path, '/main', '/../main'), '(^|/)\\.{1,2}(/|$)'), false) AS tricked FROM media""",
}

_KINDS = "CASE WHEN t.type = 'VARCHAR' THEN 'string' WHEN t.type = 'BOOLEAN' THEN 'boolean' WHEN t.type = 'ARRAY' THEN 'array' ELSE 'number' END"
#: One row per leaf of each valid document, as a JSON engine of its own sees them.
LEAVES = f"""ok AS (SELECT * FROM raw_job_docs WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
lv AS (SELECT r.feed, r.file_seq, r.file_id, r.line_no, substring(t.fullkey, 3) AS path, {_KINDS} AS kind, CASE WHEN t.type IN ('VARCHAR', 'BOOLEAN', 'ARRAY') THEN CAST(t.value AS VARCHAR) ELSE CAST(CAST(t.value AS DOUBLE) AS VARCHAR) END AS val
  FROM ok r, json_tree(r.payload) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND NOT contains(t.fullkey, '['))"""

ORACLES |= {
    "p1_alternatives": f"WITH {LEAVES} SELECT feed, path, kind, count(*) AS docs, min(file_seq) AS first_seq, max(file_seq) AS last_seq FROM lv GROUP BY feed, path, kind",
    "p1_found": f"""WITH {LEAVES},
files AS (SELECT feed, file_seq, min(file_id) AS file_id FROM raw_job_docs GROUP BY feed, file_seq),
pairs AS (SELECT b.feed, b.file_seq, b.file_id FROM files b JOIN files a ON a.feed = b.feed AND a.file_seq = b.file_seq - 1),
sch AS (SELECT feed, file_seq, path, list_sort(list(DISTINCT kind)) AS kinds FROM lv GROUP BY feed, file_seq, path),
ch AS (SELECT p.feed, p.file_seq, p.file_id, x.path, x.old, x.new FROM pairs p JOIN (SELECT coalesce(n.feed, o.feed) AS feed, coalesce(n.file_seq, o.file_seq + 1) AS file_seq, coalesce(n.path, o.path) AS path, o.kinds AS old, n.kinds AS new FROM sch n FULL JOIN sch o ON o.feed = n.feed AND o.file_seq + 1 = n.file_seq AND o.path = n.path) x USING (feed, file_seq) WHERE x.old IS DISTINCT FROM x.new),
docs AS (SELECT feed, file_seq, line_no, md5(string_agg(path || chr(1) || kind || chr(1) || val, chr(2) ORDER BY path)) AS doc FROM lv GROUP BY feed, file_seq, file_id, line_no),
dl AS (SELECT DISTINCT l.feed, l.file_seq, d.doc, l.path, l.kind || chr(1) || l.val AS v FROM lv l JOIN docs d USING (feed, file_seq, line_no)),
open AS (SELECT DISTINCT g.feed, g.file_seq FROM ch g JOIN ch c USING (feed, file_seq) WHERE g.new IS NULL AND c.old IS NULL),
st AS (SELECT o.feed, o.file_seq, a.doc AS od, b.doc AS nd, count(*) FILTER (a.v = b.v) AS votes, count(*) AS n FROM open o JOIN dl a ON a.feed = o.feed AND a.file_seq = o.file_seq - 1 JOIN dl b ON b.feed = o.feed AND b.file_seq = o.file_seq AND b.path = a.path
  WHERE (o.feed, o.file_seq, a.path) NOT IN (SELECT (feed, file_seq, path) FROM ch) GROUP BY ALL HAVING votes >= 2 AND votes >= 0.9 * n),
sh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed, file_seq, od ORDER BY votes DESC, nd) AS x, row_number() OVER (PARTITION BY feed, file_seq, nd ORDER BY votes DESC, od) AS y FROM st) WHERE x = 1 AND y = 1),
cand AS (SELECT g.feed, g.file_seq, g.path AS op, c.path AS np FROM ch g JOIN ch c USING (feed, file_seq) WHERE g.new IS NULL AND c.old IS NULL AND len(list_intersect(g.old, c.new)) > 0),
pr AS (SELECT k.feed, k.file_seq, k.op, k.np, a.v AS ov, b.v AS nv FROM cand k JOIN sh ON sh.feed = k.feed AND sh.file_seq = k.file_seq LEFT JOIN dl a ON a.feed = k.feed AND a.file_seq = k.file_seq - 1 AND a.doc = sh.od AND a.path = k.op LEFT JOIN dl b ON b.feed = k.feed AND b.file_seq = k.file_seq AND b.doc = sh.nd AND b.path = k.np),
sc AS (SELECT feed, file_seq, op, np, count(*) FILTER (ov = nv) AS same, count(*) FILTER (ov IS DISTINCT FROM nv) AS differ, count(DISTINCT ov) AS seen, levenshtein(lower(regexp_replace(regexp_extract(op, '[^.]*$'), '[_-]', '', 'g')), lower(regexp_replace(regexp_extract(np, '[^.]*$'), '[_-]', '', 'g'))) AS near FROM pr GROUP BY ALL),
ren AS (SELECT feed, file_seq, op, np FROM (SELECT *, row_number() OVER (PARTITION BY feed, file_seq, op ORDER BY seen DESC, same DESC, near, op, np) AS x, row_number() OVER (PARTITION BY feed, file_seq, np ORDER BY seen DESC, same DESC, near, op, np) AS y FROM sc WHERE differ = 0 AND same > 0) WHERE x = 1 AND y = 1)
SELECT file_id, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'type_changed' END AS change_kind, CASE WHEN old IS NULL THEN '' ELSE path END AS old_path, CASE WHEN new IS NULL THEN '' ELSE path END AS new_path FROM ch
WHERE NOT (new IS NULL AND (feed, file_seq, path) IN (SELECT (feed, file_seq, op) FROM ren)) AND NOT (old IS NULL AND (feed, file_seq, path) IN (SELECT (feed, file_seq, np) FROM ren))
UNION ALL SELECT files.file_id, 'renamed', op, np FROM ren JOIN files USING (feed, file_seq)""",
}


def _fix_pass(src: str, tag: str) -> str:
    """Overlaps, speed and duration as three steps over rows (media_id, n, start_ms, end_ms, chars) of src."""
    overlap = f"{tag}o AS (SELECT media_id, n, chars, CASE WHEN start_ms < p THEN CASE WHEN p >= end_ms THEN greatest(end_ms - 1, 0) ELSE p END ELSE start_ms END AS start_ms, end_ms FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY n) AS p FROM {src}))"
    return f"{overlap}, {_stretch_step(f'{tag}o', f'{tag}c', f'NOT (chars > 0 AND e > s AND {_FAST.format(a="s", b="e")})', 'ceil(chars / CAST(16 AS DOUBLE) * CAST(1000 AS DOUBLE))', _FAST)}, {_stretch_step(f'{tag}c', f'{tag}d', 'e - s >= 900', '900', '{b} - {a} < 900')}"


def _stretch_step(src: str, out: str, skip: str, need: str, short: str) -> str:
    """`_stretch` as named steps of a longer query."""
    body = _stretch(skip, need, short)
    step = body[body.index("f(media_id") : body.rindex("SELECT o.media_id, o.cue_index")].rstrip()
    step = step.replace("f(media_id", f"{out}f(media_id").replace("FROM f JOIN o ON o.media_id = f.media_id", f"FROM {out}f f JOIN {out}q o ON o.media_id = f.media_id").replace("FROM (SELECT DISTINCT media_id FROM o)", f"FROM (SELECT DISTINCT media_id FROM {out}q)")
    queue = f"{out}q AS (SELECT *, row_number() OVER p AS rn, lead(start_ms) OVER p AS ns, lead(end_ms) OVER p AS ne FROM {src} WINDOW p AS (PARTITION BY media_id ORDER BY n))"
    return f"{queue}, {step}, {out} AS (SELECT q.media_id, q.n, q.chars, f.out_start AS start_ms, f.out_end AS end_ms FROM {out}f f JOIN {out}q q ON q.media_id = f.media_id AND q.rn = f.rn)"


ORACLES["fix_loop_times"] = f"""WITH RECURSIVE {CUES}, z AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, cue_index) - 1 AS n, start_ms, end_ms, CAST(length(regexp_replace(text, '{WS}', '', 'g')) AS BIGINT) AS chars FROM c),
{_fix_pass("z", "a")}, {_fix_pass("ad", "b")}, {_fix_pass("bd", "e")}
SELECT media_id, n AS cue_index, start_ms, end_ms FROM ed"""


def _cjk(x: str) -> str:
    n = _CJK.replace("text", x, 1)
    return f"({n} >= 4 AND {n} >= length(regexp_replace({x}, '[^A-Za-z]', '', 'g')))"


def _wrapped(src: str, width: int, most: int) -> str:
    """Steps that wrap the texts of src (media_id, cue_index, text) into one or two lines: `wr` (media_id, cue_index, text)."""
    strip = lambda x: _STRIP % x
    cut = lambda x: f"coalesce(list_max(list_filter(range({width - width // 3 + 1}, {width + 1}), lambda k: contains('，。！？；：、,.!?;:', {x}[k]))), {width})"
    first = f"CASE WHEN length(dense) <= {width} THEN dense ELSE dense[1:{cut('dense')}] END"
    second = f"CASE WHEN length(more) <= {width} THEN more ELSE more[1:{cut('more')}] END"
    part = lambda a, b: f"array_to_string(ws[{a}:{b}], ' ')"
    best = f"list_sort(list_filter(list_transform(range(1, len(ws)), lambda i: {{'m': greatest(length({part('1', 'i')}), length({part('i + 1', 'len(ws)')})), 'a': {part('1', 'i')}, 'b': {part('i + 1', 'len(ws)')}}}), lambda x: x.m <= {width}))[1]"
    fill = f"coalesce(list_max(list_filter(range(1, len(ws) + 1), lambda i: length({part('1', 'i')}) <= {width})), 1)"
    greedy = f"array_to_string(ws[1:fill], ' ') || CASE WHEN fill < len(ws) THEN chr(10) || ws[fill + 1] ELSE '' END"
    flat = "flat" if most == 1 else f"CASE WHEN length(flat) <= {width} THEN flat WHEN best IS NOT NULL THEN best.a || chr(10) || best.b ELSE {greedy} END"
    return f"""wa AS (SELECT media_id, cue_index, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') AS ls FROM {src}),
wb AS (SELECT *, array_to_string(ls, '') AS tight, array_to_string(ls, ' ') AS loose FROM wa),
wc AS (SELECT media_id, cue_index, text, list_filter(string_split_regex(CASE WHEN {_cjk('tight')} THEN tight ELSE loose END, '{WS}+'), lambda x: x <> '') AS ws FROM wb),
wd AS (SELECT *, array_to_string(ws, ' ') AS flat, array_to_string(ws, '') AS dense, {best if most > 1 else 'NULL'} AS best, {fill} AS fill FROM wc),
we AS (SELECT *, {first} AS line_1 FROM wd), wf AS (SELECT *, dense[length(line_1) + 1:] AS more FROM we),
wr AS (SELECT media_id, cue_index, CASE WHEN len(ws) = 0 THEN text WHEN {_cjk('flat')} OR len(ws) < 2 THEN {f"line_1 || CASE WHEN more <> '' THEN chr(10) || {second} ELSE '' END" if most > 1 else 'line_1'} ELSE {flat} END AS text FROM wf)"""


#: Cues numbered by time as `c`, the items that break a rule as `bad`, and `fin`: what three passes make of them, texts and all.
_BY_TIME = f"{CUES.replace('c AS', 'c0 AS', 1)}, c AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, cue_index) - 1 AS cue_index, start_ms, end_ms, text FROM c0)"
_CHARS = f"CAST(length(regexp_replace(%s, '{WS}', '', 'g')) AS BIGINT)"
_FINAL = f"""{_BY_TIME}, {METRICS}, bad AS (SELECT DISTINCT media_id FROM ({_violations()}) WHERE severity = 'major'), {_wrapped("c", 18, 1)},
z AS (SELECT c.media_id, c.cue_index AS n, start_ms, end_ms, {_CHARS % 'c.text'} AS chars FROM c), {_fix_pass("z", "a")},
za AS (SELECT ad.media_id, n, start_ms, end_ms, {_CHARS % 'wr.text'} AS chars FROM ad JOIN wr ON wr.media_id = ad.media_id AND wr.cue_index = ad.n), {_fix_pass("za", "b")}, {_fix_pass("bd", "e")},
fin AS (SELECT c.media_id, c.cue_index, CASE WHEN bad.media_id IS NULL THEN c.start_ms ELSE ed.start_ms END AS start_ms, CASE WHEN bad.media_id IS NULL THEN c.end_ms ELSE ed.end_ms END AS end_ms, CASE WHEN bad.media_id IS NULL THEN c.text ELSE wr.text END AS text
  FROM c JOIN ed ON ed.media_id = c.media_id AND ed.n = c.cue_index JOIN wr ON wr.media_id = c.media_id AND wr.cue_index = c.cue_index LEFT JOIN bad ON bad.media_id = c.media_id)"""
_SUMMED = f"""SELECT c.media_id, count(*) AS total_cues, any_value(coalesce(n, 0)) AS violation_count, any_value(coalesce(j, 0)) AS major_count, any_value(coalesce(n, 0) - coalesce(j, 0)) AS minor_count, any_value(coalesce(j, 0)) = 0 AS ok
FROM c LEFT JOIN (SELECT media_id, count(*) AS n, count(*) FILTER (severity = 'major') AS j FROM ({_violations()}) GROUP BY media_id) v ON v.media_id = c.media_id GROUP BY c.media_id"""
_DETAIL = {
    "BAD_TIMECODE_ORDER": ("prev_start_ms",), "EMPTY_TEXT": (), "TOO_SHORT_DURATION": ("dur_ms",), "TOO_LONG_DURATION": ("dur_ms",), "TOO_FAST_CPS": ("cps", "char_count", "dur_ms"), "LINE_TOO_LONG": ("max_line_len", "lines"), "TOO_MANY_LINES": ("line_count", "lines"),
    "OVERLAP": ("overlap_ms", "prev_end_ms"),
}
_SOURCE = {"dur_ms": "mm.duration_ms", "overlap_ms": "greatest(mm.prev_end_ms - mm.start_ms, 0)", "lines": f"array_to_string(list_filter(string_split(mm.text, chr(10)), lambda x: regexp_replace(x, '{WS}', '', 'g') <> ''), chr(10))"}
_SHOWN = ", ".join(f"CASE WHEN v.type IN ({', '.join(repr(t) for t, seen in _DETAIL.items() if name in seen)}) THEN {_SOURCE.get(name, f'mm.{name}')} END AS {name}" for name in ("prev_start_ms", "dur_ms", "cps", "char_count", "max_line_len", "line_count", "lines", "overlap_ms", "prev_end_ms"))
ORACLES |= {
    "wrap_lines": f"WITH {CUES}, {_wrapped('c', 42, 2)} SELECT media_id, cue_index, text FROM wr",
    "fix_loop_final": f"WITH RECURSIVE {_FINAL} SELECT media_id, cue_index, start_ms, end_ms, text FROM fin",
    "fix_loop_summary": f"WITH RECURSIVE {_FINAL} SELECT * FROM (WITH c AS (SELECT * FROM fin), {METRICS} {_SUMMED})",
    "violation_details": f"WITH {CUES}, {METRICS}, v AS ({_violations()}) SELECT v.media_id, v.cue_index, mm.start_ms, mm.end_ms, v.type, v.severity, {_SHOWN}, CASE WHEN v.type NOT IN ('EMPTY_TEXT', 'BAD_TIMECODE_ORDER') THEN v.threshold END AS threshold FROM v JOIN mm USING (media_id, cue_index)",
    "transcript_srt": f"""WITH {SEGMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) AS number FROM s)
SELECT media_id, string_agg(CAST(number AS VARCHAR) || chr(10) || {_timecode('start_ms')} || ' --> ' || {_timecode('end_ms')} || chr(10) || coalesce(nullif({_STRIP % 'text'}, ''), ' ') || chr(10), chr(10) ORDER BY number) AS srt FROM n GROUP BY media_id""",
    "range_words": f"""WITH {SEGMENTS}, {WORDS} SELECT w.media_id, w.seg_idx, w.word_idx, greatest(w.start_ms + 250, s.start_ms) AS start_ms, least(w.end_ms + 250, s.end_ms) AS end_ms, w.word FROM w JOIN s ON s.media_id = w.media_id AND s.seg_idx = w.seg_idx
WHERE s.start_ms < s.end_ms AND greatest(w.start_ms + 250, s.start_ms) < least(w.end_ms + 250, s.end_ms)""",
}

# Chinese lines: one step cuts one line off.
_ZH_TEXT = f"CASE WHEN {_STRIP % 'text'} = '' THEN '' ELSE {_ZH % 'text'} END"


def _break(marks: str) -> str:
    return f"list_max(list_filter(range(2, 19), lambda k: contains('{marks}', rest[k]) AND NOT contains('，。、！？!?；;：:）)]】》」』”’…', rest[k + 1])))"


ORACLES["wrap_zh"] = f"""WITH RECURSIVE {SEGMENTS}, t AS (SELECT media_id, seg_idx, text, {_ZH_TEXT} AS zh FROM s),
f(media_id, seg_idx, lines, rest) AS (SELECT media_id, seg_idx, CAST([] AS VARCHAR[]), {_STRIP % 'zh'} FROM t
 UNION ALL SELECT media_id, seg_idx, list_append(lines, {_STRIP % 'rest[1:cut]'}), rest[cut + 1:] FROM (
  SELECT *, coalesce({_break('。！？!?；;…')}, {_break('，、,:：')}, CASE WHEN contains('，。、！？!?；;：:）)]】》」』”’…', rest[19]) THEN 17 ELSE 18 END) AS cut FROM f WHERE length(rest) > 18)),
g AS (SELECT media_id, seg_idx, list_filter(list_append(lines, {_STRIP % 'rest'}), lambda x: x <> '') AS ls FROM f WHERE length(rest) <= 18),
h AS (SELECT media_id, seg_idx, CASE WHEN len(ls) > 1 AND length(ls[-1]) = 1 THEN list_append(ls[1:len(ls) - 2], ls[-2] || ls[-1]) ELSE ls END AS ls FROM g)
SELECT media_id, seg_idx, CASE WHEN t.zh = '' THEN t.text WHEN len(ls) > 2 THEN ls[1] || chr(10) || array_to_string(ls[2:], '') ELSE array_to_string(ls, chr(10)) END AS text FROM h JOIN t USING (media_id, seg_idx)"""


_LEADING = r"[，。、！？!?；;：:）)\]】》」』”’…]"


def _zh_lines(src: str, name: str) -> str:
    """Lines (text, ls) of the distinct texts of src, as Chinese text is wrapped at 18: one step cuts one line off."""
    return f"""{name}f(text, lines, rest) AS (SELECT DISTINCT text, CAST([] AS VARCHAR[]), {_STRIP % f"({_ZH % 'text'})"} FROM {src}
 UNION ALL SELECT text, list_append(lines, {_STRIP % 'rest[1:cut]'}), rest[cut + 1:] FROM (
  SELECT *, coalesce({_break('。！？!?；;…')}, {_break('，、,:：')}, CASE WHEN contains('，。、！？!?；;：:）)]】》」』”’…', rest[19]) THEN 17 ELSE 18 END) AS cut FROM {name}f WHERE length(rest) > 18)),
{name} AS (SELECT text, CASE WHEN len(ls) > 1 AND length(ls[-1]) = 1 THEN list_append(ls[1:len(ls) - 2], ls[-2] || ls[-1]) ELSE ls END AS ls FROM (SELECT text, list_filter(list_append(lines, {_STRIP % 'rest'}), lambda x: x <> '') AS ls FROM {name}f WHERE length(rest) <= 18))"""


def _added(src: str, name: str) -> str:
    """(id, out) of src (id, items): items one after the other, closing marks at the head of one going to the one before."""
    return f"""{name}f(id, items, i, out) AS (SELECT id, items, 0, CAST([] AS VARCHAR[]) FROM {src}
 UNION ALL SELECT id, items, i + 1, CASE WHEN p = '' THEN out WHEN len(out) = 0 THEN [p] ELSE list_concat(list_append(out[1:len(out) - 1], out[-1] || regexp_replace(head, '{WS}+', '', 'g')), CASE WHEN more = '' THEN CAST([] AS VARCHAR[]) ELSE [more] END) END FROM (
  SELECT *, {_STRIP % 'p[length(head) + 1:]'} AS more FROM (SELECT *, regexp_extract(p, '^(?:{_LEADING}{WS}*)+') AS head FROM (SELECT *, {_STRIP % 'items[i + 1]'} AS p FROM {name}f WHERE i < len(items))))),
{name} AS (SELECT id, out FROM {name}f WHERE i = len(items))"""


def _packed(src: str, name: str, cap: int) -> str:
    """(id, out) of the distinct texts of src: tokens packed up to cap characters, longer ones cut; id is the text."""
    return f"""{name}t AS (SELECT DISTINCT text, regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]+|[A-Za-z0-9]+(?:''[A-Za-z0-9]+)?|[^\\x{{09}}-\\x{{0d}}\\x{{1c}}-\\x{{20}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]') AS toks FROM {src}),
{name}p(text, toks, i, done, piece) AS (SELECT text, toks, 0, CAST([] AS VARCHAR[]), '' FROM {name}t
 UNION ALL SELECT text, toks, i + 1, CASE WHEN length(t) > {cap} THEN list_concat(list_append(done, piece), list_transform(range(0, length(t), {cap}), lambda k: t[k + 1:k + {cap}])) WHEN length(piece) + length(t) <= {cap} THEN done ELSE list_append(done, piece) END,
  CASE WHEN length(t) > {cap} THEN '' WHEN length(piece) + length(t) <= {cap} THEN piece || t ELSE t END FROM (SELECT *, toks[i + 1] AS t FROM {name}p WHERE i < len(toks))),
{name}s AS (SELECT text AS id, list_append(done, piece) AS items FROM {name}p WHERE i = len(toks)), {_added(f'{name}s', name)}"""


_WRAPPED_ZH = "CASE WHEN len({x}) > 2 THEN {x}[1] || chr(10) || array_to_string({x}[2:], '') ELSE array_to_string({x}, chr(10)) END"
ORACLES["zh_layout_split"] = f"""WITH RECURSIVE {SEGMENTS},
sn AS (SELECT media_id, seg_idx, k, {_ZH % "x"} AS text FROM (SELECT media_id, seg_idx, k, all_x[k + 1] AS x FROM (SELECT *, unnest(range(len(all_x))) AS k FROM (SELECT media_id, seg_idx, regexp_extract_all({_ZH % 'text'}, '[^。！？!?；;…]*[。！？!?；;…]|[^。！？!?；;…]+$') AS all_x FROM s WHERE {_STRIP % 'text'} <> '')))),
la AS (SELECT text FROM sn WHERE text <> '' AND length(text) <= 36), {_zh_lines('la', 'lb')},
whole AS (SELECT text FROM lb WHERE len(ls) <= 2), big AS (SELECT DISTINCT text FROM sn WHERE text NOT IN (SELECT text FROM whole)), {_packed('big', 'pa', 36)},
pieces AS (SELECT id, k, out[k + 1] AS text FROM (SELECT *, unnest(range(len(out))) AS k FROM pa)), {_zh_lines('pieces', 'lc')},
wide AS (SELECT text FROM lc WHERE len(ls) > 2), {_packed('wide', 'pb', 18)},
own AS (SELECT p.id, flatten(list(coalesce(pb.out, [p.text]) ORDER BY p.k)) AS items FROM pieces p LEFT JOIN pb ON pb.id = p.text GROUP BY p.id), {_added('own', 'pc')},
every AS (SELECT {{'m': media_id, 'i': seg_idx}} AS id, flatten(list(CASE WHEN sn.text IN (SELECT text FROM whole) THEN [sn.text] ELSE coalesce(pc.out, CAST([] AS VARCHAR[])) END ORDER BY k)) AS items FROM sn LEFT JOIN pc ON pc.id = sn.text GROUP BY media_id, seg_idx), {_added('every', 'pd')},
laid AS (SELECT s.*, coalesce(pd.out, CAST([] AS VARCHAR[])) AS parts FROM s LEFT JOIN pd ON pd.id.m = s.media_id AND pd.id.i = s.seg_idx),
rows_ AS (SELECT media_id, seg_idx, k AS part, start_ms, end_ms, len(parts) AS n, parts[k + 1] AS text FROM (SELECT *, unnest(range(len(parts))) AS k FROM laid WHERE len(parts) > 1)),
texts AS (SELECT text FROM rows_ UNION SELECT text FROM laid WHERE len(parts) <= 1), {_zh_lines('texts', 'ld')},
wt AS (SELECT *, length(regexp_replace(text, '{WS}', '', 'g')) AS own FROM rows_),
wu AS (SELECT *, CASE WHEN sum(own) OVER seg = 0 THEN 1 ELSE own END AS w FROM wt WINDOW seg AS (PARTITION BY media_id, seg_idx)),
wv AS (SELECT *, sum(w) OVER (PARTITION BY media_id, seg_idx ORDER BY part) AS upto, sum(w) OVER (PARTITION BY media_id, seg_idx) AS total FROM wu),
ww AS (SELECT *, part + 1 + greatest(start_ms, max(start_ms + (end_ms - start_ms) * upto // total - part - 1) OVER (PARTITION BY media_id, seg_idx ORDER BY part)) AS edge FROM wv),
wx AS (SELECT *, coalesce(lag(edge) OVER (PARTITION BY media_id, seg_idx ORDER BY part), start_ms) AS from_ms FROM ww)
SELECT media_id, seg_idx, part, CAST(CASE WHEN end_ms <= start_ms THEN start_ms + part ELSE from_ms END AS BIGINT) AS start_ms,
 CAST(CASE WHEN end_ms <= start_ms THEN start_ms + part + 1 WHEN part = n - 1 THEN greatest(end_ms, from_ms + 1) ELSE edge END AS BIGINT) AS end_ms, {_WRAPPED_ZH.format(x='ls')} AS text FROM wx JOIN ld USING (text)
UNION ALL SELECT media_id, seg_idx, 0, start_ms, end_ms, CASE WHEN {_STRIP % 'text'} = '' THEN text ELSE {_WRAPPED_ZH.format(x='ls')} END FROM laid JOIN ld USING (text) WHERE len(parts) <= 1"""

_SHORT_RULE = ("e - s >= 900", "900", "{b} - {a} < 900")
_FAST_RULE = (f"NOT (chars > 0 AND e > s AND {_FAST.format(a='s', b='e')})", "ceil(chars / CAST(16 AS DOUBLE) * CAST(1000 AS DOUBLE))", _FAST)
ORACLES["subtitle_fixes"] = f"""WITH RECURSIVE {CUES}, {_wrapped("c", 42, 2)},
z AS (SELECT media_id, cue_index, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, cue_index) - 1 AS n, start_ms, end_ms, {_CHARS % 'text'} AS chars FROM c),
zo AS (SELECT media_id, n, chars, CASE WHEN start_ms < p THEN CASE WHEN p >= end_ms THEN greatest(end_ms - 1, 0) ELSE p END ELSE start_ms END AS start_ms, end_ms FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY n) AS p FROM z)),
{_stretch_step('zo', 'zd', *_SHORT_RULE)}, {_stretch_step('zd', 'zc', *_FAST_RULE)}
SELECT z.media_id, z.cue_index, zc.start_ms, zc.end_ms, wr.text FROM zc JOIN z ON z.media_id = zc.media_id AND z.n = zc.n JOIN wr ON wr.media_id = z.media_id AND wr.cue_index = z.cue_index"""


def _acted(number: int, *steps: str) -> str:
    """Items in which a step of a pass has moved a cue."""
    moved = " UNION ALL ".join(f"SELECT a.media_id FROM {a} a JOIN {b} b ON b.media_id = a.media_id AND b.n = a.n WHERE a.start_ms <> b.start_ms OR a.end_ms <> b.end_ms" for a, b in zip(steps, steps[1:]))
    return f"SELECT media_id, {number} AS pass FROM ({moved})"


ORACLES["fix_loop_report"] = f"""WITH RECURSIVE {_FINAL},
wrapped_ AS (SELECT c.media_id, 1 AS pass FROM c JOIN wr ON wr.media_id = c.media_id AND wr.cue_index = c.cue_index WHERE c.text <> wr.text),
acted AS (SELECT media_id, max(pass) AS acted FROM ({_acted(1, 'z', 'ao', 'ac', 'ad')} UNION ALL {_acted(2, 'za', 'bo', 'bc', 'bd')} UNION ALL {_acted(3, 'bd', 'eo', 'ec', 'ed')} UNION ALL SELECT * FROM wrapped_) WHERE media_id IN (SELECT media_id FROM bad) GROUP BY media_id),
changed AS (SELECT media_id, count(*) AS changed FROM (SELECT media_id, start_ms, end_ms, text FROM fin EXCEPT ALL SELECT media_id, start_ms, end_ms, text FROM c0) GROUP BY media_id),
old AS (SELECT * FROM (WITH c AS (SELECT * FROM c0), {METRICS} {_SUMMED})), new AS (SELECT * FROM (WITH c AS (SELECT * FROM fin), {METRICS} {_SUMMED}))
SELECT media_id, old.total_cues AS cues, old.ok AS ok_before, old.major_count AS major_before, new.ok AS ok_after, new.major_count AS major_after, coalesce(changed, 0) AS changed,
 CASE WHEN old.ok THEN 0 WHEN new.ok THEN coalesce(acted, 0) ELSE least(coalesce(acted, 0) + 1, 3) END AS passes, CASE WHEN old.ok THEN 'ok_before' WHEN new.ok THEN 'ok' WHEN coalesce(acted, 0) < 3 THEN 'no_progress' ELSE 'budget' END AS stop
FROM old JOIN new USING (media_id) LEFT JOIN changed USING (media_id) LEFT JOIN acted USING (media_id)"""
ORACLES["audio_commands"] = """WITH m AS (SELECT media_id, source_path AS p, length(source_path) % 3 AS mode, regexp_replace(regexp_replace(source_path, '^.*/', ''), '\\.[^.]*$', '') AS stem FROM media WHERE source_path IS NOT NULL)
SELECT media_id, 0 AS number, 'extract' AS step, 'ffmpeg -y -i ' || p || ' -vn -ac 1 -ar 16000 ' || CASE WHEN mode = 1 THEN '-af highpass=f=80,lowpass=f=8000,dynaudnorm=f=150:g=15,afftdn=nf=-25 -f wav /work/' || stem || '.audio.speech.wav' ELSE '-f wav /work/' || stem || '.audio.wav' END AS args FROM m
UNION ALL SELECT media_id, 1, 'separate', '/work/' || stem || '.audio.wav /work htdemucs' FROM m WHERE mode = 2
UNION ALL SELECT media_id, 2, 'filter', 'ffmpeg -y -i /work/htdemucs/' || stem || '.audio/vocals.wav -af highpass=f=80,lowpass=f=8000,dynaudnorm=f=150:g=15,afftdn=nf=-25 -f wav /work/' || stem || '.audio.vocals.speech.wav' FROM m WHERE mode = 2"""
