"""The same queries as plain SQL, by other methods where there is a choice."""

from __future__ import annotations

_TICK_NOTES = """
tick_notes AS (
  SELECT l_suppkey AS song_id, CAST(l_partkey % 128 AS INTEGER) AS pitch,
         (l_orderkey * 1009 + l_linenumber * 97) % 200000 AS start_tick,
         CAST(l_quantity AS BIGINT) * 48 AS len_ticks,
         CAST(1 + l_orderkey % 127 AS INTEGER) AS velocity
  FROM lineitem)"""

_STEADY = _TICK_NOTES + """,
timed AS (
  SELECT *, (start_tick * 500000 + 240) // 480 AS start_us,
         ((start_tick + len_ticks) * 500000 + 240) // 480 - (start_tick * 500000 + 240) // 480 AS dur_us
  FROM tick_notes),
notes AS (
  SELECT song_id, CAST(pitch - 21 AS INTEGER) AS key_index, velocity, start_us, dur_us,
         CASE WHEN pitch >= 60 THEN 'upper' ELSE 'lower' END AS hand
  FROM timed WHERE pitch >= 21 AND pitch < 108)"""

_SEGMENTS = """
changes AS (
  SELECT o_custkey AS song_id, (o_orderkey * 7919) % 200000 AS tick,
         CAST(max(300000 + (o_orderkey * 31) % 400000) AS BIGINT) AS us_per_quarter
  FROM orders GROUP BY ALL),
steps AS (
  SELECT *, coalesce((tick - lag(tick) OVER w) * lag(us_per_quarter) OVER w, tick * 500000) AS step
  FROM changes WINDOW w AS (PARTITION BY song_id ORDER BY tick)),
segments AS (
  SELECT song_id, tick, us_per_quarter,
         CAST(sum(step) OVER (PARTITION BY song_id ORDER BY tick) AS BIGINT) AS base_num
  FROM steps)"""

_TEMPO_NOTES = _TICK_NOTES + "," + _SEGMENTS + """,
tempo_starts AS (
  SELECT n.*, (coalesce(s.base_num + (n.start_tick - s.tick) * s.us_per_quarter, n.start_tick * 500000) + 240) // 480 AS start_us
  FROM tick_notes n ASOF LEFT JOIN segments s ON n.song_id = s.song_id AND n.start_tick >= s.tick),
tempo_ends AS (
  SELECT n.*, (coalesce(s.base_num + (n.start_tick + n.len_ticks - s.tick) * s.us_per_quarter,
                        (n.start_tick + n.len_ticks) * 500000) + 240) // 480 AS end_us
  FROM tempo_starts n ASOF LEFT JOIN segments s ON n.song_id = s.song_id AND n.start_tick + n.len_ticks >= s.tick),
tempo_timed AS (SELECT * EXCLUDE (end_us), end_us - start_us AS dur_us FROM tempo_ends),
tempo_notes AS (
  SELECT song_id, CAST(pitch - 21 AS INTEGER) AS key_index, velocity, start_us, dur_us,
         CASE WHEN pitch >= 60 THEN 'upper' ELSE 'lower' END AS hand
  FROM tempo_timed WHERE pitch >= 21 AND pitch < 108)"""

_KEYS = """
key_base AS (
  SELECT CAST(i AS INTEGER) AS key_index, (i + 21) % 12 IN (1, 3, 6, 8, 10) AS is_black,
         ['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'][(i + 21) % 12 + 1] AS label
  FROM generate_series(0, 87) g(i)),
key_ranks AS (
  SELECT *, (SELECT count(*) FROM key_base b WHERE NOT b.is_black AND b.key_index <= a.key_index) AS whites FROM key_base a),
keys AS (
  SELECT key_index, is_black,
         CAST(CASE WHEN is_black THEN whites * 1280 // 52 - 7 ELSE (whites - 1) * 1280 // 52 END AS INTEGER) AS x,
         CAST(570 AS INTEGER) AS y,
         CAST(CASE WHEN is_black THEN 14 ELSE whites * 1280 // 52 - (whites - 1) * 1280 // 52 END AS INTEGER) AS width,
         CAST(CASE WHEN is_black THEN 90 ELSE 150 END AS INTEGER) AS height, label,
         CAST(row_number() OVER (ORDER BY is_black, key_index) - 1 AS INTEGER) AS z_order
  FROM key_ranks)"""

_SNAPSHOTS = """
snapshots AS (
  SELECT s_suppkey AS song_id, c + s_suppkey * 1000 AS t_us
  FROM supplier, (SELECT unnest([0, 37000000, 101000000, 163000000]) AS c))"""

_FIRST = "firsts AS (SELECT s_suppkey AS song_id, s_suppkey * 1234567 % 200000000 AS t_us FROM supplier)"


def _gates(source: str, lane: str) -> str:
    """Gate events from ``edges(lane, t_us, ons, offs, zero, velocity)``."""
    return f"""
instants AS (
  SELECT {lane}, t_us, sum(ons) AS ons, sum(offs) AS offs, sum(zero) AS zero, min(velocity) AS velocity
  FROM {source} GROUP BY {lane}, t_us),
held AS (
  SELECT *, coalesce(sum(ons - offs - zero) OVER (PARTITION BY {lane} ORDER BY t_us
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM instants),
gates AS (
  SELECT {lane}, t_us, 0 AS rank, 'off' AS kind, 0 AS velocity FROM held WHERE b > 0 AND b = offs
  UNION ALL
  SELECT {lane}, t_us, 1, 'on', velocity FROM held WHERE b = offs AND ons > 0
  UNION ALL
  SELECT {lane}, t_us, 2, 'off', 0 FROM held WHERE zero > 0 AND b - offs + ons = zero)"""


_EDGES = """
edges AS (
  SELECT song_id, key_index, start_us - 55000 AS t_us, 1 AS ons, 0 AS offs,
         CASE WHEN dur_us = 0 THEN 1 ELSE 0 END AS zero, velocity FROM notes
  UNION ALL
  SELECT song_id, key_index, start_us + dur_us - 55000, 0, 1, 0, NULL FROM notes WHERE dur_us > 0)"""

_STEADY_GATES = _STEADY + "," + _EDGES + "," + _gates("edges", "song_id, key_index")
_GATE_COLUMNS = "t_us, CAST(rank AS INTEGER) AS rank, kind, CAST(velocity AS INTEGER) AS velocity"

_LOG = """
log AS (
  SELECT user_id AS session, event_id AS seq,
         CASE event_type WHEN 'click' THEN 'seek' WHEN 'view' THEN 'pause' ELSE 'frame' END AS kind,
         CAST(round(value * 1000000) AS BIGINT) AS value_us, CAST(round(value * 1000) AS BIGINT) AS dt_us
  FROM events),
marked AS (
  SELECT *, CAST(sum(CASE WHEN kind = 'pause' THEN 1 ELSE 0 END) OVER w AS BIGINT) % 2 = 1 AS paused,
         CAST(sum(CASE WHEN kind = 'seek' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment
  FROM log WINDOW w AS (PARTITION BY session ORDER BY seq)),
clock AS (
  SELECT session, seq, kind, paused, segment,
         CAST(sum(CASE WHEN kind = 'seek' THEN value_us WHEN kind = 'frame' AND NOT paused THEN dt_us ELSE 0 END)
              OVER (PARTITION BY session, segment ORDER BY seq) AS BIGINT) AS clock_us
  FROM marked)"""

_BURSTS = _LOG + """,
bursts AS (
  SELECT session AS song_id, seq, clock_us AS t_us, CAST(p AS INTEGER) AS pitch
  FROM clock, generate_series(21, 108) g(p)
  WHERE kind = 'seek' OR (kind = 'pause' AND paused))"""

_SEGMENT_TABLE = _LOG + """,
stretches AS (
  SELECT session, segment, min(CASE WHEN kind = 'seek' THEN clock_us END) AS seg_start_us,
         max(clock_us) AS seg_end_us, session AS song_id
  FROM clock GROUP BY session, segment)"""

_DOC = "concat_ws('-', l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT))"

_BOXES = f"""
lines AS (
  SELECT {_DOC} || '.svg' AS file, CAST(l_quantity AS BIGINT) AS q, l_partkey % 1000 AS a, l_orderkey % 1500 AS b,
         l_linenumber AS n, l_partkey % 10 AS c, CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE 1 END AS o,
         CASE WHEN l_orderkey % 4 = 0 THEN 3319.9::DOUBLE WHEN l_orderkey % 16 = 3 THEN 0.0::DOUBLE
              ELSE 1000 + CAST(l_quantity AS DOUBLE) END AS page_w,
         CASE WHEN l_orderkey % 4 = 0 THEN 4555.4::DOUBLE ELSE 2000.0::DOUBLE END AS page_h
  FROM lineitem),
boxes AS (
  SELECT file, o AS ord, c AS class_id, page_w, page_h, CAST(a AS DOUBLE) AS x0, CAST(a + 15 AS DOUBLE) AS x1,
         CASE WHEN c = 5 THEN b + n + 7.5::DOUBLE ELSE b - 30 + n + 7.5::DOUBLE END AS y0,
         CASE WHEN c = 5 THEN b + 120 + n + 7.5::DOUBLE ELSE b + n + 7.5::DOUBLE END AS y1
  FROM lines WHERE c < 8
  UNION ALL
  SELECT file, o + 1, 0, page_w, page_h, a + q, a + q + 20, b + n, b + n + 30 FROM lines
  UNION ALL
  SELECT file, o + 2, 5, page_w, page_h, a, a + 15, b, b + 120 FROM lines WHERE n <> 7
  UNION ALL
  SELECT file, o + 3, 6, page_w, page_h, 0, 15, q - 30, q FROM lines
  UNION ALL
  SELECT file, o + 4, 6, page_w, page_h, 0, 10, 0, q FROM lines),
label_rows AS (
  SELECT file, CAST(ord AS INTEGER) AS ord, CAST(class_id AS INTEGER) AS class_id,
         (x0 + (x1 - x0) / 2.0) / page_w AS norm_x, (y0 + (y1 - y0) / 2.0) / page_h AS norm_y,
         (x1 - x0) / page_w AS norm_w, (y1 - y0) / page_h AS norm_h
  FROM boxes),
labels_out AS (
  SELECT * FROM label_rows JOIN (SELECT file FROM lines WHERE page_w > 0) sized USING (file) WHERE norm_w > 0 AND norm_h > 0 AND norm_x >= 0 AND norm_y >= 0)"""

_SUFFIXES = "['.png', '.JPG', '.pdf', '.xml', '.mxl', '.mid', '.midi', '.jpeg', '.XML']"

_INPUTS = f"""
paths AS (
  SELECT url || '/p' || page_id || {_SUFFIXES}[page_id % 9 + 1] AS path FROM pages
  UNION ALL
  SELECT '/in/' || replace(p_name, ' ', '_') || {_SUFFIXES}[p_partkey % 9 + 1] FROM part)"""


def _routed(source: str) -> str:
    return f"""
cut AS (
  SELECT path, rtrim(path[:len(path) - len(split_part(path, '/', -1))], '/') AS parent, split_part(path, '/', -1) AS base FROM {source}),
named AS (
  SELECT path, parent, base[:len(base) - len(split_part(base, '.', -1)) - 1] AS stem,
         '.' || lower(split_part(base, '.', -1)) AS ext FROM cut),
routes AS (
  SELECT *, CASE WHEN ext IN ('.png', '.jpg', '.pdf') THEN 'recognise' WHEN ext IN ('.xml', '.mxl') THEN 'convert'
                 WHEN ext IN ('.mid', '.midi') THEN 'as_is' ELSE 'fallthrough' END AS route FROM named),
routed AS (
  SELECT *, parent || '/' || stem || '.mxl' AS score_path,
         CASE WHEN route = 'as_is' THEN path ELSE parent || '/' || stem || '.mid' END AS midi_path,
         ext IN ('.png', '.jpg', '.pdf', '.xml', '.mxl', '.mid', '.midi') AS accepted_by_dialog FROM routes)"""


_DURATIONS = """
SELECT song_id, CAST(coalesce(d, 1000000) AS BIGINT) AS duration_us, coalesce(d, 1000000) / 1000000.0::DOUBLE AS duration
FROM (SELECT DISTINCT song_id FROM {songs}) s
LEFT JOIN (SELECT song_id, max(start_us + dur_us) AS d FROM {notes} GROUP BY song_id) e USING (song_id)"""

_RECT = """
SELECT *, CAST(570 - (start_us - t_us) // 5000 AS INTEGER) AS bottom, CAST(dur_us // 5000 AS INTEGER) AS height,
       CAST(570 - (start_us - t_us) // 5000 - dur_us // 5000 AS INTEGER) AS top
FROM notes JOIN {times} USING (song_id)"""

_SPANS = """
spans AS (
  SELECT song_id, key_index, hand, start_us, dur_us, dur_us // 5000 AS h,
         greatest(0, CAST(floor((start_us - 5000) * 144 / 1000000.0) AS BIGINT) + 1) AS p0,
         CAST(ceil((start_us + (dur_us // 5000 + 1) * 5000) * 144 / 1000000.0) AS BIGINT) - 1 AS p1,
         greatest(0, CAST(floor((start_us - 571 * 5000) * 144 / 1000000.0) AS BIGINT) + 1) AS v0,
         CAST(ceil((start_us + (dur_us // 5000 + 151) * 5000) * 144 / 1000000.0) AS BIGINT) - 1 AS d1
  FROM notes)"""

ORACLE: dict[str, str] = {
    "playable_by_hand": f"""WITH {_TEMPO_NOTES}, {_KEYS}
        SELECT song_id, hand, count(*) AS n_notes, CAST(sum(dur_us) AS BIGINT) AS sounding_us,
               max(start_us + dur_us) AS end_us, min(x) AS left_x, max(x + width) AS right_x
        FROM tempo_notes JOIN keys USING (key_index) GROUP BY song_id, hand""",
    "svg_labels": f"WITH {_BOXES} SELECT * FROM labels_out",
    "label_lines": f"""WITH {_BOXES}
        SELECT replace(file, '.svg', '.txt') AS label_file, ord,
               printf('%d %.6f %.6f %.6f %.6f', class_id, norm_x, norm_y, norm_w, norm_h) AS line FROM labels_out""",
    "label_round_trip": f"""WITH {_BOXES}
        SELECT replace(file, '.svg', '.txt') AS label_file, ord, class_id, CAST(printf('%.6f', norm_x) AS DOUBLE) AS norm_x,
               CAST(printf('%.6f', norm_y) AS DOUBLE) AS norm_y, CAST(printf('%.6f', norm_w) AS DOUBLE) AS norm_w,
               CAST(printf('%.6f', norm_h) AS DOUBLE) AS norm_h FROM labels_out""",
    "note_round_trip": f"WITH {_STEADY} SELECT song_id, key_index, velocity, start_us, dur_us, hand FROM notes",
    "label_summary": f"WITH {_BOXES} SELECT file, count(*) AS n_labels FROM labels_out GROUP BY file",
    "label_rejects": f"""WITH {_BOXES}
        SELECT file, CAST(o + 5 AS INTEGER) AS ord, 'path' AS tag, 'Note' AS cls, 'no usable geometry' AS reason FROM lines
        UNION ALL
        SELECT file, CAST(o + 2 AS INTEGER), 'use', 'BarLine', 'bad symbol position' FROM lines WHERE n = 7
        UNION ALL
        SELECT file, CAST(ord AS INTEGER), CASE WHEN ord IN (o, o + 2, o + 3) THEN 'use' ELSE 'path' END,
               ['Note','TrebleClef','BassClef','TimeSig','MeasureNumber','BarLine','Rest','StaffLines'][class_id + 1], 'page of size zero'
        FROM boxes JOIN (SELECT file, o FROM lines) l USING (file) WHERE page_w = 0""",
    "page_sizes": f"WITH {_BOXES} SELECT DISTINCT file, page_w, page_h FROM lines",
    "class_counts": f"""WITH {_BOXES},
        names AS (SELECT unnest(['Note','TrebleClef','BassClef','TimeSig','MeasureNumber','BarLine','Rest','StaffLines']) AS cls,
                         unnest([0,1,2,3,4,5,6,7]) AS class_id),
        seen AS (SELECT c AS class_id, 'use' AS tag FROM lines WHERE c < 8
                 UNION ALL SELECT 0, 'path' FROM lines UNION ALL SELECT 0, 'path' FROM lines
                 UNION ALL SELECT 5, 'use' FROM lines UNION ALL SELECT 6, 'use' FROM lines
                 UNION ALL SELECT 6, 'path' FROM lines)
        SELECT CAST(class_id AS INTEGER) AS class_id, cls, tag, count(*) AS n_elements
        FROM seen JOIN names USING (class_id) GROUP BY ALL""",
    # Straight ends, the quadratic's middle, the cubic's two extrema at (3 -+ sqrt 3)/6, the half circle's top,
    # then the smooth cubic, which starts without a control to mirror, by its own quadratic formula.
    "path_boxes": f"""WITH raw AS (
          SELECT {_DOC} AS file, CAST(l_partkey % 500 AS DOUBLE) AS a, CAST(l_orderkey % 700 AS DOUBLE) AS b,
                 l_quantity AS q, CAST(l_linenumber * 10 - 30 AS DOUBLE) AS f, CAST(l_linenumber AS DOUBLE) AS n FROM lineitem),
        ends AS (SELECT *, a + q + 70 AS xa, a + 70 AS xs, b + n AS ys FROM raw),
        coefs AS (SELECT *, xs AS x0, xs AS x1, 3.5::DOUBLE AS x2, a AS x3, ys AS y0, ys AS y1, 10.0::DOUBLE AS y2, b AS y3 FROM ends),
        der AS (SELECT *, x3 - 3*x2 + 3*x1 - x0 AS ax, 2*(x0 - 2*x1 + x2) AS bx, x1 - x0 AS cx,
                       y3 - 3*y2 + 3*y1 - y0 AS ay, 2*(y0 - 2*y1 + y2) AS by_, y1 - y0 AS cy FROM coefs),
        roots AS (SELECT *,
            list_filter(CASE WHEN ax <> 0 THEN [(-bx + sqrt(greatest(0, bx*bx - 4*ax*cx))) / (2*ax), (-bx - sqrt(greatest(0, bx*bx - 4*ax*cx))) / (2*ax)]
                             WHEN bx <> 0 THEN [-cx / bx] ELSE [] END, lambda t: t > 0 AND t < 1) AS tx,
            list_filter(CASE WHEN ay <> 0 THEN [(-by_ + sqrt(greatest(0, by_*by_ - 4*ay*cy))) / (2*ay), (-by_ - sqrt(greatest(0, by_*by_ - 4*ay*cy))) / (2*ay)]
                             WHEN by_ <> 0 THEN [-cy / by_] ELSE [] END, lambda t: t > 0 AND t < 1) AS ty FROM der),
        tops AS (SELECT *,
            list_concat([a, a + 4, a + q, xa, xs], list_transform(tx, lambda t: (1-t)*(1-t)*(1-t)*x0 + 3*(1-t)*(1-t)*t*x1 + 3*(1-t)*t*t*x2 + t*t*t*x3)) AS xv,
            list_concat([b, b + f/2, b + abs(f) * sqrt(3.0)/6, b - abs(f) * sqrt(3.0)/6, b - 5, ys],
                        list_transform(ty, lambda t: (1-t)*(1-t)*(1-t)*y0 + 3*(1-t)*(1-t)*t*y1 + 3*(1-t)*t*t*y2 + t*t*t*y3)) AS yv FROM roots)
        SELECT file, round(list_min(xv), 6) AS xmin, round(list_max(xv), 6) AS xmax,
               round(list_min(yv), 6) AS ymin, round(list_max(yv), 6) AS ymax FROM tops""",
    "polyline_boxes": f"""WITH raw AS (
          SELECT {_DOC} AS file, CAST(l_partkey % 500 AS DOUBLE) AS a, CAST(l_orderkey % 700 AS DOUBLE) AS b,
                 CAST(l_linenumber % 3 AS DOUBLE) AS w, l_quantity AS q FROM lineitem),
        ends AS (SELECT file, a AS x0, greatest(a + w, a + 0.25) AS x1, b - 9 AS y0, b + q AS y1 FROM raw)
        SELECT file, CASE WHEN x1 - x0 < 1 THEN x0 - 5 ELSE x0 END AS xmin, CASE WHEN x1 - x0 < 1 THEN x1 + 5 ELSE x1 END AS xmax,
               y0 AS ymin, y1 AS ymax FROM ends""",
    "markup_tag_counts": r"""WITH starts AS (
          SELECT page_id, regexp_extract_all(html, '<[A-Za-z][A-Za-z0-9]*(?:\s[^>]*)?/?>') AS s FROM pages),
        tags AS (SELECT page_id, unnest(s) AS t, unnest(range(len(s))) AS ord FROM starts),
        named AS (SELECT page_id, ord, regexp_extract(t, '^<([A-Za-z][A-Za-z0-9]*)', 1) AS tag,
                  CASE WHEN regexp_matches(t, '\sclass="') THEN regexp_extract(t, '\sclass="([^"]*)"', 1) END AS cls FROM tags)
        SELECT tag, cls, count(*) AS n_tags, CAST(sum(ord) AS BIGINT) AS sum_ord, count(DISTINCT page_id) AS n_pages
        FROM named GROUP BY tag, cls""",
    "route_inputs": f"WITH {_INPUTS}, {_routed('paths')} SELECT * FROM routed",
    "render_manifest": f"""WITH {_INPUTS},
        files AS (SELECT split_part(path, '/', -1) AS file FROM paths),
        listed AS (SELECT file, regexp_replace(file, '[.][^.]*$', '') || '.svg' AS target FROM files
                   WHERE suffix(file, '.xml') OR suffix(file, '.mxl'))
        SELECT file, target, count(*) OVER (PARTITION BY target) AS n_sources,
               count(*) OVER (PARTITION BY target) > 1 AS is_collision FROM listed""",
    "manifest_status": f"""WITH {_INPUTS},
        files AS (SELECT split_part(path, '/', -1) AS file FROM paths),
        listed AS (SELECT file, regexp_replace(file, '[.][^.]*$', '') || '.svg' AS target FROM files
                   WHERE suffix(file, '.xml') OR suffix(file, '.mxl')),
        named AS (SELECT *, count(*) OVER (PARTITION BY target) AS n_sources FROM listed),
        tries AS (SELECT replace(p_name, ' ', '_') || '.xml' AS file, p_size % 3 AS exit_code,
                         row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) AS back FROM part WHERE p_size > 10)
        SELECT file, target, n_sources, n_sources > 1 AS is_collision, CAST(exit_code AS INTEGER) AS exit_code,
               CASE WHEN exit_code IS NULL THEN 'PENDING' WHEN exit_code = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status
        FROM named LEFT JOIN (SELECT file, exit_code FROM tries WHERE back = 1) USING (file)""",
    "label_target": """WITH names AS (
          SELECT regexp_replace(url, '[/:?]', '_', 'g') || ['.svg', '.svg.svg', '_svg.svg', '.svgz'][page_id % 4 + 1] AS file FROM pages)
        SELECT file, replace(file, '.svg', '.txt') AS label_file FROM names""",
    "paired_notes": f"""WITH {_TICK_NOTES},
        ons AS (SELECT *, row_number() OVER (PARTITION BY song_id, pitch ORDER BY start_tick, velocity) AS k FROM tick_notes),
        offs AS (SELECT song_id, pitch, start_tick + len_ticks AS end_tick,
                        row_number() OVER (PARTITION BY song_id, pitch ORDER BY start_tick + len_ticks) AS k FROM tick_notes)
        SELECT song_id AS file, pitch, start_tick, end_tick - start_tick AS len_ticks, velocity
        FROM ons JOIN offs USING (song_id, pitch, k)""",
    "midi_notes": f"""WITH files AS (
          SELECT {_DOC} AS file, CAST(l_partkey % 128 AS INTEGER) AS pitch, CAST(l_linenumber * 97 AS BIGINT) AS tick,
                 CAST(l_quantity AS BIGINT) * 48 AS len, CAST(1 + l_orderkey % 127 AS INTEGER) AS velocity,
                 300000 + (l_orderkey * 31) % 400000 AS us, l_orderkey % 1000 AS turn, [96, 480, 960][l_partkey % 3 + 1] AS ppq FROM lineitem),
        pairs AS (SELECT *, tick AS start_tick, len AS len_ticks FROM files
                  UNION ALL SELECT * REPLACE (64 AS velocity), tick + 24, 2 * len - 24 FROM files),
        nums AS (SELECT *, start_tick * us + greatest(0, start_tick - turn) * 100000 AS x,
                        (start_tick + len_ticks) * us + greatest(0, start_tick + len_ticks - turn) * 100000 AS y FROM pairs)
        SELECT file, pitch, start_tick, len_ticks, velocity, CAST(ppq AS INTEGER) AS ppq, (x + ppq // 2) // ppq AS start_us,
               (y + ppq // 2) // ppq - (x + ppq // 2) // ppq AS dur_us FROM nums""",
    "midi_rejects": f"SELECT {_DOC} AS file FROM lineitem WHERE l_linenumber IN (3, 7)",
    "score_playable": f"""WITH docs AS (
          SELECT {_DOC} AS file, CAST(l_quantity AS BIGINT) AS q, [1, 2, 4, 8][l_partkey % 4 + 1] AS v,
                 2 + l_linenumber % 5 AS oct, [0, 2, 4, 5, 7, 9, 11][l_orderkey % 7 + 1] AS semitone,
                 CAST(round(60000000 / (60 + l_orderkey % 90)::DOUBLE) AS BIGINT) AS us,
                 CASE WHEN l_linenumber % 2 = 0 THEN 89 ELSE 44 END AS loud FROM lineitem),
        struck AS (
          SELECT file, (oct + 1) * 12 + semitone + 1 AS pitch, 0 AS s, (q * 480 // v) * 500000 AS e, 90 AS velocity FROM docs
          UNION ALL SELECT file, (oct + 1) * 12 + 4, 0, (q * 480 // v) * 500000, 90 FROM docs
          UNION ALL SELECT file, 47, 0, ((q + 1) * 480 // v) * 500000, 90 FROM docs
          UNION ALL SELECT file, 71, ((q + 2) * 480 // v) * 500000, ((q + 2) * 480 // v) * 500000 + 1200 * us, loud FROM docs),
        timed AS (SELECT file, velocity, CASE WHEN pitch >= 60 THEN 'upper' ELSE 'lower' END AS hand, (s + 240) // 480 AS a, (e + 240) // 480 AS b FROM struck)
        SELECT file, hand, count(*) AS n_notes, CAST(sum(b - a) AS BIGINT) AS sounding_us, CAST(max(b) AS BIGINT) AS end_us,
               min(velocity) AS velocity, max(velocity) AS loudest, CAST(0 AS BIGINT) AS n_flagged FROM timed GROUP BY file, hand""",
    "score_notes": f"""WITH docs AS (
          SELECT {_DOC} AS file, CAST(l_quantity AS BIGINT) AS q, [1, 2, 4, 8][l_partkey % 4 + 1] AS v,
                 2 + l_linenumber % 5 AS oct, [0, 2, 4, 5, 7, 9, 11][l_orderkey % 7 + 1] AS semitone FROM lineitem),
        placed AS (
          SELECT file, 2 AS ord, (oct + 1) * 12 + semitone + 1 AS pitch, 0 AS start_tick, q * 480 // v AS len_ticks FROM docs
          UNION ALL SELECT file, 3, (oct + 1) * 12 + 4, 0, q * 480 // v FROM docs
          UNION ALL SELECT file, 6, 47, 0, (q + 1) * 480 // v FROM docs
          UNION ALL SELECT file, 10, 71, (q + 2) * 480 // v, 720 FROM docs
          UNION ALL SELECT file, 11, 71, (q + 2) * 480 // v + 720, 480 FROM docs)
        SELECT file, CAST(ord AS INTEGER) AS ord, CAST(pitch AS INTEGER) AS pitch, CAST(start_tick AS BIGINT) AS start_tick,
               CAST(len_ticks AS BIGINT) AS len_ticks FROM placed""",
    "tempo_segments": f"WITH {_SEGMENTS} SELECT * FROM segments",
    "note_times": f"WITH {_TEMPO_NOTES} SELECT *, start_us / 1000000.0::DOUBLE AS start_s FROM tempo_timed",
    "song_durations": f"WITH {_TEMPO_NOTES}, songs AS (SELECT c_custkey AS song_id FROM customer) "
    + _DURATIONS.format(songs="songs", notes="tempo_notes"),
    "key_usage": f"""WITH {_STEADY}, {_KEYS}
        SELECT keys.*, n_notes, held_us FROM keys LEFT JOIN (
          SELECT key_index, count(*) AS n_notes, CAST(sum(dur_us) AS BIGINT) AS held_us FROM notes GROUP BY key_index) USING (key_index)""",
    "key_styles": f"""WITH {_STEADY}, {_KEYS}, {_FIRST}, rects AS ({_RECT.format(times='firsts')}),
        down AS (SELECT DISTINCT song_id, key_index FROM rects WHERE bottom >= 570 AND top <= 570),
        styled AS (SELECT f.song_id, k.*, d.song_id IS NOT NULL AS is_pressed
                   FROM firsts f CROSS JOIN keys k LEFT JOIN down d ON d.song_id = f.song_id AND d.key_index = k.key_index)
        SELECT song_id, key_index, is_pressed,
               CASE WHEN is_black AND is_pressed THEN 'gray' WHEN is_black THEN 'black' WHEN is_pressed THEN 'darkblue'
                    ELSE 'rgb(230,230,230)' END AS fill,
               CAST(CASE WHEN is_black THEN x + 2 ELSE x + 5 END AS INTEGER) AS label_x,
               CAST(CASE WHEN is_black THEN y + height - 15 ELSE y + height - 20 END AS INTEGER) AS label_y FROM styled""",
    "gate_events": f"WITH {_STEADY_GATES} SELECT song_id, key_index, {_GATE_COLUMNS} FROM gates",
    # By the running maximum of note ends instead of by counters: a new interval begins where a note starts at or after it.
    "sounding_intervals": f"""WITH {_STEADY},
        spans AS (SELECT song_id, key_index, start_us - 55000 AS s, start_us + dur_us - 55000 AS e, velocity FROM notes),
        reach AS (SELECT *, max(e) OVER (PARTITION BY song_id, key_index ORDER BY s, velocity, e
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM spans),
        islands AS (SELECT *, sum(CASE WHEN far IS NULL OR s >= far THEN 1 ELSE 0 END)
                           OVER (PARTITION BY song_id, key_index ORDER BY s, velocity, e ROWS UNBOUNDED PRECEDING) AS island FROM reach)
        SELECT song_id, key_index, min(s) AS on_us, max(e) AS off_us, CAST(first(velocity ORDER BY s, velocity) AS INTEGER) AS velocity
        FROM islands GROUP BY song_id, key_index, island""",
    "note_state": f"""WITH {_STEADY}, {_SNAPSHOTS}
        SELECT song_id, t_us, key_index, start_us, velocity,
               CASE WHEN t_us >= start_us + dur_us - 55000 THEN 'played' WHEN t_us >= start_us - 55000 THEN 'playing' ELSE 'pending' END AS state
        FROM notes JOIN snapshots USING (song_id)""",
    "seek_state": f"""WITH {_STEADY}, {_FIRST}
        SELECT song_id, t_us, key_index, start_us, velocity, false AS is_playing, start_us - 55000 < t_us AS has_played
        FROM notes JOIN firsts USING (song_id)""",
    "seek_positions": f"""WITH {_STEADY},
        clicks AS (SELECT event_id, user_id AS song_id, CAST(event_id * 37 % 1280 AS INTEGER) AS click_x, event_id % 60 AS click_y FROM events),
        durations AS ({_DURATIONS.format(songs='clicks', notes='notes')})
        SELECT event_id, song_id, click_x, (click_x - 100) / 1080.0::DOUBLE AS fraction,
               (click_x - 100) / 1080.0::DOUBLE * duration AS seek_s
        FROM clicks JOIN durations USING (song_id)
        WHERE click_x >= 100 AND click_x <= 1180 AND click_y >= 10 AND click_y <= 40""",
    "progress": f"""WITH {_STEADY}, {_SNAPSHOTS}, durations AS ({_DURATIONS.format(songs='snapshots', notes='notes')}),
        shares AS (SELECT song_id, t_us, least(greatest(t_us::DOUBLE / duration_us::DOUBLE, 0), 1) AS progress
                   FROM snapshots JOIN durations USING (song_id))
        SELECT song_id, t_us, progress, CAST(trunc(progress * 1080) AS INTEGER) AS fill_width FROM shares""",
    "note_rects": f"""WITH {_STEADY}, {_KEYS}, {_FIRST}, rects AS ({_RECT.format(times='firsts')})
        SELECT song_id, t_us, key_index, start_us, velocity, hand, bottom, rects.height, top, x AS key_x, width AS key_width,
               label AS key_label, bottom >= 0 AS on_screen
        FROM rects JOIN keys USING (key_index) WHERE NOT top > 720""",
    "pressed_keys": f"""WITH {_STEADY}, {_SNAPSHOTS}, rects AS ({_RECT.format(times='snapshots')})
        SELECT DISTINCT song_id, t_us, key_index FROM rects WHERE bottom >= 570 AND top <= 570""",
    "frame_load": f"""WITH {_STEADY}, {_SPANS},
        moves AS (SELECT song_id, 0 AS f, 1 AS d, 0 AS p FROM spans UNION ALL SELECT song_id, d1 + 1, -1, 0 FROM spans
                  UNION ALL SELECT song_id, p0, 0, 1 FROM spans WHERE p0 <= p1 UNION ALL SELECT song_id, p1 + 1, 0, -1 FROM spans WHERE p0 <= p1),
        sums AS (SELECT song_id, f, sum(d) AS d, sum(p) AS p FROM moves GROUP BY song_id, f),
        runs AS (SELECT song_id, CAST(f AS BIGINT) AS frame_from, CAST(lead(f) OVER w - 1 AS BIGINT) AS frame_to,
                        CAST(sum(d) OVER w AS BIGINT) AS drawn, CAST(sum(p) OVER w AS BIGINT) AS pressing
                 FROM sums WINDOW w AS (PARTITION BY song_id ORDER BY f))
        SELECT * FROM runs WHERE frame_to IS NOT NULL""",
    "pressed_frames": f"""WITH {_STEADY}, {_SPANS},
        tested AS (SELECT song_id, key_index, k FROM spans, LATERAL (SELECT unnest(range(greatest(0, p0 - 2), p1 + 3)) AS k) r
                   WHERE 570 - trunc((start_us * 144 - k * 1000000) / 720000.0) >= 570
                     AND 570 - trunc((start_us * 144 - k * 1000000) / 720000.0) - h <= 570)
        SELECT song_id, key_index, count(*) AS n_frames, CAST(sum(k) AS BIGINT) AS sum_frame, max(k) AS last_frame
        FROM tested GROUP BY song_id, key_index""",
    "drawn_frames": f"""WITH {_STEADY}, {_SPANS},
        drawn AS (SELECT song_id, hand, h, CAST(570 - trunc((start_us * 144 - k * 1000000) / 720000.0) AS BIGINT) AS bottom
                  FROM spans, LATERAL (SELECT unnest(range(v0, d1 + 1)) AS k) r)
        SELECT song_id, hand, count(*) AS n_rects, CAST(sum(bottom - h) AS BIGINT) AS sum_top, CAST(sum(bottom) AS BIGINT) AS sum_bottom,
               CAST(min(bottom - h) AS INTEGER) AS min_top, CAST(max(bottom) AS INTEGER) AS max_bottom
        FROM drawn GROUP BY song_id, hand""",
    "playback_clock": f"WITH {_LOG} SELECT * FROM clock",
    "all_notes_off": f"WITH {_BURSTS} SELECT * FROM bursts",
    "sound_stream": f"""WITH {_STEADY_GATES}, {_BURSTS}
        SELECT song_id, t_us, CAST(rank AS INTEGER) AS rank, CAST(key_index + 21 AS INTEGER) AS pitch, kind,
               CAST(velocity AS INTEGER) AS velocity FROM gates
        UNION ALL SELECT song_id, t_us, -1, pitch, 'off', 0 FROM bursts""",
    "clock_segments": f"WITH {_SEGMENT_TABLE} SELECT * FROM stretches",
    "replay_gates": f"""WITH {_STEADY}, {_SEGMENT_TABLE},
        fired AS (SELECT s.session, s.segment, n.*, s.seg_end_us FROM stretches s JOIN notes n
                  ON n.song_id = s.song_id AND n.start_us - 55000 <= s.seg_end_us
                 AND (s.seg_start_us IS NULL OR n.start_us - 55000 >= s.seg_start_us)),
        replay_edges AS (
          SELECT session, segment, song_id, key_index, start_us - 55000 AS t_us, 1 AS ons, 0 AS offs,
                 CASE WHEN dur_us = 0 THEN 1 ELSE 0 END AS zero, velocity FROM fired
          UNION ALL SELECT session, segment, song_id, key_index, start_us + dur_us - 55000, 0, 1, 0, NULL FROM fired
                    WHERE dur_us > 0 AND start_us + dur_us - 55000 <= seg_end_us),
        {_gates('replay_edges', 'session, segment, song_id, key_index')}
        SELECT session, segment, song_id, key_index, {_GATE_COLUMNS} FROM gates""",
    "stream_route": f"""WITH paths AS (SELECT url || '/p' || page_id || {_SUFFIXES}[page_id % 9 + 1] AS path FROM pages), {_routed('paths')}
        SELECT * FROM routed""",
}
ORACLE["stream_gates"] = ORACLE["gate_events"]
ORACLE["late_gates"] = ORACLE["gate_events"]
# Rows of a session are numbered from 0.
ORACLE["stream_clock"] = f"""WITH {_LOG}
    SELECT session, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS seq, kind, paused, segment, clock_us FROM clock"""
ORACLE["stream_resets"] = f"""WITH {_STEADY}, {_LOG},
    seeks AS (SELECT DISTINCT session AS song_id, value_us AS r FROM log WHERE kind = 'seek'),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY r) AS epoch FROM seeks),
    struck AS (SELECT n.song_id, n.key_index, n.velocity, n.dur_us, n.start_us - 55000 AS a, n.start_us + n.dur_us - 55000 AS b FROM notes n),
    begun AS (SELECT s.*, coalesce(e.epoch, 0) AS ea FROM struck s ASOF LEFT JOIN numbered e ON s.song_id = e.song_id AND s.a >= e.r),
    ended AS (SELECT s.*, coalesce(e.epoch, 0) AS eb FROM begun s ASOF LEFT JOIN numbered e ON s.song_id = e.song_id AND s.b >= e.r),
    edges AS (
      SELECT song_id, key_index, ea AS epoch, a AS t_us, 1 AS ons, 0 AS offs, CASE WHEN dur_us = 0 THEN 1 ELSE 0 END AS zero, velocity FROM ended
      UNION ALL
      SELECT song_id, key_index, eb, b, 0, 1, 0, NULL FROM ended WHERE dur_us > 0 AND ea = eb),
    {_gates("edges", "song_id, key_index, epoch")}
    SELECT song_id, key_index, {_GATE_COLUMNS} FROM gates"""
ORACLE["label_files"] = """WITH symbols AS (
      SELECT l_suppkey, CAST(l_partkey % 10 AS INTEGER) AS c, l_partkey % 1000 AS x, 100 + l_orderkey % 1500 AS y FROM lineitem)
    SELECT 'book.txt_' || l_suppkey || '.txt' AS file, c AS class_id, CAST(printf('%.6f', (x + 7.5::DOUBLE) / 1000) AS DOUBLE) AS norm_x,
           CAST(printf('%.6f', CASE WHEN c = 5 THEN y + 60 ELSE y - 15 END / 2000.0::DOUBLE) AS DOUBLE) AS norm_y, 0.015::DOUBLE AS norm_w,
           CASE WHEN c = 5 THEN 0.06::DOUBLE ELSE 0.015::DOUBLE END AS norm_h
    FROM symbols WHERE c < 8"""
ORACLE["arrivals_once"] = f"""WITH named AS (SELECT p_partkey, p_name, {_SUFFIXES}[p_partkey % 9 + 1] AS suffix FROM part)
    SELECT 'part_' || p_partkey || suffix AS file, CAST(octet_length(encode(p_name)) AS BIGINT) AS length, lower(suffix) AS ext,
           CASE WHEN lower(suffix) IN ('.png', '.jpg', '.pdf') THEN 'recognise' WHEN lower(suffix) IN ('.xml', '.mxl') THEN 'convert'
                WHEN lower(suffix) IN ('.mid', '.midi') THEN 'as_is' ELSE 'fallthrough' END AS route FROM named"""
ORACLE["listed_scores"] = f"""SELECT 'part_' || p_partkey || suffix AS file
    FROM (SELECT p_partkey, {_SUFFIXES}[p_partkey % 9 + 1] AS suffix FROM part) WHERE suffix IN ('.xml', '.mxl')"""
ORACLE["delivered_gates"] = ORACLE["gate_events"]
ORACLE["silencing"] = f"""WITH {_LOG},
    points AS (SELECT session, seq, kind, clock_us FROM clock WHERE kind = 'seek' OR (kind = 'pause' AND paused)
               UNION ALL SELECT session, min(seq) - back, cause, -55000 FROM log, (VALUES (2, 'start'), (1, 'load')) v(back, cause)
               GROUP BY session, back, cause)
    SELECT points.*, CAST(p AS INTEGER) AS pitch FROM points, generate_series(21, 108) g(p)"""
