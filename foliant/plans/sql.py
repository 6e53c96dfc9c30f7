"""The SQL of the registered queries: fragments that mirror the column functions, and the longer statements."""

from __future__ import annotations

from foliant.functions.attributes import MIME
from foliant.functions.text import BULLETS_FROM, BULLETS_TO, SPACE
from foliant.operators.tables import DOMAIN_WORDS, LEAST_SCORE, MONEY_UNITS, REGISTRATION, ROLE_LABELS

from .fixtures import values

COUNTED = ("the", "license", "de")


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def clean(x: str) -> str:
    moved = f"translate({x}, '{BULLETS_FROM}\u00a0\u2003\ufffc\u00ad', '{BULLETS_TO}  ')"
    return trim(f"regexp_replace({moved}, ' +', ' ', 'g')")


def visible(x: str) -> str:
    return f"regexp_replace({x}, '[{SPACE}\\x{{FFFC}}]', '', 'g')"


def untagged(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>?', '', 'g')"


def text_level(x: str) -> str:
    c = clean(x)
    head = f"regexp_extract({c}, '^([0-9.]*[0-9][0-9.]*)[{SPACE}]', 1)"
    prose = " OR ".join(f"ends_with({c}, '{e}')" for e in ("다.", "함.", "임.", "음."))
    return f"CASE WHEN length({c}) <= 100 AND {head} <> '' AND NOT ({prose}) THEN CAST(least(len(list_filter(string_split({head}, '.'), lambda p: p <> '')), 6) AS INTEGER) END"


def box_level(x: str) -> str:
    c = f"regexp_replace({x}, '^[{SPACE}]+', '')"
    return f"CASE WHEN regexp_matches({c}, '^[0-9]+[.] ') THEN 2 WHEN regexp_matches({c}, '^[(][0-9A-Za-z가-힣]+[)] ') THEN 3 END"


def style_level(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^(개요|Outline) [1-6]$') THEN CAST(right({x}, 1) AS INTEGER) WHEN {x} IN ('차례 제목', 'TOC Heading') THEN 1 END"


def numeric(x: str) -> str:
    return f"({trim(x)} <> '' AND length(regexp_replace({trim(x)}, '[^0-9.,+%/() :-]', '', 'g')) * 10 >= length({trim(x)}) * 9)"


def time_token(x: str) -> str:
    return f"(regexp_matches({trim(x)}, '^[0-9]{{1,2}}$') OR regexp_matches({trim(x)}, '^[0-9]+[{SPACE}]*(Q|q|월|분기|주차|주|년차|년)$'))"


def count_of(x: str, w: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, '{w}', ''))) / {len(w)} AS BIGINT)"


def escape_record(x: str) -> str:
    return rf"replace(replace(replace({x}, '\', '\\'), chr(10), '\n'), chr(9), '\t')"


def escapes(x: str, apostrophe: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '{apostrophe}')"


def atx_level(x: str) -> str:
    return f"CAST(nullif(length(regexp_extract({x}, '^(#{{1,6}}) ', 1)), 0) AS INTEGER)"


def markdown_kind(x: str) -> str:
    first = f"regexp_extract({x}, '^[{SPACE}]*([^\\n]*)', 1)"
    stamp = f"regexp_extract({first}, '^<!-- [A-Za-z0-9._-]+:(llm|human|assets)\\b', 1)"
    return f"CASE WHEN {stamp} <> '' THEN {stamp} WHEN starts_with({first}, 'SECTION[id=') THEN 'llm' ELSE 'unknown' END"


def entry_number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^(?i:BIN)[0-9A-Fa-f]{{4}}') THEN CAST('0x' || substr({x}, 4, 4) AS INTEGER) ELSE CAST(nullif(regexp_extract({x}, '([0-9]+)', 1), '') AS INTEGER) END"


def mime(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIME.items())
    return f"CASE lower(regexp_extract({x}, '[.]([^.]*)$', 1)) {cases} ELSE 'application/octet-stream' END"


def luminance(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"CAST(least(floor(CAST(0.2126 AS DOUBLE) * {r} + CAST(0.7152 AS DOUBLE) * {g} + CAST(0.0722 AS DOUBLE) * {b} + 1e-6), 255) AS INTEGER)"


TONE = f"""CASE WHEN a = 0 THEN 'none' WHEN greatest(r, g, b) - least(r, g, b) < 12 THEN
  CASE WHEN {luminance()} <= 119 THEN 'dark' WHEN {luminance()} <= 199 THEN 'mid' WHEN {luminance()} <= 240 THEN 'pale' ELSE 'none' END
ELSE 'accent_' || CASE WHEN r >= g AND r >= b THEN CASE WHEN b >= g THEN 'magenta' WHEN g >= r - 40 THEN 'yellow' ELSE 'red' END
  WHEN g >= r AND g >= b THEN CASE WHEN b >= r THEN 'cyan' ELSE 'green' END WHEN r >= g THEN 'magenta' ELSE 'blue' END END"""

BG_TONE = f"SELECT slot, {luminance()} AS luminance, {TONE} AS tone FROM {values('fill')}"

RECORD_LINES = f"""
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_paragraphs, 'SECTION[id=sec-0]' || chr(10) || array_to_string(list_transform(l, lambda x, i:
  'PARAGRAPH[id=par-s0-p' || (i - 1) || coalesce(',level=' || ({text_level('x')}), '') || ']'
  || CASE WHEN {clean('x')} <> '' THEN chr(10) || 'TEXT: ' || {escape_record(clean('x'))} ELSE '' END), chr(10)) || chr(10) AS records
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"""

RECORD_PARSE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (WHERE {clean('x')} <> '') AS texts,
  CAST(coalesce(sum(length({escape_record(clean('x'))})), 0) AS BIGINT) AS characters
FROM l GROUP BY doc_id"""

SUMMARY = f"""
SELECT doc_id, CAST(len(l) AS INTEGER) AS paragraphs, CAST(len(list_filter(l, lambda x: {clean('x')} = '')) AS INTEGER) AS blank,
  CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS INTEGER) AS characters,
  CAST(list_sum(list_transform(l, lambda x: length(x) + length(regexp_replace(x, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')))) AS INTEGER) AS utf16_units,
  CAST(list_max(list_transform(l, lambda x: length(x))) AS INTEGER) AS widest
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"""

RECORD_ATTRS = rf"""
WITH p AS (SELECT id, line, list_filter(string_split(regexp_extract(line, '^[^\[:]*\[([^\]]*)', 1), ','), lambda x: contains(x, '=')) AS l FROM {values('record')}),
b AS (SELECT *, CASE WHEN regexp_matches(line, '^TEXT(\[[^\]]*\])?:') THEN regexp_extract(line, '^TEXT(\[[^\]]*\])?: ?(.*)$', 2) END AS body FROM p)
SELECT id, trim(regexp_extract(x, '^([^=]*)=', 1)) AS k, trim(regexp_extract(x, '^[^=]*=(.*)$', 1)) AS v, body FROM b, unnest(l) AS u(x)
UNION ALL SELECT id, NULL, NULL, body FROM b WHERE len(l) = 0"""

LAYOUT = f"""
WITH s AS (SELECT id, list_filter(string_split(x, '|'), lambda s: regexp_matches(s, '^-?[0-9]+(:-?[0-9]+){{8}}$')) AS l FROM {values('layout')})
SELECT id, len(l) AS segments, coalesce(array_to_string(l, '|'), '') AS encoded FROM s"""

_LABEL = f"(tone = 'accent_yellow' OR (starts_with(tone, 'accent_') AND tone <> 'accent_red' AND {luminance()} >= 200))"
CELL_ROLES = f"""
WITH f AS (SELECT c.*, coalesce(f.r, 0) AS r, coalesce(f.g, 0) AS g, coalesce(f.b, 0) AS b, coalesce(f.a, 0) AS a
  FROM {values('cell')} c LEFT JOIN {values('fill')} f ON c.border_fill_id - 1 = slot),
t AS (SELECT *, {TONE} AS tone FROM f),
h AS (SELECT *, bool_or({_LABEL} OR tone IN ('mid', 'dark')) OVER (PARTITION BY tbl) AS coded FROM t),
r AS (SELECT *, CASE WHEN tone = 'dark' THEN 'header' WHEN {_LABEL} THEN 'label' WHEN tone = 'mid' AND coded THEN 'label' WHEN tone = 'pale' AND col = 0 AND coded THEN 'label'
  WHEN tone = 'pale' AND row = 0 THEN 'header' WHEN row = 0 AND col <> 0 THEN 'header' WHEN col = 0 AND coded THEN 'label' ELSE 'content' END AS role FROM h)
SELECT tbl, row, col, tone, role, CASE WHEN role <> 'content' OR paragraphs > 1 OR controls > 0 THEN 'false' WHEN {clean('text')} = '' THEN 'true'
  WHEN {numeric(clean('text'))} THEN 'false' ELSE 'true' END AS editable FROM r"""

KEYWORD_COUNT = "SELECT doc_id, " + ", ".join(f"{count_of('lower(text)', w)} AS n_{w}" for w in COUNTED) + " FROM documents"

_SCORES = ", ".join("(" + " + ".join(count_of("corpus", w) for w in words) + f") AS {d}" for d, words in DOMAIN_WORDS.items())
_BEST = f"greatest({', '.join(DOMAIN_WORDS)})"
_WORDS = " ".join(f"WHEN {_BEST} >= {LEAST_SCORE} AND {d} = {_BEST} THEN '{d}'" for d in DOMAIN_WORDS)
TABLE_DOMAIN = f"""
WITH c AS (SELECT tbl, string_agg(text || chr(10), '' ORDER BY row, col) AS body,
  bool_or(row = 0 AND contains(text, '목표')) AS goal, bool_or(row = 0 AND (contains(text, '실적') OR contains(text, '달성'))) AS actual,
  bool_or(row = 0 AND contains(text, '성명')) AS name, bool_or(row = 0 AND ({' OR '.join(f"contains(text, '{w}')" for w in ROLE_LABELS)})) AS job,
  count(*) FILTER (WHERE row = 0 AND {clean('text')} <> '') AS heads, count(*) FILTER (WHERE row = 0 AND {clean('text')} <> '' AND {time_token('text')}) AS times
  FROM {values('cell')} GROUP BY tbl),
t AS (SELECT tbl, rows, cols, coalesce(owner_text, '') || chr(10) || coalesce(body, '') AS corpus, goal, actual, name, job, heads, times FROM {values('tbl')} LEFT JOIN c USING (tbl)),
s AS (SELECT *, {_SCORES} FROM t)
SELECT tbl, CASE {_WORDS}
  WHEN len(list_filter(string_split(corpus, chr(10)), lambda l: contains(l, '단위') AND ({' OR '.join(f"contains(l, '{u}')" for u in MONEY_UNITS)}))) > 0 THEN 'budget'
  WHEN goal AND actual THEN 'performance' WHEN name AND job THEN 'personnel' WHEN rows >= 2 AND cols >= 4 AND heads >= 3 AND times * 10 >= heads * 7 THEN 'schedule'
  WHEN regexp_matches(corpus, '{REGISTRATION}') THEN 'institution' ELSE 'unknown' END AS domain FROM s"""

GRID_SLOTS = f"""
WITH p AS (SELECT tbl, ord, row AS o_row, col AS o_col, r, c FROM {values('cell')}, unnest(range(row, row + greatest(row_span, 1))) AS a(r), unnest(range(col, col + greatest(col_span, 1))) AS b(c)),
w AS (SELECT tbl, r, c, arg_max(o_row, ord) AS owner_row, arg_max(o_col, ord) AS owner_col FROM p GROUP BY tbl, r, c),
s AS (SELECT tbl, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM {values('tbl')}, unnest(range(rows)) AS a(r), unnest(range(cols)) AS b(c))
SELECT s.tbl, row, col, owner_row, owner_col FROM s LEFT JOIN w ON s.tbl = w.tbl AND row = r AND col = c"""

TABLE_FORM = f"""
WITH c AS (SELECT tbl, count(*) AS n, count(*) FILTER (WHERE {clean('text')} <> '') AS filled, max({clean('text')}) FILTER (WHERE {clean('text')} <> '') AS text, sum(controls) AS controls, sum(nested) AS nested
  FROM {values('cell')} GROUP BY tbl),
t AS (SELECT tbl, text, {box_level('text')} AS lv, CASE WHEN n = 1 AND filled = 0 AND nested = 1 THEN 'unwrap'
  WHEN filled = 1 AND controls = 0 AND length(text) <= 80 AND ({box_level('text')}) IS NOT NULL THEN 'heading'
  WHEN filled = 1 AND controls = 0 AND depth = 0 AND rows = 1 AND length(text) <= 100 AND NOT contains(text, chr(10)) THEN 'passage' ELSE 'table' END AS form
  FROM {values('tbl')} LEFT JOIN c USING (tbl))
SELECT tbl, form, CASE WHEN form = 'heading' THEN lv END AS level, CASE WHEN form IN ('heading', 'passage') THEN text END AS text FROM t"""

COLOUR_HEX = """
WITH n AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS n FROM part)
SELECT p_partkey, format('#{:02X}{:02X}{:02X}', n & 255, (n >> 8) & 255, (n >> 16) & 255) AS hex, n AS back FROM n"""

GRID_FOLD = f"""
WITH p AS (SELECT tbl, row, col + i AS c, CASE WHEN i = 0 THEN replace(replace({clean('text')}, '|', '\\|'), chr(10), ' ') ELSE '' END AS x, row_span, controls
  FROM {values('cell')}, unnest(range(greatest(col_span, 1))) AS u(i)),
k AS (SELECT t.tbl, rows, cols FROM {values('tbl')} t JOIN p USING (tbl) GROUP BY t.tbl, rows, cols HAVING max(row_span) <= 1 AND sum(controls) = 0
  AND count(*) = rows * cols AND count(DISTINCT (row, c)) = rows * cols AND min(row) >= 0 AND min(c) >= 0 AND max(row) < rows AND max(c) < cols),
l AS (SELECT tbl, row, cols, '| ' || string_agg(x, ' | ' ORDER BY c) || ' |' || chr(10) AS line FROM p JOIN k USING (tbl) GROUP BY tbl, row, cols)
SELECT tbl, max(line) FILTER (WHERE row = 0) || '|' || repeat(' --- |', cols) || chr(10) || coalesce(string_agg(line, '' ORDER BY row) FILTER (WHERE row > 0), '') || chr(10) AS markdown
FROM l GROUP BY tbl, cols"""

STORED_NUMBERS = """
WITH t AS (SELECT l_orderkey, l_linenumber, CAST((l_orderkey * 2654435761 + l_partkey) % 4294967296 AS BIGINT) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, (n % 100000) / 100.0::DOUBLE AS points, CAST(n & 1 AS INTEGER) AS is_color, CAST((n >> 1) & 1 AS INTEGER) AS is_gradation,
  CAST((n >> 2) & 1 AS INTEGER) AS is_image, CAST(n % 16 AS INTEGER) AS kind, n % 16 = 0 AS is_link, n % 16 = 1 AS is_embedding, n % 16 = 2 AS is_storage,
  n % 2147483648 AS chars, n >= 2147483648 AS marker
FROM t
"""
#: Parts that the names and contents of asset_names are made of.
NAME_STEMS = ("", ".", "BIN", "a/b", "a\\b", "it's", 'say "x"', "image")
NAME_ENDS = (".png", ".JPG", "", ".bmp", ".tar.gif", ".webp", ".", ".svg", ".emf")
HEADS = ("89504E47", "FFD8FF", "474946", "47494638", "424D", "49492A", "52494646", "3C737667", "", "D7CDC69A", "01000000", "00000001")


def _one_of(items: tuple[str, ...]) -> str:
    listed = ", ".join("'" + x.replace("'", "''") + "'" for x in items)
    return f"([{listed}])[p_partkey % {len(items)} + 1]"


ASSET_NAMES = rf"""
WITH t AS (
  SELECT p_partkey, {_one_of(NAME_STEMS)} || p_partkey || {_one_of(NAME_ENDS)} AS name, {_one_of(HEADS)} || printf('%04X', p_partkey) AS h FROM part)
SELECT p_partkey, CASE WHEN name <> '' AND NOT regexp_matches(name, '^[.]|[/\\]') THEN name END AS safe,
  CASE WHEN contains(name, '.') THEN left(name, length(name) - length(split_part(name, '.', -1)) - 1) ELSE name END || '.png' AS png,
  lower(CASE WHEN contains(name, '.') THEN split_part(name, '.', -1) ELSE '' END) IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'svg') AS web,
  replace(replace(name, '''', ''), '\', '') AS font, replace(replace(name, '\', '\\'), '"', '\"') AS json,
  length(h) >= 8 AND regexp_matches(h, '^(89504E47|FFD8FF|47494638|424D|49492A00|4D4D002A|52494646|3C737667|D7CDC69A|01000000)') AS image
FROM t
"""


#: Bits of the character shapes that the header queries set, each on the numbers that it divides.
HEADER_BITS = {"italic": 2, "bold": 3, "underline_kind": 5, "strike": 7}
_SLOT_NAMES = "'hangul', 'latin', 'hanja', 'japanese', 'other', 'symbol', 'user'"


def _seven(m: int, a: int) -> str:
    return "[" + ", ".join(f"CAST(p_partkey * {i + 3} % {m} + {a} AS INTEGER)" for i in range(7)) + "]"


HEADER_FONTS = f"""WITH f AS (SELECT p_partkey % 50 AS doc_id, [{_SLOT_NAMES}][(p_partkey // 50) % 7 + 1] AS slot, p_partkey AS k, p_brand || ' & <' || p_partkey AS name FROM part)
SELECT doc_id, slot, CAST(row_number() OVER (PARTITION BY doc_id, slot ORDER BY k) - 1 AS INTEGER) AS idx, name FROM f"""
HEADER_CHARS = f"""SELECT p_partkey % 50 AS doc_id, p_partkey AS id,
CAST({" + ".join(f"CASE WHEN p_partkey % {m} = 0 THEN {bit} ELSE 0 END" for bit, m in zip((1, 2, 4, 1 << 21), HEADER_BITS.values()))} AS INTEGER) AS attr,
p_partkey % 4000 + 1 AS height, p_partkey * 31 % 16777216 AS color, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 77 % 16777216 ELSE 0 END AS shade, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 9 END AS border_fill,
CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 5 % 16777216 ELSE 0 END AS underline_color, CASE WHEN p_partkey % 7 = 0 THEN p_partkey * 11 % 16777216 END AS strike_color,
{_seven(90, 0)} AS fonts, {_seven(200, 1)} AS ratios, {_seven(150, 1)} AS sizes, {_seven(200, -100)} AS spacings, {_seven(60, -30)} AS offsets FROM part"""

_OCTETS = "'data:application/octet-stream;base64,'"
ASSETS = f"""WITH r AS (SELECT page_id, 0 AS place, 'ASSET[id=asset-' || page_id % 1000 || ',bin_id=' || page_id % 1000 || ',mime=image/png,source_id=image' || page_id % 1000 || '.png]' || chr(10) || 'DATA: data:image/png;base64,' || base64(encode(html)) AS line FROM pages WHERE html <> ''
UNION ALL SELECT page_id, 1, 'SECTION_BYTES[id=section-0,len=' || octet_length(encode(html)) || ']' || chr(10) || 'DATA: ' || {_OCTETS} || base64(encode(html)) FROM pages WHERE page_id % 2 = 0 AND html <> ''
UNION ALL SELECT page_id, 2, 'UNKNOWN_STREAM[name=Preview/PrvText.txt,len=' || octet_length(encode(url)) || ']' || chr(10) || 'DATA: ' || {_OCTETS} || base64(encode(url)) FROM pages WHERE page_id % 3 = 0 AND url <> '')
SELECT page_id AS doc_id, '<!-- foliant:assets v1 -->' || chr(10) || chr(10) || string_agg(line || chr(10) || chr(10), '' ORDER BY place) AS assets FROM r GROUP BY page_id"""
ASSET_ROWS = """SELECT page_id AS doc_id, 'ASSET' AS kind, 'image' || page_id % 1000 || '.png' AS name, 'image/png' AS mime, octet_length(encode(html)) AS n, md5(html) AS digest FROM pages WHERE html <> ''
UNION ALL SELECT page_id, 'SECTION_BYTES', 'section-0', 'application/octet-stream', octet_length(encode(html)), md5(html) FROM pages WHERE page_id % 2 = 0 AND html <> ''
UNION ALL SELECT page_id, 'UNKNOWN_STREAM', 'Preview/PrvText.txt', 'application/octet-stream', octet_length(encode(url)), md5(url) FROM pages WHERE page_id % 3 = 0 AND url <> ''"""

#: Styled turns, character by character: each character's shape is that of the last listed run that has begun at its UTF-16 offset, and tags close and open
#: where the shape changes.
STYLED = rf"""
WITH source AS (
  SELECT conv_id AS doc_id, turn, replace(text, '. ', '.' || chr(160) || ' ' || chr(65532) || '<b>&' || chr(39) || '"') AS text,
    [(3 * conv_id + 5 * turn + k * (conv_id // 4)) % 14 FOR k IN range(0, 4)] AS s, [(length(text) * k) // 4 FOR k IN range(0, 4)] AS a FROM conversations),
listed AS (
  SELECT *, CASE WHEN turn % 5 = 4 THEN [] WHEN turn % 5 = 3 THEN [{{'p': a[3], 'shape': s[1]}}, {{'p': a[2], 'shape': s[2]}}]
    ELSE [{{'p': a[1], 'shape': s[1]}}, {{'p': a[2], 'shape': s[2]}}, {{'p': a[3], 'shape': s[3]}}, {{'p': a[4], 'shape': s[4]}}] END AS runs FROM source),
chars AS (SELECT doc_id, turn, runs, i, text[i] AS c FROM listed, unnest(range(1, length(text) + 1)) AS u(i)),
placed AS (SELECT *, sum(CASE WHEN unicode(c) > 65535 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id, turn ORDER BY i) - CASE WHEN unicode(c) > 65535 THEN 2 ELSE 1 END AS pos FROM chars),
active AS (SELECT *, list_filter(runs, lambda r: r.p <= pos)[-1].shape AS shape FROM placed),
catalogue AS (
  SELECT DISTINCT conv_id AS doc_id, id, id % 4 = 0 AS strike, id % 2 = 0 AS bold, id % 3 = 0 AS italic,
    CASE WHEN id % 5 = 0 THEN 1000 ELSE 800 + id * 37 + conv_id % 50 END AS height, CASE WHEN id % 2 = 0 THEN 0 ELSE (conv_id * 7919 + id * 65537) % 16777216 END AS colour, id % 4 AS font
  FROM conversations, unnest(range(0, 12)) AS u(id)),
css AS (
  SELECT *, array_to_string(list_filter([
    CASE WHEN colour <> 0 THEN printf('color:#%02x%02x%02x', colour % 256, colour // 256 % 256, colour // 65536) END,
    CASE WHEN height <> 1000 THEN 'font-size:' || CASE WHEN CAST(CAST(height / 100 AS FLOAT) AS DOUBLE) % 1 < CAST(CAST(0.05 AS FLOAT) AS DOUBLE) THEN CAST(height // 100 AS VARCHAR) ELSE printf('%.1f', CAST(CAST(height / 100 AS FLOAT) AS DOUBLE)) END || 'pt' END,
    CASE WHEN font < 2 THEN 'font-family:' || chr(39) || 'OFont &amp; Co ' || font || chr(39) END], lambda x: x IS NOT NULL), ';') AS css FROM catalogue),
marks AS (
  SELECT doc_id, id, CASE WHEN strike THEN '~~' ELSE '' END || CASE WHEN bold THEN '**' ELSE '' END || CASE WHEN italic THEN '*' ELSE '' END AS mo,
    CASE WHEN italic THEN '*' ELSE '' END || CASE WHEN bold THEN '**' ELSE '' END || CASE WHEN strike THEN '~~' ELSE '' END AS mc,
    CASE WHEN css <> '' THEN '<span style="' || css || '">' ELSE '' END || CASE WHEN strike THEN '<s>' ELSE '' END || CASE WHEN bold THEN '<strong>' ELSE '' END || CASE WHEN italic THEN '<em>' ELSE '' END AS ho,
    CASE WHEN italic THEN '</em>' ELSE '' END || CASE WHEN bold THEN '</strong>' ELSE '' END || CASE WHEN strike THEN '</s>' ELSE '' END || CASE WHEN css <> '' THEN '</span>' ELSE '' END AS hc FROM css),
swept AS (
  SELECT doc_id, turn, i, c, shape, len(runs) = 0 AS plain, shape IS DISTINCT FROM lag(shape) OVER w AS opens, lead(i) OVER w IS NULL OR lead(shape) OVER w IS DISTINCT FROM shape AS closes
  FROM active WINDOW w AS (PARTITION BY doc_id, turn ORDER BY i)),
written AS (
  SELECT w.*, CASE WHEN unicode(c) IN (160, 8195) THEN ' ' WHEN unicode(c) IN (65532, 173) THEN '' ELSE c END AS x,
    CASE WHEN opens THEN coalesce(mo, '') ELSE '' END AS mo, CASE WHEN closes THEN coalesce(mc, '') ELSE '' END AS mc, CASE WHEN opens THEN coalesce(ho, '') ELSE '' END AS ho, CASE WHEN closes THEN coalesce(hc, '') ELSE '' END AS hc
  FROM swept w LEFT JOIN marks m ON w.doc_id = m.doc_id AND w.shape = m.id),
lines AS (
  SELECT doc_id, turn, any_value(plain) AS plain, string_agg(mo || x || mc, '' ORDER BY i) AS m, string_agg(ho || {escapes('x', '&#39;')} || hc, '' ORDER BY i) AS h, string_agg(c, '' ORDER BY i) AS raw FROM written GROUP BY doc_id, turn),
whole AS (
  SELECT s.doc_id, s.turn, {trim("regexp_replace(coalesce(m, ''), ' +', ' ', 'g')")} AS markdown, CASE WHEN len(s.runs) = 0 THEN {escapes(clean('s.text'), '&#39;')} ELSE coalesce(h, '') END AS html
  FROM listed s LEFT JOIN lines l ON s.doc_id = l.doc_id AND s.turn = l.turn),
looks AS (
  SELECT *, array_to_string(list_filter([CASE WHEN turn % 3 > 0 THEN 'padding-left:' || turn % 3 || 'em' END,
    CASE turn % 7 WHEN 2 THEN 'text-align:right' WHEN 3 THEN 'text-align:center' WHEN 1 THEN NULL WHEN 6 THEN NULL ELSE 'text-align:justify' END], lambda x: x IS NOT NULL), ';') AS style FROM whole)
SELECT doc_id, 'p' || turn AS path, markdown,
  CASE WHEN {visible(untagged('html'))} <> '' THEN '<p' || CASE WHEN style <> '' THEN ' style="' || style || '"' ELSE '' END || '>' || html || '</p>' END AS block FROM looks
"""

#: Customers as trees: `spot` sorts as the tree is walked, `level` counts the tables around, `deep` those that don't merely wrap a table.
TREE = rf"""
WITH RECURSIVE facts AS (
  SELECT c_custkey AS k, c_custkey // 2 AS q, c_custkey % 2 AS i, 'tel ' || c_nationkey AS phone,
    CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN '2. ' || c_name ELSE c_mktsegment || '  <' || c_custkey || '> & |' END AS text FROM customer),
posed AS (
  SELECT *, q % 10 = 5 AS apart, q % 3 = 0 AND q % 10 <> 5 AS tall, CASE WHEN q % 10 = 5 THEN 0 WHEN q % 3 = 1 THEN 1 - i ELSE i END AS j, CASE WHEN q % 10 = 5 THEN i ELSE 0 END AS t FROM facts),
celled AS (
  SELECT *, CASE WHEN tall THEN j ELSE 0 END AS r, CASE WHEN tall THEN 0 ELSE j END AS c, CASE WHEN q % 6 = 1 AND j = 1 THEN 2 ELSE 1 END AS span,
    '/t' || t || '/c' || CASE WHEN apart THEN 0 ELSE i END AS tail FROM posed),
tree AS (
  SELECT k, k AS doc_id, 'p0' AS path, 'p0' AS spot, 's0-p0' AS place, 0 AS level FROM celled WHERE k < 16
  UNION ALL
  SELECT x.k, p.doc_id, p.path || x.tail || '/p0', p.spot || 't' || x.t || 'r' || x.r || 'c' || x.c || 'p0', p.place || '-c' || x.t || '-r' || x.r || 'c' || x.c || '-p0', p.level + 1
  FROM tree p JOIN celled x ON x.q = p.k AND x.k >= 16),
cells AS (
  SELECT x.*, p.doc_id, p.path, p.spot, p.place, p.level, h.path || '/t' || x.t AS tbl, h.spot || 't' || x.t AS tspot, h.place || '-c' || x.t AS tplace
  FROM celled x JOIN tree p USING (k) JOIN tree h ON h.k = x.q WHERE x.k >= 16),
tables AS (
  SELECT doc_id, tbl AS path, any_value(tspot) AS spot, any_value(tplace) AS place, any_value(level) AS level, any_value(q) AS q, CAST(CASE WHEN bool_or(tall) THEN 2 ELSE 1 END AS INTEGER) AS rows,
    CAST(CASE WHEN bool_or(tall OR apart) THEN 1 ELSE 2 END AS INTEGER) AS cols FROM cells GROUP BY doc_id, tbl),
paras AS (
  SELECT doc_id, path, spot, place, level, k, text FROM tree JOIN facts USING (k)
  UNION ALL SELECT doc_id, regexp_replace(path, '0$', '1'), regexp_replace(spot, '0$', '1'), regexp_replace(place, '0$', '1'), level, k, phone FROM tree JOIN facts USING (k) WHERE k % 4 = 1)
"""
TREE_CORPUS = """, ranked AS (
  SELECT p.*, c.tbl, row_number() OVER (PARTITION BY c.doc_id, c.tbl ORDER BY c.r, c.c, p.spot) AS rank FROM paras p JOIN cells c USING (k)),
inside AS (
  SELECT doc_id, path AS root, path AS tbl, CAST(0 AS BIGINT) AS spent FROM tables
  UNION ALL SELECT i.doc_id, i.root, t.path, i.spent + r.rank FROM inside i JOIN ranked r ON r.doc_id = i.doc_id AND r.tbl = i.tbl AND i.spent + r.rank <= 7
    JOIN tables t ON t.doc_id = r.doc_id AND t.q = r.k AND ends_with(r.path, 'p0'))
SELECT i.doc_id, i.root AS path, string_agg(r.text || chr(10), '' ORDER BY r.spot) AS corpus FROM inside i JOIN ranked r ON r.doc_id = i.doc_id AND r.tbl = i.tbl AND i.spent + r.rank <= 7 GROUP BY i.doc_id, i.root
"""
TREE_HTML = rf""", seen AS (
  SELECT p.*, {escapes(clean('text'), '&#39;')} AS body, {text_level('text')} AS lv FROM paras p),
deep AS (SELECT doc_id, max(lv) FILTER (WHERE spot = 'p0') AS lv0, coalesce(max(lv) FILTER (WHERE spot = 'p1'), max(lv) FILTER (WHERE spot = 'p0')) AS lv1 FROM seen WHERE level = 0 GROUP BY doc_id),
events AS (
  SELECT s.doc_id, spot, CASE WHEN lv IS NOT NULL THEN CASE WHEN spot = 'p1' AND lv0 >= lv THEN '</section>' || chr(10) ELSE '' END || '<section class="chapter lv-' || lv || '" id="sec-' || place || '">' || chr(10) ELSE '' END
      || CASE WHEN {visible('body')} <> '' THEN '<' || CASE WHEN lv IS NOT NULL THEN 'h' || lv ELSE 'p' END || ' id="par-' || place || '"'
        || CASE WHEN coalesce(lv - 1, CASE WHEN spot = 'p0' THEN lv0 ELSE lv1 END, 0) > 0 THEN ' style="padding-left:' || coalesce(lv - 1, CASE WHEN spot = 'p0' THEN lv0 ELSE lv1 END) || 'em"' ELSE '' END
        || '>' || body || '</' || CASE WHEN lv IS NOT NULL THEN 'h' || lv ELSE 'p' END || '>' || chr(10) ELSE '' END AS x FROM seen s JOIN deep d USING (doc_id) WHERE level = 0
  UNION ALL SELECT doc_id, '', '<section id="sec-0">' || chr(10) FROM deep
  UNION ALL SELECT d.doc_id, '~', repeat('</section>' || chr(10), 1 + (SELECT count(*) FROM seen s WHERE s.doc_id = d.doc_id AND s.level = 0 AND lv IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seen o WHERE o.doc_id = s.doc_id AND o.level = 0 AND o.spot > s.spot AND o.lv <= s.lv)))
    FROM deep d
  UNION ALL SELECT s.doc_id, s.spot, CASE WHEN ends_with(s.spot, 'p1') AND EXISTS (SELECT 1 FROM seen o WHERE o.k = s.k AND o.spot < s.spot AND {visible('o.body')} <> '') THEN '<br>' ELSE '' END || body
    FROM seen s WHERE level > 0 AND {visible('body')} <> ''
  UNION ALL SELECT t.doc_id, t.spot, CASE WHEN level = 1 AND lv0 > 0 THEN '<div class="indent" style="padding-left:' || lv0 || 'em">' ELSE '' END || '<table id="tbl-' || place || '">' || chr(10) FROM tables t JOIN deep USING (doc_id)
  UNION ALL SELECT t.doc_id, t.spot || '~', '</table>' || chr(10) || CASE WHEN level = 1 AND lv0 > 0 THEN '</div>' || chr(10) ELSE '' END FROM tables t JOIN deep USING (doc_id)
  UNION ALL SELECT doc_id, spot || 'r' || i, '  <tr>' || chr(10) FROM tables, unnest(range(0, rows)) AS u(i)
  UNION ALL SELECT doc_id, spot || 'r' || i || '~', '  </tr>' || chr(10) FROM tables, unnest(range(0, rows)) AS u(i)
  UNION ALL SELECT doc_id, tspot || 'r' || r || 'c' || c, '    <td id="cell-' || tplace || '-r' || r || 'c' || c || '"' || CASE WHEN span > 1 THEN ' colspan="' || span || '"' ELSE '' END || '>' FROM cells
  UNION ALL SELECT doc_id, tspot || 'r' || r || 'c' || c || '~', '</td>' || chr(10) FROM cells)
SELECT doc_id, '<article>' || chr(10) || string_agg(x, '' ORDER BY spot) || '</article>' || chr(10) AS html FROM events GROUP BY doc_id
"""
TREE_MARKDOWN = rf""", texts AS (SELECT p.*, {clean('text')} AS x FROM paras p),
filled AS (
  SELECT c.*, (SELECT string_agg(x, ' · ' ORDER BY o.spot) FROM texts o WHERE o.k = c.k AND x <> '') AS inline, {clean("(SELECT string_agg(x, ' ' ORDER BY o.spot) FROM texts o WHERE o.k = c.k)")} AS said,
    (SELECT count(*) FROM tables t WHERE t.q = c.k) AS inner_tables FROM cells c),
formed AS (
  SELECT t.*, n, f, m, s, wide, CASE WHEN n = 1 AND f = 0 AND m = 1 THEN 'unwrap' WHEN f = 1 AND m = 0 AND length(s) <= 80 AND {box_level('s')} IS NOT NULL THEN 'heading' END AS form
  FROM tables t JOIN (SELECT doc_id, tbl AS path, count(*) AS n, count(inline) AS f, CAST(sum(inner_tables) AS BIGINT) AS m, max(said) FILTER (WHERE said <> '') AS s, sum(span) AS wide FROM filled GROUP BY doc_id, tbl) USING (doc_id, path)),
nested AS (
  SELECT f.*, (SELECT count(*) FROM formed o WHERE o.doc_id = f.doc_id AND f.path LIKE o.path || '/%' AND o.form IS DISTINCT FROM 'unwrap') AS deep FROM formed f),
shaped AS (
  SELECT *, CASE WHEN form IS NOT NULL THEN form WHEN f = 1 AND m = 0 AND deep = 0 AND rows = 1 AND length(s) <= 100 AND NOT contains(s, chr(10)) THEN 'passage' WHEN m = 0 AND wide = rows * cols AND n = rows * cols THEN 'grid' ELSE 'list' END AS how FROM nested),
lines AS (
  SELECT c.doc_id, c.tbl, c.r, '| ' || string_agg(replace(replace(said, '|', '\|'), chr(10), ' '), ' | ' ORDER BY c.c) || ' |' || chr(10) AS line FROM filled c GROUP BY c.doc_id, c.tbl, c.r),
grids AS (
  SELECT l.doc_id, l.tbl, string_agg(CASE WHEN r = 0 THEN line || '|' || repeat(' --- |', cols) || chr(10) ELSE line END, '' ORDER BY r) || chr(10) AS grid FROM lines l JOIN tables t ON t.doc_id = l.doc_id AND t.path = l.tbl GROUP BY l.doc_id, l.tbl),
idle AS (SELECT doc_id, tbl, r, min(c) AS first, max(c) AS last FROM filled WHERE inline IS NULL AND span = 1 AND inner_tables = 0 GROUP BY doc_id, tbl, r HAVING count(*) > 1),
events AS (
  SELECT doc_id, spot, CASE WHEN {text_level('text')} IS NOT NULL THEN repeat('#', {text_level('text')}) || ' ' ELSE '' END || x || chr(10) || chr(10) AS x FROM texts WHERE level = 0 AND x <> ''
  UNION ALL SELECT h.doc_id, spot, CASE how WHEN 'unwrap' THEN '' WHEN 'heading' THEN repeat('#', {box_level('s')}) || ' ' || s || chr(10) || chr(10) WHEN 'passage' THEN s || chr(10) || chr(10) WHEN 'grid' THEN grid
    ELSE repeat('  ', deep) || '<!-- table ' || rows || '×' || cols || ' (ragged/merged) -->' || chr(10) END FROM shaped h JOIN grids g ON g.doc_id = h.doc_id AND g.tbl = h.path
  UNION ALL SELECT doc_id, spot || '~', chr(10) FROM shaped WHERE how = 'list'
  UNION ALL SELECT c.doc_id, c.tspot || 'r' || c.r || 'c' || c.c, repeat('  ', deep) || '- [' || c.r || ',' || c.c || CASE WHEN first IS NOT NULL THEN '..' || last || ']: (empty)' || chr(10) ELSE ']' || CASE WHEN span <> 1 THEN ' span 1×' || span ELSE '' END
      || ':' || coalesce(' ' || replace(inline, chr(10), ' '), '') || chr(10) END
    FROM filled c JOIN shaped h ON h.doc_id = c.doc_id AND h.path = c.tbl AND how = 'list' LEFT JOIN idle e ON e.doc_id = c.doc_id AND e.tbl = c.tbl AND e.r = c.r AND c.c BETWEEN first AND last WHERE first IS NULL OR first = c.c)
SELECT doc_id, string_agg(x, '' ORDER BY spot) AS markdown FROM events GROUP BY doc_id
"""

#: Orders with their line items as tables, before and after an edit. Tables are numbered by order and, within one, by the line that holds them.
EDITED = r"""
WITH items AS (
  SELECT o_custkey AS doc_id, l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS n, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS flag, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
old_tables AS (
  SELECT doc_id, 'p' || o || '/t0' AS path, o, 0 AS n, CAST(o % 9 + 1 AS VARCHAR) AS border, '1,2,3,4' AS padding, CAST(o % 3 AS VARCHAR) AS spacing FROM items GROUP BY doc_id, o
  UNION ALL SELECT doc_id, 'p' || o || '/t0/c' || (n * 2 + 1) || '/p0/t0', o, n, CAST(n + 2 AS VARCHAR), NULL, NULL FROM items WHERE n % 3 = 0),
new_tables AS (
  SELECT doc_id, 'p' || o || '/t0' AS path, o, 0 AS n, CASE WHEN o % 4 = 0 THEN '7' ELSE '0' END AS border, '0,0,0,0' AS padding FROM items WHERE n < 7 GROUP BY doc_id, o
  UNION ALL SELECT doc_id, 'p' || o || '/t0/c' || (n * 2 + 1) || '/p0/t0', o, n, '0', NULL FROM items WHERE n % 3 = 0
  UNION ALL SELECT DISTINCT o_custkey, 'p0/t9', 0, 0, '0', NULL FROM orders WHERE o_custkey % 10 = 3),
old_ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, n) AS rank, count(*) OVER (PARTITION BY doc_id) AS total FROM old_tables),
new_ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, n) AS rank, count(*) OVER (PARTITION BY doc_id) AS total FROM new_tables),
pairs AS (SELECT w.*, v.path AS old_path, v.o AS old_o, v.n AS old_n, v.border AS old_border, v.padding AS old_padding, v.spacing AS old_spacing FROM new_ranked w JOIN old_ranked v USING (doc_id, rank, total)),
old_cells AS (SELECT doc_id, 'p' || o || '/t0' AS tbl, n - 1 AS row, i AS col, o, n FROM items, (VALUES (0), (1)) v(i) UNION ALL SELECT doc_id, 'p' || o || '/t0/c' || (n * 2 + 1) || '/p0/t0', 0, 0, o, n FROM items WHERE n % 3 = 0),
new_cells AS (
  SELECT doc_id, 'p' || o || '/t0' AS tbl, n - 1 AS row, i AS col, o, n FROM items, (VALUES (0), (1)) v(i) WHERE n < 7
  UNION ALL SELECT doc_id, 'p' || o || '/t0/c' || (n * 2 + 1) || '/p0/t0', 0, 0, o, n FROM items WHERE n % 3 = 0
  UNION ALL SELECT DISTINCT doc_id, 'p' || o || '/t0', 98, 0, o, 0 FROM items WHERE o % 7 = 0 AND n < 7)
"""
EDITED_CELLS = """, ours AS (SELECT p.doc_id, p.path AS tbl, c.row, c.col FROM pairs p JOIN new_cells c ON c.doc_id = p.doc_id AND c.tbl = p.path),
theirs AS (SELECT p.doc_id, p.path AS tbl, c.row, c.col FROM pairs p JOIN old_cells c ON c.doc_id = p.doc_id AND c.tbl = p.old_path)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.tbl, b.tbl) AS tbl, CAST(coalesce(a.row, b.row) AS INTEGER) AS row, CAST(coalesce(a.col, b.col) AS INTEGER) AS col,
  CASE WHEN a.doc_id IS NULL THEN 'removed' WHEN b.doc_id IS NULL THEN 'added' ELSE 'kept' END AS state
FROM ours a FULL JOIN theirs b ON a.doc_id = b.doc_id AND a.tbl = b.tbl AND a.row = b.row AND a.col = b.col
"""
EDITED_NODES = r""", looked AS (
  SELECT doc_id, 'p' || o || '/t0/c' || (n * 2 + i) || '/p0' AS path, 'p' || o || '/t0' AS tbl, n - 1 AS row, i AS col, n + i AS x,
    CASE WHEN i = 1 THEN CAST(CASE WHEN q > 40 THEN q + 1 ELSE q END AS VARCHAR) WHEN n % 2 = 0 THEN flag || part ELSE flag || ' ' || part || chr(10) || 'more' END AS text,
    CASE WHEN i = 0 AND n % 2 = 0 THEN flag || ' ' || part || chr(10) || 'more' END AS whole, o, n, n < 7 AS own FROM items, (VALUES (0), (1)) v(i)
  UNION ALL SELECT doc_id, 'p' || o || '/t0/c' || (n * 2 + 1) || '/p0/t0/c0/p0', 'p' || o || '/t0/c' || (n * 2 + 1) || '/p0/t0', 0, 0, n, flag, NULL, o, n, true FROM items WHERE n % 3 = 0),
kept AS (
  SELECT l.*, p.doc_id IS NOT NULL AS paired FROM looked l LEFT JOIN pairs p ON p.doc_id = l.doc_id AND p.path = l.tbl WHERE l.own),
styled AS (
  SELECT doc_id, path, paired, x, CASE WHEN x % 3 = 0 THEN '9' WHEN paired AND x % 5 > 0 THEN CAST(x % 5 AS VARCHAR) ELSE '0' END AS style, CASE WHEN paired AND x % 4 > 0 THEN CAST(x % 4 AS VARCHAR) END AS para,
    CASE WHEN paired THEN '0:' || x % 6 END AS runs, CASE WHEN paired AND x % 2 = 1 THEN '1' END AS page_break, CASE WHEN paired THEN coalesce(whole, text) ELSE text END AS text FROM kept),
tops AS (
  SELECT o_custkey AS doc_id, 'p' || o_orderkey AS path, o_orderkey AS x, p.doc_id IS NOT NULL AS paired, o_orderpriority AS text FROM orders LEFT JOIN pairs p ON p.doc_id = o_custkey AND p.path = 'p' || o_orderkey || '/t0')
SELECT doc_id, path, 'paragraph' AS kind, style, para, runs, page_break, NULL AS border, NULL AS padding, NULL AS spacing, text FROM styled
UNION ALL SELECT doc_id, path, 'paragraph', CASE WHEN x % 3 = 0 THEN '9' WHEN paired AND x % 5 > 0 THEN CAST(x % 5 AS VARCHAR) ELSE '0' END, CASE WHEN paired AND x % 4 > 0 THEN CAST(x % 4 AS VARCHAR) END, CASE WHEN paired THEN '0:' || x % 6 END, NULL, NULL, NULL, NULL, text FROM tops
UNION ALL SELECT w.doc_id, w.path, 'table', NULL, NULL, NULL, NULL, CASE WHEN w.border = '0' THEN coalesce(p.old_border, '0') ELSE w.border END, CASE WHEN coalesce(w.padding, '0,0,0,0') = '0,0,0,0' THEN coalesce(p.old_padding, w.padding) ELSE w.padding END,
    CASE WHEN p.old_spacing <> '0' THEN p.old_spacing END, NULL FROM new_ranked w LEFT JOIN pairs p ON p.doc_id = w.doc_id AND p.path = w.path
UNION ALL SELECT doc_id, CASE WHEN n = 0 THEN tbl || '/c99' WHEN tbl LIKE '%/p0/t0' THEN tbl || '/c0' ELSE tbl || '/c' || (n * 2 + col) END, 'cell', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM new_cells
"""

#: Chapters by a self join: a heading ends those earlier ones of no lower level that no heading between them ended.
CHAPTERS = rf"""
WITH raw AS (SELECT doc_id, i - 1 AS i, l[i] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)),
lines AS (
  SELECT doc_id, i, {clean("CASE WHEN (i + doc_id) % 7 = 0 THEN array_to_string(list_slice([(i + doc_id) % 9 + 1, (2 * i + doc_id) % 9 + 1, (3 * i + doc_id) % 9 + 1, (5 * i + doc_id) % 9 + 1], 1, (i * 3 + i // 7 + doc_id) % 4 + 1), '.') || ' ' || left(x, 60) ELSE x END")} AS x FROM raw),
leveled AS (SELECT *, {text_level('x')} AS level FROM lines),
heads AS (SELECT doc_id, i, level FROM leveled WHERE level IS NOT NULL),
ended AS (
  SELECT a.doc_id, a.i AS opened, min(b.i) AS stop FROM heads a JOIN heads b ON a.doc_id = b.doc_id AND b.i > a.i AND b.level <= a.level GROUP BY a.doc_id, a.i),
closes AS (SELECT doc_id, stop AS i, count(*) AS n FROM ended GROUP BY doc_id, stop),
left_open AS (SELECT h.doc_id, count(*) AS n FROM heads h LEFT JOIN ended e ON e.doc_id = h.doc_id AND e.opened = h.i WHERE e.stop IS NULL GROUP BY h.doc_id),
placed AS (SELECT *, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 0) AS depth FROM leveled),
shaped AS (
  SELECT p.doc_id, p.i, CASE WHEN level IS NOT NULL THEN repeat('</section>' || chr(10), coalesce(c.n, 0)) || '<section class="chapter lv-' || level || '" id="sec-s0-p' || p.i || '">' || chr(10) ELSE '' END
    || CASE WHEN {visible('x')} <> '' THEN '<' || CASE WHEN level IS NULL THEN 'p' ELSE 'h' || level END || ' id="par-s0-p' || p.i || '"' || CASE WHEN coalesce(level - 1, depth) > 0 THEN ' style="padding-left:' || coalesce(level - 1, depth) || 'em"' ELSE '' END
      || '>' || {escapes('x', '&#39;')} || '</' || CASE WHEN level IS NULL THEN 'p' ELSE 'h' || level END || '>' || chr(10) ELSE '' END AS x
  FROM placed p LEFT JOIN closes c ON c.doc_id = p.doc_id AND c.i = p.i)
SELECT s.doc_id, '<article>' || chr(10) || '<section id="sec-0">' || chr(10) || string_agg(x, '' ORDER BY i) || repeat('</section>' || chr(10), 1 + coalesce(any_value(o.n), 0)) || '</article>' || chr(10) AS html
FROM shaped s LEFT JOIN left_open o USING (doc_id) GROUP BY s.doc_id
"""

#: Two halves of the parts as catalogues; entries of the second that the first has are the first's, others follow its greatest id.
CATALOGUE = """
WITH own AS (SELECT p_partkey % 25 AS doc_id, p_partkey // 50 AS id, p_partkey AS k, p_brand, p_partkey % 50 >= 25 AS second FROM part),
chars AS (SELECT *, CAST(k % 4 * 2 AS INTEGER) AS attr, 800 + k % 3 * 100 AS height, CASE WHEN k % 5 = 0 THEN 255 ELSE 0 END AS color FROM own),
char_first AS (SELECT doc_id, attr, height, color, min(id) FILTER (WHERE NOT second) AS known, min(id) FILTER (WHERE second) AS asked FROM chars GROUP BY ALL),
char_new AS (
  SELECT f.*, CASE WHEN known IS NOT NULL THEN known ELSE coalesce((SELECT max(id) FROM chars c WHERE c.doc_id = f.doc_id AND NOT second), -1) + row_number() OVER (PARTITION BY f.doc_id, known IS NULL ORDER BY asked) END AS new FROM char_first f WHERE asked IS NOT NULL),
char_map AS (SELECT c.doc_id, c.id AS old, n.new FROM chars c JOIN char_new n USING (doc_id, attr, height, color) WHERE second),
paras AS (SELECT *, CAST(k % 6 AS INTEGER) AS align FROM own),
para_first AS (SELECT doc_id, align, min(id) FILTER (WHERE NOT second) AS known, min(id) FILTER (WHERE second) AS asked FROM paras GROUP BY ALL),
para_new AS (
  SELECT f.*, CASE WHEN known IS NOT NULL THEN known ELSE coalesce((SELECT max(id) FROM paras c WHERE c.doc_id = f.doc_id AND NOT second), -1) + row_number() OVER (PARTITION BY f.doc_id, known IS NULL ORDER BY asked) END AS new FROM para_first f WHERE asked IS NOT NULL),
para_map AS (SELECT c.doc_id, c.id AS old, n.new FROM paras c JOIN para_new n USING (doc_id, align) WHERE second),
styles AS (
  SELECT o.doc_id, o.id, o.second, p_brand, o.id % 3 AS next, CASE WHEN second THEN coalesce(c.new, o.id) ELSE o.id END AS cs, CASE WHEN second THEN coalesce(p.new, o.id % 7) ELSE o.id % 7 END AS ps
  FROM own o LEFT JOIN char_map c ON c.doc_id = o.doc_id AND c.old = o.id LEFT JOIN para_map p ON p.doc_id = o.doc_id AND p.old = o.id % 7),
style_first AS (SELECT doc_id, p_brand, cs, ps, min(id) FILTER (WHERE NOT second) AS known, min(id) FILTER (WHERE second) AS asked FROM styles GROUP BY ALL),
style_new AS (
  SELECT f.*, CASE WHEN known IS NOT NULL THEN known ELSE coalesce((SELECT max(id) FROM styles c WHERE c.doc_id = f.doc_id AND NOT second), -1) + row_number() OVER (PARTITION BY f.doc_id, known IS NULL ORDER BY asked) END AS new FROM style_first f WHERE asked IS NOT NULL),
style_map AS (SELECT c.doc_id, c.id AS old, n.new FROM styles c JOIN style_new n USING (doc_id, p_brand, cs, ps) WHERE second)
"""
CATALOGUE_STYLES = """, all_chars AS (SELECT doc_id, id, attr, height, color FROM chars WHERE NOT second UNION ALL SELECT doc_id, new, attr, height, color FROM char_new WHERE known IS NULL),
all_paras AS (SELECT doc_id, id, align FROM paras WHERE NOT second UNION ALL SELECT doc_id, new, align FROM para_new WHERE known IS NULL),
all_styles AS (
  SELECT doc_id, id, p_brand, cs, ps, next FROM styles WHERE NOT second
  UNION ALL SELECT n.doc_id, n.new, n.p_brand, n.cs, n.ps, coalesce(m.new, asked % 3) FROM style_new n LEFT JOIN style_map m ON m.doc_id = n.doc_id AND m.old = asked % 3 WHERE known IS NULL)
SELECT s.doc_id, s.id, p_brand, cs AS char_shape, ps AS para_shape, next AS next_style, attr, height, color, align
FROM all_styles s JOIN all_chars c ON c.doc_id = s.doc_id AND c.id = cs LEFT JOIN all_paras p ON p.doc_id = s.doc_id AND p.id = ps
"""
CATALOGUE_NODES = """, refs AS (SELECT c_custkey % 30 AS doc_id, c_custkey AS k FROM customer)
SELECT r.doc_id, k AS path, CAST(coalesce(s.new, k % 5) AS VARCHAR) AS style, CAST(coalesce(p.new, k % 9) AS VARCHAR) AS para, '0:' || coalesce(a.new, k % 4) || '|7:' || coalesce(b.new, k % 999) AS runs
FROM refs r LEFT JOIN style_map s ON s.doc_id = r.doc_id AND s.old = k % 5 LEFT JOIN para_map p ON p.doc_id = r.doc_id AND p.old = k % 9
LEFT JOIN char_map a ON a.doc_id = r.doc_id AND a.old = k % 4 LEFT JOIN char_map b ON b.doc_id = r.doc_id AND b.old = k % 999
"""

HOISTED = """
WITH pieces AS (SELECT page_id, k - 1 AS k, l[k] AS x FROM (SELECT page_id, string_split(coalesce(html, ''), '<') AS l FROM pages), unnest(range(1, len(l) + 1)) AS u(k)),
spans AS (SELECT *, CASE WHEN k = 0 THEN NULL WHEN k % 35 = 5 THEN 'one:' || k WHEN k % 5 = 0 THEN 'w:' || (k * page_id) % 7 END AS style FROM pieces),
counts AS (SELECT page_id, style, count(*) AS n FROM spans WHERE style IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
names AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, style) - 1 AS i FROM counts),
rules AS (SELECT page_id, '<style>' || chr(10) || string_agg('article .s' || i || ' { ' || style || ' }' || chr(10), '' ORDER BY i) || '</style>' || chr(10) AS head FROM names GROUP BY page_id),
bodies AS (
  SELECT s.page_id, string_agg(CASE WHEN s.style IS NULL THEN '' WHEN i IS NULL THEN '<span style="' || s.style || '">' ELSE '<span class="s' || i || '">' END || CASE WHEN k = 0 THEN '' ELSE '<' END || x, '' ORDER BY k) AS body
  FROM spans s LEFT JOIN names n ON n.page_id = s.page_id AND n.style = s.style GROUP BY s.page_id)
SELECT page_id, md5(coalesce(head, '') || body) AS digest, true AS same, length(coalesce(head, '') || body) AS n FROM bodies LEFT JOIN rules USING (page_id)
"""
