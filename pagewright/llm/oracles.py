"""DuckDB SQL with the rows of the queries that SQL can express."""

from . import decontaminate, fim, licenses, lines, mixing, quality

SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


_quoted = lambda s: s.replace("'", "''")

EDGED = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {SPLIT.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT r, line, lower({EDGED}) AS p FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
j AS (SELECT *, regexp_matches(p, '{_quoted(quality.TERMINAL)}') AND NOT regexp_matches(p, '^({quality.NAVIGATION})[ .:]*$') AND NOT regexp_matches(p, '( [|>»·] .*){{2}}')
  AND {_count('p', quality.SYMBOLS)} * {quality.CHARS_A_SYMBOL} < length(p) AND {_count('p', '!')} * {quality.CHARS_A_SYMBOL} <= length(p) AND (length(p) > {quality.BOILERPLATE_CHARS} OR NOT regexp_matches(p, '{quality.BOILERPLATE}')) AS good FROM l),
s AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count_if(good) AS n_clean_lines, sum(length({EDGED})) AS line_chars, coalesce(sum(length({EDGED})) FILTER (good), 0) AS clean_chars FROM j GROUP BY r),
g AS (SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM t) GROUP BY r),
q AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_count('text', quality.SYMBOLS)} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_clean_lines, 0) AS n_clean_lines, coalesce(clean_chars, 0) AS clean_chars, coalesce(line_chars, 0) AS line_chars FROM d LEFT JOIN s USING (r) LEFT JOIN c USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND clean_chars >= {quality.LEAST_LEFT} * line_chars AS kept,
  CAST(n_lines AS BIGINT) AS n_lines, CAST(n_clean_lines AS BIGINT) AS n_clean_lines, CAST(clean_chars AS BIGINT) AS clean_chars FROM q
"""


def _shingled(table: str, key: str, text: str = LOWERED) -> str:
    of = f"CASE WHEN len(w) >= {decontaminate.WIDTH} THEN list_transform(range(1, len(w) - {decontaminate.WIDTH - 2}), lambda i: array_to_string(w[i:i+{decontaminate.WIDTH - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"SELECT DISTINCT {key}, unnest(list_distinct({of})) AS s FROM (SELECT {key}, {SPLIT.format(text)} AS w FROM {table})"


LEAKS = f"""
WITH d AS ({_shingled('documents', 'doc_id')}), i AS ({_shingled('benchmark', 'item_id')}), n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_item AS INT) AS n_item, n_common, n_common / n_item AS containment FROM c JOIN n USING (item_id) WHERE n_common >= ceil({decontaminate.THRESHOLD} * n_item - 1e-9)
"""

MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len({SPLIT.format("coalesce(text, '')")}) AS BIGINT) AS size, md5('{mixing.SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'null')) || md5(coalesce(text, '')) AS place FROM documents),
s AS (SELECT source, sum(size) AS source_size, [{', '.join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY {mixing.MOST}.0 * source_size / w, source NULLS LAST) AS k, sum(source_size) OVER () AS total, sum(w) OVER () AS ws FROM s),
c AS (SELECT *, coalesce(sum({mixing.MOST} * source_size) OVER p, 0) AS full_size, coalesce(sum(w) OVER p, 0) AS full_w FROM o WINDOW p AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) AS first FROM c WHERE w * CAST(total - full_size AS DOUBLE) / (ws - full_w) <= {mixing.MOST} * source_size),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN k < first THEN CAST({mixing.MOST} * source_size AS DOUBLE) ELSE w * CAST(total - l.full_size AS DOUBLE) / (ws - l.full_w) END AS target
  FROM o, f, (SELECT full_size, full_w FROM c, f WHERE k = first) l),
r AS (SELECT doc_id, size, source_size, target, least(CAST(floor(target) AS BIGINT), {mixing.MOST} * source_size) AS flow, sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (flow // source_size + CAST(2 * upto - size <= 2 * (flow % source_size) AND flow % source_size > 0 AS INT)) * size END AS BIGINT) AS taken FROM r
"""

LINES = rf"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, text, k, list_filter(regexp_split_to_array(regexp_replace(trim(ls[k], ' '), '[^ \t\r]*[0-9][^ \t\r]*', '<*>', 'g'), '[ \t\r]+'), lambda w: w <> '') AS w FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM d)),
l AS (SELECT *, (len(w), w[1:{lines.LEADING}]) AS leaf FROM p WHERE len(w) > 0),
u AS (SELECT DISTINCT leaf, w FROM l WHERE leaf IN (SELECT leaf FROM l GROUP BY leaf HAVING count(DISTINCT w) > 1)),
s AS (SELECT leaf, w, unnest(range(1, len(w) + 1)) AS i FROM u), v AS (SELECT leaf, i, w[i] AS t, count(*) AS n FROM s GROUP BY ALL),
a AS (SELECT leaf, w, list(CASE WHEN n > 1 THEN t ELSE chr(1) END ORDER BY i) AS form, count_if(n > 1) AS f FROM s JOIN v USING (leaf, i) WHERE t = w[i] GROUP BY leaf, w),
g AS (SELECT leaf, list(t ORDER BY i) AS win FROM (SELECT leaf, i, max((n, t))[2] AS t FROM v GROUP BY leaf, i) GROUP BY leaf),
o AS (SELECT leaf, w, form[1:i-1] || [chr(1)] || form[i+1:] AS form FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM a WHERE f - 1 >= {lines.SIMILAR} * len(w)) WHERE form[i] <> chr(1)),
m AS (SELECT leaf, w, form FROM a WHERE f >= {lines.SIMILAR} * len(w) UNION SELECT leaf, w, form FROM o
  UNION SELECT leaf, w, ['agreed'] FROM u JOIN g USING (leaf) WHERE len(list_filter(range(1, len(w) + 1), lambda i: w[i] = win[i])) >= {lines.SIMILAR} * len(w)),
t AS (SELECT doc_id, text, k, (leaf, form) AS template FROM l JOIN m USING (leaf, w) UNION ALL SELECT doc_id, text, k, (leaf, ['exact'] || w) FROM l),
r AS (SELECT template FROM (SELECT DISTINCT template, doc_id, text FROM t) GROUP BY template HAVING count(*) >= {lines.DOCUMENTS}),
x AS (SELECT DISTINCT doc_id, text, k FROM t JOIN r USING (template)), y AS (SELECT doc_id, text, list(k) AS gone FROM x GROUP BY doc_id, text),
z AS (SELECT b.doc_id, b.text, string_split(b.text, chr(10)) AS ls, coalesce(gone, []) AS gone FROM documents b LEFT JOIN y ON b.doc_id IS NOT DISTINCT FROM y.doc_id AND b.text = y.text)
SELECT doc_id, CASE WHEN len(gone) > 0 THEN array_to_string(list_filter(ls, lambda e, i: NOT list_contains(gone, i)), chr(10)) ELSE text END AS text,
  CAST(coalesce(len(list_filter(ls, lambda e: translate(e, ' ' || chr(9) || chr(13), '') <> '')), 0) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_dropped FROM z
"""

_marks = licenses.MARKS.replace("'", "''")


def _licensed(text: str) -> str:
    plain = f"translate(regexp_replace({LOWERED.replace('text', text, 1)}, '(?m){_marks}', ' ', 'g'), '{_quoted(licenses.PUNCTUATION)}', '')"
    return SPLIT.format(plain)


def _shingles(w: str) -> str:
    n = licenses.WIDTH
    return f"CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i+{n - 1}], ' ')) WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END"


_rows = ", ".join(f"('{_quoted(name)}', {k}, '{_quoted(text)}')" for name, texts in licenses.TEMPLATES.items() for k, text in enumerate(texts))
LICENSES = f"""
WITH t AS (SELECT name, template, list_distinct({_shingles('w')}) AS ss FROM (SELECT name, template, {_licensed('body')} AS w FROM (VALUES {_rows}) v(name, template, body))),
ts AS (SELECT name, template, len(ss) AS n, unnest(ss) AS s FROM t),
d AS (SELECT DISTINCT doc_id, text FROM documents), dw AS (SELECT doc_id, text, {_licensed('text')} AS w FROM d), ds AS (SELECT doc_id, text, {_shingles('w')} AS ss FROM dw),
e AS (SELECT doc_id, text, s, min(i) AS i FROM (SELECT doc_id, text, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM ds) GROUP BY ALL),
c AS (SELECT doc_id, text, name, template, n, list(s) AS common, min(i) AS first_word FROM e JOIN ts USING (s) GROUP BY doc_id, text, name, template, n HAVING count(*) >= ceil({licenses.THRESHOLD} * n - 1e-9)),
b AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id IS NOT DISTINCT FROM c.doc_id AND o.text = c.text AND len(o.common) / o.n > len(c.common) / c.n AND list_has_all(o.common, c.common)))
SELECT x.doc_id, name, template, len(common) / n AS containment, CAST(first_word AS INT) AS first_word FROM documents x JOIN b ON x.doc_id IS NOT DISTINCT FROM b.doc_id AND x.text = b.text
"""

FILL_IN_MIDDLE = f"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
h AS (SELECT *, len(u) AS n, {', '.join(f"CAST('0x' || substr(k, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{fim.PREFIX}') OR contains(t, '{fim.SUFFIX}') OR contains(t, '{fim.MIDDLE}') OR h3 % 100 >= {fim.CHANGED} THEN 'plain' WHEN h4 % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a+1:b], '') AS m, array_to_string(u[b+1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{fim.PREFIX}' || p || '{fim.SUFFIX}' || s || '{fim.MIDDLE}' || m ELSE '{fim.SUFFIX}' || s || '{fim.PREFIX}' || p || '{fim.MIDDLE}' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256 FROM p
"""


def _field(value: str) -> str:
    shown = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({shown})) AS VARCHAR) || ':' || {shown}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


#: The crc32 of a decimal doc_id: each byte, then eight shifts.
_CRC32 = "xor(list_reduce(flatten([[4294967295], flatten(list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))]), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
_LOST = "replace(text, chr(10), '')"
MANIFEST = f"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf(_LOST)} AS lost FROM documents)),
t AS (SELECT CAST(0 AS BIGINT) AS l, source, k, n, leaf AS h FROM d UNION ALL
  SELECT l + 1, source, k // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY k)) FROM t WHERE n > 1 GROUP BY l, source, k // 3, (n + 2) // 3),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT CAST(0 AS BIGINT) AS l, k, n, subroot AS h FROM s UNION ALL SELECT l + 1, k // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY k)) FROM u WHERE n > 1 GROUP BY l, k // 3, (n + 2) // 3),
o AS (SELECT r, t.l AS l, CAST(0 AS BIGINT) AS above, t.k < d.k // CAST(pow(3, t.l) AS BIGINT) AS is_left, t.k, t.h FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source AND t.n > 1 AND t.k // 3 = d.k // CAST(pow(3, t.l + 1) AS BIGINT) AND t.k <> d.k // CAST(pow(3, t.l) AS BIGINT)
  UNION ALL SELECT r, u.l, 1, u.k < s.k // CAST(pow(3, u.l) AS BIGINT), u.k, u.h FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN u ON u.n > 1 AND u.k // 3 = s.k // CAST(pow(3, u.l + 1) AS BIGINT) AND u.k <> s.k // CAST(pow(3, u.l) AS BIGINT)),
v AS (SELECT r, d.source, l, CAST(0 AS BIGINT) AS above FROM d JOIN (SELECT DISTINCT source, l FROM t WHERE n > 1) x ON d.source IS NOT DISTINCT FROM x.source UNION ALL SELECT r, d.source, l, 1 FROM d CROSS JOIN (SELECT DISTINCT l FROM u WHERE n > 1)),
g AS (SELECT v.r, row_number() OVER (PARTITION BY v.r ORDER BY v.above, v.l) AS i, coalesce(a, '') AS a, coalesce(b, '') AS b FROM v
  LEFT JOIN (SELECT r, l, above, string_agg(h, '' ORDER BY k) FILTER (is_left) AS a, string_agg(h, '' ORDER BY k) FILTER (NOT is_left) AS b FROM o GROUP BY ALL) q ON v.r = q.r AND v.l = q.l AND v.above = q.above),
f AS (SELECT r, CAST(0 AS BIGINT) AS i, CASE WHEN {_CRC32} % 2 = 0 THEN lost ELSE leaf END AS h FROM d UNION ALL SELECT f.r, g.i, sha256(a || f.h || b) FROM f JOIN g ON g.r = f.r AND g.i = f.i + 1),
e AS (SELECT r, arg_max(h, i) AS folded_root FROM f GROUP BY r), p AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY i)) AS proof FROM g GROUP BY r), z AS (SELECT h AS root FROM u WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN e USING (r) LEFT JOIN p USING (r) CROSS JOIN z
"""

ORACLES = {"op1_quality_rules": QUALITY, "op3_benchmark_leaks": LEAKS, "op6_source_mix": MIX, "op8_license_scan": LICENSES, "op9_line_templates": LINES, "op11_fill_in_middle": FILL_IN_MIDDLE, "op12_merkle_manifest": MANIFEST}
