"""DuckDB SQL of the queries that SQL can express."""

from tidewatch.llm import licences as _licences

SPACED = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{LETTERS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{LETTERS}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS passage
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS passage
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT rid, g.n, i, item_id FROM g JOIN p USING (passage) WHERE g.n = p.n),
hit AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM h) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
m AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols FROM d),
l AS (SELECT rid, line, length(line) AS chars, row_number() OVER (PARTITION BY rid, line ORDER BY no) AS nth
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d)
  WHERE regexp_matches(line, '{SPACED}')),
ls AS (SELECT rid, CAST(count(*) FILTER (WHERE nth > 1) AS BIGINT) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE nth > 1), 0) / sum(chars) AS share FROM l GROUP BY rid),
g AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([3, 5, 7, 10]) AS n) WHERE len(w) >= n)),
twice AS (SELECT rid, n, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, n, gram) AS times FROM g) WHERE times > 1),
c AS (SELECT rid, n, count(*) AS words, sum(length(w[place])) AS chars
  FROM (SELECT DISTINCT rid, n, unnest(range(i, i + n)) AS place FROM twice) JOIN d USING (rid) GROUP BY rid, n),
s AS (SELECT m.*, coalesce(ls.n_dup_lines, 0) AS n_dup_lines, coalesce(share, 0) AS line_share,
  CAST(coalesce((SELECT words FROM c WHERE c.rid = m.rid AND n = 3), 0) AS BIGINT) AS n_repeat_words,
  coalesce((SELECT bool_and(chars / word_chars <= CASE n WHEN 5 THEN 0.15e0 WHEN 7 THEN 0.13e0 ELSE 0.10e0 END) FROM c WHERE c.rid = m.rid AND n > 3), true) AS grams_pass
  FROM m LEFT JOIN ls USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND grams_pass AND line_share <= 0.3e0 AS kept FROM f"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS overlap FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * overlap >= 80 * (na.size + nb.size - overlap)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, b FROM reach r JOIN links ON other = a),
root AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN root USING (doc_id) LEFT JOIN n USING (doc_id)"""

MIX = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')))[1:13] AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS draw
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source),
-- Sources by how soon they are full; with the first k full, the others share the rest.
o AS (SELECT *, 2 * source_size / CAST(weight AS DOUBLE) AS fullness, row_number() OVER (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), source) AS k FROM s),
c AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight, sum(source_size) OVER () AS total FROM o),
l AS (SELECT arg_min(struct_pack(free := 1.5e0 * total - 2 * full_size, open_weight := open_weight), k) AS v FROM c WHERE (1.5e0 * total - 2 * full_size) / open_weight <= fullness),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * CAST(v.free AS DOUBLE) / CAST(v.open_weight AS DOUBLE)) AS target FROM s, l),
r AS (SELECT doc_id, size, source_size, target, draw, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r"""


# A stripe's entries as plain counts of one, two and three words.
COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
u AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, count(*) AS a FROM u GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
parts AS (SELECT lang || chr(10) || phrase AS part, a FROM f WHERE k < 3),
cuts AS (SELECT lang, k, phrase, a, 1 AS cut, lang || chr(10) || w1 AS x, lang || chr(10) || CASE k WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS y FROM c
  UNION ALL SELECT lang, k, phrase, a, 2, lang || chr(10) || w1 || ' ' || w2, lang || chr(10) || w3 FROM c WHERE k = 3),
s AS (SELECT cuts.*, l.a AS l, r.a AS r, 1000000 * CAST(cuts.a AS HUGEINT) * cuts.a // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM cuts JOIN parts l ON l.part = x JOIN parts r ON r.part = y),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, phrase, max(a) AS longest FROM (
  SELECT lang, w1 || ' ' || w2 AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT m.* FROM m LEFT JOIN longer USING (lang, phrase) WHERE k = 3 OR longest IS NULL OR 100 * longest < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def licences() -> str:
    """The index as tables, positions by joins, windows of places by a self-join."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({t}, {quoted(label)}, {quoted(text)}, [{', '.join(map(quoted, phrases))}])" for t, (label, text, phrases) in enumerate(_licences.TEMPLATES))
    base = ", ".join(f"({quoted(p)}, {quoted(label)})" for p, label in _licences.BASE_PHRASES.items())
    slack, percent, rare = _licences.SLACK, _licences.PERCENT, _licences.RARE
    return rf"""
WITH tw AS (SELECT t, label, regexp_extract_all({LOWER.format("text")}, '{LETTERS}') AS w, phrases FROM (VALUES {rows}) v(t, label, text, phrases)),
post AS (SELECT t, w[j + 1] AS word, j FROM (SELECT t, w, unnest(range(len(w))) AS j FROM tw)),
df AS (SELECT word, count(DISTINCT t) AS df FROM post GROUP BY word),
idx AS (SELECT t, word, j, CAST(floor(1000 * ln((SELECT count(*) FROM tw) / CAST(df AS DOUBLE))) AS BIGINT) AS weight
  FROM post JOIN df USING (word) WHERE {rare} * df <= (SELECT count(*) FROM tw)),
total AS (SELECT t, CAST(sum(weight) AS BIGINT) AS total FROM idx GROUP BY t),
keys AS (SELECT t, pno, string_split(phrase, ' ') AS pw, phrase, position(' ' || phrase || ' ' IN ' ' || array_to_string(w, ' ') || ' ') AS chars, w
  FROM (SELECT t, w, unnest(phrases) AS phrase, generate_subscripts(phrases, 1) AS pno FROM tw)),
placed AS (SELECT t, pno, pw, phrase, len(string_split(substr(' ' || array_to_string(w, ' '), 1, chars), ' ')) - 2 AS k FROM keys),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{LETTERS}') AS w FROM documents),
u AS (SELECT rid, i, w[i + 1] AS word FROM (SELECT rid, w, unnest(range(len(w))) AS i FROM d)),
bases AS (SELECT string_split(phrase, ' ') AS pw, label FROM (VALUES {base}) b(phrase, label)),
bp AS (SELECT rid, label, i FROM u JOIN bases ON word = pw[1] JOIN d USING (rid) WHERE w[i + 1:i + len(pw)] = pw),
bs AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM bp GROUP BY rid),
hits AS (SELECT rid, t, j, weight, i - j AS o FROM u JOIN idx USING (word)),
phr AS (SELECT rid, t, pno, i - k AS o FROM u JOIN placed ON word = pw[1] JOIN d USING (rid) WHERE w[i + 1:i + len(pw)] = pw),
tries AS (SELECT rid, t, o FROM hits UNION SELECT rid, t, o FROM phr),
sup AS (SELECT rid, t, o, CAST(sum(weight) AS BIGINT) AS covered FROM (
  SELECT DISTINCT x.rid, x.t, x.o, h.j, h.weight FROM tries x JOIN hits h ON h.rid = x.rid AND h.t = x.t AND h.o BETWEEN x.o AND x.o + {slack}) GROUP BY ALL),
ok AS (SELECT x.rid, x.t, x.o, count(DISTINCT pno) AS n FROM tries x JOIN phr h ON h.rid = x.rid AND h.t = x.t AND h.o BETWEEN x.o AND x.o + {slack} GROUP BY ALL),
found AS (SELECT rid, label, covered / CAST(total AS DOUBLE) AS share FROM sup JOIN ok USING (rid, t, o) JOIN total USING (t) JOIN tw USING (t)
  WHERE n = len(phrases) AND 100 * covered >= {percent} * total),
fs AS (SELECT rid, max(share) AS share, list(DISTINCT label) AS labels FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(bs.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(fs.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1e0 ELSE coalesce(share, 0e0) END AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN fs USING (rid)"""


# Every distance at which words agree, as islands; the checksum bit by bit.
PERIODIC = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w,
  xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda h, c: list_reduce(list_concat([xor(h, c)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384)))) AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
p AS (SELECT *, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN g % n END AS a FROM e),
t AS (SELECT rid, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM p),
u AS (SELECT rid, n, i, w[i + 1] AS word FROM (SELECT rid, n, w, unnest(range(n)) AS i FROM t)),
eq AS (SELECT x.rid, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
c AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM eq) GROUP BY rid, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.rid = c.rid AND o.q < c.q AND o.s <= c.s AND o.s + o.len >= c.s + c.len)),
top AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) = 1),
told AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM r),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS collapsed FROM u ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.len AS length, top.q AS period, 1000 * top.len // top.q AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (rid) LEFT JOIN top USING (rid) LEFT JOIN kept USING (rid)"""
