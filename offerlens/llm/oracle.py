"""DuckDB statements that the queries of this folder must equal."""

from offerlens.llm.decontaminate import UNITS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Repeats are windows of words found twice or more in a text; a word is covered if one holds it.
# A repeat longer than 100 words is a repeated window of 101.
OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
sizes AS (SELECT * FROM (VALUES (3), (8), (101)) AS s(size)),
windows AS (
  SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS run
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
),
again AS (SELECT *, count(*) OVER (PARTITION BY doc_id, size, run) AS n FROM windows),
hit AS (
  SELECT doc_id, size, count(DISTINCT p) AS n
  FROM (SELECT doc_id, size, unnest(range(i, i + size)) AS p FROM again WHERE n > 1) GROUP BY ALL
),
dup AS (
  SELECT doc_id, sum(n - 1) AS n FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
  ) GROUP BY doc_id
),
stats AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(h3.n, 0)::BIGINT AS n_repeat_words,
    coalesce(h8.n, 0)::BIGINT AS covered_words,
    coalesce(h101.n, 0) > 0 AS too_long
  FROM d LEFT JOIN dup USING (doc_id)
  LEFT JOIN hit AS h3 ON h3.doc_id = d.doc_id AND h3.size = 3
  LEFT JOIN hit AS h8 ON h8.doc_id = d.doc_id AND h8.size = 8
  LEFT JOIN hit AS h101 ON h101.doc_id = d.doc_id AND h101.size = 101
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
  NOT base_failed AND 100 * covered_words <= 30 * n_words AND NOT too_long AS kept
FROM judged
"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
digests AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
    min(page_id) OVER (PARTITION BY html) AS first_id
  FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM digests
"""

OP7 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles,
  least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id,
  least(w.doc_id, coalesce(least.b, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

# Each text has two forms: names are placeholders in one, and case-folded words in the other.
_TYPED = r"""
  SELECT {key}, folded, w, list_transform(w, lambda x, i: CASE
      WHEN regexp_matches(x, '^[0-9]') THEN '0'
      WHEN i > 1 AND regexp_matches(w[i - 1], '^[0-9]') AND list_contains(string_split('{units}', ' '), lower(x)) THEN '1'
      WHEN folded THEN replace(lower(x), 'ß', 'ss')
      WHEN x <> lower(x) THEN '2' ELSE lower(x) END) AS t
  FROM (SELECT DISTINCT {key}, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,:/-][0-9]+)*|\p{{L}}[\p{{L}}\p{{M}}]*') AS w FROM {table}),
    (VALUES (false), (true)) AS forms(folded)
"""


def _windows(key: str, table: str) -> str:
    typed = _TYPED.format(key=key, table=table, units=" ".join(UNITS))
    return f"""
  SELECT {key}, folded, i, list_slice(t, i, i + 4) AS kinds, list_transform(list_slice(w, i, i + 4), lambda x: lower(x)) AS vals
  FROM (SELECT {key}, folded, w, t, unnest(range(1, len(t) - 3)) AS i FROM ({typed}) WHERE len(t) >= 5)
"""


OP9 = f"""
WITH items AS (
  SELECT * FROM ({_windows("item_id", "benchmark")})
  WHERE len(list_filter(kinds, lambda x: x NOT IN ('0', '1', '2'))) >= 3
),
sizes AS (SELECT item_id, folded, count(DISTINCT kinds) AS size FROM items GROUP BY item_id, folded),
aligned AS (
  SELECT d.doc_id, b.item_id, b.folded, d.i - b.i AS run, b.kinds, b.vals, d.vals AS own
  FROM ({_windows("doc_id", "documents")}) d JOIN items b ON d.kinds = b.kinds AND d.folded = b.folded
),
slots AS (
  SELECT DISTINCT doc_id, item_id, folded, run, kinds[k] AS kind, vals[k] AS val, own[k] AS own
  FROM aligned, (SELECT unnest(range(1, 6)) AS k) WHERE kinds[k] IN ('0', '1', '2')
),
broken AS (SELECT DISTINCT doc_id, item_id, folded, run FROM slots GROUP BY doc_id, item_id, folded, run, kind, val HAVING count(*) > 1),
leaks AS (
  SELECT doc_id, item_id, folded FROM aligned ANTI JOIN broken USING (doc_id, item_id, folded, run) JOIN sizes USING (item_id, folded)
  GROUP BY doc_id, item_id, folded, size HAVING 100 * count(DISTINCT kinds) >= 80 * size
),
by_doc AS (SELECT doc_id, count(DISTINCT item_id) AS n, min(item_id) AS first_item FROM leaks GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_items, first_item, n IS NULL AS kept
FROM documents LEFT JOIN by_doc USING (doc_id)
"""

OP10 = """
WITH one AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
whole AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
    string_agg('<|im_start|>' || coalesce(role, 'none') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
      ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
  FROM one GROUP BY conv_id
),
starts AS (SELECT conv_id, n, list_slice(turns, 1, n) AS start, n = len(turns) AS is_all FROM (SELECT conv_id, turns, unnest(range(1, len(turns) + 1)) AS n FROM whole)),
classes AS (SELECT start, min(conv_id) AS conv_id, count(*) AS copies FROM starts WHERE is_all GROUP BY start),
kept AS (SELECT * FROM classes ANTI JOIN (SELECT DISTINCT start FROM starts WHERE NOT is_all) USING (start)),
logged AS (
  SELECT starts.conv_id, sum(classes.copies)::BIGINT AS n FROM starts SEMI JOIN kept USING (conv_id)
  JOIN classes USING (start) GROUP BY starts.conv_id
)
SELECT whole.conv_id, len(whole.turns)::INTEGER AS n_turns, logged.n AS n_logged, whole.text
FROM whole JOIN logged USING (conv_id)
"""

# Phrases are runs of words within a piece; all parts of a candidate are at least as frequent as it is.
OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, size, list_slice(w, i, i + size - 1) AS run
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, range(1, 6) AS s(size) WHERE len(w) >= size)
),
f AS (SELECT lang, size, run, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT * FROM f WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.run, c.f AS a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts AS c JOIN totals USING (lang)
  JOIN f AS l ON l.lang = c.lang AND l.run = list_slice(c.run, 1, k)
  JOIN f AS r ON r.lang = c.lang AND r.run = list_slice(c.run, k + 1, c.size)
),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, run ORDER BY score, k) AS place FROM scored),
inner_runs AS (
  SELECT lang, list_slice(run, i, i + part - 1) AS run, f
  FROM (SELECT lang, run, f, part, unnest(range(1, size - part + 2)) AS i FROM candidates, range(2, 5) AS s(part) WHERE part < size)
),
around AS (SELECT lang, run, max(f) AS around FROM inner_runs GROUP BY ALL),
kept AS (
  SELECT w.lang, array_to_string(w.run, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
  FROM weakest AS w LEFT JOIN around USING (lang, run) WHERE place = 1 AND coalesce(around < a, true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

STATEMENTS: dict[str, str] = {"op1_repetition": OP1, "op2_revisits": OP2, "op7_near_duplicates": OP7, "op9_templates": OP9, "op10_chats": OP10, "op12_collocations": OP12}
