"""SQL of the corpus queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUALITY = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text, {_WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT row, i, words[i:i + 2] AS gram FROM d, unnest(range(1, len(words) - 1)) AS t(i)),
g AS (SELECT row, gram FROM w GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT row, count(DISTINCT i + j) AS n FROM w JOIN g USING (row, gram), unnest([0, 1, 2]) AS t(j) GROUP BY row),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered, len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
  FROM d LEFT JOIN r USING (row)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines AND 10 * n_lettered >= 7 * n_words AND 10 * n_ellipsis <= 3 * n_lines AS kept FROM f"""

SENTENCES = r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST, coalesce(text, '')) AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D.!?,;:]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D.!?,;:]+){0,11}[.!?,;:]*') AS s FROM documents),
n AS (SELECT *, list_transform(s, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS w FROM d),
e AS (SELECT row, i, min(j) AS j FROM n, unnest(range(1, len(s) + 1)) AS t(i), unnest(range(i + 1, least(i + 20, len(s) + 1))) AS u(j) WHERE list_sum(w[i:j]) >= 20 GROUP BY row, i),
a AS (SELECT row, i, j FROM e UNION ALL SELECT row, 1, len(s) FROM n WHERE len(s) > 0 AND row NOT IN (SELECT row FROM e)),
g AS (SELECT row, i, j, row_number() OVER (PARTITION BY s[i:j] ORDER BY row, i) AS k FROM a JOIN n USING (row)),
gone AS (SELECT DISTINCT row, x AS i FROM g, unnest(range(i, j + 1)) AS t(x) WHERE k > 1),
r AS (SELECT row, list(i) AS gone FROM gone GROUP BY row)
SELECT doc_id, len(s) AS n_sentences, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(array_to_string(list_filter(s, lambda x, i: NOT list_contains(coalesce(gone, []), i)), chr(10)), '')) AS kept_sha256 FROM d LEFT JOIN r USING (row)"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT row, doc_id, p, substr(h, 2 * p + 1, 100) AS gram FROM d, unnest(range(0, length(h) // 2 - 49)) AS t(p)),
s AS (SELECT gram, min(doc_id) AS first_id FROM g GROUP BY gram HAVING count(*) > 1),
hit AS (SELECT row, p FROM g JOIN s USING (gram) WHERE g.doc_id > s.first_id),
island AS (SELECT row, p, sum(new) OVER (PARTITION BY row ORDER BY p) AS k FROM (SELECT row, p, CASE WHEN p - lag(p) OVER (PARTITION BY row ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT row, min(p) AS a, max(p) + 50 AS b FROM island GROUP BY row, k),
edge AS (SELECT row, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS x, a AS y FROM span UNION ALL SELECT d.row, coalesce(max(b), 0), length(any_value(h)) // 2 FROM d LEFT JOIN span USING (row) GROUP BY d.row),
kept AS (SELECT row, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM edge JOIN d USING (row) GROUP BY row),
sums AS (SELECT row, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY row)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (row) LEFT JOIN sums USING (row)"""

DECONTAMINATE = rf"""
WITH i AS (SELECT item_id, {_ALNUM} AS words FROM benchmark), d AS (SELECT doc_id, row_number() OVER () AS row, {_ALNUM} AS words FROM documents),
windows AS (SELECT DISTINCT item_id, words[k:k + least(10, len(words)) - 1] AS gram FROM i, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS t(k) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT len(gram) AS size FROM windows),
found AS (SELECT row, k, size, words[k:k + size - 1] AS gram FROM d, sizes, unnest(range(1, len(words) - size + 2)) AS t(k)),
hits AS (SELECT row, k, size, item_id FROM found JOIN windows USING (gram)),
n AS (SELECT row, count(DISTINCT k + j) AS n_hit FROM hits, unnest(range(0, size)) AS t(j) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN items USING (row)"""

MIXING = rf"""
WITH s AS (SELECT doc_id, source, len({_WORDS}) AS size,
  -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
  / CASE WHEN length(text) > 0 THEN greatest(length(translate(text, '#*$%&|<>!', '')) / length(text), 0.05) ELSE 1.0 END AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s GROUP BY source),
level AS (SELECT *, 2.0::DOUBLE * source_size AS full_size, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM per WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, full_size / weight) AS water FROM level WHERE level < full_size / weight),
goal AS (SELECT source, source_size, coalesce(least(full_size, (SELECT water FROM water) * weight), full_size) AS target FROM level),
run AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS epochs,
  sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM s JOIN goal ON s.source IS NOT DISTINCT FROM goal.source),
mix AS (SELECT *, (epochs + CASE WHEN target - epochs * source_size > 0 AND ahead + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS copies FROM run)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM mix"""

PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS n FROM w, unnest(range(1, len(w) + 1)) AS t(i), unnest(range(1, least(5, len(w) - i + 1) + 1)) AS u(k) GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1),
cover AS (SELECT lang, array_to_string(s[i:i + m - 1], ' ') AS phrase, max(a) AS cover FROM c, unnest(range(2, k)) AS t(m), unnest(range(1, k - m + 2)) AS u(i) GROUP BY ALL),
cuts AS (SELECT lang, phrase, a, x AS cut, array_to_string(s[1:x], ' ') AS first, array_to_string(s[x + 1:], ' ') AS rest FROM c, unnest(range(1, k)) AS t(x)),
scored AS (SELECT cuts.lang, cuts.phrase, a, l.n AS l, r.n AS r, total.n AS n, (1000::HUGEINT * a * total.n) // (l.n::HUGEINT * r.n) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = first JOIN f r ON r.lang = cuts.lang AND r.phrase = rest JOIN total ON total.lang = cuts.lang
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, cut) = 1),
ranked AS (SELECT scored.*, row_number() OVER (PARTITION BY scored.lang ORDER BY score DESC, a DESC, scored.phrase) AS rank FROM scored LEFT JOIN cover ON cover.lang = scored.lang AND cover.phrase = scored.phrase WHERE cover IS NULL OR 100 * cover < 100 * a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"


#: CRC-32 of the decimal doc_id, bit by bit; the polynomial is a fixed value.
_CRC = """xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

MANIFEST = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, lang, {_leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} ELSE {_leaf('text')} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS place FROM d),
up AS (SELECT 0 AS k, lang, place AS idx, count(*) OVER (PARTITION BY lang) AS n, leaf AS node FROM placed UNION ALL
  SELECT k + 1, lang, idx // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY k, lang, idx // 8, n),
sub AS (SELECT lang, k AS top_k, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
high AS (SELECT 0 AS k, place AS idx, n, subroot AS node FROM sub UNION ALL
  SELECT k + 1, idx // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY k, idx // 8, n),
low_sides AS (SELECT a.k, a.lang, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS x, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS y
  FROM up a JOIN up b ON a.k = b.k AND a.lang IS NOT DISTINCT FROM b.lang AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.k, a.lang, a.idx),
high_sides AS (SELECT a.k, a.idx, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS x, coalesce(string_agg(b.node, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS y
  FROM high a JOIN high b ON a.k = b.k AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.k, a.idx),
climb AS (SELECT row, lang, 0 AS k, place AS idx, changed AS acc, '' AS proof FROM placed UNION ALL
  SELECT row, c.lang, c.k + 1, c.idx // 8, sha256(x || acc || y), proof || x || y FROM climb c JOIN low_sides s ON s.k = c.k AND s.lang IS NOT DISTINCT FROM c.lang AND s.idx = c.idx),
reached AS (SELECT row, subroot, place, acc, proof FROM climb JOIN sub ON climb.lang IS NOT DISTINCT FROM sub.lang AND k = top_k),
last AS (SELECT row, 0 AS k, place AS idx, acc, proof FROM reached UNION ALL SELECT row, l.k + 1, l.idx // 8, sha256(x || acc || y), proof || x || y FROM last l JOIN high_sides s ON s.k = l.k AND s.idx = l.idx),
root AS (SELECT k, node AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(last.proof) AS proof_sha256, last.acc AS folded_root, last.acc = root AS verified FROM last JOIN root USING (k) JOIN reached USING (row) JOIN placed USING (row)"""

SQL = {"op1_sentence_dedup": SENTENCES, "op4_quality_rules": QUALITY, "op5_substring_dedup": SUBSTRINGS, "op7_decontaminate": DECONTAMINATE, "op9_mixing": MIXING, "op11_phrases": PHRASES, "op12_manifest": MANIFEST}
