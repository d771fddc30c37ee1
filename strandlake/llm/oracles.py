"""DuckDB SQL for the rows of those queries that SQL can express.

Token files, token counts, the classifier, near-duplicates and license scans need a tokenizer, training, sampling or matching
with errors; they are tested against brute force instead. The SQL of the url filters holds for tables whose pages have no canonical links and no
refreshes, as SQL's part ends at the rules; classes of linked pages are tested by hand-made cases.
"""

from __future__ import annotations

from .mixing import BITS, LEVELS
from .quality_rules import CHAR_LIMIT, COMMON_WORDS, MIN_CHARS, MIN_COMMON, MIN_WORDS, WORD_LIMIT
from .url_filter import LOWER, UPPER

_WORD = "[^\\x20\\x09-\\x0D]+"

_CHAT = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role
   OR row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = 1 AS starts,
  length(text) - length(replace(text, '\\', '')) + length(text) + len(regexp_extract_all(text, '[<\\[](\\||/?s>|/?INST\\]|</?SYS>>)')) AS t_chars,
  length(role) - length(replace(role, '\\', '')) + length(role) + len(regexp_extract_all(role, '[<\\[](\\||/?s>|/?INST\\]|</?SYS>>)')) AS r_chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(t_chars + CASE WHEN starts THEN 24 + r_chars ELSE 8 END) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE starts) AS n_messages
FROM m GROUP BY conv_id
"""

_MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS * LEVELS // 4}) AS BIGINT) AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight FROM p),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS level FROM r),
x AS (SELECT *, coalesce(sum(cap) OVER b, 0.0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0) AS weight_left,
  sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM c WINDOW b AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, (budget - cap_before) / weight_left AS common FROM x),
z AS (SELECT *, (SELECT common FROM y WHERE common <= level ORDER BY level, source NULLS LAST LIMIT 1) AS shared FROM y),
g AS (SELECT source, source_size, CASE WHEN shared IS NOT NULL AND weight * shared < cap THEN weight * shared ELSE cap END AS target FROM z),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM g),
o AS (SELECT d.*, k.source_size, k.target, k.repeats, k.target - k.repeats * k.source_size AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS inside FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (repeats + CASE WHEN upto <= rest OR (upto - inside <= rest AND 2 * (rest - (upto - inside)) > inside) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, {_SPACE}), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""

_ITEM_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_BENCHMARK = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_ITEM_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_ITEM_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_URLS = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(rh, rp, rule, verdict) AS (VALUES ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'allow'),
  ('example.net', '/de/8', 'example.net/de/8', 'block'), ('org', '/es/', 'org/es/', 'block')),
m AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""

_CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "space": "[\\x20\\x09-\\x0D]", "symbol": "[#*$%&|<>]", "stop": "[.,;:!?''\"()\\-]", "wide": "[^\\x00-\\x7F]"}
_COMMON = ", ".join(f"'{w}'" for w in COMMON_WORDS)


def _distance(p: str, q: str, ok: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    half = "list_sum(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {p}[i] > 0 THEN {p}[i] / list_sum({p}) * log2(2 * ({p}[i] / list_sum({p})) / ({p}[i] / list_sum({p}) + {q}[i] / list_sum({q}))) ELSE 0 END))"
    return f"CASE WHEN {ok} AND list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, ({half.format(p=p, q=q)} + {half.format(p=q, q=p)}) / 2)) END"


def _quality() -> str:
    count = lambda pattern: f"CAST(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')) AS DOUBLE)"
    listed = ", ".join(count(p) for p in _CLASSES.values())
    sums = lambda name, n: "[" + ", ".join(f"sum({name}[{i}])" for i in range(1, n + 1)) + "]"
    rest = " - ".join(f"cl[{i}]" for i in range(1, len(_CLASSES) + 1))
    return f"""
WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
f AS (SELECT doc_id, lang, t, w, len(w) AS n_words, [{listed}] AS cl, {count("[a-z]")} AS low,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS full_lines,
  list_transform(w, lambda x: lower(x)) AS lw FROM a),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM f WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1) GROUP BY doc_id),
b AS (SELECT f.doc_id, lang, CAST(n_words AS BIGINT) AS n_words, CAST(length(t) - cl[3] AS BIGINT) AS word_chars, CAST(cl[4] AS BIGINT) AS n_symbols,
  CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  list_concat([low], cl, [length(t) - low - ({rest.replace(" - ", " + ")})]) AS chars,
  list_transform([{_COMMON}], lambda x: CAST(len(list_filter(lw, lambda y: y = x)) AS DOUBLE)) AS cw FROM f LEFT JOIN rep USING (doc_id)),
e AS (SELECT *, list_append(cw, n_words - list_sum(cw)) AS common, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
refs AS (SELECT lang, {sums("chars", len(_CLASSES) + 2)} AS rc, {sums("common", len(COMMON_WORDS) + 1)} AS rw FROM e WHERE NOT base_failed AND word_chars >= {MIN_CHARS} AND n_words >= {MIN_COMMON} GROUP BY lang),
j AS (SELECT e.*, {_distance("chars", "rc", f"word_chars >= {MIN_CHARS}")} AS cd, {_distance("common", "rw", f"n_words >= {MIN_COMMON}")} AS wd FROM e LEFT JOIN refs ON refs.lang IS NOT DISTINCT FROM e.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cd, 0) <= {CHAR_LIMIT} AND coalesce(wd, 0) <= {WORD_LIMIT} AS kept FROM j
"""

_TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
full_counts AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, c, CAST(1 + (1000000000 * CAST(c + 5 AS HUGEINT)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS BIGINT) AS p FROM full_counts JOIN sizes USING (lang)),
whole AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term),
q AS (SELECT lang, term, CAST(1 + (1000000000 * CAST(c + 5 AS HUGEINT)) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS BIGINT) AS q FROM whole JOIN sizes USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


ORACLES: dict[str, str] = {
    "op1_chat_formatting": _CHAT,
    "op2_quality_rules": _quality(),
    "op3_source_mixing": _MIX,
    "op5_line_dedup": _LINES,
    "op6_decontamination": _BENCHMARK,
    "op8_url_filters": _URLS,
    "op11_source_divergence": _DIVERGENCE,
    "op12_hard_negatives": _NEGATIVES,
}
