"""DuckDB SQL that states the same results plainly, for comparison."""

from __future__ import annotations

from corpusengine.llm import license_scan as lic
from corpusengine.llm import quality_rules as qual
from corpusengine.llm import url_filter as url

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY h) AS group_size,
  row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) = 1 AS kept,
  h AS text_sha256
FROM d
"""


TOOL_CALLS = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, 'c' || turn AS call_id, min_by({'turn': turn, 'text': text}, turn) AS r, 'c' || (min(turn) - 2) AS after
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
a AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, min_by(coalesce(text, ''), coalesce(text, '')) AS content, turn AS result_turn, count(*) AS n FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
l AS (SELECT conv_id, call_id, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.call_id = c.after)
  UNION ALL SELECT c.conv_id, c.call_id, level + 1 FROM l JOIN c ON c.conv_id = l.conv_id AND c.after = l.call_id),
q AS (SELECT conv_id, call_id, r.turn AS turn, level, after, CASE WHEN trim(r.text, ' ') <> '' THEN to_json(r.text)::VARCHAR END AS t, length(r.text) AS len, result_turn, coalesce(n, 0) AS n_results, content
  FROM c JOIN l USING (conv_id, call_id) LEFT JOIN a USING (conv_id, call_id))
SELECT conv_id, call_id, turn, level::BIGINT AS level, after, 'reply' AS name, t IS NOT NULL AS valid, CASE WHEN len IS NULL THEN 'missing length; missing text' WHEN t IS NULL THEN 'missing text' ELSE '' END AS errors, result_turn, n_results::BIGINT AS n_results,
  CASE WHEN t IS NULL THEN 'invalid' WHEN n_results = 0 THEN 'pending' ELSE 'linked' END AS status,
  '{"after":"' || after || '","arguments":{"length":' || coalesce(len::VARCHAR, 'null') || ',"text":' || coalesce(t, 'null') || ',"turn":' || turn || '},"id":"' || call_id || '","name":"reply","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM q
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_rules() -> str:
    fail = {
        "short": "n_words < 50",
        "repetitive": "100 * n_repeat_words > 50 * n_words",
        "symbols": "10 * n_symbols > n_words",
        "dup_lines": "10 * n_dup_lines > 3 * n_lines",
        "odd_words": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
    }
    per_host = ", ".join(f"count(*) FILTER ({fail[r]})::DOUBLE AS f_{r}" for r in qual.HOST_LIMITS)
    ctes, bad, prev = [], [], "h0"
    for k, (r, limit) in enumerate(qual.HOST_LIMITS.items()):
        ctes.append(f"""h{k}a AS (SELECT *, (sum(f_{r}) OVER () + 0.5) / (sum(n) OVER () + 1) AS m, sum(f_{r} * f_{r} / n) OVER () / sum(n) OVER () AS q, count(*) OVER () / sum(n) OVER () AS c FROM {prev}),
h{k}b AS (SELECT *, least(greatest(m * (1 - m) / greatest(greatest(q - m * m, 0) - m * (1 - m) * c, 1e-6) - 1, 2.0), 1e4) AS s FROM h{k}a),
h{k}c AS (SELECT *, (f_{r} + m * s) / (n + s) AS p FROM h{k}b),
h{k + 1} AS (SELECT * EXCLUDE (m, q, c, s, p), p - {qual.Z} * sqrt(p * (1 - p) / (n + s + 1)) > {limit} AS bad_{r} FROM h{k}c)""")
        bad.append(f"bad_{r}")
        prev = f"h{k + 1}"
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
h0 AS (SELECT source, count(*) AS n, {per_host} FROM s GROUP BY source),
{", ".join(ctes)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b AS base_failed, NOT b AND NOT ({" OR ".join(bad)}) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS b FROM s) x JOIN {prev} h ON x.source IS NOT DISTINCT FROM h.source
"""


def url_filter(z: float = 1.2816, limit: float = 0.5) -> str:
    rules = ", ".join(f"({quoted(r)}, {quoted(v)}, {quoted(r.partition('/')[0])}, {quoted('/' + r.partition('/')[2])})" for r, v in url.RULES)
    seconds = ", ".join(map(quoted, url.SECOND_LEVEL))
    suffixes = ", ".join(f"({quoted(b)}, {b.count('.') + (0 if r[0] == '!' else 2 if r[0] == '*' else 1)}, {int(r[0] == '!') * 100 + r.count('.')})" for r in url.SUFFIX_RULES for b in [r.lstrip("!*.")])
    strength = lambda rows, n, bad, mean: f"(SELECT coalesce(least(greatest(sum({n} * {mean} * (1 - {mean})) / sum({n}) / greatest((sum({n} * ({bad} / {n} - {mean}) ** 2) - sum({mean} * (1 - {mean}))) / sum({n}), 1e-6) - 1, 2.0), 1e4), 2.0) FROM {rows} WHERE {n} > 0)"
    return rf"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{url.UPPER}', '{url.LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
o AS (SELECT host, count(l.doc_id)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS b FROM p LEFT JOIN l ON page_id = doc_id GROUP BY host),
z AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:\d*)?$|\.+(:\d*)?$', '') AS y FROM o),
a AS (SELECT *, string_split(y, '.') AS x, regexp_matches(y, '^(\d+(\.\d+){{3}}|\[.*\]?)$') AS ip FROM z),
c AS (SELECT *, coalesce((SELECT max_by(k, weight) FROM (VALUES {suffixes}) AS r(bare, k, weight) WHERE y = bare OR ends_with(y, '.' || bare)), CASE WHEN length(x[-1]) = 2 AND x[-2] IN ({seconds}) THEN 2 ELSE 1 END) AS k FROM a),
h AS (SELECT host, n, b, CASE WHEN ip THEN y ELSE array_to_string(x[greatest(len(x) - k, 1):], '.') END AS domain,
  CASE WHEN ip THEN 'ip' ELSE array_to_string(x[greatest(len(x) - k + 1, 1):], '.') END AS suffix FROM c),
g AS (SELECT (sum(b) + 0.5) / (sum(n) + 1) AS m FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(b) AS b, (SELECT m FROM g) AS m FROM h GROUP BY suffix),
s1 AS (SELECT suffix, (b + k * m) / (n + k) AS m FROM s0, (SELECT {strength("s0", "n", "b", "m")} AS k)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b, any_value(s1.m) AS m FROM h JOIN s1 USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT domain, (b + k * m) / (n + k) AS m FROM d0, (SELECT {strength("d0", "n", "b", "m")} AS k)),
h0 AS (SELECT host, n, b, m FROM h JOIN d1 USING (domain)),
h1 AS (SELECT host, (b + k * m) / (n + k) AS r, n + k AS t FROM h0, (SELECT {strength("h0", "n", "b", "m")} AS k)),
v AS (SELECT host, CASE WHEN greatest(r - {z} * sqrt(r * (1 - r) / (t + 1)), 0) >= {limit} THEN 'block' ELSE 'allow' END AS verdict FROM h1),
u AS (SELECT * FROM (VALUES {rules}) AS t(rule, says, site, start)),
f AS (SELECT page_id, host, path, (SELECT max_by(rule, length(rule)) FROM u WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start)) AS rule FROM p)
SELECT page_id, host, path, f.rule AS rule, coalesce(says, v.verdict) AS verdict FROM f LEFT JOIN u ON f.rule = u.rule LEFT JOIN v USING (host)
"""


def license_scan(templates=lic.PHRASES + lic.NOTICES) -> str:
    stride = max(len(t.text.split()) for t in templates)
    rows = ", ".join(f"({quoted(t.label)}, {t.phrase}, {t.threshold}::DOUBLE, [{', '.join(map(quoted, t.text.lower().split()))}])" for t in templates)
    return rf"""
WITH t AS (SELECT label, phrase, th, seq, list_distinct(seq) AS tokens FROM (VALUES {rows}) AS v(label, phrase, th, seq)),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{lic.UPPER}', '{lic.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT doc_id, s, words[s + 1:s + {2 * stride}] AS block FROM (SELECT doc_id, words, unnest(range(0, len(words), {stride})) AS s FROM w)),
m AS (SELECT doc_id, s, block, label, phrase, seq, len(list_intersect(tokens, list_distinct(block))) / len(tokens) AS share, th FROM b, t),
c AS (SELECT *, CASE WHEN phrase THEN list_filter(range(1, least(len(block) - len(seq) + 1, {stride}) + 1), lambda p: block[p:p + len(seq) - 1] = seq) END AS places FROM m WHERE share >= th - 1e-9),
x AS (SELECT doc_id, label, phrase, share, len(places) AS n, list_min(places) + s - 1 AS low, list_max(places) + s - 1 AS high FROM c WHERE NOT phrase OR len(places) > 0),
a AS (SELECT doc_id, sum(n) FILTER (phrase) AS n, min(low) AS low, max(high) AS high, array_to_string(list_sort(list_distinct(list(label) FILTER (phrase))), ',') AS base, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels,
  max(CASE WHEN phrase THEN 1.0 ELSE share END) AS score FROM x GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low::BIGINT AS first_word, high::BIGINT AS last_word, coalesce(base, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN a USING (doc_id)
"""


FILL_MIDDLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id::VARCHAR) AS d FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, [('0x' || substr(d, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM units
), cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parts
"""
