"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from citelab.llm import align, chat_format, decontaminate, html_extract, jaccard, langid, line_dedup, mixing, phrases, pii, quality, suffix_dedup, tiff

QUERIES = {
    "op1_html": html_extract.op1_html,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_quality": quality.op11_quality,
    "op12_align": align.op12_align,
    "op13_phrases": phrases.op13_phrases,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_mixing": mixing.op4_mixing,
    "op5_preference": chat_format.op5_preference,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_langid": langid.op7_langid,
    "op8_pii": pii.op8_pii,
    "op9_tiff": tiff.op9_tiff,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, CAST([] AS VARCHAR[])) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, i, dw.k AS k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
""",
    "op5_preference": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, role = 'assistant' AS a,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(i) AS last, min(i) AS first, arg_max(text, i) AS reply FROM t WHERE a GROUP BY conv_id),
n AS (SELECT conv_id, last, first, lead(conv_id) OVER (ORDER BY conv_id) AS following, min(conv_id) OVER () AS lowest FROM l),
p AS (SELECT n.*, w.conv_id IS NOT NULL AS paired, coalesce(w.conv_id, following, lowest) AS partner FROM n LEFT JOIN l AS w ON w.conv_id = xor(n.conv_id, 1)),
q AS (SELECT p.conv_id, p.last, CASE WHEN paired THEN p.last ELSE p.first END - 1 AS shared, CASE WHEN partner = p.conv_id THEN '' ELSE o.reply END AS reply FROM p JOIN l AS o ON o.conv_id = partner),
c AS (SELECT t.*, shared, reply, max(CASE WHEN i = shared + 1 AND text = reply THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id) AS same FROM t JOIN q ON q.conv_id = t.conv_id WHERE i <= last),
d AS (SELECT *, shared + same AS n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS r,
  CAST(sum(CASE WHEN i > shared + same THEN length(role) + length(text) + 13 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS e FROM c)
SELECT conv_id, CAST(min(n) AS BIGINT) AS n_prefix, coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt, coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE i > n), '') AS chosen_text,
  CASE WHEN min(same) = 1 THEN '' ELSE '<|assistant|>' || chr(10) || min(reply) || '<|end|>' || chr(10) END AS rejected_text,
  coalesce(string_agg((e - length(text) - 8) || '-' || e, ',' ORDER BY i) FILTER (WHERE i > n AND role = 'assistant'), '') AS chosen_spans,
  CASE WHEN min(same) = 1 THEN '' ELSE '14-' || (14 + length(min(reply)) + 8) END AS rejected_spans
FROM d GROUP BY conv_id
""",
    "op10_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 80 * (a.n + b.n - m)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
""",
    "op13_phrases": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("text")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS a
      FROM (SELECT lang, k, w, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
x AS (SELECT c.lang, c.k, c.g, c.a, j, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a::HUGEINT * r.a) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
      JOIN f l ON l.lang = c.lang AND l.k = j AND l.g = array_to_string(w[:j], ' ') JOIN f r ON r.lang = c.lang AND r.k = c.k - j AND r.g = array_to_string(w[j + 1:], ' ')),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g, k ORDER BY score, j) = 1),
m AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS g FROM c WHERE k = 3) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.g) AS rank, s.g AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM s JOIN n ON n.lang = s.lang LEFT JOIN m ON m.lang = s.lang AND m.g = s.g AND s.k = 2
WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000
""",
}
