"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .url_filters import KEYWORD_RULES, PATTERN_RULES

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_KEYWORDS = "|".join(r.name[1:] for r in KEYWORD_RULES)
_PATTERNS = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in PATTERN_RULES)
OP3 = rf"""WITH a AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
 r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7' WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
  WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/' WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM p)
 SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN regexp_matches(host || path, '(?i)(^|[^a-zA-Z0-9])({_KEYWORDS})($|[^a-zA-Z0-9])') OR {_PATTERNS} THEN 'block' ELSE 'allow' END AS verdict FROM r"""

OP5 = f"""WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('1:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS s, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY 1),
 o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * s / w, source NULLS LAST) AS k, (SELECT sum(s) FROM s)::BIGINT AS total FROM s),
 c AS (SELECT *, total - 3 * (sum(s) OVER (ORDER BY k) - s) AS rest, sum(w) OVER () - (sum(w) OVER (ORDER BY k) - w) AS weight FROM o),
 f AS (SELECT min(k) AS k FROM c WHERE rest * w::DOUBLE / weight <= 3 * s),
 g AS (SELECT c.source, c.s, CASE WHEN c.k < f.k THEN (3 * c.s)::DOUBLE ELSE x.rest * c.w::DOUBLE / x.weight END AS target FROM c, f JOIN c AS x ON x.k = f.k),
 t AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM g),
 j AS (SELECT d.doc_id, d.size, t.s, t.target, t.words, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
 SELECT doc_id, size, s AS source_size, target, CASE WHEN s = 0 THEN 0 ELSE words // s * size + greatest(0, least(size, words % s - (upto - size))) END::BIGINT AS taken FROM j"""

OP6 = """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS w FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 5"""

OP8 = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
 o AS (SELECT * FROM l WHERE length(line) >= 20), u AS (SELECT line, length(line) AS n, min({'d': doc_id, 'l': line_no}) AS first FROM o GROUP BY 1),
 h AS (SELECT line, n, first, base, base // 2 AS p FROM (SELECT *, unnest([n, n - 1]) AS base FROM u)),
 c AS (SELECT DISTINCT a.line AS x, a.first AS xf, b.line AS y, b.first AS yf FROM h a JOIN h b ON a.base = b.base AND a.line <> b.line AND b.first < a.first AND (left(a.line, a.p) = left(b.line, b.p) OR right(a.line, a.base - a.p) = right(b.line, b.base - b.p))),
 m AS (SELECT x AS line, min(yf) AS partner FROM c WHERE levenshtein(x, y) <= 1 GROUP BY 1)
 SELECT o.doc_id, o.line_no::BIGINT AS line_no, CASE WHEN m.partner IS NOT NULL THEN 'near' ELSE 'exact' END AS kind, coalesce(m.partner, u.first).d AS kept_doc_id, coalesce(m.partner, u.first).l::BIGINT AS kept_line_no
 FROM o JOIN u USING (line) LEFT JOIN m USING (line) WHERE m.partner IS NOT NULL OR u.first <> {'d': o.doc_id, 'l': o.line_no}"""

#: Exact repeats go for lines of any length that hold a word; shorter lines take no part in the near step.
OP8 = OP8.replace("FROM l WHERE length(line) >= 20)", r"FROM l WHERE length(line) >= 20 OR regexp_matches(line, '[^\x20\x09-\x0D]'))").replace("FROM u))", "FROM u WHERE n >= 20))")

OP10 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
 n AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest([array_to_string(ws[j:j + 7], chr(10)) FOR j IN range(1, len(ws) - 6)]) AS x FROM d WHERE len(ws) >= 8),
 c AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS times FROM n) WHERE times > 1), r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, range(0, 8) g(k) GROUP BY 1),
 m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(ls) AS n_lines, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaim FROM d LEFT JOIN r USING (doc_id)),
 b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::BIGINT + 8 * (4 * n_symbols > n_words)::BIGINT + 16 * (10 * n_upper > 6 * word_chars)::BIGINT + 32 * (2 * n_exclaim > n_words)::BIGINT
  + 64 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT AS fail_bits FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b"""

#: crc32 of a feature's bytes, by the table of its 256 remainders.
OP11 = r"""WITH k AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) g(i)),
 d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
 b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
 f AS (SELECT r, unnest(ws) AS w FROM d), u AS (SELECT DISTINCT w FROM (SELECT w FROM f UNION ALL SELECT w FROM b)),
 h AS (SELECT w, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ((position(x[1] IN '0123456789ABCDEF') - 1) * 16 + position(x[2] IN '0123456789ABCDEF') - 1)::UBIGINT) AS bytes FROM u),
 c AS (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, x: xor(a >> 8, k.t[(xor(a, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket FROM h, k),
 s AS (SELECT bucket, count(*)::BIGINT AS n FROM f JOIN c USING (w) GROUP BY 1), t AS (SELECT bucket, count(*)::BIGINT AS n FROM b JOIN c USING (w) GROUP BY 1),
 g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000) / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
 p AS (SELECT r, sum(gain)::BIGINT AS weight FROM f JOIN c USING (w) JOIN g USING (bucket) GROUP BY 1),
 q AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN p USING (r)),
 o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place, count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS most FROM q)
 SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END::BIGINT AS rank FROM o"""

ORACLES = {"op3_url_filters": OP3, "op5_mixing": OP5, "op6_exact_topk": OP6, "op8_line_dedup": OP8, "op10_quality_rules": OP10, "op11_importance_resampling": OP11}
