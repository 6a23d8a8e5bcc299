"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SUFFIX_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
 w AS (SELECT r, i, md5(b[i + 1:i + 200]) AS k FROM (SELECT r, b, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
 f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
 g AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 OR lag(i) OVER (PARTITION BY r ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM f),
 s AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS no FROM g) GROUP BY r, no),
 t AS (SELECT r, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS l, list(z ORDER BY a) AS e FROM s GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(CASE WHEN l IS NULL THEN b ELSE list_reduce(list_transform(range(0, len(l) + 1), lambda j: b[(CASE WHEN j = 0 THEN 0 ELSE e[j] END) + 1:(CASE WHEN j = len(l) THEN n ELSE l[j + 1] END)]), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN t USING (r)"""

#: All pairs that share a shingle, exactly; classes by recursion over links.
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM d)),
 z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id != b.doc_id GROUP BY ALL),
 l AS (SELECT u, v FROM p JOIN z a ON a.doc_id = u JOIN z b ON b.doc_id = v WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
 r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v)
SELECT d.doc_id, (SELECT min(v) FROM r WHERE r.u = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.u = d.doc_id) AS n_links, coalesce(n, 0) AS n_shingles FROM d LEFT JOIN z USING (doc_id)"""

DECONTAMINATION = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_PLAIN_WORDS} AS w FROM benchmark), bw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
 d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN_WORDS} AS w FROM documents),
 dw AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS x FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
 h AS (SELECT r, i, dw.m, item FROM dw JOIN bw USING (m, x)),
 c AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS place FROM h) GROUP BY r),
 n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)"""

CHATS = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
 p AS (SELECT conv_id, row_number() OVER o AS k, string_agg(coalesce(length(role) || ':' || role, '-') || '|' || coalesce(length(text) || ':' || text, '-') || '/', '') OVER (o ROWS UNBOUNDED PRECEDING) AS pre FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
 f AS (SELECT conv_id, max(k) AS n, arg_max(pre, k) AS whole FROM p GROUP BY 1),
 q AS (SELECT whole, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n_turns FROM f GROUP BY 1),
 m AS (SELECT * FROM q WHERE whole NOT IN (SELECT pre FROM p JOIN f USING (conv_id) WHERE k < n))
SELECT m.conv_id, n_turns, n_copies, (SELECT string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FROM t WHERE t.conv_id = m.conv_id) AS rendered FROM m"""

SEED_EXTEND = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 v AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
 b AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM v) WHERE n > 1),
 c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS at FROM b),
 x AS (SELECT d.r, u.at, w[u.at] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS at) u),
 o AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.at) AS kept FROM x ANTI JOIN c ON c.r = x.r AND c.at = x.at GROUP BY x.r),
 n AS (SELECT r, count(*) AS n_removed FROM c GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (r) LEFT JOIN n USING (r)"""

EXACT_DEDUP = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents) WINDOW w AS (PARTITION BY t)"""


def _code_rounds(rounds: int) -> str:
    """Assignment k of all parts to the books of round k, and the books that follow from it."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (SELECT vec_id, part, min(d * 256 + e) AS best FROM (SELECT p.vec_id, p.part, c.e, list_sum(list_transform(list_zip(p.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} c USING (part)) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, e, list(f ORDER BY pos) AS q FROM (SELECT part, best % 256 AS e, pos, floor(sum(q[pos]) / count(*))::BIGINT AS f FROM p JOIN a{k} USING (vec_id, part), (SELECT unnest(range(1, 17)) AS pos) GROUP BY ALL) GROUP BY ALL),
 c{k + 1} AS (SELECT c.part, c.e, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.e = c.e)""")
    return ",\n ".join(steps)


#: For vectors of 64 components, with distinct ids.
VECTOR_CODES = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 p AS (SELECT vec_id, part, v[part * 16 + 1:part * 16 + 16] AS q FROM k, (SELECT unnest(range(0, 4)) AS part)),
 c0 AS (SELECT part, e, q FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, q FROM p) WHERE e < 256),
 {_code_rounds(4)},
 f AS (SELECT vec_id, string_agg(lower(right('0' || hex((best % 256)::BIGINT), 2)), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, e)) FROM c4) AS codebooks_sha256 FROM k JOIN f USING (vec_id)"""

#: The table of CRC-32 by its rule, then a fold over bytes; words meet by what is left after one letter is taken out or masked.
_CRC_STEP = "(CASE WHEN {0} % 2 = 1 THEN xor(3988292384, {0} // 2) ELSE {0} // 2 END)"
SPELLING = f"""
WITH RECURSIVE s0 AS (SELECT i, i::BIGINT AS x FROM (SELECT unnest(range(0, 256)) AS i)), {", ".join(f"s{k + 1} AS (SELECT i, {_CRC_STEP.format('x')} AS x FROM s{k})" for k in range(8))},
 tab AS (SELECT list(x ORDER BY i) AS l FROM s8),
 runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents) GROUP BY ALL),
 hx AS (SELECT doc_id, w, n, hex(encode(doc_id::VARCHAR || ':' || w)) AS h FROM runs),
 crc AS (SELECT doc_id, w, n, xor(4294967295, list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT), lambda c, b: xor(l[(xor(c, b) & 255) + 1], c // 256), 4294967295)) AS c FROM hx, tab),
 made AS (SELECT CASE WHEN c % 199 = 0 THEN left(w, (c % length(w))::INT) || substr(w, (c % length(w))::INT + 2) ELSE w END AS word, n FROM crc),
 v AS (SELECT word, sum(n)::BIGINT AS n FROM made GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
 cut AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
 pairs AS (SELECT x.word, y.word AS near, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word != y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN v y ON y.word = x.a || x.b UNION SELECT y.word, x.word, x.n FROM cut x JOIN v y ON y.word = x.a || x.b),
 best AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(near, (-n, near)) AS form FROM pairs GROUP BY 1),
 f AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN form END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n FROM v LEFT JOIN best USING (word)),
 up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, f.n, n_near, form_n FROM f JOIN up ON up.word = f.word WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.word = up.root AND g.form IS NOT NULL)"""
