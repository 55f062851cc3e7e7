"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Lower-cases A to Z alone, then takes runs of letters, digits and everything beyond ASCII.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The remainder by the reflected polynomial, bit after bit.
_CRC32 = "xor(list_reduce(flatten([[(byte >> bit) & 1 for bit in range(8)] for byte in [('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::bigint for k in range(octet_length(encode(w)))]]), lambda r, b: xor(r >> 1, 3988292384 * (xor(r, b) & 1)), 4294967295::bigint), 4294967295::bigint)"

OP11 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
     b AS (SELECT {_WORDS} AS ws FROM benchmark),
     x AS (SELECT doc_id, unnest(ws) AS w FROM d),
     y AS (SELECT unnest(ws) AS w FROM b),
     bucket AS (SELECT w, ({_CRC32}) % 10000 AS bucket FROM (SELECT DISTINCT w FROM (SELECT w FROM x UNION ALL SELECT w FROM y))),
     s AS (SELECT bucket, count(*) AS s FROM x JOIN bucket USING (w) GROUP BY 1),
     t AS (SELECT bucket, count(*) AS t FROM y JOIN bucket USING (w) GROUP BY 1),
     sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
     gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000)::double / ((coalesce(s, 0) + 1)::double * (t_all + 10000)::double)))::bigint AS gain
              FROM s FULL JOIN t USING (bucket), sums),
     weight AS (SELECT doc_id, sum(gain)::bigint AS weight FROM x JOIN bucket USING (w) JOIN gain USING (bucket) GROUP BY 1),
     scored AS (SELECT doc_id, len(ws)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight,
                       coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint AS score
                FROM d LEFT JOIN weight USING (doc_id)),
     ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM ranked) // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

OP12 = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id) AS x FROM documents),
     h AS (SELECT *, len(units)::bigint AS n, ('0x' || substr(x, 1, 8))::bigint AS h1, ('0x' || substr(x, 9, 8))::bigint AS h2, ('0x' || substr(x, 17, 8))::bigint AS h3, ('0x' || substr(x, 25, 8))::bigint AS h4 FROM u),
     c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
     p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::bigint AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::bigint AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

OP13 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
     b AS (SELECT item_id::varchar AS item, {_WORDS} AS ws FROM benchmark),
     tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS q FROM d),
     phrase AS (SELECT DISTINCT item, ws[i + 1:i + 10] AS win FROM (SELECT item, ws, unnest(range(greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)),
     win AS (SELECT win, len(win) AS k, row_number() OVER () AS id FROM (SELECT DISTINCT win FROM phrase)),
     place AS (SELECT doc_id, id, s, k FROM (SELECT doc_id, s, k, ws[s + 1:s + k] AS win FROM (SELECT doc_id, ws, k, unnest(range(greatest(0, len(ws) - k + 1))) AS s FROM d, (SELECT DISTINCT k FROM win))) JOIN win USING (win, k)),
     hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS q FROM place) GROUP BY 1),
     need AS (SELECT id, k, w, count(*) AS times FROM (SELECT id, k, unnest(win) AS w FROM win) GROUP BY ALL),
     known AS (SELECT id, k, arg_min(w, (n, w)) AS w, count(*) AS n_words FROM need JOIN (SELECT w, count(*) AS n FROM tok GROUP BY 1) USING (w) GROUP BY ALL HAVING sum(times) = k),
     around AS (SELECT known.id, known.k, known.n_words, tok.doc_id, tok.q AS p, need.w, need.times, other.q FROM known JOIN tok USING (w) JOIN need USING (id) JOIN tok AS other ON other.doc_id = tok.doc_id AND other.w = need.w AND other.q BETWEEN tok.q - known.k - 1 AND tok.q + known.k + 1),
     enough AS (SELECT a.id, a.doc_id, a.p, a.q, a.n_words, b.w FROM around AS a JOIN around AS b ON a.id = b.id AND a.doc_id = b.doc_id AND a.p = b.p AND b.q >= a.q AND b.q < a.q + a.k + 2 GROUP BY ALL HAVING count(*) >= any_value(b.times)),
     near AS (SELECT DISTINCT id, doc_id FROM (SELECT id, doc_id, p, q FROM enough GROUP BY ALL HAVING count(*) = any_value(n_words))),
     items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM place JOIN win USING (id) JOIN phrase USING (win) GROUP BY 1),
     near_items AS (SELECT doc_id, count(DISTINCT item) AS n_near_items FROM near JOIN win USING (id) JOIN phrase USING (win) GROUP BY 1)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""
