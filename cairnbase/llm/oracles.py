"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from . import decontam, neardup

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
  d AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS h FROM p),
  m AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, n AS payload_bytes, d.h AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN m ON d.h = m.h"""

_NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) >= {neardup.WORDS} THEN list_distinct(list_transform(range(1, len(w) - {neardup.WORDS - 2}), lambda i: array_to_string(w[i:i + {neardup.WORDS - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM c WHERE 100 * k >= {neardup.PERCENT} * (na + nb - k)), t AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
  r AS (SELECT doc_id AS u, doc_id AS x FROM documents UNION SELECT t.v, r.x FROM r JOIN t ON r.u = t.u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept FROM s JOIN (SELECT u, min(x) AS m FROM r GROUP BY u) ON u = doc_id"""


def _leaks() -> str:
    span, words = max(map(len, decontam.MASKS)), r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    picked = lambda m: "concat_ws(chr(1), " + ", ".join([f"'{m}'", *(f"w[p + {i + 1}]" for i, c in enumerate(m) if c == "1")]) + ")"
    seeds = lambda t, key: " UNION ALL ".join(f"SELECT {key}, w, p, {picked(m)} AS h FROM {t}_at WHERE p + {len(m)} <= len(w)" for m in decontam.MASKS)
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark),
  d_at AS (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d), b_at AS (SELECT item_id, w, unnest(range(0, len(w))) AS p FROM b WHERE len(w) >= {span}),
  ds AS ({seeds("d", "doc_id")}), bs AS ({seeds("b", "item_id")}),
  hit AS (SELECT DISTINCT ds.doc_id, ds.w AS dw, bs.item_id, bs.w AS iw, ds.p - bs.p AS g FROM ds JOIN bs USING (h)
    UNION SELECT DISTINCT doc_id, d_at.w, item_id, b.w, p FROM d_at JOIN b ON len(b.w) >= {decontam.LEAST_WORDS} AND len(b.w) < {span} AND d_at.w[p + 1:p + len(b.w)] = b.w),
  laid AS (SELECT *, greatest(-g, 0) AS low, least(len(iw) - greatest(-g, 0), len(dw) - g - greatest(-g, 0)) AS n FROM hit),
  eq AS (SELECT *, list_transform(range(1, n + 1), lambda i: CAST(dw[g + low + i] = iw[low + i] AS INT)) AS e, least({decontam.WINDOW}, len(iw)) AS wid FROM laid),
  sc AS (SELECT doc_id, item_id, g + low AS doc_start, low AS item_start, list_sum(e) AS matched, list_max(list_transform(range(1, n + 1), lambda i: list_sum(e[greatest(1, i - wid + 1):i]))) AS window_matched, len(iw) AS item_words, wid FROM eq),
  ok AS (SELECT * FROM sc WHERE window_matched >= CASE WHEN item_words < {span} THEN item_words ELSE ceil(wid * {decontam.AGREE}) END)
SELECT doc_id, item_id, CAST(doc_start AS INT) AS doc_start, CAST(item_start AS INT) AS item_start, CAST(matched AS INT) AS matched, CAST(window_matched AS INT) AS window_matched, CAST(item_words AS INT) AS item_words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY window_matched DESC, matched DESC, doc_start) AS rn FROM ok) WHERE rn = 1"""


_FIM = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('7:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
  u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM d),
  k AS (SELECT *, len(u) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 AS plain FROM u),
  c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM k),
  p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN h[4] % 100 < 50 THEN concat('<S>', suf, '<P>', pre, '<M>', mid) ELSE concat('<P>', pre, '<S>', suf, '<M>', mid) END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS s FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
  n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3"""

ORACLES = {"op12_hard_negatives": _NEGATIVES, "op13_fill_in_middle": _FIM, "op1_decontaminate": _leaks(), "op4_near_duplicates": _NEAR, "op8_warc": _WARC}
