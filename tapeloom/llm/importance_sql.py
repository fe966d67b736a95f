"""The importance resampling of single words as SQL for DuckDB."""

from __future__ import annotations

from .importance import TABLE

_TABLE = f"[{', '.join(str(int(x)) for x in TABLE)}]::BIGINT[]"

SQL = rf"""
WITH tab AS (SELECT {_TABLE} AS tab),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS rid FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT rid, unnest(words) AS w FROM d), bw AS (SELECT unnest(words) AS w FROM b),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
h AS (SELECT w, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, y: xor(tab[1 + (xor(c, y) & 255)], c >> 8)) AS c FROM v, tab),
k AS (SELECT w, xor(c, 4294967295::BIGINT) % 10000 AS bucket FROM h),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (w) GROUP BY 1),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), tot),
wt AS (SELECT rid, sum(gain)::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY 1),
r AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN wt USING (rid)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, 10 * (SELECT count(*) FROM z WHERE n_features >= 20) // 100 AS take FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= take THEN place END AS rank FROM o
"""
