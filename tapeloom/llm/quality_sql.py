"""The quality rules as SQL for DuckDB, with the fixed values of the operator."""

from __future__ import annotations

from .quality import COMMON, MAX_CLASS, MAX_INSIDE, MAX_WORDS, MIN_EXPECTED, MIN_FOUND, MIN_SHARE, MIN_WORDS

_LISTS = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in v)}]" for k, v in COMMON.items()) + " ELSE CAST([] AS VARCHAR[]) END"


def _js(p: str, q: str) -> str:
    part = lambda a, b: f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END)"
    x, y = f"({p})[i]", f"({q})[i]"
    return f"sqrt(greatest(0, coalesce(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(x, y)} + {part(y, x)})), 0) / 2))"


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE 'other' END AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
x AS (SELECT *, array_to_string(words, '') AS joined, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
  list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4]) AS wins, list_transform(words, lambda v: lower(v)) AS low, {_LISTS} AS list FROM w),
u AS (SELECT rid, unnest(wins) AS win, generate_subscripts(wins, 1) AS i FROM x),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS k FROM u),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice WHERE k > 1) GROUP BY 1),
c AS (SELECT x.*, coalesce(n_repeat_words, 0) AS n_repeat_words, len(words) AS n_words, length(joined) AS word_chars, length(regexp_replace(joined, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, regexp_replace(joined, '\p{{L}}+', '', 'g') AS rest, list_transform(list, lambda v: len(list_filter(low, lambda z: z = v))) AS hits FROM x LEFT JOIN covered USING (rid)),
f AS (SELECT *, [word_chars - length(rest), length(regexp_replace(rest, '\P{{N}}+', '', 'g')), n_symbols] AS abc, length(t) - word_chars AS space FROM c),
g AS (SELECT *, [abc[1], abc[2], abc[3], word_chars - abc[1] - abc[2] - abc[3], space] AS chars FROM f),
r AS (SELECT lang, [sum(chars[1]), sum(chars[2]), sum(chars[3]), sum(chars[4]), sum(chars[5])] AS rc, list_transform([{', '.join(f'sum(hits[{i}])' for i in range(1, 21))}], lambda v: coalesce(v, 0)) AS rh, sum(n_words) AS rw FROM g GROUP BY 1),
s AS (SELECT g.*, list_transform(chars, lambda v: v / greatest(list_sum(chars), 1)::DOUBLE) AS pc, list_transform(rc, lambda v: v / greatest(list_sum(rc), 1)::DOUBLE) AS qc,
  list_transform(list_append(hits, n_words - list_sum(hits)), lambda v: v / greatest(n_words, 1)::DOUBLE) AS ph, list_transform(list_append(rh, rw - list_sum(rh)), lambda v: v / greatest(rw, 1)::DOUBLE) AS qh,
  coalesce(list_sum(hits), 0) AS nh, n_words * list_sum(rh) / greatest(rw, 1)::DOUBLE AS expected, list_transform(hits, lambda v: v / greatest(list_sum(hits), 1)::DOUBLE) AS ih, list_transform(rh, lambda v: v / greatest(list_sum(rh), 1)::DOUBLE) AS iq FROM g JOIN r USING (lang)),
j AS (SELECT *, {_js('pc', 'qc')} AS dc, CASE WHEN len(hits) > 0 THEN {_js('ph', 'qh')} ELSE 0 END AS dw, CASE WHEN len(hits) > 0 THEN {_js('ih', 'iq')} ELSE 0 END AS di, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND (dc > {MAX_CLASS} OR dw > {MAX_WORDS}
  OR len(hits) > 0 AND (expected >= {MIN_EXPECTED} AND nh < {MIN_SHARE} * expected OR nh >= {MIN_FOUND} AND di > {MAX_INSIDE}))) AS kept FROM j
"""
