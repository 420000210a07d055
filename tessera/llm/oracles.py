"""DuckDB SQL for the numbered queries whose results SQL can express."""

from __future__ import annotations

from tessera.llm import hard_negatives as H
from tessera.llm import quality_rules as Q
from tessera.llm import spelling_index as S

# the checksum's table is built from its polynomial; a lambda folds the bytes of '<doc_id>:<run>' into it
_CRC_STEP = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"

SPELLING = f"""
WITH RECURSIVE
bits(byte, k, x) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT byte, k + 1, {_CRC_STEP.format(x="x")} FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY byte) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{S.UPPER}', '{S.LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
  FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT id, run, c, hex(encode(id || ':' || run)) AS h FROM counted WHERE length(run) >= {S.MIN_LETTERS}),
summed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i:
           CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
         lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) AS h
  FROM bytes, crc),
typed AS (
  SELECT CASE WHEN h % {S.DROP_EVERY} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM summed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= {S.MIN_LETTERS} GROUP BY word HAVING sum(c) >= {S.MIN_COUNT}),
less AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'m': -near_n, 'near': near}}) AS b FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * w.n THEN b.near END AS form,
         CASE WHEN -b.m >= 2 * w.n THEN -b.m END AS form_n
  FROM words w LEFT JOIN best USING (word)),
up(word, root, k) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT up.word, formed.form, k + 1 FROM up JOIN formed ON formed.word = up.root WHERE formed.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, k) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""

_WORD, _NO_SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
windows AS (SELECT r, i, w[i:i + {Q.WINDOW - 1}] AS s FROM (SELECT r, w, unnest(range(1, len(w) - {Q.WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range({Q.WINDOW}) AS t(j) GROUP BY r),
m AS (SELECT w.*, len(w) AS n_words, length(regexp_replace(text, '{_NO_SPACE}', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (r)),
j AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEATED} * n_words AS base_failed,
             100 * n_symbols > {Q.MAX_SYMBOLS} * n_words OR word_chars < {Q.WORD_LENGTH[0]} * n_words OR word_chars > {Q.WORD_LENGTH[1]} * n_words
             OR 100 * n_dup_lines > {Q.MAX_DUP_LINES} * len(l)
             OR 100 * (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g'))) > {Q.MAX_UPPER} * word_chars
             OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < {Q.MIN_ALPHA} * n_words
             OR 100 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) > {Q.MAX_DIGITS} * word_chars
             OR 100 * len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) > {Q.MAX_STUTTER} * n_words
             OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > {Q.MAX_ELLIPSIS} * len(l) AS bad FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM j"""

HARD_NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {H.RELABEL_EVERY} = 0 THEN (label + 1) % {H.LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor({H.SCALE} * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % {H.ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {H.POSITIVES}),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {H.LOW} * p.score <= 100 * s.score AND 100 * s.score <= {H.HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(k AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= {H.NEGATIVES}"""

NEAR_VECTORS = """
WITH RECURSIVE
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(e) > 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""

JACCARD = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{S.UPPER}', '{S.LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
          HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
same AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS class_id, len(s) AS n FROM s),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, class_id FROM same JOIN c USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
b AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(h, CAST(5 * g + 1 AS BIGINT), 5) AS INT)) AS v FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM b"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
g AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM g) WHERE r > 1),
marked AS (SELECT doc_id, p, CAST(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS INT) AS starts FROM later),
runs AS (SELECT doc_id, p, sum(coalesce(starts, 0)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans),
kept AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS b
         FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * b + 1) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

ORACLE = {"op4_sorted_passes": NEAR_VECTORS, "op5_suffix_cover": REPEATS, "op6_partenum_join": JACCARD, "op7_warc_dictionary": WARC,
          "op11_spelling_index": SPELLING, "op12_quality_rules": QUALITY, "op13_hard_negatives": HARD_NEGATIVES}
