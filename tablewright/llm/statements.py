"""SQL that states the rows of the queries which SQL can express."""

FAIR_MIX = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place, md5(coalesce(text, '')) AS digest,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place,
    sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST) - source_size AS size_before,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST) + weight AS open_weight,
    sum(source_size) OVER () AS total
  FROM sources
), levels AS (
  SELECT *, (1.5 * total - 2 * size_before) / open_weight AS level FROM ranked
), opened AS (
  SELECT min(place) AS place, arg_min(level, place) AS level FROM levels WHERE level * weight < 2 * source_size
), targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN o.place IS NULL OR l.place < o.place THEN 2.0::DOUBLE * l.source_size ELSE o.level * l.weight END AS target
  FROM levels l CROSS JOIN opened o
), timed AS (
  SELECT d.doc_id, d.size, t.source_size, CAST(t.target AS DOUBLE) AS target, CAST(round(round(t.target, 3)) AS BIGINT) AS goal,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size, d.digest ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - source_size)) AS taken
FROM timed
"""

REPEATED_PASSAGES = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT *, CAST(len(h) // 2 AS BIGINT) AS n FROM t
), windows AS (
  SELECT r, s, md5(substr(h, 2 * s + 1, 800)) AS k
  FROM (SELECT r, h, unnest(range(0, n - 399)) AS s FROM sized WHERE n >= 400)
), again AS (
  SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS met FROM windows) WHERE met > 1
), marked AS (
  SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 400 THEN 0 ELSE 1 END AS fresh FROM again
), spans AS (
  SELECT r, min(s) AS a, max(s) + 400 AS b
  FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS span FROM marked) GROUP BY r, span
), pieces AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b, b - a AS lost FROM spans
  UNION ALL SELECT r, coalesce(max(s.b), 0), max(d.n), NULL FROM sized d LEFT JOIN spans s USING (r) GROUP BY r
)
SELECT any_value(d.doc_id) AS doc_id, any_value(d.n) AS n_bytes, CAST(coalesce(sum(p.lost), 0) AS BIGINT) AS n_removed,
  count(p.lost) AS n_spans,
  sha256(unhex(string_agg(substr(d.h, CAST(2 * p.a + 1 AS BIGINT), CAST(2 * (p.b - p.a) AS BIGINT)), '' ORDER BY p.a))) AS kept_sha256
FROM pieces p JOIN sized d USING (r) GROUP BY r
"""

HOST_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)
), windows AS (
  SELECT r, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS k FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), covered AS (
  SELECT DISTINCT r, i + unnest([0, 1, 2]) AS i
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS met FROM windows WHERE k IS NOT NULL) WHERE met > 1
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT d.r, doc_id, source, coalesce(w.n, 0) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN (SELECT r, count(*) AS n FROM words GROUP BY r) w ON d.r = w.r
  LEFT JOIN lines ON d.r = lines.r LEFT JOIN (SELECT r, count(*) AS n FROM covered GROUP BY r) c ON d.r = c.r
), failures AS (
  SELECT r, source, unnest([
    {'rule': 'few_words', 'f': n_words < 50}, {'rule': 'repeated_words', 'f': 100 * n_repeat_words > 50 * n_words},
    {'rule': 'symbols', 'f': 10 * n_symbols > n_words}, {'rule': 'repeated_lines', 'f': 10 * n_dup_lines > 3 * n_lines},
    {'rule': 'word_length', 'f': word_chars < 3 * n_words OR word_chars > 10 * n_words}]) AS x
  FROM m
), hosts AS (
  SELECT source, x.rule AS rule, count(*) AS n, count(*) FILTER (x.f) AS f FROM failures GROUP BY ALL
), prior AS (
  SELECT rule, avg(f / n) AS mean, var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS spread FROM hosts GROUP BY rule
), rejected AS (
  SELECT source, bool_or(CASE WHEN spread > 0 THEN (f + mean * (mean * (1 - mean) / spread - 1)) / (n + mean * (1 - mean) / spread - 1) ELSE mean END > 0.5) AS no
  FROM hosts JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT no AS kept
FROM m JOIN rejected x ON m.source IS NOT DISTINCT FROM x.source
"""

REMOVAL_RANKS = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), told AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), marked AS (
  SELECT d.part, CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * list_unique(ws) < 65 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails, good, toxic
  FROM d LEFT JOIN told ON d.doc_id = told.doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), ranked AS (
  SELECT part, fails, n, good, toxic, filter_order,
    coalesce(list_min(list_transform(string_split(fails, ''), lambda x: strpos(filter_order, x))), 6) AS rank
  FROM cells, orders WHERE fails <> ''
  UNION ALL SELECT part, fails, n, good, toxic, filter_order, 6 FROM cells, orders WHERE fails = ''
), steps AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
    CAST(sum(n) FILTER (rank > step) AS BIGINT) AS kept, CAST(sum(n) FILTER (rank = step) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (rank < step AND strpos(fails, substr(filter_order, step, 1)) > 0) AS BIGINT) AS redundant,
    CAST(sum(n) FILTER (fails = substr(filter_order, step, 1)) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (rank = step) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (rank = step) AS BIGINT) AS toxic_lost
  FROM ranked, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
  coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley
FROM steps
"""

SPELLING_VARIANTS = r"""
WITH RECURSIVE rule AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS bytes
), runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents
  ) GROUP BY ALL
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(0, strlen(key)), lambda i: CAST('0x' || substr(hex(encode(key)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, bytes[(xor(c, b) & 255) + 1]))) AS h
  FROM (SELECT run, times, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM runs), rule
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), less AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS part
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.part = b.part AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.part = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.part = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN most END AS form_n,
    (SELECT min(o.other) FROM near o WHERE o.word = w.word AND o.n = most AND most >= 2 * w.n) AS form
  FROM words w LEFT JOIN best ON w.word = best.word
), paths AS (
  SELECT word, form AS stop FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT p.word, f.form FROM paths p JOIN formed f ON p.stop = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, form, coalesce(p.stop, f.word) AS root, n, n_near, form_n
FROM formed f LEFT JOIN (SELECT word, stop FROM paths WHERE stop NOT IN (SELECT word FROM formed WHERE form IS NOT NULL)) p ON f.word = p.word
"""
