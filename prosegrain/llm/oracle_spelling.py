"""SQL of the spelling variants: neighbours by deleted letters, forms followed by recursion."""

from .oracle_trie import CRC_TABLE, crc32

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPELLING = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, '{_UPPER}', '{_UPPER.lower()}') AS run, count(*) AS n FROM runs GROUP BY ALL),
named AS (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS name FROM low),
hashed AS (SELECT run, n, {crc32('name')} AS h FROM named, crc_table),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM words, range(length(word)) r(i)),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, b.word FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word FROM less a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS k FROM near JOIN (SELECT word AS other, n FROM words) USING (other)),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN other END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
chain AS (SELECT word, form AS at FROM known WHERE form IS NOT NULL UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON k.word = c.at WHERE k.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN known k ON k.word = c.at WHERE k.form IS NULL)
SELECT k.word, form, coalesce(root, k.word) AS root, n, n_near, form_n FROM known k LEFT JOIN ends e ON e.word = k.word"""
