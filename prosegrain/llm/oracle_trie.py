"""SQL of the prefix trie: prefixes as lists, subtrees by the members' own paths."""

#: crc32 in SQL: a table of 256 words made from the polynomial, then a fold over bytes.
CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM range(256) r(i)))"
_BYTES = "list_transform(range(1, 2 * strlen({0}), 2), lambda k: ('0x' || substr(hex(encode({0})), k, 2))::BIGINT)"


def crc32(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8 bytes, where the column ``crc`` of ``crc_table`` is in scope."""
    return f"xor(list_reduce({_BYTES.format(text)}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


TRIE = f"""WITH {CRC_TABLE},
turns AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
seqs AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS s FROM turns GROUP BY c),
lent AS (SELECT c, s, {crc32('c::VARCHAR')} % 4 AS h FROM seqs, crc_table),
built AS (SELECT a.c, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM lent a LEFT JOIN seqs b ON b.c = a.c - a.c % 20),
paths AS (SELECT c, d, md5(to_json(s[1:d])::VARCHAR) AS name, CASE WHEN d > 0 THEN md5(to_json(s[1:d - 1])::VARCHAR) END AS up, CASE WHEN d > 0 THEN s[d].x ELSE '' END AS x, d = len(s) AS last FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM built)),
nodes AS (SELECT d, name, min(up) AS up, min(c) AS conv, count(*) AS n, len(regexp_extract_all(min(x), '[^\\x20\\x09-\\x0D]+')) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM paths GROUP BY d, name),
kids AS (SELECT d - 1 AS d, up AS name, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (d, name)),
under AS (SELECT p.d, p.name, sum((q.n - 1) * q.w) AS saved, count(*) FILTER (q.k = 0) AS leaves FROM own q JOIN paths p ON p.c = q.conv AND p.d <= q.d GROUP BY p.d, p.name)
SELECT o.conv AS conv_id, o.d AS depth, u.conv AS parent_conv_id, o.n AS n_convs, o.k AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN under s USING (d, name) LEFT JOIN own u ON u.d = o.d - 1 AND u.name = o.up"""
