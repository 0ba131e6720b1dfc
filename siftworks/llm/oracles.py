"""SQL (DuckDB) that computes the rows of those queries that SQL can express."""

from __future__ import annotations

from siftworks.llm.licenses import Templates

# Windows are compared by the md5 of their words; a word goes if the last repeated window that
# starts at or before it starts less than 35 words before it.
OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY h) > 1),
j AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d WHERE len(w) > 0),
c AS (SELECT j.r, j.pos, word, coalesce(max(rep.i) OVER (PARTITION BY j.r ORDER BY j.pos ROWS UNBOUNDED PRECEDING) > j.pos - 35, false) AS gone FROM j LEFT JOIN rep ON rep.r = j.r AND rep.i = j.pos),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)"""


# crc32 of the decimal conv_id, bit by bit: a byte is taken in, then eight steps (the -1s) follow.
_CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""
# Nodes are told apart by the md5 of their turns' keys; a subtree is what a node's conversations hold from its depth on.
OP11 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, list({{'k': md5(length(role) || ':' || role || text), 'b': strlen(text)}} ORDER BY i) AS a FROM t GROUP BY 1),
h AS (SELECT conv_id, a, CAST({_CRC32.format("conv_id")} % 9 AS BIGINT) AS h FROM k),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(k.a, 1, h), []), list_slice(h.a, h + 1, len(h.a))) AS a FROM h LEFT JOIN k ON k.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(a) AS size, d, md5(list_aggregate(list_transform(list_slice(a, 1, d), lambda x: x.k), 'string_agg', '')) AS path, md5(list_aggregate(list_transform(list_slice(a, 1, d - 1), lambda x: x.k), 'string_agg', '')) AS up, coalesce(a[d].b, 0) AS b
  FROM (SELECT conv_id, a, unnest(range(0, len(a) + 1)) AS d FROM r)),
n AS (SELECT d, coalesce(path, '') AS path, CASE WHEN d > 0 THEN coalesce(any_value(up), '') END AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends FROM p GROUP BY 1, 2),
c AS (SELECT d - 1 AS d, up AS path, count(*) AS children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT DISTINCT p.d AS top, coalesce(p.path, '') AS above, q.d, coalesce(q.path, '') AS path FROM p JOIN p AS q ON q.conv_id = p.conv_id AND q.d >= p.d),
s AS (SELECT top, above, count(*) FILTER (children IS NULL) AS leaves, sum((n - 1) * b) AS saved FROM m JOIN n USING (d, path) LEFT JOIN c USING (d, path) GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN n AS u ON u.d = n.d - 1 AND u.path = n.up LEFT JOIN c ON c.d = n.d AND c.path = n.path JOIN s ON s.top = n.d AND s.above = n.path"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(x, 8 * i + 1, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM h),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f"""


def license_sql() -> str:
    """Shingles shared with a template are counted in the windows of that template's grid."""
    rows = ", ".join(f"('{name}', [{', '.join(repr(w) for w in words)}])" for name, words in Templates().words.items())
    return rf"""
WITH t(license, w) AS (VALUES {rows}),
s AS (SELECT license, len(w) AS size, greatest(1, len(w) // 4) AS step, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS sh FROM t),
n AS (SELECT license, count(*) AS total FROM s GROUP BY 1),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS m, i, array_to_string(list_slice(w, i, i + 4), ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, m, license, size, step, i, p.sh FROM p JOIN s USING (sh)),
k AS (SELECT *, unnest(range(CAST(greatest(0, ceil((i + 4 - size - step) / step)) AS BIGINT), (i - 1) // step + 1)) AS k FROM h),
c AS (SELECT doc_id, license, k * step AS first_word, least(m, k * step + size + step) - k * step AS n_words, count(DISTINCT sh) AS shared FROM k GROUP BY ALL),
r AS (SELECT doc_id, license, CAST(first_word AS INTEGER) AS first_word, CAST(n_words AS INTEGER) AS n_words, shared / total AS containment FROM c JOIN n USING (license) WHERE shared / total >= 0.8)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, first_word) = 1"""
