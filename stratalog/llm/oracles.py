"""DuckDB SQL for the queries that SQL can express."""

_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), occ AS (
  SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON win.n = pos.n AND win.s = array_to_string(pos.w[pos.i : pos.i + pos.n - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(k) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(its.s, '{_EMPTY_SHA}') AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4 = rf"""
WITH r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(v, h, p)),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_ABC}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM s JOIN r ON ends_with('.' || host, '.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT s.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN m USING (page_id)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {_ABC}) AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def _unit(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


OP10 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS weight FROM p),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::BIGINT AS rest, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS share,
    row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(k) AS k0 FROM o WHERE cap * share > rest * weight),
l AS (SELECT rest AS rest0, share AS share0 FROM o, f WHERE k = k0),
t AS (SELECT o.source, n, source_size, CASE WHEN k >= k0 THEN (rest0 * weight)::DOUBLE / share0::DOUBLE ELSE cap::DOUBLE END AS target FROM o, f LEFT JOIN l ON true),
x AS (SELECT d.doc_id, d.source, d.size, t.n, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0.0 END AS rate,
    {_unit("'17'", "doc_id::VARCHAR", "size::VARCHAR")} AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, floor(draw * ceil(n / 1024.0::DOUBLE))::BIGINT AS cell FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY source, cell ORDER BY size, draw) AS k, {_unit("'18'", "coalesce(source, '')", "cell::VARCHAR")} AS u FROM c),
e AS (SELECT *, (floor(rate) + floor((rate - floor(rate)) * k + u) - floor((rate - floor(rate)) * (k - 1) + u))::INTEGER AS copies FROM k)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM e
"""

#: CRC-32 by its table, derived from the reversed polynomial; slow, but whole.
OP8 = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) r(i))
), d AS (
  SELECT doc_id, coalesce(text, '') AS txt, strlen(coalesce(text, ''))::BIGINT + 8 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents
), b AS (
  SELECT doc_id, size, md5(txt) AS h, list_transform(range(0, length(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT) AS b FROM d
), c AS (
  SELECT doc_id, size, h, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab
), p AS (
  SELECT *, (sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING))::BIGINT AS e, (sum(size) OVER ())::BIGINT AS total FROM c
), s AS (SELECT *, least((2 * e - size) * 24 // (2 * total), 23)::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""

ORACLES = {"op2_decontamination": OP2, "op4_url_filter": OP4, "op6_exact_dedup": OP6, "op8_sharding": OP8, "op10_mixing": OP10}
