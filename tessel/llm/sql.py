"""DuckDB SQL of the corpus queries that SQL can express."""

_RECORD = r"""
'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '')
|| '>' || nl || 'WARC-Target-URI: ' || coalesce(url, '') || nl || 'Content-Type: text/html' || nl
|| 'Content-Length: ' || strlen(coalesce(html, '')) || nl || nl || coalesce(html, '') || nl || nl
"""

WARC_FIXITY = f"""
WITH records AS (
  SELECT page_id, page_id // 1000 AS archive, strlen(record) AS length, sha256(record) AS leaf, sha256('WARC/1.0' || substr(record, 9)) AS altered
  FROM (SELECT page_id, {_RECORD} AS record FROM pages, (SELECT chr(13) || chr(10) AS nl))
), placed AS (
  SELECT *, (coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS "offset"
  FROM records
)
SELECT page_id, archive, "offset", length, leaf AS record_sha256,
  CASE WHEN page_id % 500 = 3 THEN altered END AS found_sha256,
  CASE page_id % 500 WHEN 3 THEN 'changed' WHEN 77 THEN 'missing' ELSE 'intact' END AS status
FROM placed
UNION ALL
SELECT NULL, archive, "offset" + 1, NULL, NULL, leaf, 'extra' FROM placed WHERE page_id % 500 = 200
"""

JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+') IF x <> ''] AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, len(s.s)::bigint AS n_shingles, c.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_RECORD_OF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
# CRC-32 of the decimal id: each character, then eight shifts of the register
_CRC = """xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda r, c:
list_reduce([xor(r, c)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)))"""

MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_RECORD_OF} || {_FIELD.format("text")}) AS leaf, sha256({_RECORD_OF} || {_FIELD.format("found")}) AS found
  FROM (SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS found FROM documents)
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), up(level, tree, i, digest, n) AS (
  SELECT 0, tree, i, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL
  SELECT level + 1, tree, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM up WHERE n > 1 GROUP BY level, tree, i // 16
), subroots AS (SELECT tree, level AS height, digest FROM up WHERE n = 1
), top(level, i, digest, n) AS (
  SELECT 0, tree, digest, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), (any_value(n) + 15) // 16 FROM top WHERE n > 1 GROUP BY level, i // 16
), runs AS (
  SELECT level, tree, i // 16 AS run, list(digest ORDER BY i) AS members FROM up WHERE n > 1 GROUP BY level, tree, i // 16
  UNION ALL
  SELECT s.height + t.level, s.tree, -1, t.members FROM subroots s JOIN (
    SELECT t.level, t.i // 16 AS run, list(t.digest ORDER BY t.i) AS members FROM top t WHERE n > 1 GROUP BY t.level, t.i // 16
  ) t ON t.run = s.tree // (16 ^ (t.level + 1))::bigint
), walk(tree, i, level, height, pos, siblings, folded) AS (
  SELECT p.tree, p.i, 0, s.height, p.i, '', p.found FROM placed p JOIN subroots s USING (tree)
  UNION ALL
  SELECT w.tree, w.i, w.level + 1, w.height, pos // 16,
    w.siblings || array_to_string(r.members[:pos % 16], '') || array_to_string(r.members[pos % 16 + 2:], ''),
    sha256(array_to_string(r.members[:pos % 16], '') || w.folded || array_to_string(r.members[pos % 16 + 2:], ''))
  FROM (SELECT * REPLACE (CASE WHEN level = height THEN tree ELSE pos END AS pos) FROM walk) w
  JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = CASE WHEN w.level < w.height THEN w.pos // 16 ELSE -1 END
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, root.digest AS root, sha256(w.siblings) AS proof_sha256, w.folded AS folded_root, w.folded = root.digest AS verified
FROM placed p JOIN subroots s USING (tree) CROSS JOIN (SELECT digest FROM top WHERE n = 1) root
JOIN (SELECT * FROM walk QUALIFY level = max(level) OVER (PARTITION BY tree)) w ON w.tree = p.tree AND w.i = p.i
"""

FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), marks AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::int AS mask
  FROM texts LEFT JOIN marks USING (doc_id)
), cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    coalesce(list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[:step - 1], '') IF x <> '']), 0)::int AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), told AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::bigint AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::bigint AS removed, coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::bigint AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::bigint AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::bigint AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::bigint AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::bigint AS shapley FROM told
"""

SQL: dict[str, str] = {"op1_warc_fixity": WARC_FIXITY, "op4_jaccard_join": JACCARD, "op12_merkle_manifest": MERKLE, "op13_filter_audit": FILTER_AUDIT}
