"""DuckDB SQL for the queries that SQL can express on whole tables."""

SUBSTRING = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, unnest(range(1, greatest(len(w) - 12, 0)::BIGINT + 1)) AS p, w FROM d WHERE len(w) >= 13),
g AS (SELECT r, doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
c AS (
  SELECT DISTINCT r, unnest(range(p, p + 13)) AS p FROM g JOIN f USING (h)
  WHERE low IS NOT NULL AND (doc_id IS NULL OR low < doc_id)),
n AS (SELECT r, count(*) AS n FROM c GROUP BY r),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""

NEAR_VECTORS = """
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
v AS (SELECT r, vec_id, label, usable, CASE WHEN usable THEN embedding::DOUBLE[] END AS e FROM u),
l AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND a.usable AND b.usable AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
t(r, root) AS (
  SELECT r, r FROM v UNION SELECT l.a, t.root FROM t JOIN l ON l.b = t.r),
c AS (SELECT t.r, min(v.vec_id) AS component_id FROM t JOIN v ON v.r = t.root GROUP BY t.r),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (r) LEFT JOIN n USING (r)
"""

# Scores are sums of doubles: exact below 2^53, and beyond a long given as the largest or smallest one.
TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score, c.r AS cr
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id,
  CASE WHEN score >= 9223372036854775807 THEN 9223372036854775807 WHEN score <= -9223372036854775808 THEN -9223372036854775808 ELSE score::BIGINT END AS score
FROM k WHERE rank <= 5
"""

# Division of whole numbers in 128 bits where a product may pass 64.
LEXICAL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT row_number() OVER () AS i, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
c AS (SELECT count(*)::HUGEINT AS n_docs, sum(len(w))::HUGEINT AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT i, term, count(*) AS repeats FROM (SELECT i, unnest(w) AS term FROM i) GROUP BY i, term),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
t AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
m AS (SELECT r, (100 - 25 + (25 * len(w) * n_docs) // n_terms)::BIGINT AS m FROM d, c WHERE len(w) > 0),
s AS (
  SELECT i, r, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN t USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY i, r),
k AS (
  SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM s JOIN d USING (r) JOIN i USING (i) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _tree(name: str, leaves: str) -> str:
    """Nodes (level, g, pos, n, h) from leaves (g, pos, n, h) up."""
    return f"""{name}(level, g, pos, n, h) AS (
  SELECT 0, g, pos, n, h FROM {leaves}
  UNION ALL SELECT level + 1, g, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY level, g, pos // 2, n)"""


# The checksum of an id runs bit by bit: each byte, then seven zeros to shift it through.
MERKLE = f"""
WITH RECURSIVE x AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars::HUGEINT + 1)")} AS wrong,
    doc_id IS NOT NULL AND xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) % 7 = 0 AS chosen
  FROM documents),
own AS (SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n, leaf AS h, * FROM x),
{_tree("a", "own")},
subroots AS (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, h FROM a WHERE n = 1),
{_tree("b", "subroots")},
heights AS (SELECT g, max(level) AS height FROM a GROUP BY g),
steps AS (
  SELECT r, level, pos >> level AS place, g FROM own JOIN heights USING (g), range(64) t(level) WHERE level < height),
up AS (
  SELECT r, height + t.level AS level, own.g >> t.level AS place FROM own JOIN heights USING (g), range(64) t(level) WHERE t.level < (SELECT max(level) FROM b)),
siblings AS (
  SELECT r, steps.level, place, a.h FROM steps LEFT JOIN a ON a.g = steps.g AND a.level = steps.level AND a.pos = xor(place, 1::BIGINT)
  UNION ALL SELECT r, up.level, place, b.h FROM up JOIN own USING (r) JOIN heights ON heights.g = own.g LEFT JOIN b ON b.level = up.level - height AND b.pos = xor(place, 1::BIGINT)),
f(r, level, h) AS (
  SELECT r, 0::BIGINT, CASE WHEN chosen AND wrong IS NOT NULL THEN wrong ELSE leaf END FROM own
  UNION ALL SELECT f.r, f.level + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.place % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END) FROM f JOIN siblings s ON s.r = f.r AND s.level = f.level),
proofs AS (SELECT r, string_agg(h, '' ORDER BY level) AS all_siblings FROM siblings GROUP BY r)
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(coalesce(all_siblings, '')) AS proof_sha256, t.h AS folded_root, t.h = root.h AS verified
FROM own JOIN subroots s ON s.pos = own.g JOIN (SELECT h FROM b WHERE n = 1) root ON true JOIN (SELECT r, arg_max(h, level) AS h FROM f GROUP BY r) t USING (r) LEFT JOIN proofs USING (r)
"""
