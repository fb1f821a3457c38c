"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, md5(text), '') AS tag
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s),
w AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM p),
o AS (
  SELECT *,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level,
    row_number() OVER (ORDER BY cap / weight, pos) AS turn
  FROM w),
l AS (SELECT arg_min(level, turn) AS level FROM o WHERE weight * level <= cap),
t AS (SELECT source, source_size, CASE WHEN weight * l.level > cap THEN cap::DOUBLE ELSE weight * l.level END AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t)
SELECT d.doc_id, d.size, r.source_size, r.target,
  (d.size * (floor(r.rate)::BIGINT
    + CASE WHEN ('0x' || substr(md5('mix:' || d.tag), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate)
           THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

OP3 = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP8 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, payload_bytes,
    translate(concat(
      to_base(('0x' || substr(h, 1, 10))::BIGINT, 32, 8), to_base(('0x' || substr(h, 11, 10))::BIGINT, 32, 8),
      to_base(('0x' || substr(h, 21, 10))::BIGINT, 32, 8), to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8)),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS m FROM p),
r AS (SELECT m FROM h GROUP BY m HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(range(i, i + 35)) AS pos FROM h WHERE m IN (SELECT m FROM r))),
k AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.pos) AS kept, count(*) AS n
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.pos = c.pos WHERE c.pos IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP11 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM s, range(1, 6) AS r(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
b AS (
  SELECT DISTINCT c.lang, c.phrase FROM (
    SELECT lang, a AS longer, array_to_string(ws[i:i + j - 1], ' ') AS phrase
    FROM c, range(2, 5) AS q(j), range(1, 5) AS t(i) WHERE j < k AND i + j - 1 <= k) x
  JOIN c ON c.lang = x.lang AND c.phrase = x.phrase AND 100 * x.longer >= 100 * c.a),
u AS (
  SELECT c.lang, c.phrase, c.a, h.k AS cut, array_to_string(ws[1:h.k], ' ') AS l_phrase, array_to_string(ws[h.k + 1:c.k], ' ') AS r_phrase
  FROM c, range(1, 5) AS h(k)
  WHERE h.k < c.k AND NOT EXISTS (SELECT 1 FROM b WHERE b.lang = c.lang AND b.phrase = c.phrase)),
v AS (
  SELECT u.lang, u.phrase, u.a, u.cut, l.f AS l, r.f AS r, n.n,
    ((1000::HUGEINT * u.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = u.l_phrase JOIN f r ON r.lang = u.lang AND r.phrase = u.r_phrase
    JOIN n ON n.lang = u.lang),
x AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
y AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM x)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM y WHERE rank <= 2000
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce({_LOWERED.format("text")}, ''), '{_TERM}') AS ts FROM documents),
s AS (SELECT count(*) AS docs, sum(len(ts))::BIGINT AS words FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(coalesce({_LOWERED.format("text")}, ''), '{_TERM}')) AS term FROM benchmark),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM p, s GROUP BY term),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(ts) * docs) // words) AS m FROM d, s WHERE len(ts) > 0),
c AS (
  SELECT q.item_id, m.r, m.doc_id, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term JOIN m ON m.r = p.r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""

OP13 = """
WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, hex(coalesce(text, '')) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, greatest(n - 399, 0))) AS i FROM d),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM p),
s AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM s),
x AS (SELECT doc_id, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM x GROUP BY doc_id, run),
v AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM u),
k AS (
  SELECT d.doc_id, string_agg(substr(d.h, 2 * v.prev + 1, 2 * (v.a - v.prev)), '' ORDER BY v.a) || substr(any_value(d.h), 2 * max(v.b) + 1) AS kept,
    sum(v.b - v.a)::BIGINT AS n_removed, count(*) AS n_spans
  FROM v JOIN d ON d.doc_id = v.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(k.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

ORACLE = {"op2_source_mixing": OP2, "op3_exact_top_k": OP3, "op8_warc_revisits": OP8,
          "op9_repeated_passages": OP9, "op11_collocations": OP11, "op12_ranked_search": OP12, "op13_repeated_bytes": OP13}
