"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

OP1 = """WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS h FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(h, '\\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d"""

OP2 = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to FROM p LEFT JOIN k USING (payload_digest)"""


def _pour(name: str, parent: str, above: str, key: str, weight: str) -> str:
    """One level: children in order of capacity over weight fill up first, the rest share by weight."""
    part = f"PARTITION BY {parent}" if parent else ""
    using = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
    own = f"{parent}, {key}" if parent else key
    return f"""{name}0 AS (SELECT {own}, sum(capacity) AS capacity, max({weight})::DOUBLE AS weight FROM leaves GROUP BY ALL),
{name}1 AS (SELECT c.*, budget, coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER ({part} ORDER BY capacity / weight, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}0 c {using}),
{name}2 AS (SELECT *, capacity * rest <= weight * (budget - before) AS full_ FROM {name}1),
{name}3 AS (SELECT *, greatest(budget - coalesce(sum(capacity) FILTER (full_) OVER ({part}), 0), 0) AS left_, sum(weight) FILTER (NOT full_) OVER ({part}) AS open FROM {name}2),
{name} AS (SELECT {own}, CASE WHEN full_ THEN capacity ELSE weight * left_ / open END AS budget FROM {name}3)"""


OP3 = f"""WITH d0 AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS k, len({_WORDS.format("coalesce(text, '')")}) AS n_tokens FROM documents),
d AS (SELECT doc_id, lang, source, CASE WHEN k < 5 THEN 'first' WHEN k < 12 THEN 'second' ELSE 'third' END AS domain, n_tokens FROM d0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * 3 AS capacity, max(CASE domain WHEN 'first' THEN 5 WHEN 'second' THEN 3 ELSE 2 END) AS w_domain, max(CASE lang WHEN 'en' THEN 6 ELSE 2 END) AS w_lang, 1 AS w_source FROM d GROUP BY ALL),
total AS (SELECT sum(tokens)::DOUBLE * 0.6 AS budget FROM leaves),
{_pour("x", "", "total", "domain", "w_domain")},
{_pour("y", "domain", "x", "lang", "w_lang")},
{_pour("z", "domain, lang", "y", "source", "w_source")},
b AS (SELECT domain, lang, source, floor(budget + 1e-6)::BIGINT // tokens AS whole, floor(budget + 1e-6)::BIGINT % tokens AS rest FROM z JOIN leaves USING (domain, lang, source) WHERE tokens > 0 AND floor(budget + 1e-6) > 0),
u AS (SELECT doc_id, domain, lang, source, sum(n_tokens)::BIGINT AS size FROM d GROUP BY ALL),
r AS (SELECT u.*, whole, rest, sum(size) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id) AS reach FROM u JOIN b USING (domain, lang, source)),
c AS (SELECT doc_id, domain, lang, source, CAST(whole + CASE WHEN reach <= rest AND rest > 0 THEN 1 ELSE 0 END AS INT) AS copies FROM r)
SELECT d.doc_id, d.domain, d.lang, d.source, n_tokens, copies FROM d JOIN c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.domain = d.domain AND c.lang = d.lang AND c.source = d.source WHERE copies > 0"""

OP4 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT p.doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM p JOIN d USING (doc_id)),
r AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(35) t(k)),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d WHERE len(w) > 0),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS n FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
c AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT c.doc_id, e.y FROM c JOIN e ON e.x = c.r)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) GROUP BY d.doc_id, n"""

_FINE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
#: Quotient of two whole numbers, rounded down.
_DOWN = "CAST(({0} - (({0} % {1}) + {1}) % {1}) // {1} AS BIGINT)"
#: Exact squared distance of two lists of whole numbers below 2^20.
_SQUARED = "CAST(list_inner_product({0}::DOUBLE[], {0}::DOUBLE[]) + list_inner_product({1}::DOUBLE[], {1}::DOUBLE[]) - 2 * list_inner_product({0}::DOUBLE[], {1}::DOUBLE[]) AS BIGINT)"


def _code_round(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT x.vec_id, p, e, {_SQUARED.format("x.v", "b.v")} AS d FROM x JOIN b{i} b USING (p)) GROUP BY ALL)"""


def _entry_round(i: int) -> str:
    return f"""b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (SELECT p, e, list(f ORDER BY i) AS v FROM (SELECT p, e, i, {_DOWN.format("sum(v[i])", "count(*)")} AS f FROM a{i} JOIN x USING (vec_id, p), range(1, 17) t(i) GROUP BY ALL) GROUP BY ALL) m USING (p, e))"""


OP11 = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(1024 * y::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE {_FINE}),
x AS MATERIALIZED (SELECT vec_id, p, v[p * 16 + 1 : p * 16 + 16] AS v FROM k, range(4) t(p)),
b0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 256) JOIN x USING (vec_id)),
{", ".join(f"{_code_round(i)}, {_entry_round(i)}" for i in range(4))}, {_code_round(4)},
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"""


def _centroid_round(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, d * 40 + c) AS c, min(d) AS d FROM (SELECT x.vec_id, c, {_SQUARED.format("x.v", "b.v")} AS d FROM x, b{i} b) GROUP BY ALL)"""


def _mean_round(i: int) -> str:
    return f"""b{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN (SELECT c, list(f ORDER BY i) AS v FROM (SELECT c, i, {_DOWN.format("sum(v[i])", "count(*)")} AS f FROM a{i} JOIN x USING (vec_id), range(1, 65) t(i) GROUP BY ALL) GROUP BY ALL) m USING (c))"""


OP12 = f"""WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda y: CAST(floor(256 * y::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE {_FINE} AND len(embedding) = 64),
b0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM x ORDER BY h LIMIT 40)),
{", ".join(f"{_centroid_round(i)}, {_mean_round(i)}" for i in range(5))}, {_centroid_round(5)}
SELECT vec_id, CAST(a5.c AS INT) AS cluster, d AS distance, sum(d) OVER (PARTITION BY a5.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM a5 JOIN b5 USING (c)"""

OP13 = """WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, s: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, n)) AS crc),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
e AS (SELECT doc_id, octet_length(b) + 8 AS size, list_transform(regexp_extract_all(hex(b), '..'), lambda y: CAST('0x' || y AS BIGINT)) AS l FROM d),
s AS (SELECT doc_id, size, xor(list_reduce(l, lambda a, y: xor(crc[xor(a, y) % 256 + 1], a >> 8), 4294967295), 4294967295) AS text_crc32 FROM e, t),
c AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM s),
h AS (SELECT *, CAST((2 * upto - size) * 24 // (2 * total) AS INT) AS shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM h"""

ORACLES = {"op1_main_text": OP1, "op2_warc": OP2, "op3_mixing": OP3, "op4_repeated_passages": OP4, "op9_near_duplicates": OP9, "op11_vector_codes": OP11, "op12_centroids": OP12, "op13_sharding": OP13}
