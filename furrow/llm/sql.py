"""SQL for the queries that SQL can express."""

_REACH = """, reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT node, min(other) AS component_id FROM reach GROUP BY ALL)
"""

OP4 = r"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY ALL),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingled x JOIN shingled y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
nodes AS (SELECT doc_id AS node FROM documents)""" + _REACH + """SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN low ON low.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""  # fmt: skip

OP6 = """WITH RECURSIVE usable AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
nodes AS (SELECT vec_id AS node FROM embeddings)""" + _REACH + """SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN low ON low.node = e.vec_id"""  # fmt: skip

OP9 = """WITH raw AS (SELECT page_id, coalesce(html, '') AS h FROM pages), named AS (SELECT page_id, h, strlen(h) AS payload_bytes, sha1(h) AS sha FROM raw),
parts AS (SELECT *, [('0x' || substr(sha, 5 * i + 1, 5))::BIGINT FOR i IN range(0, 8)] AS p, max(page_id) OVER (PARTITION BY sha, payload_bytes) AS newest FROM named)
SELECT page_id, payload_bytes, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1) FOR s IN [15, 10, 5, 0]], '') FOR x IN p], '') AS payload_digest,
 CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to FROM parts"""
