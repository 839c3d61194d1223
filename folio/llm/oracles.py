"""DuckDB SQL of the queries that SQL can express."""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {10 * c + 1}, 10))::BIGINT >> {35 - 5 * d}) & 31)::INT + 1, 1)" for c in range(4) for d in range(8))
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {
    "op4_warc_round_trip": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS target FROM pages)
SELECT page_id, strlen(p) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> target THEN target END AS refers_to, true AS verified
FROM p
""",
    "op5_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
     k AS (SELECT doc_id, line, i,
                  translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM e),
     f AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.k = f.k GROUP BY k.doc_id
""",
    "op11_importance_resampling": f"""
WITH steps AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i)),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
runs AS (SELECT unnest(range(1, 4)) AS k),
df AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, runs)),
bf AS (SELECT array_to_string(w[i:i + k - 1], ' ') AS f FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b, runs)),
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
x AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1])), 4294967295) % 10000 AS bucket FROM names, crc),
s AS (SELECT bucket, count(*) AS n FROM df JOIN x USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN x USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT sum(n) FROM s)::DOUBLE + 10000) / ((s.n::DOUBLE + 1) * (coalesce((SELECT sum(n) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain
      FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM df JOIN x USING (f) JOIN g USING (bucket) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(d.w), 0) + greatest(len(d.w) - 1, 0) + greatest(len(d.w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id) AS place, 5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM o
""",
    "op12_ranked_search": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM l),
f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY t, docs),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))))::BIGINT AS score
      FROM q JOIN w USING (t) JOIN f USING (t) JOIN l USING (doc_id), c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
""",
    "op13_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
}
