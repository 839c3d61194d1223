"""DuckDB SQL of the queries in ``catalog_queries``."""

_CATALOG = """WITH cat AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS date, 'order ' || o_orderkey AS name, 'maker ' || o_custkey AS company,
         CASE o_orderstatus WHEN 'P' THEN '' WHEN 'O' THEN 'link ' || o_orderkey END AS link,
         o_orderpriority AS comment,
         CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 0 END AS downloaded
  FROM orders)
"""

_TITLES = """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || ' ' || p_type || ' + extra'
  ELSE 'up [' || lpad(p_partkey::VARCHAR, 6, '0') || '] [1234567] [' || p_size || ' MB] [' || p_name || '] ' || p_type || ' + extra' END AS dn FROM part"""

_FROM_BRACKET = "CASE WHEN instr({x}, '[') > 1 THEN substr({x}, instr({x}, '[')) ELSE {x} END"
_NORM = "trim(regexp_replace(lower(text), '[\\s\\p{Z}]+', ' ', 'g'))"



def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _before_plus(x: str) -> str:
    return f"regexp_replace({x}, '(?s)\\s*\\+.*$', '')"


#: Characters that end a word: RE2's own word boundary knows ASCII only.
_EDGE = "[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\x{200c}\\x{200d}]"
_SPACE = "[\\s\\x0b\\x85\\p{Z}]"


def _comparable(x: str) -> str:
    """The comparison form of a name.  A dropped word takes the characters around it as groups and puts them back; two passes find words that share one."""
    strip = lambda y: f"regexp_replace({y}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    out = _FROM_BRACKET.format(x=strip(x))
    out = f"lower(regexp_replace({out}, '(?s){_SPACE}*\\+.*$', ''))"
    out = f"translate({out}, '・♡❤♥~～！：', '')"
    around = lambda y, word: f"regexp_replace({y}, '(^|{_EDGE}){word}($|{_EDGE})', '\\1\\2', 'g')"
    without = lambda y, part: f"regexp_replace({y}, '{part}', '', 'g')"
    for _ in range(2):
        out = around(out, f"(?:disc|disk){_SPACE}*\\p{{Nd}}+")
    out = without(out, "\\[\\p{Nd}{7,}\\]")
    out = without(out, f"\\[{_SPACE}*\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?{_SPACE}*(?:kb|mb|gb|tb){_SPACE}*\\]")
    for word in ("(?:crack|patch|update)", f"mini{_SPACE}*adv"):
        for _ in range(2):
            out = around(out, word)
    return strip(f"regexp_replace({out}, '(?:{_SPACE}|[-_.])+', ' ', 'g')")


_KEYWORDS = f"""n AS (SELECT *, {_FROM_BRACKET.format(x="dn")} AS name FROM t),
g AS (SELECT *, list_transform(regexp_extract_all(name, '\\[([^\\]]+)\\]', 1), lambda x: trim(x)) AS tags FROM n),
k AS (SELECT *, list_filter(tags, lambda x: regexp_full_match(x, '\\d{{6}}'))[1] AS d,
             list_filter(tags, lambda x: NOT regexp_full_match(x, '\\d{{6,}}') AND NOT regexp_full_match(lower(x), '\\s*\\d+(?:\\.\\d+)?\\s*(?:kb|mb|gb|tb)\\s*'))[1] AS o FROM g),
w AS (SELECT *, CASE WHEN d IS NOT NULL AND o IS NOT NULL THEN '[' || d || '] [' || o || ']' WHEN d IS NOT NULL THEN '[' || d || ']'
                     WHEN o IS NOT NULL THEN '[' || o || ']' ELSE substr(trim({_before_plus("name")}), 1, 30) END AS keyword FROM k)"""

_PAGE = _CATALOG + "SELECT substr(date, 1, 4)::INT AS year, substr(date, 6, 2)::INT AS month, name, company, link AS download_url, NULL::VARCHAR AS match_name, comment, coalesce(downloaded, 0) AS downloaded FROM cat "

_SHIPPED = """
WITH c AS (
  SELECT p_partkey, 'm' || strftime(l_shipdate, '%m') || ' ' || l_returnflag AS name, 'm' || lpad((p_size %% 12 + 1)::VARCHAR, 2, '0') AS month, l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, 'link ' || l_orderkey AS link
  FROM part JOIN lineitem ON p_partkey = l_partkey),
t AS (SELECT *, {tier} AS tier FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM t)
SELECT p_partkey, tier, name, l_orderkey, link FROM r WHERE rn = 1""".replace("%%", "%")

_INGEST = """
WITH RECURSIVE items AS (
  SELECT p_partkey AS o, '2001-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') AS date, array_to_string((string_split(p_name || ' ' || p_type, ' '))[1:p_size % 3 + 1], ' ') AS name, 'm' || (p_size % 5) AS company FROM part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY company, length(name), o) AS pos FROM items WHERE NOT (contains(name, 'ring') OR contains(name, 'gear'))),
keys AS (SELECT date, name AS k, regexp_replace(name, ' [^ ]*$', '') AS parent, min(pos) AS f FROM ranked GROUP BY date, name),
walk AS (
  SELECT a.date, a.k, a.f AS t FROM keys a LEFT JOIN keys b ON a.date = b.date AND b.k = a.parent AND a.parent <> a.k WHERE b.k IS NULL
  UNION ALL
  SELECT c.date, c.k, CASE WHEN w.t IS NULL OR w.t > c.f THEN c.f END FROM walk w JOIN keys c ON c.date = w.date AND c.parent = w.k AND c.k <> w.k),
fresh AS (SELECT r.date, r.name, r.company FROM walk w JOIN ranked r ON r.date = w.date AND r.pos = w.t),
old AS (SELECT date, name, min(company) AS company FROM items WHERE o % 9 = 0 GROUP BY ALL)
"""



def _existence(scope: str) -> str:
    """Verdicts on the links of ``part`` over the files of ``supplier`` in a scope."""
    return f"""
WITH t AS ({_TITLES}), {_KEYWORDS},
m AS (SELECT p_partkey AS id, dn, keyword, sha1('m|' || p_partkey) AS h, {_comparable("dn")} AS norm,
             coalesce(regexp_extract_all(dn, '\\[(\\d{{6}})\\]', 1)[1], '') AS code,
             {_strip("regexp_replace(" + _FROM_BRACKET.format(x=_before_plus("dn")) + ", '\\[[^\\]]+\\]', '', 'g')")} AS title FROM w WHERE p_partkey % 10 <> 0),
f AS (SELECT s_suppkey AS file, s_nationkey * 1000 || '|pc' || s_suppkey AS more, CASE WHEN s_nationkey % 2 = 0 THEN '[' || lpad(s_suppkey::VARCHAR, 6, '0') || '] [x' || s_name || ']'
             ELSE 'old red ' || lpad(s_suppkey::VARCHAR, 6, '0') || ' ' || s_name END AS name FROM supplier WHERE {scope}),
fn AS (SELECT *, {_comparable("name")} AS fnorm FROM f),
searches AS (SELECT id, norm, 0 AS level, keyword AS word FROM m UNION ALL SELECT id, norm, 1, code FROM m
             UNION ALL SELECT id, norm, 2, CASE WHEN length(title) >= 3 THEN substr(title, 1, 20) ELSE '' END FROM m),
found AS (SELECT s.id, s.level, s.norm, fn.file, fn.name, fn.more, fn.fnorm FROM searches s JOIN fn ON s.word <> '' AND contains(fn.name, s.word)),
level_hits AS (SELECT * FROM found WHERE (id, level) IN (SELECT id, min(level) FROM found GROUP BY id)),
matched AS (SELECT id, file, name, more FROM level_hits WHERE norm <> '' AND fnorm <> '' AND (contains(norm, fnorm) OR contains(fnorm, norm))),
tasked AS (SELECT DISTINCT m.id FROM m JOIN supplier ON s_acctbal > 5000 AND m.h = sha1('m|' || s_suppkey)),
by_hash AS (SELECT m.id, fn.file, fn.name, fn.more FROM m JOIN fn ON contains(fn.name, substr(m.h, 1, 12)) AND norm <> '' AND fnorm <> '' AND (contains(norm, fnorm) OR contains(fnorm, norm))
            WHERE m.id NOT IN (SELECT id FROM matched) AND m.id NOT IN (SELECT id FROM tasked)),
every AS (SELECT id, count(*) AS n, string_agg(name || '|' || more, ',' ORDER BY name, file) AS names FROM (SELECT DISTINCT * FROM matched UNION SELECT * FROM by_hash) GROUP BY id),
low AS (SELECT DISTINCT m.id FROM m JOIN fn ON contains(fn.name, substr(keyword, 1, greatest(8, length(keyword) // 3))))
SELECT p_partkey AS magnet_id, every.id IS NOT NULL OR tasked.id IS NOT NULL AS exists,
       CASE WHEN every.id IS NOT NULL OR tasked.id IS NOT NULL THEN 'high' WHEN low.id IS NOT NULL THEN 'low' ELSE 'none' END AS confidence,
       coalesce(names, '') AS matched_files, coalesce(n, 0) AS n_matched, tasked.id IS NOT NULL AS in_tasks,
       CASE WHEN p_partkey % 10 = 0 THEN '磁链解析失败: invalid_btih' END AS message
FROM part LEFT JOIN every ON p_partkey = every.id LEFT JOIN tasked ON p_partkey = tasked.id LEFT JOIN low ON p_partkey = low.id"""


_CUSTOMER_TREE = "WITH RECURSIVE t AS (SELECT c_custkey AS folder_id, c_custkey // 3 AS parent_id, 'c' || c_nationkey AS name FROM customer)"

#: Links of ``part`` and what a check of all of them finds.
_CHECKED = f"""
WITH v AS ({_existence("true")}),
c AS (SELECT p_partkey AS k, '2001-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') AS date, 'title ' || p_partkey AS name, p_partkey % 5 <> 0 AS linked, v.exists, v.confidence, v.message,
             CASE WHEN p_partkey % 10 <> 0 THEN sha1('m|' || p_partkey) END AS h FROM part JOIN v ON v.magnet_id = p_partkey)
"""
_EDITS = _CATALOG + """, n AS (SELECT *, substr(name, 7)::BIGINT AS k FROM cat),
one AS (SELECT count(*) AS n FROM n WHERE k = 1),
e AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'not_found' WHEN k % 7 = 0 AND k <> 1 THEN 'collision' ELSE 'affected' END AS outcome FROM n WHERE k % 11 = 0)
"""
_ANSWERS = """
SELECT CASE WHEN p_partkey % 4 = 0 THEN 'false' ELSE 'true' END AS ok, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey::VARCHAR END AS dn,
       CASE WHEN p_partkey % 4 <> 0 THEN sha1(p_partkey::VARCHAR) END AS infohash_hex, CASE WHEN p_partkey % 4 = 0 THEN 'not_magnet' END AS error FROM part"""
_YEARS = "(SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS y FROM orders)"

ORACLES = {
    "catalog_listing": _CATALOG + "SELECT substr(date, 1, 4) AS year, substr(date, 6, 2) AS month, name, company, link AS download_url, NULL::VARCHAR AS match_name, comment, coalesce(downloaded, 0) AS downloaded, NULL::VARCHAR AS infohash_hex FROM cat",
    "catalog_years": _CATALOG + "SELECT DISTINCT substr(date, 1, 4)::INT AS year FROM cat",
    "catalog_latest_month": _CATALOG + "SELECT substr(max(date), 1, 4)::INT AS year, substr(max(date), 6, 2)::INT AS month FROM cat",
    "catalog_page": _CATALOG + "SELECT substr(date, 1, 4)::INT AS year, substr(date, 6, 2)::INT AS month, name, company, link AS download_url, NULL::VARCHAR AS match_name, comment, coalesce(downloaded, 0) AS downloaded FROM cat WHERE date = '1996-03' ORDER BY name, company LIMIT 50 OFFSET 50",
    "catalog_month_total": _CATALOG + "SELECT date, count(*) AS total, ceil(count(*) / 50)::BIGINT AS pages FROM cat GROUP BY date",
    "links_to_check": _CATALOG + "SELECT date, name, link FROM cat WHERE link IS NOT NULL AND link <> ''",
    "missing_enrichment": "SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL",
    "present_enrichment": "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "skip_list_filter": "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name <> '' AND p_brand <> '' AND NOT (contains(p_name, 'ring') OR contains(p_name, 'gear'))",
    "delete_list_clean": "SELECT p_partkey, trim(replace(trim(replace(trim(replace(trim(replace(p_name || ' ' || p_type, 'small red', '')), 'ECONOMY', '')), 'small', '')), 'red', '')) AS name FROM part",
    "normalize_name": r"SELECT doc_id, trim(regexp_replace(replace(replace(replace(text, 'The ', ' '), 'der', ' '), '-', ' '), '[\s\p{Z}]+', ' ', 'g')) AS name FROM documents",
    "keyword_relax": r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}\p{M}_\s\p{Z}]', '', 'g') AS words, length(replace(text, '-', ''))::BIGINT AS bare_length, length(replace(text, '-', ' '))::BIGINT AS spaced_length FROM documents",
    "greedy_prefix_dedup": """
WITH RECURSIVE items AS (
  SELECT p_brand AS date, array_to_string((string_split(p_name || ' ' || p_type, ' '))[1:p_size % 3 + 1], ' ') AS name, 'm' || (p_size % 5) AS company, p_partkey AS o FROM part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY company, length(name), o) AS pos FROM items),
keys AS (SELECT date, name AS k, regexp_replace(name, ' [^ ]*$', '') AS parent, min(pos) AS f FROM ranked GROUP BY date, name),
walk AS (
  SELECT a.date, a.k, a.f AS t FROM keys a LEFT JOIN keys b ON a.date = b.date AND b.k = a.parent AND a.parent <> a.k WHERE b.k IS NULL
  UNION ALL
  SELECT c.date, c.k, CASE WHEN w.t IS NULL OR w.t > c.f THEN c.f END FROM walk w JOIN keys c ON c.date = w.date AND c.parent = w.k AND c.k <> w.k)
SELECT r.date, r.name, r.company FROM walk w JOIN ranked r ON r.date = w.date AND r.pos = w.t""",
    "insert_or_ignore": """
WITH old AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL),
     fresh AS (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)
SELECT * FROM old UNION ALL SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.user_id = f.user_id AND o.event_type = f.event_type)""",
    "insert_counts": """
WITH old AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16'),
     batch AS (SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
     fresh AS (SELECT DISTINCT * FROM batch EXCEPT SELECT * FROM old)
SELECT (SELECT count(*) FROM batch) AS fetched, (SELECT count(*) FROM fresh) AS inserted, (SELECT count(*) FROM batch) - (SELECT count(*) FROM fresh) AS skipped""",
    "partial_update": """
WITH p AS (SELECT o_custkey, arg_max(CASE o_orderstatus WHEN 'P' THEN '' WHEN 'O' THEN 'OPEN' END, o_orderkey) FILTER (o_orderstatus IN ('P', 'O')) AS s,
                  arg_max(o_totalprice, o_orderkey) FILTER (o_totalprice > 300000) AS p FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, c_nationkey, coalesce(p.p, c_acctbal) AS c_acctbal, coalesce(p.s, c_mktsegment) AS c_mktsegment
FROM customer LEFT JOIN p ON c_custkey = o_custkey""",
    "delete_by_key": "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "tiered_top1": """
WITH c AS (
  SELECT p_partkey, 'm' || strftime(l_shipdate, '%m') || ' ' || l_returnflag AS name, 'm' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') AS month, l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, 'link ' || l_orderkey AS link
  FROM part JOIN lineitem ON p_partkey = l_partkey),
t AS (SELECT *, CASE WHEN contains(name, month) AND contains(name, 'R') THEN 1 WHEN contains(name, month) AND contains(name, 'A') THEN 2 WHEN contains(name, month) THEN 3 ELSE 4 END AS tier FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM t)
SELECT p_partkey, tier, name, l_orderkey, l_linenumber, l_suppkey, CASE WHEN tier < 4 THEN link END AS link FROM r WHERE rn = 1""",
    "early_release_flag": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate < date_trunc('month', o_orderdate) AS early,
       CASE WHEN l_shipdate < date_trunc('month', o_orderdate) THEN strftime(l_shipdate, '%Y-%m-%d') END AS comment
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fallback_lookup": """
WITH i AS (SELECT s_suppkey, s_nationkey AS nation, floor(s_acctbal / 1000)::BIGINT AS step FROM supplier),
c AS (SELECT c_nationkey AS nation, floor(c_acctbal / 1000)::BIGINT AS step, c_custkey FROM customer),
a AS (SELECT nation, step, count(*) AS n, min(c_custkey) AS least FROM c GROUP BY ALL),
b AS (SELECT nation, count(*) AS n, min(c_custkey) AS least FROM c GROUP BY ALL)
SELECT s_suppkey, 1 AS level, n, least FROM i JOIN a USING (nation, step)
UNION ALL SELECT s_suppkey, 2, b.n, b.least FROM i JOIN b USING (nation) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.nation = i.nation AND a.step = i.step)""",
    "url_params": "WITH q AS (SELECT page_id, CASE WHEN contains(split_part(url, '#', 1), '?') THEN regexp_replace(split_part(url, '#', 1), '^[^?]*\\?', '') ELSE '' END AS q FROM pages) SELECT page_id, "
    + ", ".join(f"nullif(url_decode(replace(regexp_extract(q, '(?:^|&){n}=([^&]+)', 1), '+', ' ')), '') AS {n}" for n in ("page", "ref", "utm_source"))
    + " FROM q",
    "magnet_parts": "SELECT p_partkey, true AS ok, upper(sha1(p_name || '|' || p_partkey)) AS btih, p_name AS dn, 'udp://t' || p_size AS trackers, sha1(p_name || '|' || p_partkey) AS infohash_hex, '' AS errors FROM part",
    "compare_normalize": f"SELECT doc_id, {_comparable('text')} AS name FROM documents",
    "compare_normalize_all": f"SELECT doc_id, {_comparable('text')} AS name FROM documents",
    "bracket_keyword": f"WITH t AS ({_TITLES}), {_KEYWORDS} SELECT p_partkey, keyword FROM w",
    "existence_confidence": _existence("true"),
    "existence_in_folder": _existence("s_suppkey % 11 IN (2, 4, 5, 8, 9, 10)"),
    "containment_match": f"WITH b AS (SELECT item_id, {_NORM} AS b FROM benchmark), d AS (SELECT doc_id, {_NORM} AS d FROM documents) SELECT item_id, doc_id FROM b JOIN d ON b.b <> '' AND d.d <> '' AND (contains(d.d, b.b) OR contains(b.b, d.d))",
    "infohash_base32": "WITH h AS (SELECT doc_id, sha1(coalesce(text, '')) AS h FROM documents) SELECT doc_id, h AS infohash_hex, "
    + " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz234567', ((('0x' || substr(h, {10 * c + 1}, 10))::BIGINT >> {35 - 5 * d}) & 31)::INT + 1, 1)" for c in range(4) for d in range(8))
    + " AS infohash_base32, h AS back FROM h",
    "bencode_infohash": "SELECT doc_id, sha1('d6:lengthi' || n_chars || 'e4:name' || strlen(source) || ':' || source || 'e') AS infohash_hex FROM documents",
    "torrent_metadata": "SELECT doc_id, sha1('d6:lengthi' || n_chars || 'e4:name' || strlen(source) || ':' || source || 'e') AS infohash_hex, source AS name, n_chars AS total_size, source AS path FROM documents",
    "torrent_total_size": "SELECT conv_id, count(*) AS n_files, sum(length(text))::BIGINT AS total_size FROM conversations GROUP BY conv_id",
    "html_links": "SELECT page_id, len(l)::BIGINT AS n_links, coalesce(array_to_string(l, ' '), '') AS links FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS l FROM pages)",
    "ingest_progress": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS fetched, count(*) FILTER (WHERE event_type = 'click') AS inserted, count(*) FILTER (WHERE event_type <> 'click') AS skipped, round(round(count(*) FILTER (WHERE event_type = 'click') / count(*) * 100, 2), 1) AS progress FROM events GROUP BY 1",
    "month_grid": f"SELECT y::INT AS year, m::INT AS month, format('{{:04d}}-{{:02d}}', y, m) AS date FROM {_YEARS} a, range(3, 12) b(m)",
    "json_first_key": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS found FROM events",
    "additive_schema": "SELECT c_name AS name, c_mktsegment AS company, NULL::VARCHAR AS link, NULL::VARCHAR AS match_name, 0 AS downloaded, NULL::VARCHAR AS infohash_hex FROM customer",
    "duplicate_links": "SELECT doc_id, uses FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS uses FROM documents WHERE text <> '') WHERE uses > 1",
    "missing_links": _CATALOG + "SELECT date, name, link FROM cat WHERE date = '1996-03' AND coalesce(link, '') = ''",
    "catalog_page_of_year": _PAGE + "WHERE date LIKE '1997-%' ORDER BY year DESC, month DESC, name, company LIMIT 50 OFFSET 100",
    "catalog_page_of_month": _PAGE + "WHERE date LIKE '%-02' ORDER BY year DESC, month DESC, name, company LIMIT 50 OFFSET 50",
    "listing_html_rows": "SELECT p_partkey, p_name AS name, p_brand AS company, 0 AS row FROM part WHERE NOT (contains(p_name, 'ring') OR contains(p_name, 'gear'))",
    "candidate_html_rows": "SELECT o_orderkey, 'A & ' || o_orderkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'magnet:?xt=urn:btih:' || sha1(o_orderkey::VARCHAR) END AS link, '1 GB' AS size, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS released, 0 AS ordinal FROM orders",
    "json_first_at_any_depth": "SELECT event_id, event_type AS kind, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "lenient_numbers": "SELECT p_partkey, CASE WHEN p_partkey % 7 < 2 THEN p_size WHEN p_partkey % 7 = 4 THEN p_size * 10 ELSE 7 END::BIGINT AS number FROM part",
    "month_arithmetic": """
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m') AS before, strftime(date_trunc('month', o_orderdate) + INTERVAL 13 MONTH, '%Y-%m') AS after,
       year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, strftime(o_orderdate, '%y%m') AS tag, strftime(o_orderdate, '%Y-%m') AS date FROM orders""",
    "run_ids": "SELECT o_orderkey, '/store/' || year(o_orderdate) AS path, epoch(o_orderdate)::BIGINT || ':' || o_orderkey || ':' || year(o_orderdate) || ':' || month(o_orderdate) AS run FROM orders",
    "month_grid_of_all_months": f"SELECT y::INT AS year, m::INT AS month, format('{{:04d}}-{{:02d}}', y, m) AS date FROM {_YEARS} a, range(1, 13) b(m)",
    "magnet_escapes": "SELECT p_partkey, '%zzA ' || p_name || '%4' AS dn, sha1(p_partkey::VARCHAR) AS infohash_hex, true AS ok FROM part",
    "magnet_mismatch": """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'infohash_mismatch,timeout' WHEN p_size % 3 = 1 THEN 'infohash_mismatch' ELSE '' END AS errors FROM part""",
    "request_answers": _ANSWERS,
    "request_answers_streamed": _ANSWERS,
    "status_lines": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS fetched, count(*) FILTER (WHERE event_type = 'click') AS inserted, count(*) FILTER (WHERE event_type <> 'click') AS skipped FROM events GROUP BY 1",
    "stored_status": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS fetched, count(*) FILTER (WHERE event_type = 'click') AS inserted, count(*) FILTER (WHERE event_type <> 'click') AS skipped FROM events GROUP BY 1",
    "stored_months": _CATALOG + "SELECT date, name, link, CASE WHEN date = '1996-03' THEN 'again' ELSE comment END AS comment FROM cat WHERE date <> '1996-03' OR link <> ''",
    "torrent_files": """
SELECT doc_id, sha1('d5:filesld6:lengthi' || n_chars || 'e4:pathl1:a' || strlen(source) || ':' || source || 'eed6:lengthi7e4:pathl1:a' || strlen(lang) || ':' || lang || 'eei3ee4:name2:dde') AS infohash_hex,
       'dd' AS name, n_chars + 7 AS total_size, 'a/' || source || ',a/' || lang AS paths, NULL::VARCHAR AS error FROM documents""",
    "tiered_one_tag": _SHIPPED.format(tier="CASE WHEN contains(name, month) AND contains(name, 'R') THEN 1 WHEN contains(name, month) THEN 2 ELSE 3 END"),
    "tiered_month_first": _SHIPPED.format(tier="CASE WHEN contains(name, month) AND contains(name, 'R') THEN 1 WHEN contains(name, month) THEN 2 WHEN contains(name, 'R') THEN 3 ELSE 4 END"),
    "run_summary": """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS date, CASE WHEN min(o_totalprice) < 1500 THEN count(*) FILTER (o_orderstatus = 'P') < 40 END AS ok FROM orders GROUP BY 1)
SELECT count(ok) AS finished_months, count(*) AS total_months, coalesce(bool_and(ok), true) AS success FROM m""",
    "check_summary": _CATALOG
    + """, e AS (SELECT date || '/' || name || ': timeout' AS error FROM cat WHERE link = '' ORDER BY error LIMIT 10)
SELECT count(*) AS checked, count(*) FILTER (downloaded = 1) AS found_downloaded, (SELECT coalesce(string_agg(error, ',' ORDER BY error), '') FROM e) AS errors FROM cat""",
    "key_collisions": "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "mark_downloaded": _CATALOG
    + """, n AS (SELECT *, substr(name, 7)::BIGINT AS k FROM cat)
SELECT date, name, CASE WHEN k % 7 = 0 THEN 1 ELSE downloaded END AS downloaded, CASE WHEN k % 7 = 0 THEN sha1(name || '|' || (2 - k % 2)) END AS infohash_hex FROM n""",
    "edit_rows": _EDITS
    + """SELECT n.date, CASE WHEN outcome = 'affected' AND n.k % 2 = 0 THEN n.name || ' b' ELSE n.name END AS name, n.company,
       CASE WHEN outcome = 'affected' AND n.k % 3 = 0 THEN '' WHEN outcome = 'affected' AND n.k % 3 = 1 THEN 'l' ELSE n.link END AS link,
       CASE WHEN outcome = 'affected' AND n.k % 5 = 0 THEN 1 ELSE n.downloaded END AS downloaded FROM n LEFT JOIN e ON n.k = e.k""",
    "edit_outcomes": _EDITS
    + """SELECT CASE WHEN k % 13 = 0 THEN '1900-01' ELSE date END AS date, name,
       CASE WHEN k % 7 <> 0 AND k % 2 <> 0 AND k % 3 = 2 AND k % 5 <> 0 THEN 'empty' ELSE outcome END AS outcome FROM e""",
    "delete_outcomes": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 100000000 END AS c_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'affected' ELSE 'not_found' END AS outcome FROM orders",
    "ingest_listings": _INGEST + "SELECT * FROM old UNION ALL SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.date = f.date AND o.name = f.name)",
    "ingest_counts": _INGEST
    + """, k AS (SELECT count(*) AS fetched, count(*) FILTER (NOT EXISTS (SELECT 1 FROM old o WHERE o.date = f.date AND o.name = f.name)) AS inserted FROM fresh f)
SELECT fetched, inserted, fetched - inserted AS skipped, fetched > 0 AS success FROM k""",
    "enrich_catalog": """
WITH own AS (SELECT p_partkey AS k, (1995 + p_size % 3) || '-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') AS date, CASE WHEN p_partkey % 17 <> 0 THEN p_name || '-' || p_partkey END AS name,
                    CASE p_partkey % 4 WHEN 0 THEN 'has' WHEN 1 THEN '' END AS link FROM part),
c AS (SELECT own.k, strftime(l_shipdate, '%y%m') || ' ' || l_returnflag AS match_name, 'link ' || l_orderkey AS new_link, l_linenumber || ' GB' AS size, l_shipdate, l_orderkey, l_linenumber, l_returnflag,
             substr(replace(date, '-', ''), 3) AS tag, CASE WHEN own.k % 3 = 0 AND l_linenumber <= 5 THEN 1 ELSE 2 END AS level
      FROM own JOIN lineitem ON own.k = l_partkey WHERE own.k % 3 < 2 AND own.k % 4 <> 0),
l AS (SELECT * FROM c WHERE (k, level) IN (SELECT k, min(level) FROM c GROUP BY k)),
t AS (SELECT *, CASE WHEN contains(match_name, tag) AND contains(match_name, 'R') THEN 1 WHEN contains(match_name, tag) AND contains(match_name, 'A') THEN 2 WHEN contains(match_name, tag) THEN 3 ELSE 4 END AS tier FROM l),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, l_shipdate DESC NULLS LAST, l_orderkey, l_linenumber, l_returnflag) AS rn FROM t) WHERE rn = 1)
SELECT date, name, CASE WHEN b.k IS NULL THEN link WHEN tier < 4 THEN new_link END AS link, CASE WHEN b.k IS NULL THEN 'sz' ELSE size END AS size,
       CASE WHEN b.k IS NULL THEN 'mn' ELSE match_name END AS match_name, 'old' AS comment
FROM own LEFT JOIN b ON own.k = b.k AND name IS NOT NULL""",
    "folder_paths": _CUSTOMER_TREE
    + """, p AS (SELECT folder_id, '/' || name AS path FROM t WHERE parent_id = folder_id UNION ALL SELECT t.folder_id, p.path || '/' || t.name FROM p JOIN t ON t.parent_id = p.folder_id AND t.folder_id <> p.folder_id)
SELECT folder_id, path FROM p""",
    "folder_subtree": _CUSTOMER_TREE + ", p AS (SELECT folder_id FROM t WHERE folder_id = 7 UNION ALL SELECT t.folder_id FROM p JOIN t ON t.parent_id = p.folder_id) SELECT folder_id FROM p",
    "check_all_marks": _CHECKED + "SELECT date, name, CASE WHEN linked AND exists THEN 1 ELSE 0 END AS downloaded, CASE WHEN linked AND exists THEN h END AS infohash_hex FROM c",
    "check_all_runs": _CHECKED
    + """SELECT 1 AS run, count(*) AS checked, count(*) FILTER (exists) AS found_downloaded FROM c WHERE linked AND date = '2001-03'
UNION ALL SELECT 2, count(*), count(*) FILTER (exists) FROM c WHERE linked AND date <> '2001-03'
UNION ALL SELECT 3, 0, 0
UNION ALL SELECT 4, count(*), 0 FROM c WHERE k % 9 = 0""",
    "check_all_ledger": _CHECKED
    + f"""SELECT c.date, c.name, sha256('magnet:?xt=urn:btih:' || CASE WHEN k % 10 = 0 THEN 'none' ELSE sha1('m|' || k) END || '&dn=' || replace(url_encode(dn), '%20', '+')) AS link_hash, exists, confidence, h AS infohash_hex, message
FROM c JOIN ({_TITLES}) t ON t.p_partkey = k WHERE linked""",
    "month_run": """
WITH y AS (SELECT year(o_orderdate)::VARCHAR AS date, count(*) AS fetched, count(*) FILTER (o_orderstatus IN ('P', 'O')) AS inserted, count(*) FILTER (o_orderstatus = 'P') AS updated FROM orders GROUP BY 1)
SELECT 1 AS attempt, date, date <> '1996' AS ok, CASE WHEN date <> '1996' THEN fetched END AS fetched, CASE WHEN date <> '1996' THEN inserted END AS inserted, CASE WHEN date <> '1996' THEN updated END AS updated,
       CASE WHEN date = '1996' THEN true END AS told FROM y
UNION ALL SELECT 2, date, true, fetched, inserted, updated, NULL FROM y""",
    "deep_pages": _CATALOG
    + """, r AS (SELECT row_number() OVER (ORDER BY date DESC, name, company) AS place, substr(date, 1, 4)::INT AS year, substr(date, 6, 2)::INT AS month, name, company, link AS download_url FROM cat)
SELECT * FROM r WHERE (place > 300 AND place <= 350) OR (place > 1100 AND place <= 1150)""",
    "run_states": """
WITH e AS (SELECT user_id::VARCHAR AS run, ts, event_type = 'purchase' AS done, lag(ts) OVER w AS before, coalesce(lag(event_type = 'purchase') OVER w, true) AS ended FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type = 'purchase')),
r AS (SELECT run, arg_max(done, (ts, done)) AS done, max(ts) AS last, count(*) FILTER (NOT ended AND epoch_ms(ts) - epoch_ms(before) > 86400000) AS stops FROM e GROUP BY run),
s AS (SELECT *, CASE WHEN done THEN 'finished' WHEN epoch_ms((SELECT max(ts) FROM events)) - epoch_ms(last) > 86400000 THEN 'stopped' ELSE 'running' END AS state FROM r)
SELECT run, state, CASE WHEN state = 'stopped' THEN 'not_running' END AS reason, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_beat, stops + (state = 'stopped')::INT AS stops FROM s""",
    "gram_search": """
WITH b AS (SELECT '2001-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') AS date, p_name || ' ' || p_partkey AS name FROM part),
a AS (SELECT date, CASE WHEN date IN ('2001-02', '2001-05') THEN name || ' string' ELSE name END AS name FROM b WHERE date <> '2001-07' UNION ALL SELECT '2001-09', 'spring ' || s_name FROM supplier)
SELECT 'before' AS when, date, name FROM b WHERE contains(name, 'ring') UNION ALL SELECT 'after', date, name FROM a WHERE contains(name, 'ring')""",
}
