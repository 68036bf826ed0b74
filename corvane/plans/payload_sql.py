"""DuckDB SQL for payload_queries, written from the definitions and not from the plans."""

from __future__ import annotations

from corvane.functions.text import STOPWORDS
from corvane.functions.tools import DATA, LENGTH, WEIGHT

_PARTS = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', ['scheme', 'host', 'path', 'query', 'fragment']"
_TRACKERS = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'msclkid', 'ref', 'ref_src', 'source'"
STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
_WORD = r"\pL\pM\p{Nd}\p{Pc}"


def _cleaned(name: str, source: str) -> str:
    """CTEs: ``source`` (with an address t) and clean, gone (parameters removed), host, display."""
    return f"""
{name}_1 AS (SELECT *, regexp_extract(t, {_PARTS}) AS u FROM {source}),
{name}_2 AS (SELECT *, [x FOR x IN string_split(u.query, '&') IF x <> ''] AS p FROM {name}_1),
{name}_3 AS (SELECT *, [x FOR x IN p IF lower(string_split(x, '=')[1]) NOT IN ({_TRACKERS})] AS k FROM {name}_2),
{name} AS (
  SELECT * EXCLUDE (u, p, k), (len(p) - len(k))::INT AS gone, CASE WHEN u.host = '' THEN 'web' ELSE u.host END AS host,
         CASE WHEN u.host = '' THEN 'web' ELSE u.host END || CASE WHEN trim(u.path, '/') = '' THEN '' ELSE ' > ' || trim(u.path, '/') END AS display,
         CASE WHEN u.scheme = '' THEN '' ELSE lower(u.scheme) || ':' END || CASE WHEN u.host = '' THEN '' ELSE '//' || u.host END || u.path
         || CASE WHEN len(k) = 0 THEN '' ELSE '?' || array_to_string(k, '&') END || CASE WHEN u.fragment = '' THEN '' ELSE '#' || u.fragment END AS clean
  FROM {name}_3)"""


def marked(text: str, pattern: str) -> str:
    """SQL for ``text`` (escaped already) with the words of ``pattern`` (an alternation) in mark elements.

    A match takes the characters beside it, so a second pass finds the words
    that share one with a word of the first; control characters stand for the marks.
    """
    first = rf"regexp_replace({text}, '(?i)(^|[^{_WORD}])(' || {pattern} || ')($|[^{_WORD}])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"
    second = rf"regexp_replace({first}, '(?i)(^|[^{_WORD}\x01])(' || {pattern} || ')($|[^{_WORD}\x02])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"
    return f"""replace(replace({second}, chr(1), '<mark class="highlight">'), chr(2), '</mark>')"""


def escaped(text: str) -> str:
    return f"""replace(replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')"""


_SERP = f"""
base AS (
  SELECT page_id, page_id // 10 AS query_id, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS position, regexp_replace(url, '[?#].*', '') AS b, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang,
         CASE WHEN page_id % 7 = 3 THEN 'ad' WHEN page_id % 7 = 5 THEN 'promoted' WHEN page_id % 7 = 6 THEN 'none' WHEN page_id % 11 = 4 THEN 'click' ELSE 'organic' END AS kind FROM pages),
linked AS (SELECT *, CASE kind WHEN 'organic' THEN b || '?utm_medium=web&no=' || page_id WHEN 'click' THEN 'https://doubleclick.net/' || page_id ELSE b END AS t FROM base WHERE kind <> 'none'),
{_cleaned('cl', 'linked')},
serp AS (
  SELECT query_id, position, page_id, lang, CASE kind WHEN 'organic' THEN 'Page & ' || page_id WHEN 'ad' THEN 'Offer ' || page_id WHEN 'promoted' THEN 'Promoted post ' || page_id ELSE 'Click ' || page_id END AS title,
         clean AS url, display AS display_url, host AS domain, CASE kind WHEN 'organic' THEN 'Snippet of page ' || page_id || ' <about> ' || lang WHEN 'ad' THEN 'x' WHEN 'promoted' THEN 'y' ELSE '' END AS snippet,
         CASE WHEN kind = 'click' THEN 1 ELSE gone END AS trackers, kind <> 'organic' AS blocked FROM cl)"""
_COUNTS = """
counts AS (SELECT query_id, sum((NOT blocked)::INT)::BIGINT AS organic, sum(blocked::INT)::BIGINT AS ads_blocked, sum(CASE WHEN blocked THEN 0 ELSE trackers END)::BIGINT AS trackers_stripped FROM serp GROUP BY query_id)"""
_NEWS = f"""
base AS (SELECT page_id, page_id // 10 AS query_id, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS position, regexp_replace(url, '[?#].*', '') || '?utm_source=rss&n=' || page_id AS t FROM pages),
{_cleaned('cl', 'base')},
news AS (
  SELECT query_id, position, CASE WHEN page_id % 3 = 0 THEN 'Plain headline ' || page_id ELSE 'Head - line ' || page_id END AS title, clean AS url,
         CASE WHEN page_id % 3 = 0 THEN 'Source &amp; ' || page_id % 4 ELSE 'Paper ' || page_id % 5 END AS source, CASE WHEN page_id % 3 = 0 THEN 'https://s' || page_id % 4 || '.example' ELSE '' END AS source_url,
         'Mon, ' || (page_id % 28 + 1) || ' Jan' AS pub_date, 'News of ' || page_id || ' & more' AS snippet FROM cl)"""


def _windows(name: str, source: str) -> str:
    """CTE: one row (k, n, body) for each window of the words w of ``source``; whole text otherwise."""
    return f"""
{name}_1 AS (SELECT *, [x FOR x IN regexp_split_to_array(whole, '\\s+') IF x <> ''] AS w FROM {source}),
{name}_2 AS (SELECT *, unnest(CASE WHEN len(w) <= 300 THEN [0] ELSE [i FOR i IN range(0, len(w), 260) IF i = 0 OR len(w) - i >= 30] END) AS i FROM {name}_1 WHERE len(w) > 0),
{name} AS (SELECT * EXCLUDE (w, i), i // 260 AS k, least(300, len(w) - i) AS n, CASE WHEN len(w) <= 300 THEN whole ELSE array_to_string(w[i + 1:i + 300], ' ') END AS body FROM {name}_2)"""


_UNITS = ", ".join(f"('{family}', {i}, '{unit}', {factor!r}::DOUBLE, {len(units)})" for family, units in (("length", LENGTH), ("weight", WEIGHT), ("data", DATA)) for i, (unit, factor) in enumerate(units.items()))
_BREAKS = r"'\r\n?|[\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'"
_STORE = rf"""
file AS (
  SELECT doc_id, 'corpus/' || source || '/' || doc_id || '.md' AS file_path, doc_id || '.md' AS file_name, coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN ' and more words' ELSE '' END AS text FROM documents),
clean AS (SELECT *, trim(regexp_replace(text, {_BREAKS}, chr(10), 'g'), ' ' || chr(9) || chr(10)) AS whole FROM file),
{_windows('chunk', 'clean')}"""
_QUOTED = "replace(url_encode({}), '%2F', '/')"

SQL: dict[str, str] = {
    "url_hops": rf"""
WITH raw AS (
  SELECT page_id, page_id % 7 AS kind, url, CASE page_id % 7
    WHEN 0 THEN 'https://www.bing.com/ck/a?!&p=1&u=a1' || rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=') || '&ntb=1' WHEN 1 THEN '//duckduckgo.com/l/?uddg=' || url_encode(url) || '&rut=x'
    WHEN 2 THEN 'https://www.google.com/url?q=' || url_encode(url) || '&sa=U' WHEN 3 THEN 'https://googleadservices.com/pagead?x=' || page_id || '&ref=2'
    WHEN 4 THEN '  ' || regexp_replace(url, '[?#].*', '') || '?gclid=abc&amp;id=' || page_id || '&amp;FBCLID=1 ' WHEN 5 THEN 'https://shop.doubleclick.net/c/' || page_id ELSE url END AS raw FROM pages),
code AS (SELECT *, translate(regexp_extract(raw, '[?&]u=a1([a-zA-Z0-9_-]+)', 1), '-_', '+/') AS c FROM raw),
hop AS (
  SELECT page_id, kind IN (3, 5) AS is_ad, (kind < 3)::INT AS hops, CASE kind WHEN 0 THEN decode(from_base64(rpad(c, (ceil(length(c) / 4.0) * 4)::INT, '='))) WHEN 1 THEN url_decode(regexp_extract(raw, 'uddg=([^&]*)', 1))
    WHEN 2 THEN url_decode(regexp_extract(raw, '[?&]q=([^&]*)', 1)) ELSE trim(replace(raw, '&amp;', '&')) END AS t FROM code),
{_cleaned('cl', 'hop')}
SELECT page_id, CASE WHEN is_ad THEN t ELSE clean END AS clean_url, (hops + CASE WHEN is_ad THEN 1 ELSE gone END)::INT AS trackers_removed, is_ad, host AS domain, display AS display_url FROM cl""",
    "address_queries": r"""
WITH named AS (SELECT page_id, regexp_extract(url, '//([^/?#]*)', 1) AS h, url FROM pages),
asked AS (SELECT page_id, trim(CASE page_id % 7 WHEN 0 THEN h WHEN 1 THEN url WHEN 2 THEN ' ' || h || ':8080/a b ' WHEN 3 THEN 'words of ' || h WHEN 4 THEN '-' || h WHEN 5 THEN h || '.' ELSE 'a_b.' || h END) AS q FROM named),
cut AS (SELECT *, string_split(regexp_extract(q, '^[^:/]*'), '.') AS l, regexp_replace(q, '^[^:/]*', '') AS tail FROM asked),
judged AS (
  SELECT *, regexp_matches(q, '^https?://') OR (len(l) > 1 AND len([x FOR x IN l IF regexp_full_match(x, '[a-zA-Z0-9-]{1,63}') AND x[1] <> '-' AND x[-1] <> '-']) = len(l)
    AND regexp_full_match(l[-1], '[a-zA-Z]{2,}') AND regexp_full_match(tail, '(:[0-9]+)?(/.*)?')) AS is_address FROM cut)
SELECT page_id, is_address, CASE WHEN is_address THEN CASE WHEN starts_with(q, 'http') THEN q ELSE 'https://' || q END END AS url FROM judged""",
    "serp_results": f"WITH {_SERP} SELECT query_id, position, title, url, display_url, domain, snippet, trackers, blocked FROM serp",
    "serp_counts": f"WITH {_SERP}, {_COUNTS} SELECT * FROM counts",
    "serp_with_fallback": f"""
WITH {_SERP}, {_COUNTS}, few AS (SELECT DISTINCT page_id // 10 AS query_id FROM pages EXCEPT SELECT query_id FROM counts WHERE organic >= 5)
SELECT query_id, position, title, url, snippet FROM serp WHERE NOT blocked
UNION ALL SELECT query_id, 1000000, 'Red fox ' || query_id || ' - Wikipedia', 'https://en.wikipedia.org/wiki/Red_fox_' || query_id, 'a fox' FROM few
UNION ALL SELECT query_id, 1000001, 'C/D é - Wikipedia', 'https://en.wikipedia.org/wiki/C/D_%C3%A9', 'second' FROM few""",
    "web_ranking": f"""
WITH {_SERP}, asked AS (SELECT DISTINCT query_id, list_distinct(['page', (query_id * 10)::VARCHAR, query_id::VARCHAR]) AS terms FROM serp),
every AS (
  SELECT query_id, position, url, round(1 / (1 + exp(4 - 8.0 * len(list_intersect(terms, ['snippet', 'page', page_id::VARCHAR, lang])) / len(terms))), 4) AS score, false AS direct FROM serp JOIN asked USING (query_id) WHERE NOT blocked
  UNION ALL SELECT query_id, -1, p.url, 1.0, true FROM asked JOIN pages p ON p.page_id = query_id * 10 WHERE query_id % 2 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY direct DESC, score DESC, position) AS rank, url, score, direct FROM every QUALIFY rank <= 6""",
    "record_results": """
SELECT page_id // 10 AS query_id, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS position, 'Title ' || page_id || ' & more' AS title,
       regexp_replace(url, '[?#].*', '') || '?a=1&b=' || page_id AS url, CASE WHEN page_id % 3 = 1 THEN '' ELSE 'Text of ' || page_id END AS snippet FROM pages WHERE page_id % 5 <> 2""",
    "image_cards": f"""
WITH base AS (SELECT page_id, page_id // 10 AS query_id, regexp_replace(url, '#.*', '') AS t FROM pages WHERE page_id % 4 <> 3), {_cleaned('cl', 'base')}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY page_id) - 1 AS position,
       CASE WHEN page_id % 3 > 0 THEN 'Image ' || page_id || ' <x>' WHEN page_id % 6 = 0 THEN 'described' ELSE 'q' || query_id || ' image' END AS title,
       'https://img.example/' || page_id || '.png' AS image_url, 'https://img.example/' || page_id || '.png' AS thumb_url, clean AS source_url, host AS domain, (page_id % 5 * 100)::INT AS width, (page_id + 1)::INT AS height
FROM cl QUALIFY position < 5""",
    "media_images": """
WITH own AS (SELECT page_id, page_id // 5 AS query_id FROM pages), asked AS (SELECT query_id, count(*) FILTER (page_id % 4 <> 3) AS n FROM own GROUP BY query_id)
SELECT query_id, 'Image ' || page_id AS title, 'https://img.example/' || page_id || '.png' AS image_url, image_url AS thumb_url, image_url AS source_url, 'web' AS domain, 1 AS width, 2 AS height FROM own WHERE page_id % 4 <> 3
UNION ALL SELECT query_id, 'Media 9 of ' || query_id || '.jpg', 'https://media.example/' || query_id || '.jpg', 'https://media.example/' || query_id || '.jpg', 'https://media.example/about/' || query_id, 'commons.wikimedia.org', 640, query_id::INT FROM asked WHERE n < 4
UNION ALL SELECT query_id, 'Media 7 of ' || query_id || '.jpg', '', '', 'https://commons.wikimedia.org', 'commons.wikimedia.org', 0, 0 FROM asked WHERE n < 4""",
    "stored_document": """
WITH now AS (SELECT doc_id, 'corpus/' || source || '/' || doc_id || '.md' AS file_path, coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN ' and more words' ELSE '' END AS t FROM documents WHERE doc_id IN (20, 34, 7) AND doc_id % 17 <> 0)
SELECT file_path, sha256(t) AS file_hash, strlen(t)::BIGINT AS file_size FROM now""",
    "image_neighbours": """
WITH levels AS (
  SELECT vec_id, list_transform(range(72), lambda i: greatest(0, least(255, floor(128 + 512 * embedding[i % 64 + 1]::DOUBLE)))::INT) AS p
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0
), images AS (
  SELECT 2 * vec_id AS image_id, p FROM levels
  UNION ALL SELECT 2 * vec_id + 1, list_transform(range(72), lambda i: CASE WHEN i = vec_id % 72 THEN 255 - p[i + 1] ELSE p[i + 1] END) FROM levels
), hashed AS MATERIALIZED (
  SELECT image_id, array_to_string(list_transform(range(64), lambda k: CASE WHEN p[k // 8 * 9 + k % 8 + 1] < p[k // 8 * 9 + k % 8 + 2] THEN '1' ELSE '0' END), '') AS bits FROM images
), hashes AS MATERIALIZED (SELECT bits, bits::BIT AS b, min(image_id) AS same FROM hashed GROUP BY bits),
near AS (SELECT x.bits, count(*) AS n FROM hashes x JOIN hashes y ON x.bits <> y.bits AND bit_count(xor(x.b, y.b)) <= 4 GROUP BY x.bits)
SELECT image_id,
       array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', 1 + 8 * substr(bits, 4 * k + 1, 1)::INT + 4 * substr(bits, 4 * k + 2, 1)::INT + 2 * substr(bits, 4 * k + 3, 1)::INT + substr(bits, 4 * k + 4, 1)::INT, 1)), '') AS hash,
       same, coalesce(n, 0) AS n_near
FROM hashed JOIN hashes USING (bits) LEFT JOIN near USING (bits)""",
    "image_samples": "SELECT count(*) AS parts, p_brand AS brand, p_type AS type FROM part GROUP BY p_brand, p_type",
    "video_cards": f"""
WITH one AS (SELECT page_id, page_id // 10 AS query_id, substr(md5((page_id - (page_id % 4 = 1)::INT)::VARCHAR), 1, 11) AS id FROM pages WHERE page_id % 20 <= 13),
firsts AS (SELECT query_id, id, min(page_id) AS page_id FROM one GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS n FROM firsts QUALIFY n <= 6),
plain AS (SELECT page_id // 10 AS query_id, 'Plain ' || page_id || '/é' AS title FROM pages QUALIFY row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) <= 3)
SELECT query_id, 'Video & ' || page_id AS title, 'https://www.youtube.com/watch?v=' || id AS url, 'YouTube' AS platform FROM best
UNION ALL SELECT query_id, title, 'https://www.bing.com/videos/search?q=' || {_QUOTED.format('title')}, 'Web Video' FROM plain WHERE query_id NOT IN (SELECT query_id FROM best GROUP BY query_id HAVING count(*) >= 4)""",
    "news_items": f"WITH {_NEWS} SELECT * FROM news WHERE position < 8",
    "json_responses": f"""
WITH {_NEWS}
SELECT query_id, CASE WHEN query_id % 3 = 0 THEN '' ELSE 'news ' || query_id END AS query, 'news' AS category, CASE WHEN query_id % 3 = 0 THEN 0 ELSE least(4, count(*)) END AS total_hits,
       CASE WHEN query_id % 3 = 0 THEN '' ELSE max(title) FILTER (position = 0) END AS first_title, CASE WHEN query_id % 3 = 0 THEN '' ELSE coalesce(max(url) FILTER (position = 3), '') END AS last_url
FROM news GROUP BY query_id""",
    "web_responses": f"""
WITH {_SERP}, {_COUNTS}, firsts AS (SELECT query_id, arg_min(url, position) AS url, arg_min(snippet, position) AS snippet, arg_min(page_id, position) AS page_id, arg_min(lang, position) AS lang FROM serp WHERE NOT blocked GROUP BY query_id)
SELECT q.query_id, 'web' AS mode, least(3, coalesce(organic, 0)) AS total_hits, coalesce(ads_blocked, 0) AS ads, coalesce(trackers_stripped, 0) AS trackers, CASE WHEN q.query_id % 4 = 1 THEN format('{{:g}}', q.query_id * 1000.0::DOUBLE) || ' m' ELSE '' END AS answer,
       coalesce(f.url, '') AS first_url, CASE WHEN f.url IS NULL THEN '' ELSE 'Snippet of ' || CASE WHEN q.query_id % 4 = 1 THEN 'page' ELSE '<mark class="highlight">page</mark>' END || ' ' || f.page_id || ' &lt;about&gt; ' || f.lang END AS first_snippet
FROM (SELECT DISTINCT page_id // 10 AS query_id FROM pages) q LEFT JOIN counts c ON c.query_id = q.query_id LEFT JOIN firsts f ON f.query_id = q.query_id""",
    "shopping": """
WITH part_of AS (
  SELECT *, p_partkey // 20 AS query_id, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) AS n,
         ['www.amazon.com', 'shop.example', 'www.bestbuy.com', 'ebay.example', 'www.walmart.com', 'target.example', 'www.books.example', 'newegg.com', 'bhphotovideo.example'][p_partkey % 9 + 1] AS shop,
         ['Amazon', 'Shop.example', 'Best Buy', 'eBay', 'Walmart', 'Target', 'Books.example', 'Newegg', 'B&H Photo'][p_partkey % 9 + 1] AS named,
         ['www.amazon.com', 'shop.example', 'www.bestbuy.com', 'ebay.example', 'www.walmart.com', 'target.example', 'www.Books.example', 'newegg.com', 'bhphotovideo.example'][p_partkey % 9 + 1] AS written FROM part),
every AS (
  SELECT query_id, 0 AS kind, n, p_name AS title, 'https://www.google.com/search?q=' || url_encode(p_name) || '+buy+online' AS url, CASE WHEN p_size % 3 = 0 THEN 'Verified Store' ELSE p_brand END AS store, '$' || printf('%.2f', p_retailprice) AS price,
         p_type AS snippet, 'ecommerce' AS domain, p_size / 10.0::DOUBLE AS rating FROM part_of WHERE n <= 5
  UNION ALL SELECT query_id, 1, n, p_name || CASE WHEN p_partkey % 4 = 0 THEN ' $' || printf('%.2f', p_retailprice) ELSE '' END, 'https://' || written || '/p?id=' || p_partkey, named,
         CASE p_partkey % 4 WHEN 0 THEN '$' || printf('%.2f', p_retailprice) WHEN 1 THEN '$' || p_size ELSE 'Check Store' END, CASE WHEN p_partkey % 4 = 1 THEN 'now $' || p_size || ' only' ELSE 'cheap' END, shop, NULL FROM part_of)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY kind, n) - 1 AS position, title, url, store, price, snippet, domain, rating FROM every QUALIFY position < 17""",
    "suggestion_lists": "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY suggestion) - 1 AS position, suggestion FROM (SELECT DISTINCT p_partkey % 50 AS query_id, p_name AS suggestion FROM part) QUALIFY position < 8",
    "summary_cards": """SELECT n_nationkey AS query_id, n_name AS title, 'About "' || n_name || '"' AS extract, 'https://en.wikipedia.org/wiki/' || n_name AS url FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey % 5 <> 2""",
    "visual_matches": """
WITH spot AS (SELECT page_id, page_id // 20 AS query_id, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS position FROM pages),
named AS (SELECT query_id, 'Match ' || page_id AS title, row_number() OVER (PARTITION BY query_id ORDER BY page_id) - 1 AS position FROM spot WHERE page_id % 10 < 6)
SELECT a.query_id, a.position, coalesce(n.title, 'Visual Match ' || (a.position + 1)) AS title, 'https://m' || page_id % 7 || '.example/' || page_id || '.jpg' AS image_url, 'm' || page_id % 7 || '.example' AS domain
FROM spot a LEFT JOIN named n ON n.query_id = a.query_id AND n.position = a.position WHERE a.position < 16""",
    "card_descriptions": """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Described <' || page_id || '>' WHEN 1 THEN 'Open ' || page_id ELSE 'Direct destination website for ' || url || '. Click to open.' END AS snippet,
       regexp_extract(url, '//([^/?#]*)', 1) || ' > Direct Destination' AS display_url FROM pages""",
    "image_bytes": f"""
WITH coded AS (
  SELECT p_partkey, p_partkey % 4 AS kind, p_size * 10 AS w, p_partkey + 1 AS h, CASE p_partkey % 4
    WHEN 0 THEN '89504E470D0A1A0A0000000D49484452' || printf('%08X', p_size * 10) || printf('%08X', p_partkey + 1) || '0806000000' WHEN 1 THEN '524946460000000057454250' WHEN 2 THEN 'FFD8FFE0' ELSE '89504E470D0A1A0A00' END AS hex,
    {_QUOTED.format("'https://img.example/a b/' || p_partkey || '?x=1'")} AS link FROM part),
read AS (SELECT *, CASE kind WHEN 1 THEN 'WEBP' WHEN 2 THEN 'JPEG' ELSE 'PNG' END AS format FROM coded)
SELECT p_partkey, format, CASE WHEN kind = 0 THEN w ELSE 800 END AS width, CASE WHEN kind = 0 THEN h ELSE 600 END AS height, CASE WHEN kind = 0 THEN round(w / h::DOUBLE, 2)::VARCHAR || ':1' ELSE '4:3' END AS aspect_ratio,
       round(length(hex) / 2048.0::DOUBLE, 1) AS size_kb, 'data:image/' || lower(format) || ';base64,' || to_base64(from_hex(hex)) AS data_uri, 'https://lens.google.com/uploadbyurl?url=' || link AS google_lens,
       'https://www.bing.com/images/search?view=detailv2&iss=sbi&q=imgurl:' || link AS bing_visual, 'https://tineye.com/search?url=' || link AS tineye, 'https://yandex.com/images/search?rpt=imageview&url=' || link AS yandex FROM read""",
    "tool_answers": """
WITH asked AS (SELECT p_partkey AS query_id, p_partkey % 8 AS k, p_size::DOUBLE AS s, p_size AS n, p_name, p_type FROM part),
worked AS (
  SELECT *, CASE k WHEN 0 THEN s * 1000.0 / 1609.344 WHEN 1 THEN s * 9.0 / 5.0 + 32.0 WHEN 2 THEN s * 1048576.0 / 1024.0 WHEN 3 THEN s / 100.0 * query_id WHEN 4 THEN (s + 2) * 3 - 3.5 WHEN 6 THEN sqrt(s) + 8 WHEN 7 THEN (s - 32.0) * 5.0 / 9.0 END::DOUBLE AS v FROM asked)
SELECT query_id, CASE k WHEN 0 THEN format('{:g}', v) || ' miles' WHEN 1 THEN printf('%.2f', v) || '°F' WHEN 2 THEN format('{:g}', v) || ' KB' WHEN 5 THEN p_name WHEN 7 THEN printf('%.2f', v) || '°C' ELSE format('{:g}', round(v, 8)) END AS title,
       CASE k WHEN 0 THEN n || ' km = ' || format('{:.4g}', v) || ' miles' WHEN 1 THEN n || '° Celsius = ' || printf('%.2f', v) || '° Fahrenheit' WHEN 2 THEN n || ' MB = ' || format('{:.4g}', v) || ' KB'
         WHEN 3 THEN n || '.0% of ' || format('{:g}', query_id::DOUBLE) || ' = ' || format('{:g}', v) WHEN 4 THEN '(' || n || ' + 2) * 3 - 7 / 2 = ' || format('{:g}', v) WHEN 5 THEN p_type
         WHEN 6 THEN 'sqrt(' || n || ') + 2^3 = ' || format('{:g}', round(v, 8)) ELSE n || '° Fahrenheit = ' || printf('%.2f', v) || '° Celsius' END AS extract,
       CASE WHEN k = 5 THEN 'https://e.example' ELSE '#calculator' END AS url, CASE WHEN k IN (0, 1, 2, 7) THEN 'Instant Unit' WHEN k = 5 THEN 'Wikipedia Instant Answer' ELSE 'Instant Math' END AS source,
       CASE WHEN k IN (0, 1, 2, 7) THEN 'unit' WHEN k = 5 THEN 'summary' ELSE 'math' END AS kind FROM worked""",
    "unit_table": f"""
WITH unit(family, i, unit, factor, n) AS (VALUES {_UNITS})
SELECT p_partkey, a.family, format('{{:g}}', (p_size + 0.5)::DOUBLE * a.factor / b.factor) || ' ' || CASE WHEN a.family = 'data' THEN upper(b.unit) ELSE b.unit END AS result
FROM part JOIN unit a ON a.i = p_partkey % a.n JOIN unit b ON b.family = a.family AND b.i = p_partkey // a.n % a.n""",
    "unescaped_titles": "SELECT page_id, chr((page_id % 26 + 65)::INT) || chr((page_id % 26 + 97)::INT) || ' Éé ' || chr(128512) || 'A &lt; &amp; < &nosuch; ©' || page_id || ' & x' || chr(65533) AS text FROM pages",
    "marked_texts": f"""
WITH plain AS (SELECT doc_id, {escaped("coalesce(text, '')")} AS e FROM documents)
SELECT doc_id, md5({marked('e', "'THE|de|sta-te|src'")}) AS marked_md5 FROM plain""",
    "token_places": rf"""
WITH cut AS (SELECT doc_id, regexp_extract_all(text, '[a-zA-Z0-9]+(?:[_\-][a-zA-Z0-9]+)*') AS t, regexp_split_to_array(text, '[a-zA-Z0-9]+(?:[_\-][a-zA-Z0-9]+)*') AS g FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, unnest(t) AS raw, unnest(g[1:len(t)]) AS gap, generate_subscripts(t, 1) AS i FROM cut),
run AS (SELECT *, sum(length(gap) + length(raw)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM each),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position FROM run WHERE lower(raw) NOT IN ({STOP}))
SELECT doc_id, count(*) AS tokens, sum(position)::BIGINT AS positions, sum(stop - length(raw))::BIGINT AS starts, sum(stop)::BIGINT AS ends, sum(length(raw))::BIGINT AS letters FROM kept GROUP BY doc_id""",
    "heading_chunks": rf"""
WITH body AS (SELECT doc_id, lang, source, array_to_string([x FOR x IN regexp_split_to_array(coalesce(text, ''), '\s+') IF x <> ''], ' ') AS b, doc_id % 2 = 0 AS titled FROM documents),
part AS (
  SELECT doc_id, 1 AS start_line, 1 AS end_line, CASE WHEN titled THEN ['Title ' || lang] ELSE [] END AS h, 'Intro ' || lang AS whole FROM body
  UNION ALL SELECT doc_id, 2, 3, [source], trim('# ' || source || chr(10) || b, ' ' || chr(10)) FROM body
  UNION ALL SELECT doc_id, 4, 8, [source, 'Part ' || doc_id], '## Part ' || doc_id || chr(10) || b || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' FROM body
  UNION ALL SELECT doc_id, 9, 10, [source, 'Part ' || doc_id, 'Deep'], '#### Deep' || chr(10) || 'last words' FROM body
  UNION ALL SELECT doc_id, 11, 13, CASE WHEN titled THEN ['End'] ELSE [source, 'End'] END, '# End  ' || chr(10) || chr(10) || 'of ' || doc_id FROM body),
{_windows('chunk', 'part')}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line, k) - 1 AS chunk_index, array_to_string(h, ' > ') AS headings, start_line, end_line, n AS token_count,
       md5(CASE WHEN len(h) > 0 THEN array_to_string(h, ' > ') || chr(10) || chr(10) ELSE '' END || body) AS content_md5 FROM chunk""",
    "file_scan": "SELECT sha256(t || chr(10)) AS file_hash, octet_length(encode(t || chr(10))) AS file_size, t AS text FROM (SELECT n_name || ' é ' || n_regionkey AS t FROM nation)",
    "store_chunks": f"""
WITH {_STORE}
SELECT file_path, count(*) AS chunks, sum(n)::BIGINT AS words, 1 AS first_line, file_name AS headings, round(sum(length(file_name || chr(10) || chr(10) || body))::DOUBLE, 1) AS vector_sum FROM chunk WHERE doc_id % 17 <> 0 GROUP BY file_path, file_name""",
    "chunk_ids": f"""
WITH {_STORE} SELECT file_path, k AS chunk_index, row_number() OVER (ORDER BY file_path, k) - 1 AS doc_id FROM chunk WHERE doc_id % 17 <> 0""",
    "encoded_texts": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS t FROM documents),
n AS (SELECT doc_id, length(t)::DOUBLE AS a, 1.0 + len([x FOR x IN string_split(t, ' ') IF x <> ''])::DOUBLE AS b FROM t)
SELECT doc_id, round((a / sqrt(a * a + b * b))::FLOAT::DOUBLE, 3) AS v0, round((b / sqrt(a * a + b * b))::FLOAT::DOUBLE, 3) AS v1 FROM n""",
    "pair_scores": "SELECT p_partkey, round(1 / (1 + exp(-(length(p_name) - length(p_type)) / 4.0::DOUBLE)), 4) AS score FROM part",
    "store_totals": f"""
WITH {_STORE}, live AS (SELECT DISTINCT doc_id FROM chunk WHERE doc_id % 17 <> 0)
SELECT (SELECT count(DISTINCT doc_id) FROM chunk WHERE doc_id % 10 = 0) AS indexed_files, (SELECT count(*) FROM file WHERE doc_id NOT IN (SELECT doc_id FROM chunk WHERE doc_id % 10 = 0)) AS skipped_files,
       (SELECT count(*) FROM chunk WHERE doc_id % 10 = 0) AS total_chunks_created, 1 AS errors, (SELECT count(*) FROM live) AS total_documents,
       (SELECT sum(octet_length(encode(text)))::BIGINT FROM file JOIN live USING (doc_id)) AS total_bytes, (SELECT count(*) FROM chunk WHERE doc_id % 17 <> 0) AS total_chunks""",
    "value_p95": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value FROM r WHERE i = least(n - 1, floor(n * 0.95::DOUBLE)::BIGINT)""",
    "nation_table": "SELECT '| n_nationkey | n_name |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' FROM nation",
    "pooled_labels": """
WITH e AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS m, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
mean AS (SELECT label, dim, sum(v * m) / greatest(sum(m), 1e-9) AS v FROM e GROUP BY label, dim)
SELECT label, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 5) AS value FROM mean""",
}
