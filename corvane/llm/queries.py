"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.centroids import CLUSTERS, DIMS, ROUNDS, cluster_vectors
from corvane.llm.decontamination import decontaminate
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.html_extraction import extract_main_text
from corvane.llm.license_scan import scan_licenses
from corvane.llm.line_dedup import line_dedup
from corvane.llm.mixing import mix_to_targets
from corvane.llm.ngram_join import ngram_components
from corvane.llm.periodic_runs import periodic_runs, with_planted_periods
from corvane.llm.quality import quality_scores
from corvane.llm.substring_dedup import substring_dedup
from corvane.llm.toxicity import toxicity_scores
from corvane.llm.warc import header_text, page_records, resolve_revisits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_records(_table(spark, sf_dir, "pages")))
    return out.select(F.col("record_id").alias("page_id"), "canonical_url", F.coalesce("response_id", F.lit(-1)).alias("response_id"), "status", header_text(F.col("headers")).alias("headers"), "payload_digest")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, _table(spark, sf_dir, "benchmark"), rewrite=False)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _fold(folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=_fold(5) != 0)
    return out.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), width=3, similarity=(90, 100))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=_fold(4) != 2)
    return out.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",")
    return out.select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licenses"), families.alias("families"), F.coalesce(F.array_max(F.transform("licenses", lambda x: x["probability"])), F.lit(0.0)).alias("best_probability"), F.exists("licenses", lambda x: x["confirmed"]).alias("confirmed"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_planted_periods(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n"))), "")
    found = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.size"), F.col("best.period")
    return found.select("doc_id", "n_runs", "best.start", length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_revisits": op2_revisits,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_mix_sources": op5_mix_sources,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality": op7_quality,
    "op8_main_text": op8_main_text,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroid_clusters": op13_centroid_clusters,
}

_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"



def _lloyd_sql() -> str:
    """Plain k-means, a few CTEs a round."""
    near = "SELECT i, vec_id, v, arg_min(k, struct_pack(d := d, k := k)) AS k, min(d) AS d FROM (SELECT i, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, {c}) GROUP BY i, vec_id, v"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMS})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1)::INT AS k, v AS c FROM kept ORDER BY k LIMIT {CLUSTERS})",
    ]
    for r in range(ROUNDS):
        sums = f"SELECT k, list(m ORDER BY j) AS c FROM (SELECT k, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM n{r}) GROUP BY k, j) GROUP BY k"
        steps += [f"n{r} AS MATERIALIZED ({near.format(c=f'c{r}')})", f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(s.c, o.c) AS c FROM c{r} o LEFT JOIN ({sums}) s USING (k))"]
    steps.append(f"done AS MATERIALIZED ({near.format(c=f'c{ROUNDS}')})")
    return f"WITH {', '.join(steps)} SELECT vec_id, k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM done JOIN c{ROUNDS} USING (k)"


SQL: dict[str, str] = {
    "op1_line_dedup": f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM line),
common AS (SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last_id AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    "op2_revisits": r"""
WITH cut AS (
  SELECT page_id, html, trim(url, ' ') AS raw FROM pages),
part AS (
  SELECT page_id, html, raw,
         regexp_extract(raw, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?', ['host', 'port', 'path', 'query']) AS u FROM cut),
page AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, page_id * 60 AS ts,
         CASE WHEN raw = '' THEN NULL ELSE
           regexp_replace(lower(u.host), '^www\.', '') || CASE WHEN u.port IN ('', '80', '443') THEN '' ELSE ':' || u.port END
           || CASE WHEN u.path = '' THEN '/' ELSE u.path END
           || coalesce('?' || nullif(array_to_string(list_sort([x FOR x IN string_split(u.query, '&')
                IF x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]*|gclid|fbclid|msclkid|sessionid|phpsessid|jsessionid|ref)=')]), '&'), ''), '') END AS canonical_url
  FROM part),
response AS (SELECT page_id, canonical_url, digest, ts, substr(digest, 1, 16) AS etag, 'day ' || (ts // 86400) AS day FROM page),
revisit AS (
  SELECT page_id, canonical_url, CASE WHEN page_id % 5 = 4 THEN ts - 86400 ELSE ts + 7 * 86400 + 1 END AS ts, 'day ' || (ts // 86400) AS last_modified,
         CASE page_id % 4 WHEN 0 THEN substr(digest, 1, 16) WHEN 2 THEN 'W/' || substr(digest, 1, 16) WHEN 3 THEN 'changed' END AS etag
  FROM page),
met AS (
  SELECT v.*, r.page_id AS response_id, r.digest, r.etag AS r_etag, r.day AS r_day
  FROM revisit v ASOF LEFT JOIN response r ON v.canonical_url = r.canonical_url AND v.ts > r.ts),
judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
                 WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = r_etag THEN 'resolved' ELSE 'mismatch' END
                 WHEN last_modified = r_day THEN 'resolved' ELSE 'mismatch' END AS status FROM met)
SELECT page_id, canonical_url, coalesce(response_id, -1) AS response_id, status,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10)
         || 'date: day ' || floor(ts / 86400.0)::BIGINT || chr(10) || 'etag: ' || r_etag END AS headers,
       CASE WHEN status = 'resolved' THEN digest END AS payload_digest
FROM judged
""",
    "op3_decontaminate": rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
gram AS (SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM doc, (SELECT DISTINCT l FROM win) AS ls, unnest(range(1, len(w) - l + 2)) AS r(i)),
hit AS (SELECT doc_id, i, l, item_id FROM gram JOIN win USING (g, l)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + l)) AS r(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos ON pos.doc_id = doc.doc_id LEFT JOIN its ON its.doc_id = doc.doc_id
""",
    "op5_mix_sources": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sized GROUP BY source),
cap AS (SELECT i, source_size * 2.0::DOUBLE AS cap, [5.0, 2.0, 1.0][((i - 1) % 3 + 1)::INT]::DOUBLE AS w, (SELECT sum(source_size) * 1.5::DOUBLE FROM src) AS budget FROM src),
fill AS (
  SELECT 0 AS step, i, cap, w, budget, false AS full_up FROM cap
  UNION ALL
  SELECT step + 1, i, cap, w, budget, full_up OR w * level > cap FROM (
    SELECT *, (budget - coalesce(sum(cap) FILTER (full_up) OVER (), 0)) / nullif(sum(w) FILTER (NOT full_up) OVER (), 0) AS level FROM fill) WHERE step < 60),
final AS (SELECT *, (budget - coalesce(sum(cap) FILTER (full_up) OVER (), 0)) / nullif(sum(w) FILTER (NOT full_up) OVER (), 0) AS level FROM fill WHERE step = 60),
goal AS (SELECT source, source_size, round(CASE WHEN full_up THEN cap ELSE w * level END, 6) AS target FROM src JOIN final USING (i)),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goal),
run AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS own
  FROM sized s JOIN plan g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN budget > 0 AND (upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
""",
    "op6_ngram_join": rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(len(w), 3) - 1], ' ')) AS g
         FROM doc, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
way AS (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link),
reach AS (SELECT u, v FROM way UNION SELECT r.u, w.v FROM reach r JOIN way w ON r.v = w.u),
low AS (SELECT u, least(u, min(v)) AS c FROM reach GROUP BY u)
SELECT doc.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low.c, doc.doc_id) AS component_id
FROM doc LEFT JOIN n ON n.doc_id = doc.doc_id LEFT JOIN low ON low.u = doc.doc_id
""",
    "op9_exact_dedup": """
WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM hashed
""",
    "op11_substring_dedup": r"""
WITH doc AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS g FROM doc, unnest(range(len(w) - 49)) AS r(i)),
own AS (SELECT g, min(doc_id) AS owner FROM win GROUP BY g),
lost AS (SELECT DISTINCT doc_id, x FROM win JOIN own USING (g), unnest(range(i, i + 50)) AS r(x) WHERE owner < doc_id),
word AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) - 1 AS x FROM doc),
kept AS (SELECT word.doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY x) AS t FROM word ANTI JOIN lost ON word.doc_id = lost.doc_id AND word.x = lost.x GROUP BY word.doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept ON doc.doc_id = kept.doc_id
""",
    "op13_centroid_clusters": _lloyd_sql(),
    # runs are islands of equal words a distance q apart; only words within repeated 6-grams can begin one
    "op12_periodic_runs": rf"""
WITH byte AS (SELECT doc_id, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS b FROM documents),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: list_reduce(list_prepend(xor(c, x), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) AS h FROM byte),
plain AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, h, h // 10 AS g FROM documents JOIN crc USING (doc_id)),
told AS (SELECT *, CASE WHEN len(w) > 0 THEN g % len(w) END AS a, CASE WHEN len(w) > 0 THEN 1 + (len(w) - g % len(w)) // (3 + g % 8) END AS p FROM plain),
doc AS MATERIALIZED (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM told),
gram AS MATERIALIZED (SELECT doc_id, i, hash(w[i + 1:i + 6]) AS g FROM doc, unnest(range(len(w) - 5)) AS r(i)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM gram x JOIN gram y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 + q AS e FROM island GROUP BY doc_id, q, k),
run AS MATERIALIZED (SELECT doc_id, s, e - s AS n, min(q) AS q FROM stretch WHERE e - s >= 12 AND e - s >= 2 * q GROUP BY doc_id, s, e),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s, q) = 1),
gone AS (SELECT doc_id, list(DISTINCT x) AS gone FROM run, unnest(range(s + q, s + n)) AS r(x) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM doc),
lost AS (SELECT doc_id, unnest(gone) AS i FROM gone),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN lost ON word.doc_id = lost.doc_id AND word.i = lost.i GROUP BY word.doc_id)
SELECT doc.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.n::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.n // best.q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM doc LEFT JOIN listed ON doc.doc_id = listed.doc_id LEFT JOIN best ON doc.doc_id = best.doc_id LEFT JOIN kept ON doc.doc_id = kept.doc_id
""",
}
