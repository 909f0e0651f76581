"""Queries over texts: numbered lines, hashes, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.plans.tables import table


def numbered_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), T.numbered_line(F.col("i") + 1, F.col("line")).alias("numbered"))


_LINES_SQL = r"""
  SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[1:len(parts)-1] ELSE parts END AS lines
  FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS parts FROM documents)"""

NUMBERED_SQL = f"""
SELECT doc_id, CAST(i AS INTEGER) AS line_no, printf('%04d | %s', i, lines[i]) AS numbered
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM ({_LINES_SQL}))"""


def line_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.lines_of(F.col("text"))).cast("long").alias("n_lines"))


LINE_COUNT_SQL = f"SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines FROM ({_LINES_SQL})"


def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


CONTENT_HASH_SQL = "SELECT doc_id, sha256(text) AS hash FROM documents"


def merkle_fingerprint(spark, sf_dir):
    """One hash of all paths and contents: SHA-256 over ordered hashes, in ranges of 4096 ids, then 4096 ranges, then all.

    A task sees one range's hashes at a time, and the last one a sixteen-millionth of the rows."""
    leaf = F.sha2(F.concat(F.col("doc_id").cast("string").cast("binary"), F.lit(b"\0"), F.col("text").cast("binary"), F.lit(b"\0")), 256)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("at"), leaf.alias("h"))
    ordered = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ""), 256)
    for _ in range(2):
        rows = rows.groupBy(F.expr("at div 4096").alias("up")).agg(ordered.alias("h")).withColumnRenamed("up", "at")
    return rows.agg(ordered.alias("fingerprint"))


MERKLE_SQL = r"""
WITH l AS (SELECT doc_id AS a, sha256(encode(CAST(doc_id AS VARCHAR)) || '\x00'::BLOB || encode(text) || '\x00'::BLOB) AS h FROM documents),
r AS (SELECT a // 4096 AS a, sha256(string_agg(h, '' ORDER BY a)) AS h FROM l GROUP BY l.a // 4096),
s AS (SELECT a // 4096 AS a, sha256(string_agg(h, '' ORDER BY a)) AS h FROM r GROUP BY r.a // 4096)
SELECT sha256(string_agg(h, '' ORDER BY a)) AS fingerprint FROM s"""


def scan_filter_language(spark, sf_dir):
    """Pages by the language part of their path; mobile and blog hosts are skipped."""
    p = table(spark, sf_dir, "pages").select("page_id", "url").filter(~F.col("url").rlike(r"^https?://(m|blog)\."))
    return p.select("page_id", F.nullif(F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1), F.lit("")).alias("language")).filter("language is not null")


SCAN_SQL = r"""SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS language FROM pages
WHERE NOT regexp_matches(url, '^https?://(m|blog)\.') AND regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) <> ''"""


def embed_json(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.script_safe_json(F.col("html")), 256).alias("hash"))


def extract_json(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("reply: "), "props", F.lit(" end"))).otherwise("no object")
    return table(spark, sf_dir, "events").select("event_id", T.extract_json(raw).alias("object"))


EXTRACT_SQL = r"""SELECT event_id, CASE event_id % 3 WHEN 2 THEN '' ELSE props END AS object FROM events"""


def search_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(T.matches_search(F.col("text"), F.col("source"), " Thing ")).select("doc_id")


def dir_prefix_tree(spark, sf_dir):
    """Directories of all paths with their parents and depths."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    parts = table(spark, sf_dir, "pages").select(F.array_remove(F.split(path, "/"), "").alias("p"))
    dirs = parts.select(F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"), "p").select(F.array_join(F.slice("p", F.lit(1), F.col("depth")), "/").alias("path"), "depth", F.when(F.col("depth") > 1, F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), "/")).alias("parent"))
    return dirs.distinct()


DIRS_SQL = r"""
WITH p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS p FROM pages),
d AS (SELECT p, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS depth FROM p)
SELECT DISTINCT array_to_string(p[1:depth], '/') AS path, depth, CASE WHEN depth > 1 THEN array_to_string(p[1:depth - 1], '/') END AS parent FROM d"""

#: Rules in order; the first that fits the host counts.
HOST_RULES = [(0, "%.example.com"), (1, "m.%"), (2, "%.net"), (3, "%")]


IMPORT_SQL = r"""SELECT page_id, min(rule) AS rule FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) JOIN (VALUES """ + ", ".join(f"({n}, '{p}')" for n, p in HOST_RULES) + r""") r(rule, pattern) ON host LIKE pattern GROUP BY 1"""

_ALL = {
    "numbered_source": (numbered_source, NUMBERED_SQL),
    "line_count": (line_count, LINE_COUNT_SQL),
    "content_hash": (content_hash, CONTENT_HASH_SQL),
    "merkle_fingerprint": (merkle_fingerprint, MERKLE_SQL),
    "scan_filter_language": (scan_filter_language, SCAN_SQL),
    "embed_json": (embed_json, r"SELECT page_id, sha256(replace(html, '</', '<\/')) AS hash FROM pages"),
    "extract_json": (extract_json, EXTRACT_SQL),
    "search_hits": (search_hits, "SELECT doc_id FROM documents WHERE contains(lower(text), 'thing') OR contains(lower(source), 'thing')"),
    "dir_prefix_tree": (dir_prefix_tree, DIRS_SQL),
}
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
