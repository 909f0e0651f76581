"""Validation: anti-joins, coverage, snapping, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import coverage, snap
from terrane.plans.tables import table


def coverage_exactly_once(spark, sf_dir):
    """Orders by their lines; some orders have other numbers, so their lines are unknown and they have none."""
    want = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 4 == 0, 10_000_000).otherwise(0)).alias("id"))
    have = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return coverage.exactly_once(want, have, "id")


COVERAGE_SQL = """
WITH w AS (SELECT o_orderkey + CASE WHEN o_orderkey % 4 = 0 THEN 10000000 ELSE 0 END AS id FROM orders), h AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT * FROM (SELECT coalesce(w.id, h.id) AS id, CASE WHEN w.id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' END AS status, coalesce(n, 0) AS n
FROM w FULL JOIN h ON w.id = h.id) WHERE status IS NOT NULL"""


def _labels(spark, sf_dir):
    """Labels of all documents that have one; the ids of some are altered, so that documents lack theirs and replies are unknown."""
    return table(spark, sf_dir, "labels").select(
        (F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 10_000_000).otherwise(0)).alias("id"),
        F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("label"),
        F.when(F.col("toxic") == 1, "").otherwise("ok").alias("summary"),
    )


_LABELS_SQL = """(SELECT doc_id + CASE WHEN doc_id % 3 = 0 THEN 10000000 ELSE 0 END AS id, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'q' || quality END AS label,
  CASE WHEN toxic = 1 THEN '' ELSE 'ok' END AS summary FROM labels)"""


def label_strict_cover(spark, sf_dir):
    return coverage.strict_cover(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), _labels(spark, sf_dir), "id", "label", "summary")


STRICT_SQL = f"""SELECT * FROM (SELECT coalesce(d.doc_id, l.id) AS id, CASE WHEN d.doc_id IS NULL THEN 'unexpected' WHEN l.id IS NULL THEN 'omitted' WHEN trim(label) = '' THEN 'empty label' WHEN trim(summary) = '' THEN 'empty summary' END AS fault
FROM documents d FULL JOIN {_LABELS_SQL} l ON d.doc_id = l.id) WHERE fault IS NOT NULL"""


def label_apply(spark, sf_dir):
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("label"), F.col("lang").alias("summary"))
    return coverage.apply_labels(nodes, _labels(spark, sf_dir), "id", ["label", "summary"])


APPLY_SQL = f"SELECT d.doc_id AS id, CASE WHEN l.id IS NULL THEN d.source ELSE l.label END AS label, CASE WHEN l.id IS NULL THEN d.lang ELSE l.summary END AS summary FROM documents d LEFT JOIN {_LABELS_SQL} l ON d.doc_id = l.id"

HOUR = 3_600_000_000


def nearest_snap(spark, sf_dir):
    """Each error event snaps to the nearest purchase of its user within an hour; the first one wins a tie."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    left = e.filter("event_type = 'error'").select("event_id", "user_id", F.col("t").alias("at"))
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("t").alias("to"), F.col("event_id").alias("purchase_id"))
    return snap.nearest(left, right, "user_id", "at", "to", "event_id", ["purchase_id"], HOUR)


SNAP_SQL = f"""
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events)
SELECT event_id, distance, purchase_id FROM (SELECT a.event_id, abs(a.t - b.t) AS distance, b.event_id AS purchase_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.event_id) AS r
FROM e a JOIN e b USING (user_id) WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND abs(a.t - b.t) <= {HOUR}) WHERE r = 1"""


def clamp_range(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    last = line.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("last"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 9 - 1).cast("int").alias("s"), (F.col("o_custkey") % 6).cast("int").alias("e"))
    rows = rows.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    a, b = snap.clamp(F.col("s"), F.col("e"), F.col("last"))
    return rows.select("o_orderkey", a.alias("start_line"), b.alias("end_line"))


CLAMP_SQL = """
WITH r AS (SELECT o_orderkey, CAST(o_orderkey % 9 - 1 AS INTEGER) AS s, CAST(o_custkey % 6 AS INTEGER) AS e, coalesce(m, 1) AS m FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
c AS (SELECT o_orderkey, least(greatest(s, 1), m) AS a, least(greatest(e, 1), m) AS b FROM r)
SELECT o_orderkey, least(a, b) AS start_line, greatest(a, b) AS end_line FROM c"""


_ALL = {
    "coverage_exactly_once": (coverage_exactly_once, COVERAGE_SQL),
    "label_strict_cover": (label_strict_cover, STRICT_SQL),
    "label_apply": (label_apply, APPLY_SQL),
    "nearest_snap": (nearest_snap, SNAP_SQL),
    "clamp_range": (clamp_range, CLAMP_SQL),
}
QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items()}
