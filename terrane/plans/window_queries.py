"""Ordered operators, classification and planning over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.operators import incremental, windows
from terrane.plans.tables import table


def _days(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_suppkey", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("day"))


def greedy_windows(spark, sf_dir):
    return windows.greedy_windows(_days(spark, sf_dir), "l_suppkey", "day")


_DAYS_SQL = "days AS (SELECT DISTINCT l_suppkey, CAST(datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS day FROM lineitem)"
_GREEDY_SQL = f"""{_DAYS_SQL},
w AS (SELECT l_suppkey, 1 AS window_no, min(day) AS start_line FROM days GROUP BY 1
  UNION ALL SELECT w.l_suppkey, w.window_no + 1, (SELECT min(day) FROM days d WHERE d.l_suppkey = w.l_suppkey AND d.day > w.start_line + 127)
  FROM w WHERE EXISTS (SELECT 1 FROM days d WHERE d.l_suppkey = w.l_suppkey AND d.day > w.start_line + 127))"""
GREEDY_SQL = f"WITH RECURSIVE {_GREEDY_SQL} SELECT l_suppkey, window_no, start_line FROM w"


def done_set(spark, sf_dir):
    """How many distinct lines lie in all earlier windows."""
    days = _days(spark, sf_dir).distinct()
    w = windows.greedy_windows(days, "l_suppkey", "day")
    per = windows.window_of(days, w, "l_suppkey", "day").groupBy("l_suppkey", "window_no").agg(F.count("*").alias("n"))
    over = F.sum("n").over(windows.W.partitionBy("l_suppkey").orderBy("window_no").rowsBetween(windows.W.unboundedPreceding, -1))
    return per.select("l_suppkey", "window_no", "n", F.coalesce(over, F.lit(0)).alias("done_before"))


DONE_SQL = f"""WITH RECURSIVE {_GREEDY_SQL},
per AS (SELECT w.l_suppkey, w.window_no, count(*) AS n FROM w JOIN days d ON d.l_suppkey = w.l_suppkey AND d.day BETWEEN w.start_line AND w.start_line + 127 GROUP BY 1, 2)
SELECT l_suppkey, window_no, n, CAST(coalesce(sum(n) OVER (PARTITION BY l_suppkey ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS done_before FROM per"""


def adjacent_merge_pairwise(spark, sf_dir):
    e = windows.adjacent_merge(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return e.groupBy("user_id", "island", "pair").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n")).select("user_id", "first_id", "last_id", "n")


MERGE_SQL = """
WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER o THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM a),
c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) - 1) // 2 AS pair FROM b)
SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM c GROUP BY user_id, island, pair"""


def kind_layer_map(spark, sf_dir):
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "call").when(flag == "N", F.when(F.col("l_linestatus") == "F", "variable").otherwise("function")).when(flag == "R", "return").otherwise("statement")
    out = table(spark, sf_dir, "lineitem").select(kind.alias("kind"))
    return out.select("kind", T.node_kind(F.col("kind")).alias("node_kind"), T.layer_of(F.col("kind")).alias("layer")).groupBy("kind", "node_kind", "layer").agg(F.count("*").alias("n"))


KIND_SQL = """
WITH k AS (SELECT CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'variable' ELSE 'function' END WHEN 'R' THEN 'return' ELSE 'statement' END AS kind FROM lineitem)
SELECT kind, CASE WHEN kind IN ('function', 'method', 'type', 'interface', 'file') THEN 'group' WHEN kind = 'call' THEN 'call' WHEN kind IN ('if', 'else') THEN 'decision'
  WHEN kind = 'loop' THEN 'loop' WHEN kind = 'return' THEN 'output' WHEN kind = 'variable' THEN 'state' ELSE 'action' END AS node_kind,
  CASE kind WHEN 'call' THEN 'calls' WHEN 'return' THEN 'data' WHEN 'variable' THEN 'state' ELSE 'flow' END AS layer, count(*) AS n FROM k GROUP BY ALL"""


def label_builder(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "if").when(F.col("event_type") == "click", "loop").when(F.col("event_type") == "purchase", "return").when(F.col("event_type") == "signup", "else").otherwise("call")
    cond = F.when(F.col("event_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("v"), (F.col("event_id") % 7).cast("string"), F.lit(" ")))
    name = F.when(F.col("user_id") % 2 == 0, "range").otherwise("for")
    e = e.select("event_id", kind.alias("kind"), cond.alias("condition"), name.alias("name"))
    label, summary = T.label_and_summary(F.col("kind"), F.lit(None).cast("string"), F.col("name"), F.col("condition"))
    return e.select("event_id", label.alias("label"), summary.alias("summary"))


LABEL_SQL = """
WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'if' WHEN 'click' THEN 'loop' WHEN 'purchase' THEN 'return' WHEN 'signup' THEN 'else' ELSE 'call' END AS kind,
  trim(CASE WHEN event_id % 5 = 0 THEN '  ' ELSE 'v' || (event_id % 7) || ' ' END) AS c, CASE WHEN user_id % 2 = 0 THEN 'range' ELSE 'for' END AS name FROM events)
SELECT event_id, CASE WHEN kind = 'else' THEN 'else' WHEN kind = 'call' THEN 'Вызов ' || name WHEN kind = 'loop' THEN trim(name || ' ' || c) ELSE trim(kind || ' ' || c) END AS label,
  CASE WHEN kind IN ('if', 'loop', 'return') AND c <> '' THEN c END AS summary FROM e"""


def _plan(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    files = docs.select(F.col("doc_id").alias("path"), T.content_hash(F.col("text")).alias("hash"), F.lit("k1").alias("cache_key"))
    state = labels.join(docs.select("doc_id", T.content_hash(F.col("text")).alias("h")), "doc_id").select(
        F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("h")).alias("hash"), F.lit("k1").alias("cache_key"),
        F.concat(F.lit("r/"), F.col("doc_id").cast("string")).alias("report_path"), F.when(F.col("toxic") == 1, "failed").alias("error"),
    )
    return incremental.update_plan(files, state)


def update_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


_PLAN_SQL = """
SELECT doc_id AS path, sha256(text) AS hash,
  CASE WHEN toxic = 1 AND doc_id % 5 <> 0 THEN 'error' WHEN toxic IS NOT NULL AND doc_id % 5 <> 0 THEN 'ready' ELSE 'pending' END AS status,
  CASE WHEN toxic IS NOT NULL AND doc_id % 5 <> 0 THEN 'r/' || doc_id END AS report_path,
  CASE WHEN toxic = 1 AND doc_id % 5 <> 0 THEN 'failed' END AS error
FROM documents LEFT JOIN labels USING (doc_id)"""


def plan_totals(spark, sf_dir):
    return incremental.plan_totals(_plan(spark, sf_dir))


TOTALS_SQL = f"SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'ready') AS cached FROM ({_PLAN_SQL})"


def path_union(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()


def label_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def _all():
    return {
        "greedy_windows": (greedy_windows, GREEDY_SQL),
        "done_set": (done_set, DONE_SQL),
        "adjacent_merge_pairwise": (adjacent_merge_pairwise, MERGE_SQL),
        "kind_layer_map": (kind_layer_map, KIND_SQL),
        "label_builder": (label_builder, LABEL_SQL),
        "update_plan": (update_plan, _PLAN_SQL),
        "plan_totals": (plan_totals, TOTALS_SQL),
        "path_union": (path_union, "SELECT o_custkey AS path FROM orders UNION SELECT c_custkey FROM customer"),
        "label_except": (label_except, "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"),
    }


QUERIES = {k: f for k, (f, _) in _all().items()}
ORACLES = {k: sql for k, (_, sql) in _all().items()}
