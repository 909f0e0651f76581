"""Viewer operators and text functions on small rows."""

from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.operators import view


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_positions_and_paths(spark):
    lit = F.lit
    p, n = zip(T.error_position(lit("/p/f.go:7:37")), T.error_position(lit("dom.go:118")), strict=True)
    assert tuple(one(spark, a=p[0], b=n[0], c=p[1], d=n[1])) == ("/p/f.go", 7, "dom.go", 118)
    a, b = T.error_position(lit("nothing"))
    assert tuple(one(spark, a=a, b=b)) == ("", 0)
    r = one(spark, a=T.relative_path(lit("/x/y/"), lit("/x/y/z\\q.go")), b=T.is_within_root(lit("../q")), c=T.is_within_root(lit("..a/q")))
    assert tuple(r) == ("z/q.go", False, True)
    assert one(spark, a=T.source_lines(lit("a\r\nb\nc\n"), lit(2), lit(9)))["a"] == "0002 | b\n0003 | c"


def test_sizes(spark):
    assert one(spark, a=T.wrap(F.lit("aa bb cc dddddddd e"), 48))["a"] == ["aa bb", "cc", "dddddddd", "e"]
    w, h = T.node_size(F.lit("action"), F.lit("short"))
    assert tuple(one(spark, w=w, h=h)) == (140, 44)
    w, h = T.node_size(F.lit("decision"), F.lit("a long condition that wraps into several lines of text in the box"))
    r = one(spark, w=w, h=h)
    assert r["w"] == 280 and r["h"] > 44


def nodes(spark):
    rows = [("r", "a", None, "1", 0, "group", "flow", 1), ("r", "b", "a", "1/1", 1, "decision", "flow", 2), ("r", "c", "b", "1/1/1", 2, "call", "calls", 3), ("r", "d", "a", "1/2", 1, "action", "flow", 4)]
    return spark.createDataFrame(rows, "report STRING, id STRING, parent_id STRING, path STRING, depth INT, kind STRING, layer STRING, start_line INT")


def test_what_shows(spark):
    n = nodes(spark)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(view.visible(n, ["flow"])) == ["a", "b", "d"]
    collapsed = spark.createDataFrame([("r", "1/1")], "report STRING, path STRING")
    assert ids(view.visible(n, ["flow", "calls"], collapsed)) == ["a", "b", "d"]
    assert ids(view.drill_down(n, n.filter("id = 'b'"))) == ["b", "c"]
    edges = spark.createDataFrame([("c", "d"), ("b", "d"), ("a", "b")], "`from` STRING, `to` STRING")
    got = {(r["from"], r["to"]): r["priority"] for r in view.lifted_edges(edges, n, collapsed).collect()}
    assert got == {("a", "b"): 0, ("a", "d"): 0, ("b", "d"): 1}
    assert view.structural_edges(n).count() == 3


def test_arcs(spark):
    n = nodes(spark).withColumn("branches", F.array(F.struct(F.lit("yes").alias("condition"), F.lit("c").alias("target")), F.struct(F.lit("no").alias("condition"), F.lit("zz").alias("target"))))
    assert [(r["from"], r["to"], r["label"]) for r in view.branch_arcs(n).collect()] == [("b", "c", "yes")]
    arcs = spark.createDataFrame([("r", "a", "b"), ("r", "a", "d"), ("r", "b", "c"), ("r", "b", "d")], "report STRING, `from` STRING, `to` STRING")
    assert {(r["from"], r["to"]) for r in view.sequential_arcs(arcs, n).collect()} == {("a", "b"), ("b", "d"), ("b", "c")}


def test_navigation_styles_and_queue(spark):
    symbols = spark.createDataFrame([("s", ("f.go", 1, 2))], "id STRING, source STRUCT<file:STRING,start_line:INT,end_line:INT>")
    asked = spark.createDataFrame([("s", None), ("s", "g.go"), ("t", None)], "symbol STRING, file STRING")
    assert sorted(map(str, (r["file"] for r in view.navigate(asked, symbols).collect()))) == ["None", "f.go", "g.go"]
    n = nodes(spark).withColumn("element_type", F.when(F.col("id") == "a", "db"))
    palette = spark.createDataFrame([("db", "red")], "type STRING, color STRING")
    kinds = spark.createDataFrame([("action", "grey"), ("call", "blue")], "kind STRING, color STRING")
    assert {r["id"]: r["color"] for r in view.styles(n, palette, kinds).collect()} == {"a": "red", "b": "grey", "c": "blue", "d": "grey"}
    plan = spark.createDataFrame([("b", "pending", None), ("a", "error", None), ("c", "error", "r"), ("d", "ready", "r")], "path STRING, status STRING, report_path STRING")
    assert [(r["path"], r["place"]) for r in view.queue(plan).orderBy("place").collect()] == [("a", 1), ("b", 2)]
    done = spark.createDataFrame([("a", None, True), ("b", "bad", True), ("c", None, False)], "path STRING, error STRING, done BOOLEAN")
    assert tuple(view.progress(done).first()) == (3, 2, 1)
    assert one(spark, a=T.status_text(F.lit("error")))["a"] == "ошибка"
