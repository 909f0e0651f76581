"""Every registered query against its SQL on the smallest tables, and ordered operators against plain Python."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from terrane.operators import layout, snap, windows
from terrane.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    rel = duck.sql(registry.ORACLES[name])
    assert names == sorted(rel.columns)
    want = rel.project(", ".join(f'"{c}"' for c in names)).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(names).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["go_entities", "ts_entities"])
def test_entities_are_extracted_once(spark, duck, name):
    """Parsing takes nearly all of the time and rows are many: the lines of the entities above come with the rows, without a join."""
    over, *below = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")
    assert len(below) == 1 and "Exchange" not in over


def test_greedy_windows_and_merge(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(1, 900)) for k in range(5) for _ in range(120)]
    got = windows.greedy_windows(spark.createDataFrame(rows, "f INT, line INT"), "f", "line").collect()
    want = set()
    for k in range(5):
        start = no = None
        for x in sorted({x for f, x in rows if f == k}):
            if start is None or x > start + 127:
                start, no = x, (no or 0) + 1
                want.add((k, no, x))
    assert {tuple(r) for r in got} == want

    events = [(k, i, rng.choice(["a", "a", "b", None])) for k in range(4) for i in range(60)]
    out = windows.adjacent_merge(spark.createDataFrame(events, "k INT, i INT, g STRING"), "k", ["i"], "g").groupBy("k", "island", "pair").agg(F.array_sort(F.collect_list("i")).alias("is")).collect()
    want = []
    for k in range(4):
        kept = []
        for _, i, g in (e for e in events if e[0] == k):
            if kept and g is not None and kept[-1][1] == g:
                kept[-1] = ([*kept[-1][0], i], None)
            else:
                kept.append(([i], g))
        want += [(k, tuple(x)) for x, _ in kept]
    assert sorted((r["k"], tuple(r["is"])) for r in out) == sorted(want)


def test_nearest(spark):
    rng = random.Random(2)
    left = [(i, rng.choice("xy"), rng.randint(0, 80)) for i in range(60)]
    right = [(rng.choice("xy"), rng.randint(0, 80), i) for i in range(25)]
    out = snap.nearest(spark.createDataFrame(left, "rid INT, f STRING, mid LONG"), spark.createDataFrame(right, "f STRING, line LONG, o INT"), "f", "mid", "line", "rid", ["o"])
    want = {}
    for rid, f, mid in left:
        near = sorted((abs(mid - line), o) for g, line, o in right if g == f and abs(mid - line) <= 5)
        if near:
            want[rid] = near[0]
    assert {r["rid"]: (r["distance"], r["o"]) for r in out.collect()} == want


def test_layers_and_collapse(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node INT")
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (4, 3)], "a INT, b INT")
    assert {r["node"]: r["layer"] for r in layout.longest_path(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 0}
    cycle = spark.createDataFrame([(0, 1), (1, 0)], "a INT, b INT")
    assert layout.longest_path(nodes.limit(2), cycle).count() == 2
    placed = {r["node"]: (r["layer"], r["x"], r["y"]) for r in layout.layered(nodes.select("node", F.lit(100).alias("width"), F.lit(50).alias("height")), edges).collect()}
    assert placed[0][1:] == (40.0, 40.0) and placed[1][2] == 160.0 and placed[5][1] == 320.0
    tree = spark.createDataFrame([("a", "1"), ("b", "1/1"), ("c", "1/1/1"), ("d", "1/2")], "id STRING, path STRING")
    shown = layout.visible_ancestors(tree, spark.createDataFrame([("1/1",)], "path STRING"))
    assert {r["id"]: r["shown"] for r in shown.collect()} == {"a": "a", "b": "b", "c": "b", "d": "d"}


def test_change_stream(spark, tmp_path):
    from terrane.sources.schema import STATE
    from terrane.streaming import changes

    (tmp_path / "in").mkdir()
    row = lambda p, h, t: f'{{"path": "{p}", "hash": "{h}", "cache_key": "k", "seen": "2024-01-01T00:0{t}:00Z"}}\n'
    (tmp_path / "in" / "a.json").write_text(row("x", "1", 0) + row("x", "1", 1) + row("y", "2", 1) + row("z", "3", 1) + row("z", "4", 2))
    state = spark.createDataFrame([("y", "2", "k", "r", None)], STATE)
    seen = []
    q = changes.pending(changes.snapshots(spark, str(tmp_path / "in")), lambda: state, lambda df, _: seen.extend(map(tuple, df.collect())), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("x", "1"), ("z", "4")]
