"""The commands end to end on a small Go module and a small TypeScript project."""

import dataclasses
import json
import weakref

import pytest
from pyspark.sql import functions as F

from terrane.api import Project
from terrane.operators import labels, tree, validate, view
from terrane.sources import files, golang, typescript

GO = '''package store

import (
	"fmt"
	"os"
)

type Box struct{ n int }

func (b *Box) Put(v int) error {
	if v < 0 {
		return fmt.Errorf("bad")
	} else if v == 0 {
		b.n = 1
	}
	for i := 0; i < v; i++ {
		b.n += twice(i)
	}
	return nil
}

func twice(x int) int { return x * 2 }

func Load(name string) (int, error) {
	data, err := os.ReadFile(name)
	switch len(data) {
	case 0:
		return 0, err
	default:
		go twice(1)
	}
	return len(data), nil
}
'''
MAIN = 'package main\n\nimport "example.org/demo/store"\n\nfunc main() {\n\tb := &store.Box{}\n\tb.Put(1)\n\tstore.Load("x")\n}\n'
TS = 'import { help } from "./help.js"\n\nexport async function run(q: string): Promise<number> {\n  const n = await help(q)\n  if (n > 1) {\n    console.log(n)\n  }\n  return n\n}\n'
HELP = 'export function help(q: string): number {\n  for (const c of q) {\n    fetch(c)\n  }\n  return q.length\n}\n'


def test_go_rows():
    out = golang.extract("example.org/demo", {"store/store.go": GO, "main.go": MAIN})
    assert [p["id"] for p in out["packages"]] == ["example.org/demo", "example.org/demo/store"]
    pairs = {(c["from"].split("/")[-1], c["to"]) for c in out["calls"]}
    assert ("store.Box.Put", "example.org/demo/store.twice") in pairs
    assert ("demo.main", "example.org/demo/store.Load") in pairs
    assert {(e["kind"], e["detail"]) for e in out["effects"]} == {("file_system", "os.ReadFile"), ("other", "goroutine")}
    kinds = [e["kind"] for e in out["entities"]]
    assert kinds.count("else") == 1 and kinds.count("if") == 2 and kinds.count("case") == 2 and kinds.count("loop") == 1


def test_broken_go_package_keeps_its_row_only():
    out = golang.extract("m", {"a/a.go": "package a\nfunc f() {", "b/b.go": "package b\nfunc G() {}\n"})
    assert {p["id"] for p in out["packages"]} == {"m/a", "m/b"} and out["errors"][0]["file"] == "a/a.go"
    assert {s["id"] for s in out["symbols"]} == {"m/b.G"}


def test_ts_rows():
    out = typescript.extract({"src/run.ts": TS, "src/help.ts": HELP, "src/types.d.ts": "declare const x: number"})
    assert {(c["from"], c["to"]) for c in out["calls"]} == {("src/run.ts:run", "src/help.ts:help"), ("src/run.ts:run", "console.log"), ("src/help.ts:help", "fetch")}
    assert {e["kind"] for e in out["effects"]} == {"log", "network"}
    run = next(s for s in out["symbols"] if s["name"] == "run")
    assert run["is_async"] and run["is_exported"] and (run["source"]["start_line"], run["source"]["end_line"]) == (3, 9)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("demo")
    (root / "store").mkdir()
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.ts").write_text("export const x = 1")
    (root / "go.mod").write_text("module example.org/demo\n")
    (root / "store" / "store.go").write_text(GO)
    (root / "main.go").write_text(MAIN)
    return Project(spark, str(root), now=lambda: 0)


def test_file_tree_and_symbols(project):
    assert [(r["path"], r["language"]) for r in project.get_file_tree().collect()] == [("main.go", "go"), ("store/store.go", "go")]
    assert [r["name"] for r in project.get_symbols().collect()] == ["main", "Put", "Load", "twice"]


def test_reports(project):
    whole = project.analyze_project()
    assert whole["edges"] == 0 and whole["nodes"] == 5  # package, file, Box, Box.Put, Load
    assert project.analyze_project() == whole
    one = project.analyze_function("example.org/demo/store.Load")
    assert one["nodes"] == 8
    text = project.read_report(project.list_reports().first()["path"])
    assert "DATA=" in text and "</script></body>" in text


def test_plan_update_and_edit(project):
    plan = {r["path"]: r for r in project.get_update_plan().collect()}
    assert {r["status"] for r in plan.values()} == {"pending"}
    out = project.update_file("store/store.go", plan["store/store.go"]["hash"])
    assert out["nodes"] >= 15
    assert {r["path"]: r["status"] for r in project.get_update_plan().collect()} == {"main.go": "pending", "store/store.go": "ready"}
    before = project.read_report(out["report_path"])
    assert project.rerender_report("store/store.go") == out["report_path"] and project.read_report(out["report_path"]) == before
    with open(f"{project.root}/store/store.go", "a") as f:
        f.write("// more\n")
    assert {r["path"]: r["status"] for r in project.get_update_plan().collect()}["store/store.go"] == "pending"
    with pytest.raises(ValueError, match="changed"):
        project.update_file("store/store.go", plan["store/store.go"]["hash"])


def test_settings_and_palette(project):
    project.save_palette([{"type": "t", "label": "T", "color": "#000", "icon": "🌐", "description": ""}])
    assert [r["icon"] for r in project.get_palette().collect()] == ["globe"]
    assert project.check_connection()
    assert project.detect_test_commands() == {"unit": "go test ./..."}


def _nodes(spark, rows):
    cols = "report STRING, id STRING, parent_id STRING, ord INT, depth INT, path STRING, kind STRING, label STRING, layer STRING, file STRING, start_line INT, end_line INT, symbol STRING, summary STRING, coverage_ids ARRAY<STRING>, group_id STRING"
    return spark.createDataFrame(rows, cols)


def test_pairwise_merge(spark):
    row = lambda k, i, g: ("r", i, None, k, 0, f"{k:08d}", "action", i, "flow", "f", k, k, None, "s", [i], g)
    out = labels.merge_groups(_nodes(spark, [row(1, "a", "g"), row(2, "b", "g"), row(3, "c", "g"), row(4, "d", None)]))
    got = {r["id"]: (list(r["coverage_ids"]), r["start_line"], r["end_line"], r["group_id"]) for r in out.collect()}
    assert got == {"a": (["a", "b"], 1, 2, None), "c": (["c"], 3, 3, "g"), "d": (["d"], 4, 4, None)}


def test_strict_labels(spark):
    row = lambda k, i: ("r", i, None, k, 0, f"{k:08d}", "action", i, "flow", "f", k, k, None, None, [i], None)
    nodes = _nodes(spark, [row(1, "a"), row(200, "b")])
    with pytest.raises(ValueError, match="omitted 'b'"):
        labels.label(nodes, lambda n: labels.offline(n).filter("id = 'a'"))
    out = labels.label(nodes)
    assert {r["id"]: r["summary"] for r in out.collect()} == {"a": "a", "b": "b"}


def test_validation_errors(spark, project):
    m = project.model()
    nodes = tree.file_reports(m, spark.createDataFrame([("store/store.go",)], "path STRING"))
    nodes = labels.label(nodes)
    assert validate.validate(nodes, m, "file")[1].count() == 0
    unit = nodes.filter(F.size("coverage_ids") > 0).first()["id"]
    lost = nodes.withColumn("coverage_ids", F.when(F.col("id") == unit, F.array().cast("array<string>")).otherwise(F.col("coverage_ids")))
    assert [r["message"] for r in validate.validate(lost, m, "file")[1].collect()] == [f"coverage: missing AST unit '{unit}'"]
    odd = nodes.withColumn("kind", F.when(F.col("id") == unit, F.lit("odd")).otherwise(F.col("kind")))
    assert [r["message"] for r in validate.validate(odd, m, "file")[1].collect()] == [f"schema: node '{unit}': kind is unknown"]
    edges = spark.createDataFrame([("store/store.go", "x", "y", "verified")], "report STRING, `from` STRING, `to` STRING, status STRING")
    assert validate.edge_errors(edges, nodes).count() == 2 and validate.backed_edges(edges, nodes, m).first()["status"] == "inferred"


@pytest.mark.parametrize("module,texts", [(golang, {f"p/c{k}.go": GO for k in range(20)}), (typescript, {f"src/r{k}.ts": TS for k in range(20)} | {"src/help.ts": HELP})])
def test_a_group_passes_file_by_file(monkeypatch, module, texts):
    parse, alive, most = module.parse, weakref.WeakSet(), []

    def counted(path, text):
        f = parse(path, text)
        alive.add(f.source)
        most.append(len(alive))
        return f

    monkeypatch.setattr(module, "parse", counted)
    out = module.extract("m", texts) if module is golang else module.extract(texts)
    assert {len(out["errors"]), len(out["packages"])} == {0, 1} and len(out["calls"]) > 20 and max(most) <= 2


def test_groups_beyond_memory_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(files, "_HELD", 64)
    monkeypatch.setattr(files, "_OUT", 200)
    texts = {"src/run.ts": TS, "src/help.ts": HELP, "src/again.ts": 'export { help } from "./help.js"\nimport { help } from "./help.js"\n', "src/far.ts": TS.replace("./help.js", "./again.js").replace("run", "far")}
    rows = [("p", "m", "typescript", path, text) for path, text in texts.items()]
    got = files.extract(spark.createDataFrame(rows, "project STRING, module STRING, language STRING, path STRING, text STRING")).collect()
    want = [(name, json.dumps(row, ensure_ascii=False)) for name, some in typescript.extract(texts).items() for row in some]
    assert sorted((r["relation"], r["row"]) for r in got) == sorted(want)
    assert ("src/far.ts:far", "src/help.ts:help") in {(json.loads(r)["from"], json.loads(r)["to"]) for name, r in want if name == "calls"}


def test_validation_snaps_only_what_lines_need(spark, project):
    m = project.model()
    nodes = labels.label(tree.file_reports(m, spark.createDataFrame([("store/store.go",)], "path STRING")))
    nodes = spark.createDataFrame(nodes.collect(), nodes.schema)
    errors = validate.validate(nodes, m, "file", edges=view.structural_edges(nodes))[1]
    assert errors._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 4  # snapped once: to symbols, last lines, calls
    low = F.col("source").withField("end_line", F.lit(0))
    odd = dataclasses.replace(m, symbols=m.symbols.withColumn("source", low))
    assert {r["message"].split(" has ")[-1] for r in validate.validate(nodes, odd, "file")[1].collect()} == {"invalid source range 0-0"}
