"""The commands of the engine, on one project folder."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import incremental, labels, tree, validate
from terrane.sources import files, model, render, schema

PROMPT_VERSION = "1"
#: Element types a report may use.
PALETTE = [
    {"type": "function", "label": "Функция", "color": "#4c78a8", "icon": "function", "description": "вызываемый код"},
    {"type": "data", "label": "Данные", "color": "#72b7b2", "icon": "database", "description": "состояние и хранение"},
    {"type": "external", "label": "Внешнее", "color": "#e45756", "icon": "globe", "description": "сеть, файлы, очереди"},
]
#: Old icons by the names that replace them.
ICONS = {"ƒ": "function", "💾": "database", "🌐": "globe"}
DEFAULTS = {"base_url": "", "model": "", "api_key": "", "palette": PALETTE}


class Project:
    """root: the project's folder, on a file system that driver and executors share; state lies in a sub-folder of it, or in state_dir."""

    def __init__(self, spark: SparkSession, root: str, state_dir: str | None = None, labeller: labels.Labeller = labels.offline, now=time.time):
        self.spark, self.root, self.labeller, self.now = spark, root.rstrip("/"), labeller, now
        self.dir = state_dir or f"{self.root}/{files.STATE_DIR}"
        os.makedirs(f"{self.dir}/reports", exist_ok=True)

    # Settings and palette.
    def _load(self, name: str, default):
        try:
            with open(f"{self.dir}/{name}.json", encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            return default

    def _save(self, name: str, value) -> None:
        """Written beside and moved into place, so a reader sees the old or the new text."""
        with open(f"{self.dir}/{name}.json.new", "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
        os.replace(f"{self.dir}/{name}.json.new", f"{self.dir}/{name}.json")

    def get_settings(self) -> dict:
        env = {k: os.environ[f"TERRANE_{k.upper()}"] for k in ("base_url", "model", "api_key") if f"TERRANE_{k.upper()}" in os.environ}
        settings = DEFAULTS | env | self._load("settings", {})
        if any(p.get("icon") in ICONS for p in settings["palette"]):
            settings["palette"] = [p | {"icon": ICONS.get(p.get("icon"), p.get("icon"))} for p in settings["palette"]]
            self.save_settings(settings)
        return settings

    def save_settings(self, settings: dict) -> None:
        self._save("settings", settings)

    def get_palette(self) -> DataFrame:
        return self.spark.createDataFrame(self.get_settings()["palette"], "type STRING, label STRING, color STRING, icon STRING, description STRING")

    def save_palette(self, palette: list[dict]) -> None:
        self.save_settings(self.get_settings() | {"palette": palette})

    def check_connection(self) -> bool:
        """Whether the labeller answers: it labels one node."""
        row = ("check", "a", None, 1, 0, "00000001", "action", "a", "flow", "a", 1, 1, None, None, [], None)
        cols = "report STRING, id STRING, parent_id STRING, ord INT, depth INT, path STRING, kind STRING, label STRING, layer STRING, file STRING, start_line INT, end_line INT, symbol STRING, summary STRING, coverage_ids ARRAY<STRING>, group_id STRING"
        return self.labeller(labels.label_windows(self.spark.createDataFrame([row], cols))).count() == 1

    def cache_key(self) -> str:
        s = self.get_settings()
        part = {"prompt_version": PROMPT_VERSION, "model": s["model"], "base_url": s["base_url"], "palette": s["palette"]}
        return hashlib.sha256(json.dumps(part, ensure_ascii=False, sort_keys=True).encode()).hexdigest()

    # Model.
    def _extract(self) -> model.Model:
        found = files.languages(self.spark, self.root)
        rows = files.sources(self.spark, self.root).withColumn("language", files.language_of(F.col("path")))
        rows = rows.filter(F.col("language").isin([x for x in ("go", "typescript", "tsx") if x in found or (x == "tsx" and "typescript" in found)]))
        module = files.module_name(self.spark, self.root) if "go" in found else ""
        rows = rows.withColumn("project", F.lit("p")).withColumn("module", F.lit(module))
        return model.from_texts(rows)

    def model(self) -> model.Model:
        """The cached model if the sources are the same and it has a coverage unit or an error; else a new one."""
        mark = files.fingerprint(self.spark, self.root)
        if self._load("model", {}).get("fingerprint") == mark:
            cached = model.read(self.spark, f"{self.dir}/model-{mark}")
            if not cached.entities.filter("coverage").isEmpty() or not cached.errors.isEmpty():
                return cached
        shutil.rmtree(f"{self.dir}/model-{mark}", ignore_errors=True)
        model.write(self._extract(), f"{self.dir}/model-{mark}")
        self._save("model", {"fingerprint": mark})
        return model.read(self.spark, f"{self.dir}/model-{mark}")

    def rebuild_model(self) -> int:
        """Drops the cached model, makes a new one, and returns its number of symbols."""
        self._save("model", {})
        return self.model().symbols.count()

    def get_file_tree(self) -> DataFrame:
        return files.file_tree(self.spark, self.root)

    def get_symbols(self) -> DataFrame:
        return tree.callables(self.model().symbols)

    # Plan and state.
    def _state(self) -> DataFrame:
        return self.spark.createDataFrame([(r["path"], r["hash"], r["cache_key"], r["report_path"], r["error"]) for r in self._load("state", [])], schema.STATE)

    def _put(self, changes: DataFrame) -> None:
        self._save("state", [r.asDict() for r in incremental.upsert(self._state(), changes).orderBy("path").collect()])

    def get_update_plan(self) -> DataFrame:
        """path, hash, status, report_path, error of every file of a package or with an error."""
        m = self.model()
        paths = m.packages.select(F.explode("files").alias("path")).union(m.errors.select("file")).distinct()
        now = files.sources(self.spark, self.root).select("path", "hash").join(paths, "path", "left_semi").withColumn("cache_key", F.lit(self.cache_key()))
        errors = m.errors.select(F.col("file").alias("path"), F.when(F.col("start_line") > 0, F.concat("file", F.lit(":"), F.col("start_line").cast("string"), F.lit(": "), "message")).otherwise(F.concat("file", F.lit(": "), "message")).alias("message"))
        return incremental.update_plan(now, incremental.retain(self._state(), now), errors).orderBy("path")

    # Reports.
    def _write(self, nodes: list[dict], title: str, level: str, path: str | None = None) -> dict:
        report = render.nest(nodes, title, level)
        used = {r["file"] for r in nodes if r["file"]}
        texts = {r["path"]: r["text"] for r in files.sources(self.spark, self.root).filter(F.col("path").isin(sorted(used))).collect()} if used else {}
        stamp = time.strftime("%Y%m%d-%H%M%S", time.localtime(self.now()))
        digest = hashlib.sha256(render.script_json(report).encode()).hexdigest()[:8]
        path = path or f"{self.dir}/reports/report-{level}-{stamp}-{digest}.html"
        with open(path, "w", encoding="utf-8") as f:
            f.write(render.page(report, self.get_settings()["palette"], texts))
        with open(path.removesuffix(".html") + ".dsl.json", "w", encoding="utf-8") as f:
            json.dump(report, f, ensure_ascii=False, sort_keys=True)
        return {"report_path": path, "nodes": len(nodes), "edges": len(report["edges"])}

    def _finish(self, nodes: DataFrame, m: model.Model, title: str, level: str) -> dict:
        nodes = labels.merge_groups(labels.label(nodes, self.labeller))
        fixed, errors = validate.validate(nodes, m, level)
        bad = validate.error_texts(errors).first()
        if bad is not None:
            raise ValueError(bad["error"])
        rows = [r.asDict(recursive=True) for r in tree.with_cross_refs(fixed, m).collect()]  # one report
        return self._write(rows, title, level)

    def _cached(self, kind: str, key: str, make) -> dict:
        done = self._load(kind, {})
        if key in done and os.path.exists(done[key]["report_path"]):
            return done[key]
        out = make()
        self._save(kind, {**done, key: out})
        return out

    def analyze_project(self) -> dict:
        m = self.model()
        mark = self._load("model", {})["fingerprint"]
        return self._cached("projects", f"{self.cache_key()}-{mark}", lambda: self._finish(tree.project_map(m), m, "project", "project"))

    def analyze_file(self, path: str) -> dict:
        m, one = self.model(), self.spark.createDataFrame([(path,)], "path STRING")
        faults = tree.error_reports(m, one)
        if not faults.isEmpty():
            return self._write([r.asDict(recursive=True) for r in faults.collect()], path, "file") | {"error": faults.first()["summary"]}
        return self._finish(tree.file_reports(m, one), m, path, "file")

    def analyze_function(self, symbol: str) -> dict:
        m = self.model()
        row = m.symbols.filter(F.col("id") == symbol).first()
        if row is None:
            raise ValueError(f"no symbol '{symbol}'")
        digest = files.sources(self.spark, self.root).filter(F.col("path") == row["source"]["file"]).first()["hash"]
        one = self.spark.createDataFrame([(symbol,)], "id STRING")
        return self._cached("functions", f"{self.cache_key()}-{digest}-{symbol}", lambda: self._finish(tree.function_reports(m, one), m, symbol, "function"))

    def update_file(self, path: str, expected_hash: str) -> dict:
        """Makes a file's report if its text is still that of the plan, and notes the result."""
        row = files.sources(self.spark, self.root).filter(F.col("path") == path).first()
        if row is None or row["hash"] != expected_hash:
            raise ValueError(f"{path} changed since the plan was made")
        out, error = {"report_path": None}, None
        try:
            out = self.analyze_file(path)
            error = out.get("error")
        except ValueError as e:
            error = str(e)
        self._put(self.spark.createDataFrame([(path, expected_hash, self.cache_key(), out["report_path"], error)], schema.STATE))
        if error is not None and out["report_path"] is None:
            raise ValueError(error)
        return out

    def rerender_report(self, path: str) -> str:
        """Writes a file's report anew from its stored tree, without labelling."""
        state = {r["path"]: r for r in self._load("state", [])}
        html = state[path]["report_path"]
        with open(html.removesuffix(".html") + ".dsl.json", encoding="utf-8") as f:
            report = json.load(f)

        def flat(nodes: list, up: str | None):
            for k, n in enumerate(nodes, 1):
                s = n["source"] or {"file": None, "start_line": None, "end_line": None}
                yield {**n, **s, "parent_id": up, "ord": k}
                yield from flat(n["children"], n["id"])

        self._write(list(flat(report["nodes"], None)), report["title"], report["level"], html)
        return html

    def list_reports(self) -> DataFrame:
        rows = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(f"{self.dir}/reports")
        return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.date_format("modificationTime", "dd.MM.yyyy HH:mm").alias("created")).orderBy(F.desc("name"))

    def read_report(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()["value"]

    def detect_test_commands(self) -> dict[str, str]:
        """Commands by kind of test, as the project's files suggest them."""
        out = {}
        if os.path.exists(f"{self.root}/go.mod"):
            out["unit"] = "go test ./..."
        try:
            with open(f"{self.root}/package.json", encoding="utf-8") as f:
                scripts = json.load(f).get("scripts", {})
        except (OSError, ValueError):
            scripts = {}
        for kind, names in (("unit", ("test:unit", "test")), ("integration", ("test:integration",)), ("e2e", ("test:e2e", "e2e"))):
            name = next((n for n in names if n in scripts), None)
            if name:
                out.setdefault(kind, f"npm run {name}")
        return out

    def run_test(self, kind: str, timeout: int = 600) -> dict:
        """Runs one of the detected commands in the project's folder."""
        import shlex
        import subprocess

        command = self.detect_test_commands().get(kind)
        if command is None:
            raise ValueError(f"no command for {kind} tests")
        done = subprocess.run(shlex.split(command), cwd=self.root, capture_output=True, text=True, timeout=timeout)
        return {"success": done.returncode == 0, "output": done.stdout + done.stderr}
