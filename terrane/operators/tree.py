"""Scope trees of files and functions, the project map, and cross references; all files at once, one row per node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.sources.model import Model
from terrane.sources.staging import settle

COLUMNS = ["report", "id", "parent_id", "ord", "depth", "path", "kind", "label", "layer", "file", "start_line", "end_line", "symbol", "summary", "coverage_ids", "group_id"]


def _pad(n: Column) -> Column:
    return F.lpad(n.cast("string"), 8, "0")


def _none(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def nodes_of(tree: DataFrame) -> DataFrame:
    """View nodes of tree rows (report, path, depth, ord, parent, and an entity's columns)."""
    label, summary = T.label_and_summary(F.col("kind"), F.col("label"), F.col("name"), F.col("condition"))
    call = (F.col("kind") == "call") & (F.col("callee") != "")
    return tree.select(
        "report", "id", F.col("parent").alias("parent_id"), "ord", "depth", "path", T.node_kind(F.col("kind")).alias("kind"), label.alias("label"), T.layer_of(F.col("kind")).alias("layer"),
        F.col("source.file").alias("file"), F.col("source.start_line").alias("start_line"), F.col("source.end_line").alias("end_line"),
        F.when(call, F.col("callee")).otherwise(_none("symbol")).alias("symbol"),
        F.coalesce(summary, F.when(call, F.concat(F.lit("→ "), "callee"))).alias("summary"),
        F.when(F.col("coverage"), F.array("id")).otherwise(F.array().cast("array<string>")).alias("coverage_ids"),
        F.lit(None).cast("string").alias("group_id"),
    )


def grow(roots: DataFrame, entities: DataFrame) -> DataFrame:
    """Tree rows below the roots (report and an entity's columns), one level a step; a step joins the last level only.

    Siblings stand by start line, then id, which is the model's order. An entity never stands below itself, so ids that collide end the
    tree there."""
    w = W.partitionBy("source.file", "parent_id").orderBy("source.start_line", "id")
    kids = settle(entities.filter("parent_id <> ''").withColumn("ord", F.row_number().over(w)), "tree-kids")
    level = roots.withColumn("path", _pad(F.lit(1))).withColumn("depth", F.lit(0)).withColumn("ord", F.lit(1)).withColumn("parent", F.lit(None).cast("string")).withColumn("_line", F.array("id"))
    names = level.columns
    level = settle(level, "tree-level")
    tree = level
    while not level.isEmpty():
        up = level.select("report", F.col("id").alias("up"), F.col("path").alias("up_path"), F.col("depth").alias("up_depth"), F.col("source.file").alias("up_file"), F.col("_line").alias("up_line"))
        level = kids.join(up, (kids["parent_id"] == up["up"]) & (kids["source.file"] == up["up_file"])).filter(~F.array_contains("up_line", F.col("id")))
        level = level.withColumn("_line", F.array_append("up_line", F.col("id")))
        level = level.withColumn("path", F.concat("up_path", F.lit("/"), _pad(F.col("ord")))).withColumn("depth", F.col("up_depth") + 1).withColumn("parent", F.col("up"))
        level = settle(level.select(*names), "tree-level")
        tree = tree.unionByName(level)
    return tree


def _synthetic(df: DataFrame, eid: Column, kind: str, name: Column, symbol: Column, source: Column) -> DataFrame:
    empty = F.lit("")
    return df.select(
        "report", eid.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), empty.alias("label"), symbol.alias("symbol"), empty.alias("callee"), empty.alias("condition"), empty.alias("code"),
        F.lit(False).alias("coverage"), source.alias("source"), empty.alias("parent_id"), F.array().cast("array<string>").alias("children"),
    )


def file_reports(model: Model, files: DataFrame) -> DataFrame:
    """Nodes of the reports of files (column path); a file without a file entity gets one of its own, line 1 to 1."""
    want = files.select(F.col("path").alias("report")).distinct()
    e = model.entities
    roots = e.filter("kind = 'file' and parent_id = ''").join(want, F.col("source.file") == F.col("report")).select("report", *e.columns)
    roots = roots.withColumn("_n", F.row_number().over(W.partitionBy("report").orderBy("id"))).filter("_n = 1").drop("_n")
    lost = want.join(roots.select("report"), "report", "left_anti")
    source = F.struct(F.col("report").alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    own = _synthetic(lost, F.concat(F.lit("file:"), "report"), "file", F.col("report"), F.lit(""), source)
    return nodes_of(grow(roots.unionByName(own), e))


def function_reports(model: Model, symbols: DataFrame) -> DataFrame:
    """Nodes of the reports of symbols (column id): from the symbol's function or method entity, or else from the symbol's row."""
    want = symbols.select(F.col("id").alias("report")).distinct()
    e = model.entities
    roots = e.filter(F.col("kind").isin("function", "method")).join(want, F.col("symbol") == F.col("report")).select("report", *e.columns)
    roots = roots.withColumn("_n", F.row_number().over(W.partitionBy("report").orderBy("id"))).filter("_n = 1").drop("_n")
    lost = want.join(roots.select("report"), "report", "left_anti").join(model.symbols.withColumnRenamed("id", "report"), "report")
    own = _synthetic(lost, F.concat(F.lit("func:"), "report"), "function", F.col("name"), F.col("report"), F.col("source"))
    return nodes_of(grow(roots.unionByName(own), e))


def project_map(model: Model) -> DataFrame:
    """package > file > symbol nodes of exported symbols and of those in a package main; empty files and packages drop out."""
    shown = model.symbols.filter(F.col("is_exported") | (F.col("package") == "main") | F.col("package").endswith("/main"))
    files = model.packages.select(F.col("id").alias("pkg"), F.col("name").alias("pkg_name"), F.explode("files").alias("f")).distinct()
    s = files.join(shown, F.col("f") == F.col("source.file"))
    file_id = F.concat(F.lit("file:"), "f")

    def node(df: DataFrame, nid: Column, parent: Column, depth: int, kind: Column, label: Column, file: Column, a: Column, b: Column, symbol: Column) -> DataFrame:
        none = F.lit(None).cast("string")
        return df.select(
            F.lit("project").alias("report"), nid.alias("id"), parent.cast("string").alias("parent_id"), F.lit(depth).alias("depth"), kind.alias("kind"), label.alias("label"), F.lit("flow").alias("layer"), file.cast("string").alias("file"),
            a.cast("int").alias("start_line"), b.cast("int").alias("end_line"), symbol.cast("string").alias("symbol"), none.alias("summary"), F.array().cast("array<string>").alias("coverage_ids"), none.alias("group_id"),
        )

    null, group = F.lit(None), F.lit("group")
    p = node(s.select("pkg", "pkg_name").distinct(), F.col("pkg"), null, 0, group, F.col("pkg_name"), null, null, null, null)
    f = node(s.select("pkg", "f").distinct(), file_id, F.col("pkg"), 1, group, T.basename(F.col("f")), F.col("f"), F.lit(1), F.lit(1), null)
    kind = F.when(F.col("source_kind") == "variable", "action").otherwise("group")
    leaf = node(s.withColumn("source_kind", F.col("kind")), F.col("id"), file_id, 2, kind, F.col("name"), F.col("f"), F.col("source.start_line"), F.col("source.end_line"), F.col("id"))
    out = p.unionByName(f).unionByName(leaf)
    out = out.withColumn("ord", F.row_number().over(W.partitionBy("parent_id", "depth").orderBy("id")))
    one = out.filter("depth = 0").select(F.col("id").alias("_p"), _pad(F.col("ord")).alias("path0"))
    two = out.filter("depth = 1").join(one, F.col("parent_id") == F.col("_p")).select(F.col("id").alias("_p"), F.concat("path0", F.lit("/"), _pad(F.col("ord"))).alias("path0"))
    places = one.unionByName(two)
    top = out.filter("depth = 0").withColumn("path", _pad(F.col("ord")))
    rest = out.filter("depth > 0").join(places, F.col("parent_id") == F.col("_p")).withColumn("path", F.concat("path0", F.lit("/"), _pad(F.col("ord"))))
    return top.select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def callables(symbols: DataFrame) -> DataFrame:
    """id, name, kind, file of functions and methods, by id."""
    return symbols.filter(F.col("kind").isin("function", "method")).select("id", "name", "kind", F.col("source.file").alias("file")).orderBy("id")


def cross_refs(nodes: DataFrame, model: Model) -> DataFrame:
    """report, id, cross_refs: a call node points to its symbol; any other node with a symbol is pointed to by its callers, one entry
    for each call, in call order."""
    sym = model.symbols.select(F.col("id").alias("sid"), F.col("name").alias("sname"), F.col("source.file").alias("sfile"))
    ref = lambda i, f, l: F.struct(F.col(i).alias("id"), F.col(f).alias("file"), l.alias("label"))
    out = nodes.filter("kind = 'call' and symbol is not null").select("report", "id", "symbol").join(sym, F.col("symbol") == F.col("sid"))
    out = out.select("report", "id", F.array(ref("sid", "sfile", F.concat(F.lit("→ "), "sname", F.lit(" in "), "sfile"))).alias("cross_refs"))
    into = nodes.filter("kind <> 'call' and symbol is not null").select("report", "id", "symbol")
    calls = model.calls.select(F.col("from"), F.col("to"), F.col("source.file").alias("cf"), F.col("source.start_line").alias("cl"))
    into = into.join(calls, F.col("symbol") == F.col("to")).join(sym, F.col("from") == F.col("sid"))
    entry = F.struct("from", "cf", "cl", ref("sid", "sfile", F.concat(F.lit("← "), "sname", F.lit(" in "), "sfile")).alias("r"))
    into = into.groupBy("report", "id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["r"]).alias("cross_refs"))
    return out.unionByName(into)


def with_cross_refs(nodes: DataFrame, model: Model) -> DataFrame:
    refs = cross_refs(nodes, model)
    empty = F.array().cast("array<struct<id:string,file:string,label:string>>")
    return nodes.join(refs, ["report", "id"], "left").withColumn("cross_refs", F.coalesce("cross_refs", empty))


def error_reports(model: Model, files: DataFrame) -> DataFrame:
    """One error node for each file (column path) with errors, its summary all messages, a line each."""
    line = T.error_line(F.col("file"), F.col("start_line"), F.col("message"))
    e = model.errors.join(files.select(F.col("path").alias("file")).distinct(), "file").select("file", F.struct("start_line", "message", "end_line", line.alias("text")).alias("e"))
    one = e.groupBy("file").agg(F.array_sort(F.collect_list("e")).alias("es"))
    none = F.lit(None).cast("string")
    return one.select(
        F.col("file").alias("report"), F.concat(F.lit("error:"), "file").alias("id"), none.alias("parent_id"), F.lit(1).alias("ord"), F.lit(0).alias("depth"), _pad(F.lit(1)).alias("path"), F.lit("error").alias("kind"),
        F.lit("Ошибка компиляции").alias("label"), F.lit("flow").alias("layer"), "file", F.col("es")[0]["start_line"].alias("start_line"), F.col("es")[0]["end_line"].alias("end_line"), none.alias("symbol"),
        F.array_join(F.transform("es", lambda x: x["text"]), "\n").alias("summary"), F.array().cast("array<string>").alias("coverage_ids"), none.alias("group_id"),
    )
