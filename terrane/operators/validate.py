"""Validation of report nodes against the model: schema rules first, then snapping, references and coverage; errors are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.operators import coverage, snap
from terrane.sources import schema
from terrane.sources.model import Model

SNAPPED = ("call", "action", "error", "async")


def _errors(df: DataFrame, message: Column) -> DataFrame:
    return df.select("report", message.alias("message"))


def schema_errors(nodes: DataFrame) -> DataFrame:
    """report, message for nodes that break the output schema: ids, kinds, layers, labels, lines."""
    rules = {
        "id must not be empty": F.coalesce(F.col("id"), F.lit("")) == "",
        "kind is unknown": ~F.coalesce(F.col("kind").isin(*schema.NODE_KINDS), F.lit(False)),
        "layer is unknown": ~F.coalesce(F.col("layer").isin(*schema.LAYERS), F.lit(False)),
        "label must not be empty": F.coalesce(F.col("label"), F.lit("")) == "",
        "lines must be 1 or more": F.col("file").isNotNull() & ((F.col("start_line") < 1) | (F.col("end_line") < 1)),
    }
    found = F.array_compact(F.array(*(F.when(c, F.concat(F.lit("schema: node '"), F.coalesce("id", F.lit("")), F.lit(f"': {m}"))) for m, c in rules.items())))
    return nodes.select("report", F.explode(found).alias("message"))


def snapped(nodes: DataFrame, model: Model) -> DataFrame:
    """nodes with their lines on the symbol's range, or on the nearest call's for the kinds that act; clamped to the file's last symbol line."""
    last = model.symbols.groupBy(F.col("source.file").alias("file")).agg(F.max("source.end_line").alias("_last"))
    sym = model.symbols.select(F.col("id").alias("symbol"), F.col("source.file").alias("file"), F.col("source.start_line").alias("_ss"), F.col("source.end_line").alias("_se"))
    out = nodes.join(sym, ["symbol", "file"], "left").join(last, "file", "left")
    free = out.filter(F.col("_ss").isNull() & F.col("kind").isin(*SNAPPED) & F.col("file").isNotNull())
    left = free.select(F.struct("report", "id").alias("rid"), "file", snap.midpoint(F.col("start_line"), F.col("end_line")).alias("mid"))
    calls = model.calls.select(F.col("source.file").alias("file"), F.col("source.start_line").cast("long").alias("line"), F.col("from"), F.col("source.end_line").alias("call_end"), F.col("to"))
    near = snap.nearest(left, calls, "file", "mid", "line", "rid", ["from", "line", "to", "call_end"])
    near = near.select(F.col("rid.report").alias("report"), F.col("rid.id").alias("id"), F.col("line").cast("int").alias("_cs"), F.col("call_end").alias("_ce"))
    out = out.join(near, ["report", "id"], "left")
    a, b = snap.clamp(F.coalesce("_ss", "_cs", "start_line"), F.coalesce("_se", "_ce", "end_line"), F.col("_last"))
    has = F.col("file").isNotNull()
    return out.withColumn("_a", a).withColumn("_b", b).withColumn("start_line", F.when(has, F.col("_a"))).withColumn("end_line", F.when(has, F.col("_b"))).select(*nodes.columns)


def known_symbols(nodes: DataFrame, model: Model) -> DataFrame:
    """nodes with symbols that the model doesn't have cleared."""
    known = model.symbols.select(F.col("id").alias("_known")).distinct()
    return nodes.join(known, F.col("symbol") == F.col("_known"), "left").withColumn("symbol", F.col("_known")).select(*nodes.columns)


def line_errors(nodes: DataFrame) -> DataFrame:
    """Ranges that are no ranges."""
    name = F.concat(F.lit("node '"), F.col("id"), F.lit("' "))
    return _errors(nodes.filter((F.col("start_line") < 1) | (F.col("start_line") > F.col("end_line"))), F.concat(name, F.lit("has invalid source range "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")))


def node_errors(nodes: DataFrame, model: Model, level: str) -> DataFrame:
    """Faults of nodes by themselves, lines apart (line_errors)."""
    name = F.concat(F.lit("node '"), F.col("id"), F.lit("' "))
    files = model.symbols.select(F.col("source.file").alias("file")).distinct()
    unknown = nodes.filter("file is not null").select("file").distinct().join(files, "file", "left_anti")
    out = _errors(nodes.join(unknown, "file", "left_semi"), F.concat(name, F.lit("references unknown file '"), F.col("file"), F.lit("'")))
    if level != "project":
        out = out.unionByName(_errors(nodes.filter("file is null"), F.concat(name, F.lit("missing source ref on scoped level"))))
        out = out.unionByName(_errors(nodes.filter(F.coalesce(F.trim("summary"), F.lit("")) == ""), F.concat(name, F.lit("missing Russian summary"))))
    return out


def palette_errors(nodes: DataFrame, palette: DataFrame) -> DataFrame:
    """nodes: report, id, element_type; palette: type."""
    lost = nodes.filter("element_type is not null").join(palette.select(F.col("type").alias("element_type")), "element_type", "left_anti")
    return _errors(lost, F.concat(F.lit("node '"), "id", F.lit("' uses unknown element_type '"), "element_type", F.lit("'")))


def branch_errors(branches: DataFrame, nodes: DataFrame) -> DataFrame:
    """branches: report, id, target."""
    lost = branches.join(nodes.select("report", F.col("id").alias("target")), ["report", "target"], "left_anti")
    return _errors(lost, F.concat(F.lit("node '"), "id", F.lit("' branch targets unknown node '"), "target", F.lit("'")))


def edge_errors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges: report, from, to."""
    ends = edges.select("report", F.explode(F.array("from", "to")).alias("id"), F.concat("from", F.lit("→"), "to").alias("edge"))
    lost = ends.join(nodes.select("report", "id"), ["report", "id"], "left_anti")
    return _errors(lost, F.concat(F.lit("edge '"), "edge", F.lit("' references unknown node '"), "id", F.lit("'")))


def backed_edges(edges: DataFrame, nodes: DataFrame, model: Model) -> DataFrame:
    """edges with verified turned to inferred where no call backs it; a node's symbol is that of the last node with its id."""
    last = nodes.filter("symbol is not null").groupBy("report", "id").agg(F.max_by("symbol", "path").alias("symbol"))
    pairs = model.calls.select(F.col("from").alias("_fs"), F.col("to").alias("_ts")).distinct().withColumn("_hit", F.lit(True))
    a = last.select("report", F.col("id").alias("from"), F.col("symbol").alias("_fs"))
    b = last.select("report", F.col("id").alias("to"), F.col("symbol").alias("_ts"))
    out = edges.join(a, ["report", "from"], "left").join(b, ["report", "to"], "left").join(pairs, ["_fs", "_ts"], "left")
    status = F.when((F.col("status") == "verified") & F.col("_hit").isNull(), "inferred").otherwise(F.col("status"))
    return out.withColumn("status", status).select(*edges.columns)


def coverage_errors(nodes: DataFrame, model: Model, level: str) -> DataFrame:
    """Units of the root's file (of the root's lines at function level) must be covered exactly once."""
    roots = nodes.filter("depth = 0 and ord = 1").select("report", F.col("file").alias("rf"), F.col("start_line").alias("rs"), F.col("end_line").alias("re"))
    none = roots.filter("rf is null").select("report", F.lit("coverage: scoped visualization has no source file").alias("message"))
    units = model.entities.filter("coverage").select("id", F.col("source.file").alias("rf"), F.col("source.start_line").alias("s"), F.col("source.end_line").alias("e"))
    want = units.join(roots, "rf")
    if level == "function":
        want = want.filter("s >= rs and e <= re")
    key = F.struct("report", "id").alias("key")
    have = nodes.select("report", F.explode("coverage_ids").alias("id"))
    bad = coverage.exactly_once(want.select(key), have.select(key), "key").withColumn("report", F.col("key.report"))
    bad = bad.join(roots.filter("rf is not null").select("report").distinct(), "report", "left_semi")
    quoted = F.concat(F.lit("'"), F.col("key.id"), F.lit("'"))
    text = F.when(F.col("status") == "missing", F.concat(F.lit("coverage: missing AST unit "), quoted)).when(F.col("status") == "unknown", F.concat(F.lit("coverage: unknown AST unit "), quoted))
    text = text.otherwise(F.concat(F.lit("coverage: AST unit "), quoted, F.lit(" appears "), F.col("n").cast("string"), F.lit(" times")))
    return none.unionByName(bad.select(F.col("key.report").alias("report"), text.alias("message")))


def validate(nodes: DataFrame, model: Model, level: str = "file", palette: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapped nodes with known symbols, and all errors (report, message); reports that break the schema show those errors only.

    Element types are checked against palette (type) where nodes have the column element_type, branch targets where they have
    branches (condition, target), and ends of edges (report, from, to) where edges are given; see backed_edges for their status."""
    broken = schema_errors(nodes)
    lost = broken.select("report").distinct()
    fixed = known_symbols(snapped(nodes.join(lost, "report", "left_anti"), model), model)
    # Snapping changes lines only, and leaves a fault in them only where a file's last line is below 1; the other checks read the nodes as they came.
    none = model.symbols.groupBy(F.col("source.file").alias("file")).agg(F.max("source.end_line").alias("_last")).filter("_last < 1").select("file")
    errors = line_errors(snapped(nodes.join(none, "file", "left_semi"), model)).unionByName(node_errors(nodes, model, level))
    if palette is not None and "element_type" in nodes.columns:
        errors = errors.unionByName(palette_errors(nodes, palette))
    if "branches" in nodes.columns:
        errors = errors.unionByName(branch_errors(nodes.select("report", "id", F.explode("branches.target").alias("target")), nodes))
    if edges is not None:
        errors = errors.unionByName(edge_errors(edges, nodes).join(nodes.select("report").distinct(), "report", "left_semi"))
    if level != "project":
        errors = errors.unionByName(coverage_errors(fixed if level == "function" else nodes, model, level))
    return fixed, broken.unionByName(errors.join(lost, "report", "left_anti"))


def error_texts(errors: DataFrame) -> DataFrame:
    """report, error: all messages in a stable order, joined."""
    return errors.groupBy("report").agg(F.array_join(F.array_sort(F.collect_list("message")), "; ").alias("error"))
