"""Schemas of the code-model relations, and their fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

RANGE = "STRUCT<file:STRING,start_line:INT,end_line:INT>"
RELATIONS = {
    "packages": "id STRING, name STRING, dir STRING, files ARRAY<STRING>",
    "symbols": f"id STRING, kind STRING, name STRING, package STRING, source {RANGE}, signature STRING, is_exported BOOLEAN, is_async BOOLEAN",
    "calls": f"`from` STRING, `to` STRING, source {RANGE}",
    "effects": f"symbol STRING, kind STRING, detail STRING, source {RANGE}",
    "entities": f"id STRING, kind STRING, name STRING, label STRING, symbol STRING, callee STRING, condition STRING, code STRING, coverage BOOLEAN, source {RANGE}, parent_id STRING, children ARRAY<STRING>",
    "errors": "file STRING, message STRING, start_line INT, end_line INT",
}
MODEL = "language STRING, " + ", ".join(f"{name} ARRAY<STRUCT<{cols}>>" for name, cols in RELATIONS.items())

SYMBOL_KINDS = ("function", "method", "type", "interface", "variable")
EFFECT_KINDS = ("network", "database", "file_system", "queue", "log", "other")
LEVELS = ("project", "file", "function")
NODE_KINDS = ("group", "action", "decision", "call", "data", "state", "error", "async", "input", "output", "loop", "effect")
LAYERS = ("flow", "calls", "data", "state", "effects")
EDGE_STATUSES = ("verified", "inferred")

NODE = (
    "id STRING, parent_id STRING, ord INT, depth INT, path STRING, kind STRING, label STRING, layer STRING, "
    f"source {RANGE}, symbol STRING, summary STRING, coverage_ids ARRAY<STRING>, group_id STRING, "
    "cross_refs ARRAY<STRUCT<id:STRING,file:STRING,label:STRING>>"
)
STATE = "path STRING, hash STRING, cache_key STRING, report_path STRING, error STRING"


def struct(name: str) -> T.StructType:
    """Schema of one relation."""
    return T.StructType.fromDDL(RELATIONS[name])


#: The model with nested arrays, as analysers write it: one JSON document.
def model() -> T.StructType:
    fields = [T.StructField("language", T.StringType())]
    return T.StructType(fields + [T.StructField(n, T.ArrayType(struct(n))) for n in RELATIONS])
