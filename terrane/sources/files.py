"""Source files: scans, fingerprints, language detection, extraction in parallel."""

from __future__ import annotations

import itertools
import json
import tempfile
from collections.abc import Collection, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from terrane.sources import golang, schema, typescript

STATE_DIR = ".terrane"
#: Folders that a scan leaves out: tools' own and build output.
SKIPPED = (".git", STATE_DIR, "node_modules", "target", "dist")


def _read(spark: SparkSession, root: str, glob: str = "*.{go,ts,tsx}") -> DataFrame:
    """path (relative to root), content, modificationTime, length of the files below root; sub-folders included."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = F.lit(root.rstrip("/") + "/")
    relative = F.expr("substring(path, instr(path, base) + length(base))")
    return rows.withColumn("base", base).withColumn("path", relative).drop("base")


def language_of(path: Column) -> Column:
    return F.when(path.endswith(".go"), "go").when(path.endswith(".tsx"), "tsx").when(path.endswith(".ts"), "typescript")


def _has_part(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a folder in the relative path has one of the names; where the project itself lies makes no difference."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*(F.lit(n) for n in names)))


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, name, language of the source files, by path."""
    rows = _read(spark, root).filter(~_has_part(F.col("path"), SKIPPED))
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), language_of(F.col("path")).alias("language")).orderBy("path")


def sources(spark: SparkSession, root: str) -> DataFrame:
    """path, text, hash of the source files."""
    rows = _read(spark, root).filter(~_has_part(F.col("path"), SKIPPED))
    return rows.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("hash"))


def fingerprint(spark: SparkSession, root: str) -> str:
    """One hash of all source files (only the state folder left out): files hashed apart, then folder by folder, then all."""
    rows = _read(spark, root).filter(~_has_part(F.col("path"), (STATE_DIR,)))
    leaf = F.sha2(F.concat(F.col("path").cast("binary"), F.lit(b"\0"), F.col("content"), F.lit(b"\0")), 256)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    ordered = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "h"))), lambda x: x["h"]), ""), 256)
    dirs = rows.select(folder.alias("dir"), "path", leaf.alias("h")).groupBy("dir").agg(ordered("path").alias("h"))
    return dirs.agg(ordered("dir").alias("h")).first()["h"]


def languages(spark: SparkSession, root: str) -> list[str]:
    """go where there is a go.mod, typescript where there is a package.json or tsconfig.json; an error if there is neither."""
    marks = spark.read.format("binaryFile").option("pathGlobFilter", "{go.mod,package.json,tsconfig.json}").load(root)
    names = {r["n"] for r in marks.select(F.element_at(F.split("path", "/"), -1).alias("n")).collect()}
    found = ["go"] * ("go.mod" in names) + ["typescript"] * bool(names & {"package.json", "tsconfig.json"})
    if not found:
        raise ValueError(f"no go.mod, package.json or tsconfig.json in {root}")
    return found


def module_name(spark: SparkSession, root: str) -> str:
    row = spark.read.text(f"{root.rstrip('/')}/go.mod").filter(F.col("value").startswith("module ")).first()
    return row["value"].split()[1] if row else "main"


_HELD, _OUT = 1 << 24, 1 << 20  # bytes of a group's texts in memory, and characters of a batch of rows


class _Texts(Mapping):
    """Texts of one group by path; beyond _HELD bytes they lie in a file of the worker's own, which goes with the group."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.file, self.places, end = tempfile.SpooledTemporaryFile(_HELD), {}, 0
        for f in batches:
            for path, text in zip(f.column("path").to_pylist(), f.column("text")):
                data = text.as_py().encode()
                self.file.write(data)
                self.places[path] = end, len(data)
                end += len(data)

    def __getitem__(self, path: str) -> str:
        at, n = self.places[path]
        self.file.seek(at)
        return self.file.read(n).decode()

    def __iter__(self) -> Iterator[str]:
        return iter(self.places)

    def __len__(self) -> int:
        return len(self.places)


def _above(rows: Iterable[tuple[str, dict]]) -> Iterator[tuple[str, dict]]:
    """The rows, which come file by file; each entity with kind and first line of the one above in its file (above), if there is one."""
    for path, some in itertools.groupby(rows, lambda r: r[1]["source"]["file"] if r[0] == "entities" else None):
        if path is None:
            yield from some
            continue
        found = [row for _, row in some]
        labels = {row["id"]: f"{row['kind']}:{row['source']['start_line']}" for row in found}
        for row in found:
            yield "entities", row | {"above": labels.get(row["parent_id"])}


def extract(texts: DataFrame, project: str = "project", module: str = "module", language: str = "language", names: Collection[str] = tuple(schema.RELATIONS), above: bool = False) -> DataFrame:
    """project, module, language, path, text to rows of the relations named: project, relation, row (JSON); above: entities have it, too.

    A Go package or a TypeScript project is one group; it reads its own files only, and a project's package ids as a column. A group
    passes file by file: what is held of it is its paths and the names that it declares."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    rows = texts.withColumn("dir", F.when(F.col(language) == "go", folder).otherwise(""))
    dirs = rows.filter(F.col(language) == "go").groupBy(project).agg(F.array_sort(F.collect_set("dir")).alias("dirs"))
    rows = rows.join(dirs, project, "left").select(F.col(project).alias("project"), F.col(module).alias("module"), F.when(F.col(language) == "go", "go").otherwise("ts").alias("lang"), "dir", "dirs", "path", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches)
        of, source, folder = (first.column(c)[0].as_py() for c in ("project", "module", "dir"))
        found = _Texts(itertools.chain([first], batches))
        if first.column("lang")[0].as_py() == "go":
            some = golang.package_rows(source, folder, found, first.column("dirs")[0].as_py(), names)
        else:
            some = typescript.project_rows(found, names)
        if above:
            some = _above(some)
        kinds, out, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of] * len(out), pa.string()), pa.array(kinds, pa.string()), pa.array(out, pa.string())], ["project", "relation", "row"])

        for name, row in some:
            kinds.append(name)
            out.append(json.dumps(row, ensure_ascii=False))
            size += len(out[-1])
            if size > _OUT:
                yield batch()
                kinds, out, size = [], [], 0
        yield batch()

    # By a fixed number, so that small groups aren't put into one task for their bytes: parsing takes the time.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "project", "lang", "dir").groupBy("project", "lang", "dir").applyInArrow(run, "project STRING, relation STRING, row STRING")


def relation(extracted: DataFrame, name: str, above: bool = False) -> DataFrame:
    """One relation of the extracted rows, with its project; above: entities that were extracted with it."""
    rows, kind = extracted.filter(F.col("relation") == name), schema.struct(name)
    if above:
        kind = StructType([*kind.fields, StructField("above", StringType())])
    return rows.select("project", F.from_json("row", kind).alias("r")).select("project", "r.*")
