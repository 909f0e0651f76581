"""The code model: reading analysers' JSON, joining models, writing and reading the cached one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.sources import schema

#: Sort orders that make a model's rows comparable.
ORDER = {"packages": ["id"], "symbols": ["id"], "calls": ["from", "source.file", "source.start_line", "to"], "effects": ["symbol", "source.file", "source.start_line", "kind", "detail"], "entities": ["id"], "errors": ["file", "start_line", "message"]}


@dataclass
class Model:
    """Relations of one or more projects; missing fields have their defaults, empty text stands for none in entities."""

    packages: DataFrame
    symbols: DataFrame
    calls: DataFrame
    effects: DataFrame
    entities: DataFrame
    errors: DataFrame

    def relations(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in schema.RELATIONS}

    def views(self) -> None:
        """Registers each relation for Spark SQL."""
        for n, df in self.relations().items():
            df.createOrReplaceTempView(n)


def _defaults(name: str, df: DataFrame) -> DataFrame:
    """Booleans default to false, entities' texts to ""; kinds outside the fixed lists are refused by filter where they are closed."""
    for f in schema.struct(name).fields:
        kind = f.dataType.simpleString()
        if kind == "boolean":
            df = df.withColumn(f.name, F.coalesce(F.col(f"`{f.name}`"), F.lit(False)))
        elif kind == "string" and name == "entities":
            df = df.withColumn(f.name, F.coalesce(F.col(f.name), F.lit("")))
    if name == "symbols":
        df = df.filter(F.col("kind").isin(*schema.SYMBOL_KINDS))
        df = df.dropDuplicates(["id"])
    if name == "effects":
        df = df.filter(F.col("kind").isin(*schema.EFFECT_KINDS))
    return df


def from_documents(docs: DataFrame) -> Model:
    """From rows of the nested schema."""
    out = {n: _defaults(n, docs.select(F.explode(n).alias("r")).select("r.*")) for n in schema.RELATIONS}
    return Model(**out)


def read_json(spark: SparkSession, path: str) -> Model:
    """An analyser's output: a JSON document, or a folder of them (their union)."""
    return from_documents(spark.read.schema(schema.model()).json(path, multiLine=True))


def from_texts(texts: DataFrame) -> Model:
    """From source files (project, module, language, path, text); each relation is extracted by itself."""
    from terrane.sources.files import extract, relation

    return Model(**{n: _defaults(n, relation(extract(texts, names=(n,)), n).drop("project")) for n in schema.RELATIONS})


def entities_above(texts: DataFrame) -> DataFrame:
    """Entities of source files, and above: kind and first line of the entity above (null: none), which is in the same file."""
    from terrane.sources.files import extract, relation

    return _defaults("entities", relation(extract(texts, names=("entities",), above=True), "entities", above=True).drop("project"))


def union(a: Model, b: Model) -> Model:
    """Both models' rows; keys are kept as they are."""
    return Model(**{n: df.unionByName(getattr(b, n)) for n, df in a.relations().items()})


def write(model: Model, path: str) -> None:
    for n, df in model.relations().items():
        df.write.mode("overwrite").parquet(f"{path}/{n}")


def read(spark: SparkSession, path: str) -> Model:
    return Model(**{n: spark.read.schema(schema.struct(n)).parquet(f"{path}/{n}") for n in schema.RELATIONS})


def to_json(model: Model, language: str) -> DataFrame:
    """The model as one JSON text in a fixed order (column value); for models that fit one document only."""
    cols = [F.lit(language).alias("language")]
    out = model.packages.sparkSession.range(1)
    for n, df in model.relations().items():
        w = W.orderBy(*ORDER[n])
        rows = df.withColumn("_o", F.row_number().over(w)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.struct(*(F.col(f"`{f.name}`") for f in schema.struct(n).fields)).alias("r")))), lambda x: x["r"]).alias(n))
        out = out.crossJoin(rows)
        cols.append(F.col(n))
    return out.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))
