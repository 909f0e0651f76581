"""What the training-data operators share: word splitting, shared-folder staging, fresh names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


_scopes: list[list[str]] = []


def stage_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which all machines share. Where that is unset a local session takes the warehouse; a cluster fails."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/_terrane_stage"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Deletes the shuffle files of a step when it is done, which Spark else keeps until the driver's memory is cleaned.

    Shuffles are numbered in order; those numbered meanwhile are the step's. One that another thread's job still wants is made anew by
    Spark, as after the loss of an executor."""
    context = spark.sparkContext._jsc.sc()
    first = context.newShuffleId()
    yield
    if (cleaner := context.cleaner()).isDefined():
        for k in range(first + 1, context.newShuffleId()):
            cleaner.get().doCleanupShuffle(k, False)


def settle(df: DataFrame, what: str, outer: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors. It lasts as long as the scope around, or (outer) the one around that."""
    path = stage_dir(df.sparkSession, what)
    with own_shuffles(df.sparkSession):
        df.write.parquet(path)
    if len(_scopes) > outer:
        _scopes[-1 - outer].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(*settled: DataFrame) -> None:
    """Deletes tables that settle gave, before their scope ends; nothing may read them after."""
    for df in settled:
        _delete(df.sparkSession, df._staged)
        for scope in _scopes:
            if df._staged in scope:
                scope.remove(df._staged)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope: what is settled in it is deleted at its end, so no DataFrame that reads it may be used after. Outside of all scopes tables stay, as results read them."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def stratum(column: Column) -> Column:
    """A non-null key for a nullable string column; null has a key of its own."""
    return F.coalesce(F.concat(F.lit("="), column), F.lit(""))
