"""Idempotent appends: the last duplicate of a batch wins, rows already held are left out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.registry import TableSpec, align, evolve, require
from tidemark.sources import shared_dir


def dedupe_keep_last(df: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """The row of the greatest ordinal per key; nulls in the key are equal."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(ordinal).desc()))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def not_held(incoming: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Incoming rows whose key the table lacks; null equals null."""
    held = table.select(*[F.col(c).alias(f"_h_{c}") for c in key])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in key])
    return incoming.join(held, same, "left_anti")


def rows_to_append(incoming: DataFrame, table: DataFrame, spec: TableSpec, ordinal: str) -> DataFrame:
    """What ``append`` would write: checked, deduplicated, aligned, and not held yet."""
    require(incoming, (*spec.key, *spec.required))
    key = [*spec.key, *([spec.known_at] if spec.known_at else [])]
    kept = dedupe_keep_last(incoming, key, ordinal)
    target = (evolve(table, incoming.drop(ordinal)) if spec.dynamic else table).schema
    return not_held(align(kept, target), table, key)


def append(spark: SparkSession, incoming: DataFrame, path: str, spec: TableSpec, ordinal: str) -> dict[str, int]:
    """Append to the table at ``path``; a second call with the same rows writes none.

    Returns the rows offered and added.  The rows are settled in the shared
    folder first, so that a retry can't read its own half-written output.
    """
    table = spark.read.schema(spec.schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], spec.schema)
    staged = shared_dir(spark, "append")
    rows_to_append(incoming, table, spec, ordinal).write.parquet(staged)
    fresh = spark.read.parquet(staged)
    added = fresh.count()
    if added:
        fresh.write.mode("append").parquet(path)
    return {"offered": incoming.count(), "added": added}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(p))


def upsert_view(log: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """An append-only log read as a table with replacement by key."""
    return dedupe_keep_last(log, key, at)
