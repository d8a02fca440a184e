"""A warehouse of specified tables: bound SQL, raw payload versions, manifests, and an audit of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import loading, temporal
from tidemark.operators.registry import LeakError, Kind, TableSpec, guard


class Warehouse:
    """Tables under one folder, known by their specifications.

    Nothing is held open: a table is the Parquet files of its folder, and an
    empty frame of its schema before the first append.
    """

    def __init__(self, spark: SparkSession, path: str, specs: Sequence[TableSpec]):
        self.spark, self.path, self.specs = spark, path.rstrip("/"), {s.name: s for s in specs}

    def create_all(self) -> list[str]:
        """Check all specifications and make the folders that are missing; names of the tables."""
        for spec in self.specs.values():
            spec.check()
            if not loading._exists(self.spark, f"{self.path}/{spec.name}"):
                self.spark.createDataFrame([], spec.schema).write.mode("ignore").parquet(f"{self.path}/{spec.name}")
        return sorted(self.specs)

    def table(self, name: str) -> DataFrame:
        where, spec = f"{self.path}/{name}", self.specs[name]
        if not loading._exists(self.spark, where):
            return self.spark.createDataFrame([], spec.schema)
        if spec.dynamic:
            return self.spark.read.option("mergeSchema", True).parquet(where)
        return self.spark.read.schema(spec.schema).parquet(where)

    def sql(self, text: str, **params) -> DataFrame:
        """A query over the tables by name; ``:name`` parameters are bound, never pasted."""
        for name in self.specs:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text, args=params)

    def append(self, name: str, rows: DataFrame, ordinal: str) -> dict[str, int]:
        return loading.append(self.spark, rows, f"{self.path}/{name}", self.specs[name], ordinal)

    def status(self) -> DataFrame:
        """name, kind, n of every table."""
        one = lambda s: self.table(s.name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s.name).alias("name"), F.lit(s.kind.value).alias("kind"), "n")
        return reduce(DataFrame.unionByName, [one(s) for s in self.specs.values()])

    def read_as_of(self, name: str, cutoff: Column, **how) -> DataFrame:
        return temporal.read_as_of(self.table(name), self.specs[name], cutoff, **how)

    def closing(self, name: str, keys: DataFrame, on: Sequence[str]) -> DataFrame:
        """The sanctioned door to a closing table: only the rows asked for by key."""
        return _sanctioned(self.table(name), self.specs[name], Kind.CLOSING, keys, on)

    def labels(self, name: str, keys: DataFrame, on: Sequence[str]) -> DataFrame:
        """The sanctioned door to an outcome table."""
        guard(self.specs[name], allow_outcomes=True)
        return _sanctioned(self.table(name), self.specs[name], Kind.OUTCOME, keys, on)

    @contextmanager
    def run(self, name: str, at: Column | None = None):
        """Log a run in table ``runs`` (run, event, at, error): a start row, and an end row with the error if one came."""
        log = lambda event, error=None: self.spark.range(1).select(F.lit(name).alias("run"), F.lit(event).alias("event"), (at if at is not None else F.current_timestamp()).alias("at"), F.lit(error).cast("string").alias("error")).write.mode("append").parquet(f"{self.path}/runs")
        log("running")
        try:
            yield
        except Exception as e:
            log("failed", str(e)[:1000])
            raise
        log("ok")


def _sanctioned(table: DataFrame, spec: TableSpec, kind: Kind, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    if spec.kind is not kind:
        raise LeakError(f"{spec.name} holds no {kind.value} values")
    return table.join(keys.select(*on).distinct(), list(on), "left_semi")


def bound(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], **params) -> DataFrame:
    """SQL over frames named in braces, with bound ``:name`` parameters."""
    return spark.sql(text, args=params, **tables)


def run_states(log: DataFrame) -> DataFrame:
    """run, event, seconds, error: the latest state of every run of an append-only log; an end beats a start of the same time."""
    ended = F.col("event") != "running"
    latest = F.struct("at", ended.cast("int"))
    return log.groupBy("run").agg(
        F.max_by(F.struct("event", "error"), latest).alias("l"),
        F.when(F.bool_or(ended), F.unix_seconds(F.max(F.when(ended, F.col("at")))) - F.unix_seconds(F.min("at"))).alias("seconds"),
    ).select("run", "l.event", "seconds", "l.error")


def raw_versions(payloads: DataFrame, key: Sequence[str], at: str, ties: Sequence[str], body: str) -> DataFrame:
    """Rows that change the content of their key, with ``sha256``: content-addressed versions of a raw store; null bodies are no version."""
    held = payloads.where(F.col(body).isNotNull()).withColumn("sha256", F.sha2(body, 256))
    runs = temporal.identical_runs(held, key, at, ties, "sha256")
    return runs.where("run = 1").drop("run")


def latest_as_of(versions: DataFrame, key: Sequence[str], at: str, ties: Sequence[Column], cutoff: Column) -> DataFrame:
    return temporal.as_of(versions, key, at, cutoff, ties)


def manifest_rows(raw: DataFrame, manifest: DataFrame, key: Sequence[str]) -> DataFrame:
    """The entries of ``raw`` that the manifest lacks, once each."""
    return loading.not_held(raw.select(*key).distinct(), manifest, key)


def content_hash(df: DataFrame, by: str, order: str, body: str) -> DataFrame:
    """by, digest: sha256 over the row hashes of a file in row order.  A file is what one write made, so it is small by nature."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.sha2(F.coalesce(body, F.lit("")), 256).alias("h"))))
    return df.groupBy(by).agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["h"]), ""), 256).alias("digest"))


def read_glob(spark: SparkSession, glob: str, key: Sequence[str], ordinal: str) -> DataFrame:
    """Parquet files of a pattern as one frame, the greatest ordinal of each key."""
    return loading.dedupe_keep_last(spark.read.option("mergeSchema", True).parquet(glob), key, ordinal)


def append_parquet(spark: SparkSession, glob: str, path: str, spec: TableSpec, ordinal: str) -> dict[str, int]:
    """Bulk append of staged Parquet files: as ``loading.append``, from files."""
    return loading.append(spark, spark.read.option("mergeSchema", True).parquet(glob), path, spec, ordinal)


class Ingester:
    """A source: ``plan`` names its partitions, ``parse`` maps raw payloads to tables; it may write only the tables it declares."""

    writes: frozenset[str] = frozenset()

    def plan(self, start: str, stop: str) -> list:
        raise NotImplementedError

    def parse(self, raw: DataFrame) -> Mapping[str, DataFrame]:
        raise NotImplementedError

    def load(self, raw: DataFrame, warehouse: Warehouse, ordinal: str, progress=None) -> dict[str, dict[str, int]]:
        """Append what ``parse`` gives; PermissionError for a table that isn't declared.  ``progress(table, added)`` is told after each."""
        parsed = self.parse(raw)
        if strange := set(parsed) - set(self.writes):
            raise PermissionError(f"{type(self).__name__} may not write {sorted(strange)}")
        out = {}
        for name, rows in parsed.items():
            out[name] = warehouse.append(name, rows, ordinal)
            if progress:
                progress(name, out[name]["added"])
        return out
