"""Fingerprints and integrity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tick_fingerprint(df: DataFrame, by: Sequence[str], key: str, body: str) -> DataFrame:
    """digest, keys, bodies, n_bytes per tick: sha256 over the sorted "key:sha256(body)" lines.

    A tick is one poll of a source, small by nature; lines are combined per
    key and body before they are gathered.
    """
    lines = df.groupBy(*by, key, body).agg(F.count(F.lit(1)).alias("_c"))
    line = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.sha2(F.coalesce(F.col(body), F.lit("")), 256))
    text = F.array_join(F.array_sort(F.flatten(F.collect_list(F.array_repeat(line, F.col("_c").cast("int"))))), "\n")
    return lines.groupBy(*by).agg(
        F.sha2(text, 256).alias("digest"), F.count_distinct(key).alias("keys"), F.count_distinct(body).alias("bodies"),
        F.coalesce(F.sum(F.col("_c") * F.octet_length(body)), F.lit(0)).alias("n_bytes"),
    )


def table_counts(tables: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """name, n, newest: rows and latest version of every table, as text."""
    one = lambda n, df, at: df.agg(F.count(F.lit(1)).alias("n"), F.max(at).cast("string").alias("newest")).select(F.lit(n).alias("name"), "n", "newest")
    return reduce(DataFrame.unionByName, [one(n, df, at) for n, (df, at) in tables.items()])


def counts_fingerprint(counts: DataFrame) -> DataFrame:
    """One row: sha256 over the sorted lines of ``table_counts``."""
    line = F.concat_ws("|", "name", F.col("n").cast("string"), F.coalesce("newest", F.lit("")))
    return counts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("tables"))


def counts_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, change: added, removed or moved tables between two ``table_counts``."""
    b, a = before.alias("b"), after.alias("a")
    change = F.when(F.col("b.name").isNull(), "added").when(F.col("a.name").isNull(), "removed").when(
        ~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.newest").eqNullSafe(F.col("b.newest"))), "moved"
    )
    both = a.join(b, F.col("a.name") == F.col("b.name"), "full")
    return both.select(F.coalesce("a.name", "b.name").alias("name"), change.alias("change")).where("change is not null")


def check(name: str, bad: DataFrame, severity: str = "error") -> DataFrame:
    """One result row: passed if ``bad`` is empty."""
    return bad.agg(F.count(F.lit(1)).alias("metric")).select(
        F.lit(name).alias("name"), (F.col("metric") == 0).alias("passed"), F.lit(severity).alias("severity"), "metric"
    )


def suite(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def gate(results: DataFrame) -> DataFrame:
    """open: whether no error-level check failed; failed: how many did."""
    return results.agg(F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("failed")).select((F.col("failed") == 0).alias("open"), "failed")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: Sequence[str]) -> DataFrame:
    return child.join(parent.select(*key), list(key), "left_anti")


def revisions(df: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Keys with more than one distinct version, exactly counted."""
    return df.groupBy(*key).agg(F.count_distinct(version).alias("versions")).where("versions > 1")


def ratio(name: str, df: DataFrame, holds: Column, least: float) -> DataFrame:
    """name, ratio, passed: the share of rows for which ``holds``; an empty table passes with a null ratio."""
    share = df.agg(F.avg(F.coalesce(holds, F.lit(False)).cast("int")).alias("r"))
    return share.select(F.lit(name).alias("name"), F.round("r", 6).alias("ratio"), F.coalesce(F.col("r") >= least, F.lit(True)).alias("passed"))


def classes(df: DataFrame, value: str, table: Mapping[str, str], otherwise: str = "unknown") -> DataFrame:
    """class, n, share: rows per class of a value; values outside the table are counted, never guessed."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    per = df.groupBy(F.coalesce(F.try_element_at(names, F.col(value)), F.lit(otherwise)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = per.agg(F.sum("n").alias("_all")).withColumn("_one", F.lit(1))  # one row
    return per.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").select("class", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))
