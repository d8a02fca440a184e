"""Problem 6: attributes as known at event time.

Entities are hash-partitioned and, within an entity, cut into blocks of time;
an embedded DuckDB runs an ASOF LEFT JOIN in every bucket on the
availability-ordered versions.  Each block is given the one version that was
current when it began, so no block needs another and an entity that holds a
third of all rows is spread over its blocks.
"""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one bucket, in expectation; a bucket is what one DuckDB call holds.
BUCKET_ROWS = 200_000
BLOCK_SECONDS = 7 * 86_400


def current_versions(versions: DataFrame, entity: str, known_at: str, tie: str, keep: list[str]) -> DataFrame:
    """entity, known_at and the kept columns, one row per entity and availability time.

    Ties in availability go to the smallest ``tie``.  Rows without entity or
    availability time can't be known at any time and are left out.
    """
    row = F.struct(F.col(tie), *[F.col(c) for c in keep if c != tie])
    return (
        versions.where(F.col(entity).isNotNull() & F.col(known_at).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(known_at).alias("known_at"))
        .agg(F.min(row).alias("row"))
        .select("entity", "known_at", *[F.col(f"row.{c}").alias(c) for c in keep])
    )


def _asof(keep: list[str], left_schema: list[str]):
    right = ", ".join(f"r.{c}" for c in keep)
    left = ", ".join(f"l.{c}" for c in left_schema)

    def run(table: pa.Table) -> pa.Table:
        import duckdb

        con = duckdb.connect()
        try:
            con.execute("SET threads = 1")
            con.register("both_sides", table)
            # strict: a version known at the very moment of the event came too late
            return con.sql(
                f"SELECT {left}, {right} FROM (SELECT * FROM both_sides WHERE is_left) l "
                f"ASOF LEFT JOIN (SELECT * FROM both_sides WHERE NOT is_left) r "
                "ON l.entity = r.entity AND l.block = r.block AND l.at_us > r.at_us"
            ).to_arrow_table()
        finally:
            con.close()

    return run


def asof_attributes(
    events: DataFrame, versions: DataFrame, keep: list[str], expected_rows: int,
    block_seconds: int = BLOCK_SECONDS, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``events`` (entity, at, ...) with the kept columns of the version known strictly before ``at``.

    ``versions`` comes from ``current_versions``; ``expected_rows`` (of both
    sides, roughly) sizes the buckets.  Every event gives one row;
    without an earlier version, or with a null entity or time, the kept columns
    are null.  Column names of the two sides must differ but for ``entity``.
    """
    us = lambda c: F.unix_micros(F.col(c))
    block = lambda c: F.floor(us(c) / F.lit(block_seconds * 1_000_000)).cast("bigint")
    extra = [c for c in events.columns if c not in ("entity", "at")]
    types = dict(events.dtypes) | dict(versions.dtypes)
    left = events.where("entity is not null and at is not null").withColumns({"at_us": us("at"), "block": block("at")})
    right = versions.withColumns({"at_us": us("known_at"), "block": block("known_at")})

    # the version current at the start of each block that has events: blocks, not rows, take part
    last = right.groupBy("entity", "block").agg(F.max_by(F.struct("at_us", *keep), "at_us").alias("row"))
    asked = left.select("entity", "block").distinct()
    path = Window.partitionBy("entity").orderBy("block", "asks")
    rows = last.withColumn("asks", F.lit(1)).unionByName(
        asked.withColumn("asks", F.lit(0)).withColumn("row", F.lit(None).cast(last.schema["row"].dataType))
    )
    carried = (
        rows.withColumn("row", F.last("row", ignorenulls=True).over(path.rowsBetween(Window.unboundedPreceding, -1)))
        .where("asks = 0 and row is not null")
        .select("entity", "block", "row.*")
    )
    sides = left.select("entity", "block", "at_us", *extra, F.lit(True).alias("is_left"))
    known = right.select("entity", "block", "at_us", *keep).unionByName(carried).withColumn("is_left", F.lit(False))
    both = sides.unionByName(known, allowMissingColumns=True)
    width = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(ceil(expected_rows / bucket_rows), min(width, ceil(expected_rows / 20_000)), 1)
    both = both.withColumn("bucket", F.pmod(F.hash("entity", "block"), F.lit(buckets)))
    schema = ", ".join(f"`{c}` {types[c]}" for c in ["entity", *extra, *keep])
    got = both.groupBy("bucket").applyInArrow(_asof(keep, ["entity", *extra]), schema)
    lost = events.where("entity is null or at is null").select("entity", *extra)
    return got.unionByName(lost, allowMissingColumns=True)


def latest_starts(games: DataFrame) -> DataFrame:
    """game_pk, start, venue_id of each game's row with the greatest as_of_ts (ties: smallest rec_id)."""
    newest = F.max_by(F.struct("scheduled_start_ts", "venue_id"), F.struct("as_of_ts", -F.col("rec_id")))
    return (
        games.where("game_pk is not null and as_of_ts is not null")
        .groupBy("game_pk")
        .agg(newest.alias("row"))
        .select("game_pk", F.col("row.scheduled_start_ts").alias("start"), F.col("row.venue_id").alias("venue_id"))
    )


def games_as_known(games: DataFrame, venues: DataFrame) -> DataFrame:
    """game_pk, start, game_rec_id, venue_id, venue_rec_id as known before the start.

    Games without a start, or without an earlier game or venue row, are left out.
    """
    size = games.count() + venues.count()  # from the file footers
    starts = latest_starts(games).where("start is not null").select(F.col("game_pk").alias("entity"), F.col("start").alias("at"), F.unix_micros("start").alias("start_us"))
    game_rows = current_versions(
        games.select("game_pk", "as_of_ts", F.col("rec_id").alias("game_rec_id"), "venue_id"),
        "game_pk", "as_of_ts", "game_rec_id", ["game_rec_id", "venue_id"],
    )
    known = asof_attributes(starts, game_rows, ["game_rec_id", "venue_id"], size).where("game_rec_id is not null")
    asks = known.select(
        F.col("venue_id").alias("entity"), F.timestamp_micros("start_us").alias("at"),
        F.col("entity").alias("game_pk"), "start_us", "game_rec_id",
    )
    venue_rows = current_versions(
        venues.select("venue_id", "as_of_ts", F.col("rec_id").alias("venue_rec_id")), "venue_id", "as_of_ts", "venue_rec_id", ["venue_rec_id"]
    )
    return (
        asof_attributes(asks, venue_rows, ["venue_rec_id"], size)
        .where("venue_rec_id is not null")
        .select("game_pk", F.timestamp_micros("start_us").alias("start"), "game_rec_id", F.col("entity").alias("venue_id"), "venue_rec_id")
    )
