"""What the polling archive says about its sources: health, completeness, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ticks(archive: DataFrame, minutes: int = 15) -> DataFrame:
    """venue, tick, records, errors, succeeded: one row per venue and poll interval; success is more records than errors."""
    tick = F.window("fetched_at", f"{minutes} minutes")["start"]
    per = archive.groupBy("venue", tick.alias("tick")).agg(F.count("payload").alias("records"), F.count("error").alias("errors"))
    return per.withColumn("succeeded", F.col("records") > F.col("errors"))


def venue_health(per_tick: DataFrame) -> DataFrame:
    """venue, ticks, failures, longest_failure, current_failure, last_success: runs of failed ticks as islands."""
    span = Window.partitionBy("venue").orderBy("tick")
    island = per_tick.withColumn("_i", F.sum(F.col("succeeded").cast("int")).over(span))
    run = island.where("not succeeded").groupBy("venue", "_i").agg(F.count(F.lit(1)).alias("n"))
    longest = run.groupBy("venue").agg(F.max("n").alias("longest_failure"), F.max_by("n", "_i").alias("_last_n"), F.max("_i").alias("_last_i"))
    whole = island.groupBy("venue").agg(
        F.count(F.lit(1)).alias("ticks"), F.count_if(~F.col("succeeded")).alias("failures"), F.max("_i").alias("_top"),
        F.max(F.when(F.col("succeeded"), F.col("tick"))).alias("last_success"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return whole.join(longest, "venue", "left").select(
        "venue", "ticks", "failures", zero(F.col("longest_failure")).alias("longest_failure"),
        zero(F.when(F.col("_last_i") == F.col("_top"), F.col("_last_n"))).alias("current_failure"), "last_success",
    )


def coverage(expected: DataFrame, listed: DataFrame, key: str, by: str) -> DataFrame:
    """by, expected, covered, missing, unlisted, status: a full comparison of a slate with what a source lists.

    Both sides are (by, key).  unknown when a source lists nothing at all: that
    is not the same as covering nothing.
    """
    e = expected.select(by, key).distinct().withColumn("_e", F.lit(1))
    l = listed.select(by, key).distinct().withColumn("_l", F.lit(1))
    both = e.join(l, [by, key], "full").groupBy(by).agg(
        F.count("_e").alias("expected"), F.count_if(F.col("_e").isNotNull() & F.col("_l").isNotNull()).alias("covered"),
        F.count_if(F.col("_l").isNull()).alias("missing"), F.count_if(F.col("_e").isNull()).alias("unlisted"), F.count("_l").alias("_n"),
    )
    status = F.when(F.col("_n") == 0, "unknown").when(F.col("missing") == 0, "complete").otherwise("partial")
    return both.withColumn("status", status).drop("_n")


def price_staleness(quotes: DataFrame, key: str, at: str, seen: str, minutes: int) -> DataFrame:
    """key, n, stale, worst_minutes: how old quotes were when they were fetched."""
    age = (F.unix_micros(seen) - F.unix_micros(at)) / 60_000_000
    return quotes.withColumn("_age", age).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_age") > minutes).alias("stale"), F.max("_age").alias("worst_minutes")
    )


# -- slates -----------------------------------------------------------------------


def _hours(n: float) -> F.Column:
    return F.make_dt_interval(mins=F.lit(int(n * 60)))


def in_window(games: DataFrame, start: str, at: F.Column, lead_hours: float = 12, trail_hours: float = 5) -> DataFrame:
    """Games near enough to their start that they should be quoted at ``at``; both ends inclusive."""
    return games.where(F.col(start).between(at - _hours(trail_hours), at + _hours(lead_hours)))


def quote_horizon(start: F.Column, at: F.Column, horizon_hours: float = 6, closes_hours: float = 4) -> F.Column:
    """not_yet, no_longer (both strictly beyond), or expected_now."""
    return F.when(start > at + _hours(horizon_hours), "not_yet").when(start < at - _hours(closes_hours), "no_longer").otherwise("expected_now")


def diagnosis(start: F.Column, at: F.Column, priced: F.Column) -> F.Column:
    """Why a game counts or doesn't, the first that holds.  ``priced``: null if no source lists it, false if listed without a price."""
    horizon = quote_horizon(start, at)
    return (
        F.when(F.coalesce(priced, F.lit(False)), "counted").when(start.isNull(), "no start").when(horizon == "not_yet", "not yet")
        .when(horizon == "no_longer", "no longer").when(priced.isNotNull(), "listed, no price").otherwise("absent")
    )


def alerts(archive: DataFrame, games: DataFrame, start: str, at: F.Column, stale_minutes: int = 45, before_hours: float = 6, after_hours: float = 5) -> DataFrame:
    """venue, state at ``at``: quiet while no game is near, critical if it never succeeded, stale, or ok."""
    near = in_window(games, start, at, before_hours, after_hours).agg((F.count(F.lit(1)) > 0).alias("active")).withColumn("_one", F.lit(1))
    known = ticks(archive.where(F.col("fetched_at") <= at)).where("succeeded").groupBy("venue").agg(F.max("tick").alias("last"))
    both = archive.select("venue").distinct().join(known, "venue", "left").withColumn("_one", F.lit(1)).join(F.broadcast(near), "_one")  # one row
    late = F.col("last") < at - F.make_dt_interval(mins=F.lit(stale_minutes))
    return both.select("venue", F.when(~F.col("active"), "quiet").when(F.col("last").isNull(), "critical").when(late, "stale").otherwise("ok").alias("state"))


def throttle(checks: DataFrame, seconds: int) -> DataFrame:
    """key, at of the alerts that are sent: at most one per key and ``seconds``, at once again after a recovery.

    checks: key, at, failing.  A key's checks are sorted and streamed through
    one task with a constant state; nothing is gathered.
    """
    import pandas as pd

    kind = checks.schema["key"].dataType.simpleString()

    def run(frames):
        now, sent = object(), None
        for pdf in frames:
            keep = []
            for key, at, failing in zip(pdf["key"], pdf["at"], pdf["failing"]):
                if key != now:
                    now, sent = key, None
                if not failing:
                    sent = None
                elif sent is None or (at - sent).total_seconds() >= seconds:
                    sent = at
                    keep.append((key, at))
            yield pd.DataFrame(keep, columns=["key", "at"])

    slim = checks.select("key", "at", F.coalesce("failing", F.lit(False)).alias("failing")).where("key is not null and at is not null")
    return slim.repartition("key").sortWithinPartitions("key", "at").mapInPandas(run, f"key {kind}, at timestamp")


def busiest_window(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """key, most: the most events any ``seconds`` held, both ends of whole seconds counted; by running counts, not by pairs."""
    from tidemark.operators import temporal

    upto = temporal.running_count(events, at, [key])
    due = upto.select(key, at, "upto", (F.col(at) - F.make_dt_interval(secs=F.lit(seconds))).alias("_from"))
    both = temporal.asof_join(due, upto.withColumnsRenamed({at: "_at", "upto": "_before"}), [key], "_from", "_at", ["_before"], suffix="")
    return both.groupBy(key).agg(F.max(F.col("upto") - F.coalesce("_before", F.lit(0))).alias("most"))


def adaptive_interval(days_left: F.Column, calls_left: F.Column, configured: float, exhausted: float = 3600.0) -> F.Column:
    """Seconds between calls that make the remaining calls last."""
    return F.when(calls_left > 0, F.greatest(F.lit(configured), days_left * 86400.0 / calls_left)).otherwise(exhausted)
