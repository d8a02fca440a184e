"""Problem 4: records of two tables paired by nearest time within a tolerance.

Both sides are united and sorted per entity and block of time; the last and the
next right-side record are carried onto each left row and the nearer one within
tolerance is kept.  A right record near the edge of its block also stands in
the neighbouring block, so blocks never look at one another and an entity that
holds a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timetext import read_times
from tidemark.operators.attributes import latest_starts
from tidemark.operators.timestamps import hourly_instants

#: Width of a block, at least.
BLOCK_SECONDS = 6 * 3600


def nearest_within(left: DataFrame, right: DataFrame, reach_us: int, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``left`` rows with the nearest right record.

    ``reach_us`` is the greatest tolerance: right records no farther from the
    edge of a block stand in the neighbouring block too, and a left row that
    asks for more raises.  left: entity, at_us, tolerance_us and any further columns; right: entity,
    at_us, ref (a struct, compared in order).  Before and after both count, the
    tolerance is inclusive.  Ties go to the earlier instant, then the smallest
    ref.  Adds ``ref`` and ``ref_us``, null when none is near enough; rows with
    a null entity or time match nothing.  Right records that share entity and
    instant are combined before the shuffle.  A column of ``left`` may have any
    name but ref, ref_us, block and side.
    """
    width = max(block_seconds * 1_000_000, reach_us)
    block = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    at = F.col("at_us")
    reduced = right.where("entity is not null and at_us is not null").groupBy("entity", "at_us").agg(F.min("ref").alias("ref"))
    reach = F.lit(reach_us)
    spread = reduced.withColumn("block", F.explode(F.array_distinct(F.array(block(at - reach), block(at), block(at + reach)))))
    beyond = F.raise_error(F.lit(f"a tolerance above the reach of {reach_us}"))
    left = left.withColumn("tolerance_us", F.when(F.col("tolerance_us") > reach, beyond.cast("bigint")).otherwise(F.col("tolerance_us")))
    carried = [c for c in left.columns if c not in ("entity", "at_us")]
    asks = left.where("entity is not null and at_us is not null").select(
        "entity", "at_us", block(at).alias("block"), F.lit(1).alias("side"), F.struct(*carried).alias("row")
    )
    have = spread.select("entity", "at_us", "block", F.lit(0).alias("side"), F.struct("at_us", "ref").alias("hit"))
    # most blocks of the right side hold no question
    have = have.join(asks.select("entity", "block").distinct(), ["entity", "block"], "left_semi")
    both = have.unionByName(asks, allowMissingColumns=True)
    order = Window.partitionBy("entity", "block").orderBy("at_us", "side")
    before = F.last("hit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("hit", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.withColumns({"before": before, "after": after}).where("side = 1")
    ago, ahead = at - F.col("before.at_us"), F.col("after.at_us") - at
    pick = F.when(F.col("after").isNull() | (ago <= ahead), F.col("before")).otherwise(F.col("after"))
    out = found.select("entity", "at_us", "row.*", pick.alias("pick"))
    near = F.abs(F.col("pick.at_us") - at) <= F.col("tolerance_us")
    out = out.select(
        "entity", "at_us", *carried, F.when(near, F.col("pick.ref")).alias("ref"), F.when(near, F.col("pick.at_us")).alias("ref_us")
    )
    rest = left.where("entity is null or at_us is null")
    return out.unionByName(rest, allowMissingColumns=True)


def bookmaker_updates(odds: DataFrame) -> DataFrame:
    """game_pk, partner, at_us, ref(rec_id, pos) of each readable last_update; unresolved games and null keys are left out."""
    books = odds.where("game_pk is not null").select("game_pk", "rec_id", F.posexplode("bookmakers").alias("pos", "book"))
    read = F.transform(read_times(F.array("book.last_update")), lambda p: F.coalesce(p["instant"], p["local"]))[0]
    return (
        books.where("book.key is not null and book.last_update is not null")
        .select("game_pk", F.col("book.key").alias("partner"), F.unix_micros(read).alias("at_us"), F.struct("rec_id", "pos").alias("ref"))
        .where("at_us is not null")
    )


def game_partners(
    games: DataFrame, meteo: DataFrame, odds: DataFrame, weather_minutes: int = 45, book_minutes: int = 20
) -> DataFrame:
    """game_pk, partner, rec_id, pos: each game's nearest weather hour and bookmaker updates.

    The start and venue are those of the game's row with the greatest as_of_ts.
    """
    minute = 60_000_000
    starts = latest_starts(games).where("start is not null").withColumn("at_us", F.unix_micros("start"))
    hours = hourly_instants(meteo).where("instant is not null and venue_id is not null")
    weather = hours.select(
        F.concat(F.lit("w|"), F.col("venue_id").cast("string")).alias("entity"),
        F.unix_micros("instant").alias("at_us"), F.struct("rec_id", "pos").alias("ref"),
    )
    updates = bookmaker_updates(odds)
    book_entity = F.concat(F.lit("b|"), F.col("game_pk").cast("string"), F.lit("|"), F.col("partner")).alias("entity")
    books = updates.select(book_entity, "at_us", "ref")
    ask = lambda df, entity, partner, minutes: df.select(
        entity, "at_us", "game_pk", partner.alias("partner"), F.lit(minutes * minute).alias("tolerance_us")
    )
    asks = ask(
        starts.where("venue_id is not null"),
        F.concat(F.lit("w|"), F.col("venue_id").cast("string")).alias("entity"), F.lit("weather"), weather_minutes,
    ).unionByName(
        ask(updates.select("game_pk", "partner").distinct().join(starts, "game_pk"), book_entity, F.col("partner"), book_minutes)
    )
    found = nearest_within(asks, weather.unionByName(books), max(weather_minutes, book_minutes) * minute)
    return found.where("ref is not null").select("game_pk", "partner", F.col("ref.rec_id").alias("rec_id"), F.col("ref.pos").alias("pos"))
