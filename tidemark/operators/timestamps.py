"""Problem 1: one unambiguous UTC instant for every readable time text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timetext import PLAIN_DAY, PLAIN_INSTANT, both_readings, plain, read_time, read_times


def settle_sequence(readings: Column) -> Column:
    """Choose the offset history of an ordered array that breaks order least.

    ``readings`` is ``array<struct<e,l>>`` (earlier and later reading, null for
    unreadable entries).  Within each run of repeated wall clocks a history is a
    switch position: entries before it are read early, from it on late.  The
    fold keeps the cheapest early and late history (cost: entries not after
    their predecessor), closes the run at the next clear entry, and prefers the
    latest switch on ties, so order alone can move a reading to the later
    instant.  State is constant per entry; arrays without a repeated clock skip
    the fold.  Null arrays give null, empty arrays empty ones.
    """
    ts, i32 = "timestamp", "int"
    ranges = "array<struct<a:int,b:int>>"
    null_ts = F.lit(None).cast(ts)
    start = F.struct(
        F.lit(0).alias("i"), F.lit(False).alias("open"), null_ts.alias("prev"),
        F.lit(0).alias("ce"), null_ts.alias("pe"), F.lit(0).alias("cl"), null_ts.alias("pl"),
        F.lit(0).alias("sw"), F.array().cast(ranges).alias("late"),
    )

    def cost(before: Column, now: Column) -> Column:
        return F.when(before >= now, 1).otherwise(0)

    def pack(i, opened, prev, ce, pe, cl, pl, sw, late):
        return F.struct(
            i.cast(i32).alias("i"), opened.alias("open"), prev.cast(ts).alias("prev"),
            ce.cast(i32).alias("ce"), pe.cast(ts).alias("pe"), cl.cast(i32).alias("cl"),
            pl.cast(ts).alias("pl"), sw.cast(i32).alias("sw"), late.cast(ranges).alias("late"),
        )

    def span(a, b):
        return F.array(F.struct(a.cast(i32).alias("a"), b.cast(i32).alias("b")))

    def step(s, x):
        nxt = s["i"] + 1
        ce, cl = s["ce"] + cost(s["pe"], x["e"]), s["cl"] + cost(s["pl"], x["e"])
        closed = F.when(s["open"] & (cl < ce), F.concat(s["late"], span(s["sw"], s["i"] - 1))).otherwise(s["late"])
        clear = pack(nxt, F.lit(False), x["e"], F.lit(0), null_ts, F.lit(0), null_ts, F.lit(0), closed)
        first = pack(
            nxt, F.lit(True), s["prev"], cost(s["prev"], x["e"]), x["e"], cost(s["prev"], x["l"]), x["l"], s["i"], s["late"]
        )
        stay, switch = s["cl"] + cost(s["pl"], x["l"]), s["ce"] + cost(s["pe"], x["l"])
        more = pack(
            nxt, F.lit(True), s["prev"], ce, x["e"], F.least(stay, switch), x["l"],
            F.when(switch <= stay, s["i"]).otherwise(s["sw"]), s["late"],
        )
        # another year's repeated hour: the open run ends before it
        again = pack(
            nxt, F.lit(True), s["pl"], F.lit(0), x["e"], F.lit(0), x["l"], s["i"],
            F.when(s["cl"] < s["ce"], F.concat(s["late"], span(s["sw"], s["i"] - 1))).otherwise(s["late"]),
        )
        apart = F.unix_micros(x["e"]) - F.unix_micros(s["pe"]) > 2 * 3600 * 1_000_000
        idle = pack(nxt, s["open"], s["prev"], s["ce"], s["pe"], s["cl"], s["pl"], s["sw"], s["late"])
        return (
            F.when(x.isNull() | x["e"].isNull(), idle)
            .when(x["e"] == x["l"], clear)
            .when(s["open"] & apart, again)
            .when(s["open"], more)
            .otherwise(first)
        )

    def finish(s):
        return F.when(s["open"] & (s["cl"] < s["ce"]), F.concat(s["late"], span(s["sw"], s["i"] - 1))).otherwise(s["late"])

    def settle(r):
        moved = lambda late: F.transform(
            r, lambda x, i: F.when(F.exists(late, lambda q: (q["a"] <= i) & (i <= q["b"])), x["l"]).otherwise(x["e"])
        )
        return F.when(
            F.exists(r, lambda x: x["e"] != x["l"]), F.transform(F.array(F.aggregate(r, start, step, finish)), moved)[0]
        ).otherwise(F.transform(r, lambda x: x["e"]))

    # one-element arrays bind a value, so that it is computed once
    return F.transform(F.array(readings), settle)[0]


def normalise_array(texts: Column, zone: Column) -> Column:
    """Instants of an ordered array of texts; ``zone`` is for texts without one."""
    return settle_sequence(
        F.transform(
            read_times(texts),
            lambda p: F.when(p["instant"].isNotNull(), F.struct(p["instant"].alias("e"), p["instant"].alias("l"))).otherwise(
                both_readings(p["local"], F.coalesce(p["region"], zone))
            ),
        )
    )


def normalise(text: Column, zone: Column) -> Column:
    """Instant of a lone text; a wall clock that occurs twice is the earlier."""
    return F.transform(
        read_times(F.array(text)),
        lambda p: F.coalesce(p["instant"], F.to_utc_timestamp(p["local"], F.coalesce(p["region"], zone))),
    )[0]


def day_of(text: Column) -> Column:
    """Calendar day of a text as ISO, null if unreadable."""
    return F.date_format(read_time(text)["day"], "yyyy-MM-dd")


def hourly_instants(meteo: DataFrame) -> DataFrame:
    """One row per entry of ``hourly.time``: rec_id, venue_id, pos, text, instant.

    Null structs, null or empty arrays give no row; unreadable or null entries
    give a null instant.
    """
    zone = F.coalesce(F.col("timezone"), F.lit("UTC"))
    times = F.col("hourly")["time"]
    both = F.arrays_zip(times.alias("text"), normalise_array(times, zone).alias("instant"))
    return (
        meteo.where(F.size(F.coalesce(times, F.array())) > 0)
        .select("rec_id", "venue_id", F.posexplode(both).alias("pos", "x"))
        .select("rec_id", "venue_id", "pos", F.col("x")["text"].alias("text"), F.col("x")["instant"].alias("instant"))
    )


def schedule_games(schedule: DataFrame) -> DataFrame:
    """One row per game of a schedule payload with its position ``date.game``."""
    return (
        schedule.select("rec_id", F.posexplode("dates").alias("d", "day"))
        .select("rec_id", "d", F.posexplode("day.games").alias("g", "game"))
        .select(
            "rec_id",
            F.concat_ws(".", "d", "g").alias("pos"),
            F.col("game.gameDate").alias("game_date"),
            F.col("game.officialDate").alias("official_date"),
            F.col("game.venue.id").alias("venue_id"),
            F.col("game.teams.home.team.id").alias("home_id"),
        )
    )


def normalised_texts(
    schedule: DataFrame, venues: DataFrame, teams: DataFrame, meteo: DataFrame, markets: DataFrame
) -> DataFrame:
    """Every readable text of the four fields: src, rec_id, pos, text, utc.

    Zone-less gameDate takes the venue's zone (a venue's zone never changes, so
    any of its versions serves); a payload without venue falls back to the home
    team's park.  Unreadable, empty and null texts give no row.  Rows repeat
    with the input; ``rec_id`` and ``pos`` identify them.
    """
    zones = venues.where("venue_id is not null and timezone is not null").groupBy("venue_id").agg(F.min("timezone").alias("zone"))
    parks = teams.groupBy(F.col("team_id").alias("home_id")).agg(F.min("home_venue_id").alias("park"))
    games = (
        schedule_games(schedule)
        .join(parks, "home_id", "left")
        .withColumn("venue_id", F.coalesce("venue_id", "park"))
        .join(zones, "venue_id", "left")
    )
    keep = lambda df, src, pos, text, utc: df.select(
        F.lit(src).alias("src"), "rec_id", pos.cast("string").alias("pos"), text.alias("text"), utc.alias("utc")
    )
    parts = [
        keep(games, "mlb_schedule.gameDate", F.col("pos"), F.col("game_date"), plain(normalise(F.col("game_date"), F.col("zone")))),
        keep(games, "mlb_schedule.officialDate", F.col("pos"), F.col("official_date"), day_of(F.col("official_date"))),
        keep(hourly_instants(meteo), "open_meteo.hourly.time", F.col("pos"), F.col("text"), plain(F.col("instant"))),
        keep(markets, "kalshi_markets.close_time", F.lit("0"), F.col("close_time"), plain(normalise(F.col("close_time"), F.lit("America/New_York")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("text is not null and utc is not null")


def changed_texts(normalised: DataFrame) -> DataFrame:
    """The texts that were not in plain form already."""
    plain_already = F.when(F.col("src") == "mlb_schedule.officialDate", F.col("text").rlike(PLAIN_DAY)).otherwise(
        F.col("text").rlike(PLAIN_INSTANT)
    )
    return normalised.where(~plain_already).select("src", "rec_id", "pos", "utc")
