"""Two quote streams against each other: gaps, where prices went afterwards, and what they cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import market
from tidemark.operators import temporal

#: A difference above this is no gap; edges of the size buckets, near-miss bands and minute bands.
MOST = 0.25
SIZES = (0.0, 0.04, 0.06, 0.10, 0.25)
NEAR_MISSES = (0.010, 0.015, 0.020, 0.0275)
MINUTES = (5, 15, 30, 60, 120, 180)
#: Horizon -> minutes after the gap; ``close`` is the last quote before the start.
HORIZONS = {"+1 snapshot": 15, "+1 hour": 60}


def bands(value: Column, edges: Sequence[float], text) -> Column:
    """Half-open bands; null outside."""
    out = F.when(F.lit(False), "")
    for lo, hi in zip(edges, edges[1:]):
        out = out.when((value >= lo) & (value < hi), text(lo, hi))
    return out


def minute_band(minutes: Column) -> Column:
    """Bands with inclusive upper edges."""
    out, lo = F.when(minutes.isNull() | (minutes < 0), None), 0
    for hi in MINUTES:
        out, lo = out.when(minutes <= hi, f"{lo}-{hi}"), hi
    return out.otherwise(f"{lo}+")


def find_gaps(quotes: DataFrame, sharp: DataFrame, starts: DataFrame, by: str, half_spread: float = 0.01, alignment: float = 0.0, stale_minutes: int = 30) -> DataFrame:
    """Every quote with ``reason``: the first of in play, stale, unoriented, under floor, implausible that holds, else gap.

    quotes and sharp: by, at, price, team; starts: by, start.  A quote takes the
    last sharp quote at or before it, and its price is stated for that quote's
    team.  Quotes of entities without a start aren't rows.
    """
    joined = temporal.asof_join(quotes.join(starts, by), sharp, [by], "at", "at", ["price", "team"], tolerance_us=stale_minutes * 60_000_000, suffix="_sharp")
    price = market.orient(F.col("price"), F.col("team"), F.col("team_sharp"))
    oriented = joined.withColumnsRenamed({"price_sharp": "sharp"}).withColumn("own", price)
    size, floor = F.abs(F.col("sharp") - F.col("own")), market.floor_of(F.col("own"), F.lit(half_spread), F.lit(alignment))
    reason = temporal.reason_cascade(
        [
            ("in play", F.col("at") >= F.col("start")), ("stale", F.col("at_sharp").isNull()), ("unoriented", F.col("own").isNull()),
            ("under floor", F.col("size") <= F.col("floor")), ("implausible", F.col("size") > MOST),
        ],
        "gap",
    )
    return oriented.withColumns({"size": size, "floor": floor}).withColumn("reason", reason)


def direction(sharp: Column, own: Column) -> Column:
    return F.when(sharp > own, 1).otherwise(-1)


def attach_outcomes(gaps: DataFrame, quotes: DataFrame, by: str) -> DataFrame:
    """``gaps`` with later_<horizon>: the first quote at or after each delay, and the last one up to the start, for the gap's team."""
    out = gaps
    slim = quotes.select(by, "at", F.col("price").alias("_p"), F.col("team").alias("_team"))
    for name, minutes in HORIZONS.items():
        due = out.withColumn("_due", F.col("at") + F.make_dt_interval(mins=F.lit(minutes)))
        got = temporal.asof_join(due, slim, [by], "_due", "at", ["_p", "_team"], "forward", suffix="_l")
        out = got.withColumn(f"later_{name}", market.orient(F.col("_p_l"), F.col("_team_l"), F.col("team_sharp"))).drop("_due", "at_l", "_p_l", "_team_l")
    got = temporal.asof_join(out, slim, [by], "start", "at", ["_p", "_team"], suffix="_l")
    close = F.when(F.col("at_l") > F.col("at"), market.orient(F.col("_p_l"), F.col("_team_l"), F.col("team_sharp")))
    return got.withColumn("later_close", close).drop("at_l", "_p_l", "_team_l")


def moves(outcomes: DataFrame) -> DataFrame:
    """The gaps with one row per horizon that has a later price: horizon, move (towards the sharp price, unclipped)."""
    cells = [F.struct(F.lit(h).alias("horizon"), ((F.col(f"later_{h}") - F.col("own")) * direction(F.col("sharp"), F.col("own"))).alias("move")) for h in (*HORIZONS, "close")]
    return outcomes.select("*", F.inline(F.array(*cells))).where("move is not null")


def summarise(moved: DataFrame) -> DataFrame:
    """horizon, n, mean, median, floor, toward."""
    return moved.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg("move").alias("mean"), F.median("move").alias("median"), F.avg("floor").alias("floor"), F.count_if(F.col("move") > 0).alias("toward")
    )


def size_table(moved: DataFrame) -> DataFrame:
    """bucket, n, toward, still, breakeven, floor of the moves to the close, by size of the gap."""
    bucket = bands(F.col("size"), SIZES, lambda lo, hi: f"{lo:.2f}-{hi:.2f}")
    per = moved.where("horizon = 'close'").withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("move") > 0).cast("int")).alias("toward"), F.avg((F.col("move") == 0).cast("int")).alias("still"),
        F.avg("size").alias("_size"), F.avg("floor").alias("floor"),
    )
    return per.withColumn("breakeven", market.breakeven_rate(F.col("_size"), F.col("floor"))).drop("_size")


def near_misses(scanned: DataFrame, at_price: float = 0.80, half_spread: float = 0.01, alignment: float = 0.0) -> DataFrame:
    """band, n, mean_price, mean_floor, would: differences under the floor, and how many the floor at ``at_price`` would let pass."""
    tail = market.floor_of(F.lit(at_price), F.lit(half_spread), F.lit(alignment))
    band = bands(F.col("size"), NEAR_MISSES, lambda lo, hi: f"{lo:.4f}-{hi:.4f}")
    rows = scanned.where("reason = 'under floor'").withColumn("band", band).where("band is not null")
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("own").alias("mean_price"), F.avg("floor").alias("mean_floor"), F.count_if(F.col("size") > tail).alias("would"))


def one_side(sides: DataFrame, by: str, sharp_team: str) -> DataFrame:
    """One market side per entity: the sharp quotes' team if it is there, else the one with most quotes, then the first name."""
    best = F.struct((F.col("team") == F.col(sharp_team)).cast("int"), "n", -F.ascii("team"))
    return sides.groupBy(by).agg(F.max_by(F.struct("team", "n"), best).alias("_s")).select(by, "_s.team", "_s.n")


def live_moments(starts: DataFrame, fetches: DataFrame, key: str, at: str, slack_minutes: int = 15, minutes: int = 180) -> DataFrame:
    """key, n: fetches with start + slack < at <= start + minutes, for each entity, without a pair of game and fetch."""
    lag = lambda m: F.col("start") + F.make_dt_interval(mins=F.lit(m))
    spans = starts.select(key, F.lit(1).alias("_all"), lag(slack_minutes).alias("_from"), lag(minutes).alias("_to"))
    points = fetches.select(F.lit(1).alias("_all"), at)
    return temporal.interval_overlap_count(points, at, spans, "_from", "_to", ["_all"]).select(key, "n")


def median_cadence(fetches: DataFrame, at: str) -> DataFrame:
    """One row, minutes: the median pause between neighbouring fetch times.

    The times are cut into days; only the seams between days come together.
    """
    from pyspark.sql import Window

    times = fetches.select(temporal.micros(at).alias("us")).distinct().withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    inner = times.withColumn("d", F.col("us") - F.lag("us").over(Window.partitionBy("day").orderBy("us"))).where("d is not null").select("d")
    ends = times.groupBy("day").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    seams = ends.select((F.col("a") - F.lag("b").over(Window.partitionBy(F.lit(1)).orderBy("day"))).alias("d")).where("d is not null")
    return inner.unionByName(seams).agg((F.median("d") / 60_000_000).alias("minutes"))
