"""Outcome shares of hit balls by speed and angle: cells shrunk to their band, bands to the whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of the buckets and edges of the angle bands.
SPEED_WIDTH, ANGLE_WIDTH = 2.0, 3.0
BAND_EDGES = (-90, 0, 10, 25, 50, 90)


def speed_bucket(v: Column) -> Column:
    return F.floor(v / SPEED_WIDTH)


def angle_bucket(v: Column) -> Column:
    return F.floor(v / ANGLE_WIDTH)


def angle_band(v: Column) -> Column:
    """Half-open bands; beyond the edges ``out_of_range``; null stays null."""
    out = F.when(v.isNull(), None)
    for lo, hi in zip(BAND_EDGES, BAND_EDGES[1:]):
        out = out.when((v >= lo) & (v < hi), f"{lo}..{hi}")
    return out.otherwise("out_of_range")


def _shares(outcomes: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(f"x_{o}") for o in outcomes]


def marginal_shares(balls: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """One row: shares over all balls, measured or not; equal shares when there are none."""
    one = balls.agg(F.count_if(F.col("outcome").isin(*outcomes)).alias("n"), *_shares(outcomes))
    return one.select(F.array(*[F.coalesce(F.try_divide(F.col(f"x_{o}"), F.col("n")), F.lit(1.0 / len(outcomes))) for o in outcomes]).alias("marginal"))


def contact_table(balls: DataFrame, outcomes: Sequence[str], k: float = 40.0) -> DataFrame:
    """level, band, speed, n, p: shrunk shares of every cell with a measured ball, of the bands above them, and of all.

    ``balls``: speed, angle, outcome, of the days the fit may know.  One
    aggregation over the balls; bands and the whole are sums of its cells.
    """
    measured = balls.where("speed is not null and angle is not null").where(F.col("outcome").isin(*outcomes))
    cells = measured.groupBy(angle_band(F.col("angle")).alias("band"), speed_bucket(F.col("speed")).alias("speed")).agg(F.count(F.lit(1)).alias("n"), *_shares(outcomes))
    sums = [F.sum("n").alias("n"), *[F.sum(f"x_{o}").alias(f"x_{o}") for o in outcomes]]
    vector = F.array(*[F.col(f"x_{o}").cast("double") for o in outcomes])
    shrink = lambda x, n, parent: F.zip_with(x, parent, lambda a, p: (a + k * p) / (n + k))
    root = cells.agg(*sums).where("n > 0").select(F.lit("all").alias("level"), F.lit(None).cast("string").alias("band"), F.lit(None).cast("bigint").alias("speed"), "n", F.transform(vector, lambda x: F.try_divide(x, F.col("n"))).alias("p"))
    above = root.select(F.col("p").alias("root"), F.lit(1).alias("one"))  # one row
    bands = cells.groupBy("band").agg(*sums).withColumn("one", F.lit(1)).join(F.broadcast(above), "one").select(F.lit("band").alias("level"), "band", F.lit(None).cast("bigint").alias("speed"), "n", shrink(vector, F.col("n"), F.col("root")).alias("p"))
    inner = cells.join(bands.select("band", F.col("p").alias("parent")), "band").select(F.lit("cell").alias("level"), "band", "speed", "n", shrink(vector, F.col("n"), F.col("parent")).alias("p"))
    return inner.unionByName(bands).unionByName(root)


def predict(balls: DataFrame, table: DataFrame, marginal: DataFrame) -> DataFrame:
    """``balls`` with ``p`` and ``source``: the shares of the nearest populated level (cell, band, all), the marginal for an unmeasured ball or an empty table."""
    measured = F.col("speed").isNotNull() & F.col("angle").isNotNull()
    keyed = balls.withColumns({"_band": F.when(measured, angle_band(F.col("angle"))), "_speed": F.when(measured, speed_bucket(F.col("speed"))), "_one": F.lit(1)})
    at = lambda level, *names: table.where(F.col("level") == level).select(*[F.col(n).alias(f"_{n}") for n in names], F.col("p").alias(f"_p_{level}"))
    one = lambda df: F.broadcast(df.withColumn("_one", F.lit(1)))
    joined = keyed.join(at("cell", "band", "speed"), ["_band", "_speed"], "left").join(at("band", "band"), "_band", "left")
    joined = joined.join(one(at("all")), "_one", "left").join(one(marginal), "_one")
    found = F.when(measured, F.coalesce("_p_cell", "_p_band", "_p_all"))
    source = F.when(~measured | found.isNull(), "marginal").when(F.col("_p_cell").isNotNull(), "cell").when(F.col("_p_band").isNotNull(), "band").otherwise("all")
    return joined.select(*balls.columns, F.coalesce(found, F.col("marginal")).alias("p"), source.alias("source"))


def expected_shares(predicted: DataFrame, by: Sequence[str], weight: Column, size: int) -> DataFrame:
    """by, p, p2, n: weighted means of the predicted shares and of their squares over a player's balls."""
    w = predicted.withColumn("_w", weight)
    total = F.sum("_w")
    mean = lambda f: F.array(*[F.try_divide(F.sum(F.col("_w") * f(F.col("p")[i])), total) for i in range(size)])
    return w.groupBy(*by).agg(mean(lambda x: x).alias("p"), mean(lambda x: x * x).alias("p2"), total.alias("n"))


def cell_rows(balls: DataFrame, table: DataFrame, marginal: DataFrame) -> DataFrame:
    """speed, angle, n, p: the table at the middle of every (speed, angle) bucket that holds a ball."""
    measured = balls.where("speed is not null and angle is not null")
    counts = measured.groupBy(speed_bucket(F.col("speed")).alias("speed_bucket"), angle_bucket(F.col("angle")).alias("angle_bucket")).agg(F.count(F.lit(1)).alias("n"))
    middle = counts.withColumns({"speed": (F.col("speed_bucket") + 0.5) * SPEED_WIDTH, "angle": (F.col("angle_bucket") + 0.5) * ANGLE_WIDTH})
    return predict(middle, table, marginal).select("speed_bucket", "angle_bucket", "n", "p")
