"""History to posterior rates: one plan over all snapshot dates at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import rates

#: Bounds of a predicted first rate, least share of a split prior, strength of a split prior, first seasons' trials.
PROXY_LOW, PROXY_HIGH = 0.02, 0.60
LEAST_SHARE, SPLIT_K, ROOKIE = 1e-6, 2000.0, 500.0


def tallies(history: DataFrame, outcomes: Sequence[str], snapshots: Sequence[str], half_life: float, more: dict[str, Column] | None = None) -> DataFrame:
    """snapshot, player, split, n, x_<outcome> and m_<name>: weighted counts of everything strictly before each snapshot.

    ``more`` adds weighted sums (pitches, swings, squares of expected shares).
    Rows are first folded to one per player, side and day, then to the interval
    between snapshots they fall in; as a weight falls by the same factor for
    all older rows, a running sum over the intervals gives every snapshot, so no
    row is repeated per snapshot.  A row counts for split ALL and its opposing side.
    """
    names = [f"x_{o}" for o in outcomes] + [f"m_{k}" for k in (more or {})]
    cells = [F.count_if(F.col("outcome") == o).cast("double") for o in outcomes] + [F.sum(c).cast("double") for c in (more or {}).values()]
    days = history.groupBy("player", "opposing", "day").agg(F.count(F.lit(1)).cast("double").alias("n"), *[c.alias(a) for a, c in zip(names, cells)])
    marks = F.array_sort(F.array(*[F.to_date(F.lit(s)) for s in snapshots]))
    first = F.filter(marks, lambda s: s > F.col("day"))  # the first snapshot that knows the day
    due = days.withColumn("snapshot", F.get(first, F.lit(0))).where("snapshot is not null")
    weight = rates.recency_weight(F.datediff("snapshot", "day"), half_life)
    split = F.explode(F.array(F.lit("ALL"), "opposing")).alias("split")
    aged = due.select("snapshot", "player", split, *[(weight * F.col(c)).alias(c) for c in ("n", *names)])
    per = aged.groupBy("player", "split", "snapshot").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    # a row per player, split and snapshot from the first one on: as many as there are results
    begun = per.groupBy("player", "split").agg(F.min("snapshot").alias("_from"))
    grid = begun.select("player", "split", F.explode(F.filter(marks, lambda s: s >= F.col("_from"))).alias("snapshot"))
    full = grid.join(per, ["player", "split", "snapshot"], "left")
    since = F.datediff("snapshot", F.lit("2000-01-01").cast("date")) / float(half_life)
    span = Window.partitionBy("player", "split").orderBy("snapshot")
    last = F.max("_h").over(Window.partitionBy("player", "split"))
    aged = full.withColumn("_h", since).withColumn("_top", last)
    # summed as if all were seen from the last snapshot, then moved back to each
    sums = [(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.pow(F.lit(2.0), F.col("_h") - F.col("_top"))).over(span) * F.pow(F.lit(2.0), F.col("_top") - F.col("_h"))).alias(c) for c in ("n", *names)]
    return aged.select("snapshot", "player", "split", *sums)


def sampling_variance(x: Column, n: Column) -> Column:
    """Of an observed rate of yes and no; 0 without trials."""
    rate = F.try_divide(x, n)
    return F.when(n > 0, rate * (1 - rate) / n).otherwise(0.0)


def contact_variance(total: Column, squares: Column, balls: Column, n: Column) -> Column:
    """Of a rate that sums probabilities over ``balls``: their spread within the player; 0 without balls or trials."""
    mean = F.try_divide(total, balls)
    within = F.greatest(F.try_divide(squares, balls) - mean * mean, F.lit(0.0))
    return F.when((n > 0) & (balls > 0), within * balls / (n * n)).otherwise(0.0)


def prior_key(hand: Column, trials: Column, rookie: float = ROOKIE) -> tuple[Column, Column]:
    return F.concat(F.lit("hand:"), hand), F.when(F.coalesce(trials, F.lit(0.0)) < rookie, "rookie").otherwise("established")


def proxied(means: Column, predicted: Column) -> Column:
    """Prior means whose first is replaced by a prediction within bounds, the others scaled to keep the sum; unchanged without one."""
    p = F.greatest(F.least(predicted, F.lit(PROXY_HIGH)), F.lit(PROXY_LOW))
    rest = 1 - means[0]
    moved = F.transform(means, lambda m, i: F.when(i == 0, p).otherwise(m * (1 - p) / rest))
    return F.when(predicted.isNotNull() & (rest > 0), moved).otherwise(means)


def split_prior(overall: Column, deltas: Column) -> Column:
    """A player's own rates moved by the league's split deltas, floored and scaled to one."""
    raw = F.zip_with(overall, deltas, lambda p, d: F.greatest(p + F.coalesce(d, F.lit(0.0)), F.lit(LEAST_SHARE)))
    return F.transform(F.array(raw), lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda a, y: a + y)))[0]


def constants(counted: DataFrame, outcomes: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """snapshot, outcome, min_trials, mean, k of the ALL split."""
    long = counted.where("split = 'ALL'").select(
        "snapshot", "n", F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"x_{o}").alias("x")) for o in outcomes]))
    )
    return rates.eb_constants(long, "n", "x", thresholds, ["snapshot", "outcome"])


def project(history: DataFrame, outcomes: Sequence[str], snapshots: Sequence[str], half_life: float, thresholds: Sequence[float], split_k: float = SPLIT_K) -> DataFrame:
    """snapshot, player, split, outcome, p, concentration, prior_weight, label.

    The ALL split is shrunk to the snapshot's league by the constants of the
    greatest threshold; a side is shrunk, with ``split_k``, to the player's own
    rates moved by the league's deltas of that side.  ``history``: player, day,
    opposing, outcome.  Outcomes outside the list count as trials only.
    """
    counted = tallies(history, outcomes, snapshots, half_life)
    arr = lambda f: F.array(*[f(o) for o in outcomes])
    fit = constants(counted, outcomes, thresholds).where(F.col("min_trials") == max(thresholds))
    prior = fit.groupBy("snapshot").agg(*[F.max(F.when(F.col("outcome") == o, F.struct("mean", "k"))).alias(f"f_{o}") for o in outcomes])
    prior = prior.select("snapshot", arr(lambda o: F.col(f"f_{o}.mean")).alias("means"), arr(lambda o: F.col(f"f_{o}.k")).alias("ks"))
    x = arr(lambda o: F.col(f"x_{o}"))
    whole = counted.where("split = 'ALL'").select("snapshot", "player", "n", x.alias("x")).join(prior, "snapshot")
    whole = whole.withColumn("p", rates.dirichlet_posterior(F.col("x"), F.col("n"), F.col("means"), F.col("ks")))
    whole = whole.withColumn("concentration", rates.concentration(F.col("p"), F.col("n"), F.col("ks")))
    rate = lambda df, by, a: df.groupBy(*by).agg(F.array(*[F.try_divide(F.sum(f"x_{o}"), F.sum("n")) for o in outcomes]).alias(a))
    league = rate(counted.where("split <> 'ALL'"), ["snapshot", "split"], "side").join(rate(counted.where("split = 'ALL'"), ["snapshot"], "all"), "snapshot")
    deltas = league.select("snapshot", "split", F.zip_with("side", "all", lambda a, b: a - b).alias("deltas"))
    sides = counted.where("split <> 'ALL' and n > 0").select("snapshot", "player", "split", "n", x.alias("x"))
    sides = sides.join(whole.select("snapshot", "player", F.col("p").alias("overall")), ["snapshot", "player"]).join(deltas, ["snapshot", "split"], "left")
    heavy = F.array(*[F.lit(float(split_k)) for _ in outcomes])
    sides = sides.withColumn("means", split_prior(F.col("overall"), F.coalesce("deltas", F.transform("overall", lambda _: F.lit(0.0))))).withColumn("ks", heavy)
    sides = sides.withColumn("p", rates.dirichlet_posterior(F.col("x"), F.col("n"), F.col("means"), F.col("ks")))
    sides = sides.withColumn("concentration", rates.concentration(F.col("p"), F.col("n"), F.col("ks")))
    weight = F.greatest(F.col("concentration") - F.col("n"), F.lit(0.0)) / F.col("concentration")
    cols = lambda df, split, label: df.select("snapshot", "player", split, "concentration", weight.alias("prior_weight"), F.lit(label).alias("label"), F.inline(F.arrays_zip(arr(F.lit).alias("outcome"), F.col("p").alias("p"))))
    return cols(whole, F.lit("ALL").alias("split"), "league").unionByName(cols(sides, F.col("split"), "league+platoon"))
