"""Shrunken rates: empirical-Bayes constants, pooling over prefixes, posteriors, weighted least squares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the prior strength.
K_LOW, K_HIGH = 1.0, 100_000.0


def strict_weight(age_days: Column, half_life: float) -> Column:
    """As ``recency_weight``, but an observation from the future raises."""
    ahead = F.raise_error(F.lit("negative age: an observation from the future is a leak")).cast("double")
    return F.when(age_days < 0, ahead).otherwise(recency_weight(age_days, half_life))


def recency_weight(age_days: Column, half_life: float) -> Column:
    """Halves every ``half_life`` days; the future counts as today."""
    return F.exp(-F.log(F.lit(2.0)) * F.greatest(age_days, F.lit(0)) / half_life)


def eb_constants(tallies: DataFrame, trials: str, successes: str, thresholds: Sequence[float], by: Sequence[str] = (), noise: str | None = None) -> DataFrame:
    """Method-of-moments prior per group and threshold: mean, var_true, k, n_eligible, saturated.

    Two passes for precision: means first, then squared deviations from them.
    ``noise`` names a column with the sampling variance of each row's rate; it
    is needed for rates that don't count yes and no.  With fewer than two
    eligible rows, or no variance beyond the noise, k is at its upper bound and
    ``saturated`` is set; a group without an eligible row has mean 0.
    """
    n, x = F.col(trials).cast("double"), F.col(successes).cast("double")
    own = F.col(noise).cast("double") if noise else F.lit(None).cast("double")
    each = tallies.select(*by, n.alias("_n"), x.alias("_x"), own.alias("_v"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("min_trials"))
    fits = (F.col("_n") >= F.col("min_trials")) & (F.col("_n") > 0)
    group = [*by, "min_trials"]
    means = each.groupBy(*group).agg(
        F.coalesce(F.try_divide(F.sum(F.when(fits, F.col("_x"))), F.sum(F.when(fits, F.col("_n")))), F.lit(0.0)).alias("mean"), F.count_if(fits).alias("n_eligible")
    )
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"m.{c}")) for c in group]
    joined = each.alias("e").join(means.alias("m"), same).withColumn("_fits", (F.col("e._n") >= F.col("e.min_trials")) & (F.col("e._n") > 0))
    weight = F.when(F.col("_fits"), F.col("e._n"))
    total = F.sum(weight)
    spread = joined.groupBy(*[F.col(f"m.{c}").alias(c) for c in group], "m.mean", "m.n_eligible").agg(
        F.try_divide(F.sum(weight * F.pow(F.col("e._x") / F.col("e._n") - F.col("m.mean"), 2)), total).alias("variance"),
        F.try_divide(F.sum(weight * F.col("e._v")), total).alias("given"), F.try_divide(F.count_if(F.col("_fits")), total).alias("inverse"),
    )
    binomial = F.col("mean") * (1 - F.col("mean"))
    beyond = F.col("variance") - (F.col("given") if noise else binomial * F.col("inverse"))
    bad = F.coalesce((F.col("n_eligible") < 2) | (beyond <= 0), F.lit(True))
    k = F.when(bad, K_HIGH).otherwise(F.greatest(F.lit(K_LOW), F.least(F.lit(K_HIGH), F.try_divide(binomial, beyond) - 1)))
    true = F.when(bad, 0.0).otherwise(beyond)
    return spread.select(*group, "n_eligible", "mean", true.alias("var_true"), k.alias("k"), bad.alias("saturated"))


def pooled_rates(df: DataFrame, levels: Sequence[str], successes: Column, trials: Column, k: float) -> DataFrame:
    """Every prefix of ``levels`` shrunk to its parent: (x + k parent) / (n + k); the root is its raw mean.

    One rollup gives the sums of all prefixes; each level is then joined to the
    one above.  Nulls among the levels are a value of their own.
    """
    named = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in levels], successes.alias("_x"), trials.alias("_n"))
    sums = named.rollup(*levels).agg(F.sum("_x").alias("x"), F.sum("_n").alias("n"), F.grouping_id().alias("_id"))
    depth = len(levels)
    at = lambda d: sums.where(F.col("_id") == (1 << (depth - d)) - 1)
    level = at(0).select(F.lit(0).alias("depth"), *[F.lit(None).cast("string").alias(c) for c in levels], "x", "n", F.try_divide("x", "n").alias("rate"))
    out = level
    for d in range(1, depth + 1):
        parent = level.select(*levels[: d - 1], F.col("rate").alias("_parent")) if d > 1 else None
        here = at(d)
        if parent is None:
            root = level.select(F.col("rate").alias("_parent"), F.lit(1).alias("_one"))
            here = here.withColumn("_one", F.lit(1)).join(F.broadcast(root), "_one")  # one root row
        else:
            here = here.join(parent, list(levels[: d - 1]))
        level = here.select(
            F.lit(d).alias("depth"), *[F.col(c) if i < d else F.lit(None).cast("string").alias(c) for i, c in enumerate(levels)],
            "x", "n", F.try_divide(F.col("x") + k * F.col("_parent"), F.col("n") + k).alias("rate"),
        )
        out = out.unionByName(level)
    return out


def dirichlet_posterior(counts: Column, trials: Column, priors: Column, strengths: Column) -> Column:
    """Each bucket shrunk on its own, then scaled to one.  All arguments but ``trials`` are arrays."""
    raw = F.transform(F.arrays_zip(counts.alias("x"), priors.alias("m"), strengths.alias("k")), lambda b: (b["x"] + b["k"] * b["m"]) / (trials + b["k"]))
    return F.transform(F.array(raw), lambda r: _shares(r))[0]


def _shares(raw: Column) -> Column:
    whole = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    total = F.when(whole == 0, F.raise_error(F.lit("shrunk rates sum to zero")).cast("double")).otherwise(whole)
    return F.transform(F.array(total), lambda t: F.transform(raw, lambda p: p / t))[0]


def concentration(p: Column, trials: Column, strengths: Column) -> Column:
    """How sure a posterior is: the harmonic mean of trials plus strengths, weighted by the shares; the trials if nothing weighs."""
    parts = F.zip_with(p, strengths, lambda a, k: F.when(trials + k > 0, a / (trials + k)).otherwise(0.0))
    inverse = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.when(inverse > 0, F.try_divide(F.lit(1.0), inverse)).otherwise(trials)


def prior_lookup(cells: DataFrame, table: DataFrame, levels: Sequence[str]) -> DataFrame:
    """``cells`` with mean and label of the nearest populated prefix of ``pooled_rates``; raises where not even the root has trials."""
    names = {d: f"_m{d}" for d in range(len(levels) + 1)}
    out = cells.withColumn("_one", F.lit(1))
    for d in range(len(levels), -1, -1):
        at = table.where((F.col("depth") == d) & (F.col("n") > 0))
        if d:
            held = at.select(*[F.col(c).alias(f"_k{d}{i}") for i, c in enumerate(levels[:d])], F.col("rate").alias(names[d]))
            out = out.join(held, [F.col(c).eqNullSafe(F.col(f"_k{d}{i}")) for i, c in enumerate(levels[:d])], "left")
        else:
            out = out.join(F.broadcast(at.select(F.lit(1).alias("_one"), F.col("rate").alias(names[0]))), "_one", "left")  # one row
    mean = F.coalesce(*[F.col(names[d]) for d in range(len(levels), -1, -1)])
    label = F.when(F.lit(False), "")
    for d in range(len(levels), -1, -1):
        label = label.when(F.col(names[d]).isNotNull(), F.concat_ws("|", *[F.col(c) for c in levels[:d]]) if d else F.lit("root"))
    known = F.when(mean.isNull(), F.raise_error(F.lit("no populated prior")).cast("double")).otherwise(mean)
    return out.select(*cells.columns, known.alias("mean"), label.alias("label"))


def split_deltas(df: DataFrame, own: str, split: str, buckets: dict[str, Column], trials: Column) -> DataFrame:
    """own, split, bucket, delta: a split's rate less the rate over all splits, from one grouping-sets pass."""
    base = df.select(own, split, trials.alias("_n"), *[c.alias(f"_b_{b}") for b, c in buckets.items()])
    sums = base.groupBy(own, split).agg(F.sum("_n").alias("_n"), *[F.sum(f"_b_{b}").alias(f"_b_{b}") for b in buckets])
    whole = base.groupBy(F.col(own).alias("_own")).agg(F.sum("_n").alias("_wn"), *[F.sum(f"_b_{b}").alias(f"_w_{b}") for b in buckets])
    joined = sums.join(whole, F.col(own).eqNullSafe(F.col("_own")))
    rows = F.array(*[
        F.struct(F.lit(b).alias("bucket"), (F.try_divide(F.col(f"_b_{b}"), F.col("_n")) - F.try_divide(F.col(f"_w_{b}"), F.col("_wn"))).alias("delta"))
        for b in buckets
    ])
    return joined.select(own, split, F.inline(rows))


def weighted_least_squares(df: DataFrame, y: str, x1: str, x2: str, weight: str, by: Sequence[str] = (), least_weight: float = 0.0, least_rows: int = 30, least_r2: float = 0.10) -> DataFrame:
    """Intercept and two slopes per group from centred weighted moments, one aggregation and one join.

    Rows of less than ``least_weight`` don't count; ``usable`` says whether
    there are rows and fit enough, ``residual_sd`` how far the fit is off.

    With collinear or constant regressors the minimum-norm slopes are given;
    ``n`` and ``r2`` say whether to trust the fit.
    """
    d = df.select(*by, *[F.col(c).cast("double").alias(a) for c, a in ((y, "_y"), (x1, "_1"), (x2, "_2"), (weight, "_w"))]).dropna(subset=["_y", "_1", "_2", "_w"]).where(F.col("_w") >= least_weight)
    group = list(by) or ["_all"]
    d = d if by else d.withColumn("_all", F.lit(1))
    mean = d.groupBy(*group).agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(f"m{c}") for c in ("_y", "_1", "_2")], F.count(F.lit(1)).alias("n"))
    c = d.join(mean if by else F.broadcast(mean), group)  # one row without groups
    dev = {k: F.col(k) - F.col(f"m{k}") for k in ("_y", "_1", "_2")}
    moment = lambda a, b: F.sum(F.col("_w") * dev[a] * dev[b])
    m = c.groupBy(*group, "n", "m_y", "m_1", "m_2").agg(
        moment("_1", "_1").alias("s11"), moment("_2", "_2").alias("s22"), moment("_1", "_2").alias("s12"),
        moment("_1", "_y").alias("s1y"), moment("_2", "_y").alias("s2y"), moment("_y", "_y").alias("syy"), F.sum("_w").alias("sw"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    full = det > 1e-12 * F.col("s11") * F.col("s22")
    trace = F.col("s11") + F.col("s22")
    # rank one: the slopes lie along the only direction with spread
    single = F.try_divide(F.lit(1.0), trace)
    b1 = F.when(full, F.try_divide(F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y"), det)).otherwise(F.coalesce(F.col("s1y") * single, F.lit(0.0)))
    b2 = F.when(full, F.try_divide(F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y"), det)).otherwise(F.coalesce(F.col("s2y") * single, F.lit(0.0)))
    fit = m.withColumns({"b1": b1, "b2": b2})
    explained = F.col("b1") * F.col("s1y") + F.col("b2") * F.col("s2y")
    r2 = F.try_divide(explained, F.col("syy"))
    return fit.select(
        *by, "n", (F.col("m_y") - F.col("b1") * F.col("m_1") - F.col("b2") * F.col("m_2")).alias("b0"), "b1", "b2",
        r2.alias("r2"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("syy") - explained, F.col("sw")))).alias("residual_sd"),
        F.coalesce((F.col("n") >= least_rows) & (r2 >= least_r2), F.lit(False)).alias("usable"),
    )


def cell_rates(df: DataFrame, cell: Sequence[str], subject: str, hit: Column, min_cell: int, min_subject: int, k: float) -> DataFrame:
    """subject, n, excess, shrunk: mean of hit less its cell's rate, over cells with enough rows.

    The cell's rate is an aggregate joined back, so no window holds a whole
    cell; ``shrunk`` is the excess times n / (n + k).
    """
    marked = df.withColumn("_hit", hit.cast("double"))
    league = marked.groupBy(*cell).agg(F.avg("_hit").alias("_rate"), F.count(F.lit(1)).alias("_cell_n")).where(F.col("_cell_n") >= min_cell)
    over = marked.join(league, list(cell)).groupBy(subject).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_hit") - F.col("_rate")).alias("excess"))
    return over.where(F.col("n") >= min_subject).withColumn("shrunk", F.col("excess") * F.col("n") / (F.col("n") + k))


def nearest_index_percentile(df: DataFrame, group: Sequence[str], value: str, q: float, bins: int = 1000) -> DataFrame:
    """The value at index min(floor(q n), n - 1) of each sorted group, without gathering a group.

    Values are counted first, so ties cost one row, and laid into ``bins``
    between the group's least and greatest; only the values of the bin that
    holds the index are sorted.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ends = counts.groupBy(*keys).agg(F.min("_v").cast("double").alias("_lo"), F.max("_v").cast("double").alias("_hi"), F.sum("_c").alias("_n"))
    binned = counts.alias("c").join(ends.alias("e"), [F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys])
    share = F.try_divide(F.col("_v").cast("double") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    binned = binned.select(*[F.col(f"c.{k}") for k in keys], "_v", "_c", "_n", at.alias("_bin"))
    run = Window.partitionBy(*keys).orderBy("_bin")
    sums = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_all"), F.max("_n").alias("_n")).withColumn("_upto", F.sum("_all").over(run))
    index = F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1)
    hit = sums.where((F.col("_upto") > index) & (F.col("_upto") - F.col("_all") <= index)).select(*[F.col(k).alias(f"h{k}") for k in keys], F.col("_bin").alias("h_bin"), (F.col("_upto") - F.col("_all")).alias("_base"))
    near = binned.join(hit, [F.col("_bin") == F.col("h_bin"), *[F.col(k).eqNullSafe(F.col(f"h{k}")) for k in keys]])
    placed = near.withColumn("_upto", F.col("_base") + F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")))
    found = placed.where((F.col("_upto") > index) & (F.col("_upto") - F.col("_c") <= index))
    return found.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], F.col("_v").alias("percentile"))
