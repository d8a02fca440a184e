"""Reads over append-only versions, and joins of irregular series by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.registry import TableSpec, guard


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order; only one row per key and task is shuffled on."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def as_of(
    df: DataFrame, key: Sequence[str], known_at: str, cutoff: Column, ties: Sequence[Column] = (),
    where: Column | None = None, inclusive: bool = True, collapse: bool = True,
) -> DataFrame:
    """Rows as known at ``cutoff``.

    ``where`` narrows the versions BEFORE the latest is chosen ("latest among
    the matching"); filter the result for "latest, if it matches".  With
    ``collapse`` off, all versions known by then.
    """
    known = df.where(F.col(known_at) <= cutoff if inclusive else F.col(known_at) < cutoff)
    if where is not None:
        known = known.where(where)
    return latest(known, key, [F.col(known_at).desc(), *ties]) if collapse else known


def read_as_of(df: DataFrame, spec: TableSpec, cutoff: Column, allow_outcomes: bool = False, **how) -> DataFrame:
    """``as_of`` behind the leak guard of the table's specification."""
    guard(spec, allow_outcomes)
    return as_of(df, spec.key, spec.known_at, cutoff, **how)


def before_event(df: DataFrame, key: Sequence[str], known_at: str, events: DataFrame, on: Sequence[str], at: str, lead_seconds: int = 0, ties: Sequence[Column] = ()) -> DataFrame:
    """Latest version per key strictly before each entity's own event time, all entities at once."""
    lead = F.make_dt_interval(secs=F.lit(lead_seconds))
    joined = df.join(events.select(*on, at), list(on)).where(F.col(known_at) < F.col(at) - lead)
    return latest(joined, key, [F.col(known_at).desc(), *ties])


def expanding_aggregate(df: DataFrame, date: str, through: Column, group: Sequence[str], seasons: Sequence[int] | None = None, **values: Column) -> DataFrame:
    """Aggregates per group over everything strictly before ``through``, in the given years if there are any (an empty list selects none)."""
    known = df.where(F.col(date) < through)
    if seasons is not None:
        known = known.where(F.year(date).isin(list(seasons)))
    return known.groupBy(*group).agg(*[v.alias(k) for k, v in values.items()])


def expanding_snapshots(df: DataFrame, date: Column, start: str, stop: str, step_days: int, group: Sequence[str], value: Column) -> DataFrame:
    """snapshot, n, total: count and sum per group strictly before every snapshot date.

    Snapshots lie ``step_days`` apart from ``start`` to ``stop``.  Rows are
    first summed into the interval they fall in, so the window runs over
    intervals, not rows; groups without earlier rows give none.
    """
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(stop))
    ahead = F.greatest(F.lit(0), F.floor(F.datediff(date, first) / step_days) + 1).cast("int")
    cells = (
        df.select(*group, F.date_add(first, ahead * step_days).alias("_mark"), value.alias("_value"))
        .where(F.col("_mark") <= last)
        .groupBy(*group, "_mark")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_sum"))
    )
    run = Window.partitionBy(*group).orderBy("_mark")
    until = F.coalesce(F.date_sub(F.lead("_mark").over(run), 1), last)
    totals = cells.withColumns({"n": F.sum("_n").over(run), "total": F.sum("_sum").over(run), "_until": until})
    step = F.make_dt_interval(days=F.lit(step_days))
    return totals.select(*group, F.explode(F.sequence("_mark", "_until", step)).alias("snapshot"), "n", "total")


#: Width of the time blocks an entity is cut into, so that one that holds a third of all rows is spread over its blocks.
BLOCK_SECONDS = 86_400


def micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def _block(us: Column, seconds: int) -> Column:
    return F.floor(us / F.lit(seconds * 1_000_000)).cast("bigint")


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, values: Sequence[str],
    direction: str = "backward", tolerance_us: int | None = None, ties: Sequence[Column] = (), suffix: str = "_r", block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Each left row with the last right row at or before it (or the first at or after it).

    Union and a running ``last`` within blocks of time: linear after one sort,
    equal times match, and among right rows of equal time the last in ``ties``
    order wins.  What a block doesn't know, the last right row before it, comes
    from a row per entity and block.  Beyond the tolerance (inclusive), without
    a match, and for rows with a null entity or time the values are null.
    """
    sign = -1 if direction == "forward" else 1  # the first after is the last before, in time that runs backwards
    at = lambda c: micros(c) * sign
    carried = F.struct(micros(right_at).alias("us"), F.col(right_at).alias(right_at), *[F.col(v) for v in values if v != right_at])
    tie = F.struct(*(ties or [F.lit(0)]))
    r = right.where(F.col(right_at).isNotNull()).select(*by, at(right_at).alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), carried.alias("_hit"))
    row = F.struct(*[F.col(c) for c in left.columns if c not in by])
    l = left.select(*by, at(left_at).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"))
    both = r.unionByName(l, allowMissingColumns=True).withColumn("_b", _block(F.col("_t"), block_seconds))
    # one row per entity and block: its last right row, and from it the last one of all blocks before
    ends = both.groupBy(*by, "_b").agg(F.max_by("_hit", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    heads = ends.withColumn("_hit", before).where("_hit is not null and _b is not null")
    heads = heads.select(*by, "_b", F.lit(-1).alias("_side"), "_hit")
    span = Window.partitionBy(*by, "_b").orderBy("_side_first", "_t", "_side", "_tie")
    known = both.unionByName(heads, allowMissingColumns=True).withColumn("_side_first", F.when(F.col("_side") == -1, 0).otherwise(1))
    hit = F.last("_hit", ignorenulls=True).over(span.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = known.withColumn("_hit", hit).where("_side = 1")
    near = F.col("_t").isNotNull()
    for c in by:
        near = near & F.col(c).isNotNull()
    if tolerance_us is not None:
        near = near & (F.abs(F.col("_t") * sign - F.col("_hit.us")) <= tolerance_us)
    names = [right_at, *[v for v in values if v != right_at]]
    return found.select(*by, "_row.*", *[F.when(near, F.col(f"_hit.{n}")).alias(n + suffix) for n in names])


def episodes(df: DataFrame, key: Sequence[str], at: str, gap_seconds: int, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Rows with the number of the run they belong to; a pause longer than ``gap_seconds`` starts a new run.

    Runs are counted within blocks of time; a row per entity and block carries
    the last time and the number of runs of the blocks before it.
    """
    keyed = df.withColumn("_us", micros(at)).withColumn("_b", _block(F.col("_us"), block_seconds))
    span, blocks = Window.partitionBy(*key, "_b").orderBy("_us"), Window.partitionBy(*key).orderBy("_b")
    inner = keyed.withColumn("_ago", F.col("_us") - F.lag("_us").over(span))
    long = F.col("_ago") > gap_seconds * 1_000_000
    ends = inner.groupBy(*key, "_b").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count_if(long).alias("_n"))
    ago = F.col("_first") - F.lag("_last").over(blocks)
    opens = F.when(ago <= gap_seconds * 1_000_000, 0).otherwise(1)
    heads = ends.withColumn("_open", opens).withColumn("_base", F.sum(F.col("_open") + F.col("_n")).over(blocks) - F.col("_n"))
    names = [*key, "_b"]
    joined = inner.join(heads.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(names)], "_base"), [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(names)])
    number = F.col("_base") + F.coalesce(F.sum(F.when(long, 1).otherwise(0)).over(span), F.lit(0))
    return joined.withColumn("episode", number).select(*df.columns, "episode")


def identical_runs(df: DataFrame, key: Sequence[str], at: str, ties: Sequence[str], digest: str, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Rows with ``run``: how many rows in a row before and including it, by ``at`` and ``ties``, have the same digest.

    Runs are counted within blocks of time; a row per entity and block carries
    the run that the blocks before it end with.
    """
    keyed = df.withColumn("_b", _block(micros(at), block_seconds))
    order = [F.col(at), *[F.col(c) for c in ties]]
    span = Window.partitionBy(*key, "_b").orderBy(*order)
    was = F.lag(F.struct(F.col(digest).alias("d"))).over(span)  # null only at the first row
    change = F.when(was.isNull(), 0).when(F.col(digest).eqNullSafe(was["d"]), 0).otherwise(1)
    inner = keyed.withColumn("_change", change).withColumn("_isle", F.sum("_change").over(span))
    inner = inner.withColumn("_run", F.row_number().over(Window.partitionBy(*key, "_b", "_isle").orderBy(*order)))
    place, body = F.struct(*order), F.struct(F.col(digest).alias("d"))
    ends = inner.groupBy(*key, "_b").agg(
        F.min_by(body, place).alias("_first"), F.max_by(body, place).alias("_last"), F.max_by("_run", place).alias("_tail"), F.max("_isle").alias("_isles")
    )
    blocks = Window.partitionBy(*key).orderBy("_b")
    goes_on = F.coalesce(F.col("_first")["d"].eqNullSafe(F.lag("_last").over(blocks)["d"]) & F.lag("_last").over(blocks).isNotNull(), F.lit(False))
    chains = ends.withColumn("_on", goes_on).withColumn("_chain", F.sum(F.when(F.col("_on") & (F.col("_isles") == 0), 0).otherwise(1)).over(blocks))
    total = F.sum("_tail").over(Window.partitionBy(*key, "_chain").orderBy("_b"))
    carried = chains.withColumn("_total", total).withColumn("_carry", F.when(F.col("_on"), F.lag("_total").over(blocks)).otherwise(0))
    names = [*key, "_b"]
    heads = carried.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(names)], "_carry")
    joined = inner.join(heads, [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(names)])
    return joined.withColumn("run", (F.col("_run") + F.when(F.col("_isle") == 0, F.col("_carry")).otherwise(0)).cast("int")).select(*df.columns, "run")


def nearest_or_refuse(pairs: DataFrame, key: Sequence[str], distance: str, start: str, tie: str, apart_seconds: int) -> DataFrame:
    """Best candidate per key with ``status``: matched, or ambiguous when the runner-up starts too close to it.

    ``pairs`` holds only candidates within the caller's range.
    """
    span = Window.partitionBy(*key).orderBy(distance, tie)
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    ranked = pairs.withColumns({"_rank": F.row_number().over(span), "_next": F.lead(start).over(span)}).where("_rank = 1")
    close = F.abs(seconds(start) - seconds("_next")) < apart_seconds
    return ranked.withColumn("status", F.when(F.coalesce(close, F.lit(False)), "ambiguous").otherwise("matched")).drop("_rank", "_next")


def unique_or_null(pairs: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """One row per key: the value if there is exactly one candidate row, else null."""
    return pairs.groupBy(*key).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias(value), F.count(F.lit(1)).alias("candidates"))


def running_count(points: DataFrame, at: str, on: Sequence[str], block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """on, at, upto: how many points of the entity lie at or before each time that has one.  Null entities and times are left out."""
    known = points.dropna(subset=[*on, at]).groupBy(*on, at).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", _block(micros(at), block_seconds))
    sums = known.groupBy(*on, "_b").agg(F.sum("_n").alias("_cnt"))
    base = sums.withColumn("_base", F.sum("_cnt").over(Window.partitionBy(*on).orderBy("_b")) - F.col("_cnt")).drop("_cnt")
    inner = F.sum("_n").over(Window.partitionBy(*on, "_b").orderBy(at))
    return known.withColumn("_in", inner).join(base, [*on, "_b"]).select(*on, at, (F.col("_base") + F.col("_in")).alias("upto"))


def interval_overlap_count(points: DataFrame, at: str, spans: DataFrame, start: str, stop: str, on: Sequence[str]) -> DataFrame:
    """``n`` of points with start < at <= stop per span: the points up to its stop less those up to its start.

    Two as-of joins with the running count, so no pair of point and span is made.
    """
    upto = running_count(points, at, on)
    ends = asof_join(spans, upto, on, stop, at, ["upto"], suffix="_stop")
    both = asof_join(ends, upto, on, start, at, ["upto"], suffix="_start")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = F.when(F.col(start).isNull() | F.col(stop).isNull(), 0).otherwise(F.greatest(count("upto_stop") - count("upto_start"), F.lit(0)))
    return both.select(*spans.columns, n.alias("n"))


def greedy_assignment(pairs: DataFrame, group: Sequence[str], left: str, right: str, distance: str) -> DataFrame:
    """One-to-one pairs per group, nearest first; each side is used once.

    Ties go by left, then right.  ``pairs`` holds one group's candidates within
    the caller's range (say, two teams on neighbouring days), so a group is
    small by nature; extra columns fall away.
    """
    import pandas as pd

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        used_l, used_r, keep = set(), set(), []
        ordered = pdf.sort_values([distance, left, right], kind="stable")
        for i, a, b in zip(ordered.index, ordered[left], ordered[right]):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                keep.append(i)
        return ordered.loc[keep]

    slim = pairs.select(*group, left, right, distance).dropna(subset=[left, right, distance])
    return slim.groupBy(*group).applyInPandas(assign, slim.schema)


def reason_cascade(reasons: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first reason that holds; a null condition doesn't hold."""
    out = None
    for name, holds in reasons:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(otherwise)
