"""Prices, margins and gaps as column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def american_to_decimal(v: Column) -> Column:
    """Null inside (-100, 100), where no American price lies."""
    return F.when(v >= 100, 1 + v / 100.0).when(v <= -100, 1 + F.lit(100.0) / -v)


def decimal_to_american(d: Column) -> Column:
    """Half-even rounding; null at or below 1."""
    profit = d - 1
    return F.when(d >= 2, F.bround(profit * 100, 0)).when(d > 1, -F.bround(F.try_divide(F.lit(100.0), profit), 0))


def implied(d: Column) -> Column:
    return F.try_divide(F.lit(1.0), d)


def american_to_prob(v: Column) -> Column:
    return implied(american_to_decimal(v))


def total(q: Column) -> Column:
    return F.aggregate(q, F.lit(0.0), lambda a, x: a + x)


def valid_market(q: Column) -> Column:
    """Two or more outcomes, all above zero, more than one in sum."""
    return (F.size(q) >= 2) & F.forall(q, lambda x: x.isNotNull() & (x > 0)) & (total(q) > 1)


def _with_total(q: Column, use) -> Column:
    """``use(total)`` with the sum computed once per market."""
    return F.transform(F.array(total(q)), use)[0]


def devig_multiplicative(q: Column) -> Column:
    return F.when(valid_market(q), _with_total(q, lambda t: F.transform(q, lambda x: x / t)))


def devig_additive(q: Column) -> Column:
    """Null when an outcome would be at or below zero."""
    fair = _with_total(q, lambda t: F.transform(q, lambda x: x - (t - 1) / F.size(q)))
    return F.when(valid_market(q) & F.forall(fair, lambda x: x > 0), fair)


def _bisect(low: float, high: float, steps: int, too_low) -> Column:
    """Root by bisection in a fold; ``too_low(mid)`` says whether the root lies above."""
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def step(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        return F.struct(F.when(too_low(mid), mid).otherwise(s["lo"]).alias("lo"), F.when(too_low(mid), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["lo"] + s["hi"]) / 2)


def devig_power(q: Column, steps: int = 60) -> Column:
    """The exponent at which the powers sum to one, then scaled to one."""
    powers = lambda k: F.transform(q, lambda x: F.pow(x, k))
    exponent = _bisect(1.0, 20.0, steps, lambda k: total(powers(k)) > 1)
    raised = F.transform(F.array(exponent), powers)[0]
    return F.when(valid_market(q), F.transform(F.array(raised), lambda p: _with_total(p, lambda t: F.transform(p, lambda x: x / t)))[0])


def devig_shin(q: Column, steps: int = 60) -> Column:
    """Share of informed money by bisection on [0, 0.99], then scaled to one."""
    fair = lambda z: _with_total(q, lambda t: F.transform(q, lambda x: (F.sqrt(z * z + 4 * (1 - z) * x * x / t) - z) / (2 * (1 - z))))
    share = _bisect(0.0, 0.99, steps, lambda z: total(fair(z)) > 1)
    raised = F.transform(F.array(share), fair)[0]
    return F.when(valid_market(q), F.transform(F.array(raised), lambda p: _with_total(p, lambda t: F.transform(p, lambda x: x / t)))[0])


DEVIG = {"multiplicative": devig_multiplicative, "additive": devig_additive, "power": devig_power, "shin": devig_shin}


def devig_all(q: Column) -> Column:
    """A struct of all methods; a method that fails is null."""
    return F.struct(*[f(q).alias(k) for k, f in DEVIG.items()])


def spread_across_methods(fairs: Column, i: int) -> Column:
    """Largest difference between the methods for outcome ``i``, over those that gave a result."""
    values = [F.get(fairs[k], F.lit(i)) for k in DEVIG]
    return F.greatest(*values) - F.least(*values)


def sharp_fair(q: Column, method: str = "power") -> Column:
    """Fair prices by the named method, by the multiplicative one where it fails."""
    return F.coalesce(DEVIG[method](q), devig_multiplicative(q))


def fee(p: Column) -> Column:
    return 0.07 * p * (1 - p)


def floor_of(p: Column, half_spread: Column, alignment: Column) -> Column:
    return fee(p) + half_spread + alignment


def orient(price: Column, team: Column, reference: Column) -> Column:
    """The price seen from the reference side; null if either is unknown."""
    return F.when(team == reference, price).when(team.isNotNull() & reference.isNotNull(), 1 - price)


def mid_of_book(yes: Column, no: Column) -> Column:
    """Middle of best yes and one minus best no; null if one-sided, out of (0, 1) or crossed."""
    best_yes, best_no = (F.array_max(F.transform(x, lambda level: level[0])) for x in (yes, no))
    ask = 1 - best_no
    inside = (best_yes > 0) & (best_yes < 1) & (best_no > 0) & (best_no < 1) & (best_yes <= ask + 1e-9)
    return F.when(inside, (best_yes + ask) / 2)


def circular_minutes(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(1440))
    return F.least(d, 1440 - d)


def breakeven_rate(gap: Column, floor: Column, symmetric: bool = True) -> Column:
    share = F.lit(0.5) + floor / (2 * gap) if symmetric else floor / gap
    return F.when(gap > 0, F.least(F.lit(1.0), share)).otherwise(1.0)


def innings_to_outs(text: Column) -> Column:
    """"6.2" is 20 outs; the digit after the point must be 0, 1 or 2."""
    whole, part = F.split_part(text, F.lit("."), F.lit(1)).try_cast("int"), F.coalesce(F.nullif(F.split_part(text, F.lit("."), F.lit(2)), F.lit("")), F.lit("0"))
    return F.when(text.rlike(r"^\d+(\.[012]?)?$"), whole * 3 + part.try_cast("int"))


def wind_components(speed: Column, from_deg: Column, bearing: Column) -> tuple[Column, Column]:
    """(outward, across) parts of a wind against the bearing to centre field."""
    angle = F.radians(from_deg - F.pmod(bearing + 180, F.lit(360)))
    return speed * F.cos(angle), speed * F.sin(angle)


def prob_to_decimal(p: Column) -> Column:
    """Null at or below 0."""
    return F.when(p > 0, F.try_divide(F.lit(1.0), p))


def cents_to_prob(cents: Column) -> Column:
    return cents / 100.0


def consensus(prices, by, book: str, fair: str, weights: dict[str, float]):
    """by, fair, books: the weighted mean of fair prices; books beyond ``weights`` weigh 1, null prices nothing."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    w = F.coalesce(F.try_element_at(table, F.col(book)), F.lit(1.0))
    rows = prices.where(F.col(fair).isNotNull()).withColumn("_w", w)
    mean = F.try_divide(F.sum(F.col("_w") * F.col(fair)), F.sum("_w"))
    return rows.groupBy(*by).agg(F.round(mean, 6).alias("fair"), F.count_if(F.col("_w") > 0).alias("books"))
