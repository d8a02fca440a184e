"""Reading free-text instants with JVM expressions only.

A text is split into a calendar day, a clock and a zone remark.  Days may be
ISO, slashed (month first), compact or spelt; clocks 24 or 12 hour, with any
precision; zones an offset, a fixed abbreviation (``EDT``), or letters for the
clock then in force (``ET``).  Whole numbers of 10 and 13 digits are epoch
seconds and milliseconds.  Anything else reads as null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations and what they stand for.
FIXED_OFFSETS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6,
    "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}
REGIONS = {
    "ET": "America/New_York", "CT": "America/Chicago",
    "MT": "America/Denver", "PT": "America/Los_Angeles",
}

PLAIN_INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"
PLAIN_DAY = r"^\d{4}-\d\d-\d\d$"

_DAYS = (
    # pattern, replacement giving "y m d|rest"
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt\s]+(.*))?$", "$1 $2 $3|$4"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:[Tt,\s]+(.*))?$", "$3 $1 $2|$4"),
    (r"^(\d{4})(\d\d)(\d\d)(?:[Tt\s]?(\d{4}.*))?$", "$1 $2 $3|$4"),
    (r"^(?:[A-Za-z]+\.?,?\s+)?([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})(?:[Tt,\s]+(.*))?$", "$3 $1 $2|$4"),
    (r"^(?:[A-Za-z]+\.?,?\s+)?(\d{1,2})[\s-]([A-Za-z]{3})[a-z]*\.?[\s-](\d{4})(?:[Tt,\s]+(.*))?$", "$3 $2 $1|$4"),
)
_CLOCK = r"^(\d{1,2}):?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?\s*([AaPp]\.?[Mm]\.?)?\s*([A-Za-z]{1,5}|(?:UTC|GMT)?[+-]\d\d(?::?\d\d)?)?$"


def _lookup(word: Column, table: dict) -> Column:
    """CASE over a fixed table; null for words it lacks."""
    out = None
    for key, value in table.items():
        out = F.when(word == key, F.lit(value)) if out is None else out.when(word == key, F.lit(value))
    return out


def _piped(values: Column, *stages) -> Column:
    """Apply the stages to every element; each stage's result is computed once."""
    for stage in stages:
        values = F.transform(values, stage)
    return values


def _split_day(text: Column) -> Column:
    t = F.trim(text)
    split = None
    for pattern, to in _DAYS:
        cond, val = t.rlike(pattern), F.regexp_replace(t, pattern, to)
        split = F.when(cond, val) if split is None else split.when(cond, val)
    epoch = F.when(t.rlike(r"^\d{10}$"), F.timestamp_seconds(t.try_cast("bigint"))).when(
        t.rlike(r"^\d{13}$"), F.timestamp_millis(t.try_cast("bigint"))
    )
    return F.struct(epoch.alias("epoch"), F.split(split, r"[ |]").alias("ymd"), F.trim(F.split_part(split, F.lit("|"), F.lit(2))).alias("rest"))


def _split_clock(p: Column) -> Column:
    word = F.lower(p["ymd"][1])
    month = F.when(word.rlike(r"^\d+$"), word.try_cast("int")).otherwise(
        F.when(
            F.instr(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), word) % 4 == 1,
            (F.instr(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), word) + 3) / 4,
        ).try_cast("int")
    )
    group = lambda k: F.regexp_extract(p["rest"], _CLOCK, k)
    return F.struct(
        p["epoch"].alias("epoch"), p["ymd"][0].try_cast("int").alias("y"), month.alias("mo"), p["ymd"][2].try_cast("int").alias("d"),
        F.when(p["rest"] == "", "0").when(p["rest"].rlike(_CLOCK), group(1)).try_cast("int").alias("h"),
        F.when(p["rest"] == "", "0").otherwise(group(2)).try_cast("int").alias("mi"),
        F.when(group(3) == "", "0").otherwise(group(3)).try_cast("int").alias("s"),
        F.lower(F.substring(group(5), 1, 1)).alias("half"), F.upper(group(6)).alias("zone"),
    )


def _combine(p: Column) -> Column:
    hour = (
        F.when(p["half"] == "", p["h"])
        .when((p["h"] < 1) | (p["h"] > 12), None)
        .otherwise(p["h"] % 12 + F.when(p["half"] == "p", 12).otherwise(0))
    )
    numeric = F.regexp_replace(p["zone"], r"^(UTC|GMT)", "")
    minutes = F.when(
        numeric.rlike(r"^[+-]"),
        F.when(F.substring(numeric, 1, 1) == "-", -1).otherwise(1)
        * (
            F.substring(numeric, 2, 2).try_cast("int") * 60
            + F.when(F.length(numeric) > 3, F.substring(numeric, -2, 2).try_cast("int")).otherwise(0)
        ),
    ).otherwise(_lookup(p["zone"], {k: v * 60 for k, v in FIXED_OFFSETS.items()}))
    return F.struct(
        p["epoch"].alias("epoch"), p["zone"].alias("zone"), minutes.alias("minutes"), _lookup(p["zone"], REGIONS).alias("region"),
        F.try_make_timestamp(p["y"], p["mo"], p["d"], hour, p["mi"], p["s"].cast("decimal(16,6)"), F.lit("UTC")).alias("local"),
    )


def _judge(p: Column) -> Column:
    # a zone remark that means nothing makes the whole text unreadable
    known = (p["zone"] == "") | p["minutes"].isNotNull() | p["region"].isNotNull()
    local = F.when(known, p["local"])
    return F.struct(
        local.alias("local"),
        F.coalesce(p["epoch"], F.timestamp_micros(F.unix_micros(local) - p["minutes"].cast("bigint") * 60_000_000)).alias("instant"),
        F.when(local.isNotNull(), p["region"]).alias("region"),
        F.coalesce(F.to_date(local), F.to_date(p["epoch"])).alias("day"),
    )


def read_times(texts: Column) -> Column:
    """``array<struct(local, instant, region, day)>`` of an array of texts.

    ``instant`` is set where the text carries its zone, ``region`` where letters
    name a regional clock; with neither, ``local`` waits for a default zone.
    All are null for unreadable texts.  ``local`` is the wall clock held as if
    it were UTC.
    """
    return _piped(texts, _split_day, _split_clock, _combine, _judge)


def read_time(text: Column) -> Column:
    """``read_times`` for one text."""
    return read_times(F.array(text))[0]


def both_readings(local: Column, zone: Column) -> Column:
    """``struct(e, l)``: the earlier and later instant a wall clock can mean.

    They differ only within the hour (or half hour) that a clock repeats.  A
    wall clock that a spring change skips keeps the offset before the change.
    """
    early = F.transform(F.array(F.struct(local.alias("w"), zone.alias("z"))), lambda p: F.struct(p["w"].alias("w"), p["z"].alias("z"), F.to_utc_timestamp(p["w"], p["z"]).alias("e")))

    def pair(p):
        after = lambda s: F.timestamp_micros(F.unix_micros(p["e"]) + s * 1_000_000)
        same = lambda s: F.from_utc_timestamp(after(s), p["z"]) == p["w"]
        late = F.when(same(3600), after(3600)).when(same(1800), after(1800)).otherwise(p["e"])
        return F.struct(p["e"].alias("e"), late.alias("l"))

    return F.transform(early, pair)[0]


def plain(instant: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``, fractions cut off (session clock: UTC)."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")
