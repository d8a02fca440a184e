"""Problem 1 against a row-at-a-time reading with the standard library."""

import datetime as dt
import re
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.timetext import read_time
from tidemark.operators.timestamps import changed_texts, day_of, normalise, normalise_array, normalised_texts
from tidemark.sources import load

UTC = dt.timezone.utc
ABBR = {"EDT": -4, "EST": -5, "CDT": -5, "CST": -6, "MDT": -6, "MST": -7, "PDT": -7, "PST": -8}
LETTERS = {"ET": "America/New_York", "CT": "America/Chicago", "MT": "America/Denver", "PT": "America/Los_Angeles"}


def brute(text, zone):
    """(naive, aware): one of the two, or neither when unreadable."""
    if text is None:
        return None, None
    t = text.strip()
    if re.fullmatch(r"\d{10}", t):
        return None, dt.datetime.fromtimestamp(int(t), UTC)
    if re.fullmatch(r"\d{13}", t):
        return None, dt.datetime.fromtimestamp(int(t) // 1000, UTC)
    t = re.sub(r"[.,](\d+)(?=Z|$|[+-])", "", t.replace("t", "T").replace("z", "Z")) if t[:2].isdigit() else t
    m = re.search(r" (EDT|EST|CDT|CST|MDT|MST|PDT|PST|ET|CT|MT|PT|UTC)$", t)
    tail = m.group(1) if m else None
    if m:
        t = t[: m.start()]
    for form in (
        "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M%z", "%Y-%m-%d %H:%M:%S%z", "%Y%m%dT%H%M%S%z", "%a, %d %b %Y %H:%M:%S %z",
        "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %I:%M %p",
        "%b %d, %Y %I:%M:%S %p", "%Y-%m-%d", "%m/%d/%Y", "%Y%m%d", "%b %d, %Y",
    ):
        try:
            x = dt.datetime.strptime(t, form)
        except ValueError:
            continue
        if x.tzinfo:
            return None, x.astimezone(UTC)
        if tail in ABBR:
            return None, (x - dt.timedelta(hours=ABBR[tail])).replace(tzinfo=UTC)
        if tail == "UTC":
            return None, x.replace(tzinfo=UTC)
        return x, None if tail is None else x.replace(tzinfo=ZoneInfo(LETTERS[tail])).astimezone(UTC)
    return None, None


def brute_array(texts, zone):
    out, prev = [], None
    for t in texts:
        naive, aware = brute(t, zone)
        if aware is None and naive is not None:
            both = [naive.replace(tzinfo=ZoneInfo(zone), fold=k).astimezone(UTC) for k in (0, 1)]
            aware = next((b for b in both if prev is None or b > prev), both[0])
        out.append(aware)
        prev = aware or prev
    return out


def fmt(x):
    return x and x.strftime("%Y-%m-%dT%H:%M:%SZ")


def test_whole_tables(spark, data):
    tables = [load(spark, data, n) for n in ("mlb_schedule", "venues", "teams", "open_meteo", "kalshi_markets")]
    got = {(r.src, r.rec_id, r.pos): r.utc for r in changed_texts(normalised_texts(*tables)).collect()}
    zones = {r.venue_id: r.timezone for r in tables[1].collect()}
    want = {}
    for row in tables[0].collect():
        for i, day in enumerate(row.dates):
            for j, g in enumerate(day.games):
                pos = f"{i}.{j}"
                naive, aware = brute(g.gameDate, None)
                if aware is None and naive is not None:
                    aware = naive.replace(tzinfo=ZoneInfo(zones[g.venue.id])).astimezone(UTC)
                if aware and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", g.gameDate):
                    want["mlb_schedule.gameDate", row.rec_id, pos] = fmt(aware)
                naive, _ = brute(g.officialDate, None)
                if naive and not re.fullmatch(r"\d{4}-\d\d-\d\d", g.officialDate):
                    want["mlb_schedule.officialDate", row.rec_id, pos] = naive.strftime("%Y-%m-%d")
    for row in tables[3].select("rec_id", "timezone", "hourly.time").collect():
        for k, (t, x) in enumerate(zip(row.time or [], brute_array(row.time or [], row.timezone or "UTC"))):
            if x and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", t):
                want["open_meteo.hourly.time", row.rec_id, str(k)] = fmt(x)
    for row in tables[4].collect():
        naive, aware = brute(row.close_time, None)
        if aware is None and naive is not None:
            aware = naive.replace(tzinfo=ZoneInfo("America/New_York")).astimezone(UTC)
        if aware and not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", row.close_time):
            want["kalshi_markets.close_time", row.rec_id, "0"] = fmt(aware)
    assert len(want) > 5000
    assert got == want


@pytest.mark.parametrize(
    "texts, zone, hours",
    [
        # repeated hour: order decides
        (["2021-11-07T00:30", "2021-11-07T01:30", "2021-11-07T01:30", "2021-11-07T02:30"], "America/New_York", [4, 5, 6, 7]),
        # one reading only: the earlier
        (["2021-11-07T00:30", "2021-11-07T01:30", "2021-11-07T02:30"], "America/New_York", [4, 5, 7]),
        # going back on the clock forces the later one
        (["2021-11-07T01:45", "2021-11-07T01:30"], "America/New_York", [5, 6]),
        # nulls and junk in between don't reset the order
        (["2021-11-07T01:30", None, "junk", "2021-11-07T01:30"], "America/New_York", [5, None, None, 6]),
        # skipped hour keeps the offset before the change
        (["2021-03-14T02:30"], "America/New_York", [7]),
        ([], "UTC", []),
    ],
)
def test_sequences(spark, texts, zone, hours):
    df = spark.createDataFrame([(texts, zone)], "t array<string>, z string")
    got = df.select(normalise_array(F.col("t"), F.col("z")).alias("x")).first().x
    assert [x and x.hour for x in got] == hours


def test_two_autumns_in_one_array(spark):
    texts = ["2020-11-01T01:30", "2020-11-01T01:30", "2021-11-07T01:30", "2021-11-07T02:30"]
    df = spark.createDataFrame([(texts,)], "t array<string>")
    got = df.select(normalise_array(F.col("t"), F.lit("America/Chicago")).alias("x")).first().x
    assert [x.hour for x in got] == [6, 7, 6, 8]


@pytest.mark.parametrize(
    "text, want",
    [
        ("2021-02-30T10:00:00Z", None), ("", None), ("   ", None), ("TBD", None), (None, None), ("2021-05-01 10:00 XQZ", None),
        ("05/01/2021 13:00 PM", None), ("12/31/2021 12:00 AM", "2021-12-31T05:00:00Z"),
        (" 2021-05-01t10:00:00.9999999z ", "2021-05-01T10:00:00Z"), ("1 May 2021 10:00 +0530", "2021-05-01T04:30:00Z"),
        ("20210501100000Z", "2021-05-01T10:00:00Z"), ("Saturday, May 1, 2021 9:00 PM ET", "2021-05-02T01:00:00Z"),
        ("2021-11-07 01:30:00", "2021-11-07T05:30:00Z"), ("x" * 100_000, None), ("99999999999999999999", None),
    ],
)
def test_lone_texts(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(normalise(F.col("t"), F.lit("America/New_York")).alias("x")).first().x
    assert fmt(got) == want


def test_days(spark):
    df = spark.createDataFrame([("20210501",), ("5/1/2021",), ("2021-05-01 00:00:00",), ("soon",)], "t string")
    assert [r.d for r in df.select(day_of(F.col("t")).alias("d")).collect()] == ["2021-05-01"] * 3 + [None]
