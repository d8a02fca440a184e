"""Problem 6 against a search of all versions."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators.attributes import asof_attributes, current_versions, games_as_known
from tidemark.sources import load


def test_whole_tables(spark, data):
    games, venues = load(spark, data, "games"), load(spark, data, "venues")
    g, v = games.select("rec_id", "game_pk", "venue_id", "as_of_ts", "scheduled_start_ts").collect(), venues.select("rec_id", "venue_id", "as_of_ts").collect()
    want = set()
    for pk in {r.game_pk for r in g}:
        own = [r for r in g if r.game_pk == pk]
        start = max(own, key=lambda r: (r.as_of_ts, -r.rec_id)).scheduled_start_ts
        before = [r for r in own if start and r.as_of_ts < start]
        if before:
            row = max(before, key=lambda r: (r.as_of_ts, -r.rec_id))
            parks = [r for r in v if r.venue_id == row.venue_id and r.as_of_ts < start]
            if parks:
                want.add((pk, row.rec_id, max(parks, key=lambda r: (r.as_of_ts, -r.rec_id)).rec_id))
    got = [tuple(r) for r in games_as_known(games, venues).select("game_pk", "game_rec_id", "venue_rec_id").collect()]
    assert len(got) == len(want) > 50 and set(got) == want


def test_strictness_ties_blocks_and_nulls(spark):
    t = lambda d, h=0: dt.datetime(2021, 1, d, h)
    versions = spark.createDataFrame(
        [("a", t(1), 5), ("a", t(1), 3), ("a", t(20), 7), ("b", t(5), 1), (None, t(1), 9), ("a", None, 8)], "entity string, known_at timestamp, rec long"
    )
    kept = current_versions(versions, "entity", "known_at", "rec", ["rec"])
    assert kept.count() == 3
    events = spark.createDataFrame(
        [("a", t(1), 0), ("a", t(1, 1), 1), ("a", t(19), 2), ("a", t(20), 3), ("a", t(28), 4), ("b", t(5), 5), ("c", t(9), 6), (None, t(9), 7), ("a", None, 8)],
        "entity string, at timestamp, k int",
    )
    got = {r.k: r.rec for r in asof_attributes(events, kept, ["rec"], 100, block_seconds=86_400).collect()}
    assert got == {0: None, 1: 3, 2: 3, 3: 3, 4: 7, 5: None, 6: None, 7: None, 8: None}
    assert asof_attributes(events.limit(0), kept, ["rec"], 1).count() == 0
    assert asof_attributes(events, kept.limit(0), ["rec"], 1).where(F.col("rec").isNotNull()).count() == 0


def test_empty_and_repeated(spark, data):
    games, venues = load(spark, data, "games"), load(spark, data, "venues")
    assert games_as_known(games.limit(0), venues).count() == 0
    assert games_as_known(games, venues.limit(0)).count() == 0
    twice = games_as_known(games.unionAll(games), venues.unionAll(venues))
    assert twice.exceptAll(games_as_known(games, venues)).count() == 0
