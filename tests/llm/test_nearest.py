"""Problem 4 against a comparison of every candidate."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.nearest import bookmaker_updates, game_partners, nearest_within
from tidemark.operators.timestamps import hourly_instants
from tidemark.sources import load


def test_whole_tables(spark, data):
    games, meteo, odds = (load(spark, data, n) for n in ("games", "open_meteo", "odds_api"))
    newest = {}
    for r in games.select("rec_id", "game_pk", "venue_id", "as_of_ts", F.unix_micros("scheduled_start_ts").alias("at")).collect():
        if r.as_of_ts and ((r.as_of_ts, -r.rec_id) > newest.get(r.game_pk, ((), ()))[0] if r.game_pk in newest else True):
            newest[r.game_pk] = ((r.as_of_ts, -r.rec_id), r.at, r.venue_id)
    hours, books = defaultdict(list), defaultdict(list)
    for r in hourly_instants(meteo).where("instant is not null").select("rec_id", "venue_id", "pos", F.unix_micros("instant").alias("at")).collect():
        hours[r.venue_id].append((r.at, r.rec_id, r.pos))
    for r in bookmaker_updates(odds).collect():
        books[r.game_pk, r.partner].append((r.at_us, r.ref.rec_id, r.ref.pos))
    want = set()
    for pk, (_, at, venue) in newest.items():
        if at is None:
            continue
        partners = [("weather", hours[venue], 45)] + [(k[1], v, 20) for k, v in books.items() if k[0] == pk]
        for name, rows, minutes in partners:
            near = [x for x in rows if abs(x[0] - at) <= minutes * 60_000_000]
            if near:
                best = min(near, key=lambda x: (abs(x[0] - at), *x))
                want.add((pk, name, best[1], best[2]))
    assert len(want) > 100
    assert {tuple(r) for r in game_partners(games, meteo, odds).collect()} == want


def test_ties_tolerance_and_nulls(spark):
    left = spark.createDataFrame(
        [("a", 1000, 10, "x"), ("a", 2000, 10, "y"), ("b", 1000, 10, "z"), (None, 1000, 10, "n"), ("a", None, 10, "m"), ("a", 1000, 10, "x")],
        "entity string, at_us long, tolerance_us long, name string",
    )
    right = spark.createDataFrame(
        [("a", 990, (7, 0)), ("a", 1010, (1, 0)), ("a", 990, (5, 2)), ("a", 990, (5, 1)), ("a", 2011, (1, 1)), ("a", None, (0, 0)), (None, 1000, (0, 0))],
        "entity string, at_us long, ref struct<rec_id: long, pos: int>",
    )
    got = sorted((r.name, r.ref and tuple(r.ref)) for r in nearest_within(left, right, 10).collect())
    assert got == [("m", None), ("n", None), ("x", (5, 1)), ("x", (5, 1)), ("y", None), ("z", None)]


def test_blocks_don_t_hide_neighbours(spark):
    width = 6 * 3600 * 1_000_000
    left = spark.createDataFrame([("a", width - 1, width, 0), ("a", 5 * width, width, 1)], "entity string, at_us long, tolerance_us long, k int")
    right = spark.createDataFrame([("a", width + 5, (1, 1)), ("a", 4 * width, (2, 2))], "entity string, at_us long, ref struct<rec_id: long, pos: int>")
    assert {r.k: tuple(r.ref) for r in nearest_within(left, right, width).collect()} == {0: (1, 1), 1: (2, 2)}


def test_a_tolerance_beyond_the_reach_raises(spark):
    left = spark.createDataFrame([("a", 10, 99)], "entity string, at_us long, tolerance_us long")
    right = spark.createDataFrame([("a", 12, (1, 1))], "entity string, at_us long, ref struct<rec_id: long, pos: int>")
    assert nearest_within(left, right, 99).first().ref_us == 12
    with pytest.raises(Exception, match="above the reach"):
        nearest_within(left, right, 98).collect()


def test_empty_sides(spark, data):
    games, meteo, odds = (load(spark, data, n) for n in ("games", "open_meteo", "odds_api"))
    assert game_partners(games.limit(0), meteo, odds).count() == 0
    assert game_partners(games, meteo.limit(0), odds.limit(0)).count() == 0
