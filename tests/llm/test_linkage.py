"""Problem 7: readings of titles and tickers, and the links against known games."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import linkage
from tidemark.llm.linkage import (
    Teams, asked_teams, best_games, calibrate, event_records, game_index, linked_events, matched_pairs, nearest_games, read_ticker, read_title, retrieve,
)
from tidemark.sources import load

ROWS = [
    (1, "Cañón Viejo Night Owls", "CAN"), (2, "Stoneview Stilts", "SON"), (3, "Vallée-Dorée Stilts", "VAL"),
    (4, "Willow Bay Comets", "WLL"), (5, "Willowmere Tinkers", "WIL"), (6, "Mapleton Sextants", "MPL"), (7, "Maple Springs Kestrels", "MAP"),
]


@pytest.mark.parametrize(
    "mention, teams",
    [
        ("CANON VIEJO NIGHT OWLS", {1}), ("night owls", {1}), ("Stilts", {2, 3}), ("V. Stilts", {3}), ("SON Stilts", {2}), ("Mpaleton", {6}),
        ("Mapleton Sexatnts", {6}), ("StoneviewS tilts", {2}), ("WIL", {5}), ("Willow  Bay", {4}), ("", set()), ("zebra", set()), ("Wilolwmere", {5}),
    ],
)
def test_mentions(mention, teams):
    assert set(Teams(ROWS).find(mention)) == teams


@pytest.mark.parametrize(
    "title, want",
    [
        ("Will the Stilts beat the Tinkers on November 3?", (["Stilts", "Tinkers"], (11, 3), None)),
        ("MLB: Mapleton Sextants v Cañón Viejo Night Owls, Sep 17 - G2", (["Mapleton Sextants", "Cañón Viejo Night Owls"], (9, 17), 2)),
        ("VAL / JUN 9/11", (["VAL", "JUN"], (9, 11), None)), ("Willow Bay - Señal Roja", (["Willow Bay", "Señal Roja"], None, None)),
        ("A @   B  (Game 1)", (["A", "B"], None, 1)), ("Vallée-Dorée vs Zürnbach Winner?", (["Vallée-Dorée", "Zürnbach"], None, None)),
        ("PENASCO ALTO @ IRONFIELD - Apr 2", (["PENASCO ALTO", "IRONFIELD"], (4, 2), None)), ("Will the Wardens win?", (["Wardens"], None, None)),
        (None, ([], None, None)), ("", ([], None, None)),
    ],
)
def test_titles(title, want):
    assert read_title(title) == want


def test_tickers():
    day, minute, codes, number = read_ticker("KXMLBGAME-21MAR141935MAPGRA")
    assert (day, minute, number) == ((2021, 3, 14), 19 * 60 + 35, None) and ["MAP", "GRA"] in codes
    day, minute, codes, number = read_ticker("KXBBWIN-051321-HARVSON-G1")
    assert (day, minute, number) == ((2021, 5, 13), None, 1) and ["HAR", "SON"] in codes
    assert read_ticker("KXLEAGUECHAMP-21")[0] is None and read_ticker(None)[0] is None


def test_links_agree_with_known_games(spark, data):
    tables = [load(spark, data, n) for n in ("odds_api", "kalshi_markets", "polymarket_events", "teams", "games")]
    linked = linked_events(*tables)
    known = {"odds:" + r.id: r.game_pk for r in tables[0].where("game_pk is not null").select("id", "game_pk").distinct().collect()}
    got = {r.key: r.game_pk for r in linked.collect()}
    assert sum(got.get(k) == g for k, g in known.items()) >= 0.98 * len(known)
    pairs = matched_pairs(*tables).collect()
    assert len({(r.key_a, r.key_b) for r in pairs}) == len(pairs) > 100
    assert all(r.key_a < r.key_b and 0 < r.confidence <= 1 for r in pairs)
    assert all(r.key_a.split(":")[0] != r.key_b.split(":")[0] for r in pairs)


def test_empty_tables(spark, data):
    tables = [load(spark, data, n) for n in ("odds_api", "kalshi_markets", "polymarket_events", "teams", "games")]
    assert matched_pairs(*[t.limit(0) for t in tables[:3]], *tables[3:]).count() == 0
    assert matched_pairs(*tables[:4], tables[4].limit(0)).count() == 0
    assert event_records(*[t.limit(0) for t in tables[:3]], tables[3].limit(0)).count() == 0


def test_each_pair_is_asked_by_one_team():
    pairs = [(f"1-{t}", 1.0) for t in range(2, 40)] + [("50-60", 0.5)]
    asked = asked_teams(pairs)
    assert [t for t, _ in asked] == [1, 50] and asked[0][1] == {t: 1.0 for t in range(2, 40)} and asked[1][1] == {60: 0.5}
    assert asked_teams([]) == []


def test_pruning_keeps_the_best_two(spark, data, monkeypatch):
    tables = [load(spark, data, n) for n in ("odds_api", "kalshi_markets", "polymarket_events", "teams", "games")]
    records, index = event_records(*tables[:4]).cache(), game_index(tables[4]).cache()
    pruned = nearest_games(best_games(retrieve(records, index)))
    got = {r.key: (r.game_pk, round(r.score, 6), round(r.gap, 6)) for r in pruned.collect()}

    def everything(records, index):
        teams = index.select("game_pk", F.transform("teams", lambda t: t["at"].cast("int")).alias("t"))
        hit = F.expr("exists(asks, a -> array_contains(t, a.team) and exists(map_keys(a.others), o -> array_contains(t, o)))")
        return records.select("key", "asks").join(teams, hit).groupBy("key").agg(F.collect_list("game_pk").alias("games"))

    monkeypatch.setattr(linkage, "candidates", everything)
    want = {r.key: (r.game_pk, round(r.score, 6), round(r.gap, 6)) for r in nearest_games(best_games(retrieve(records, index))).collect()}
    assert got == want and len(got) > 300


def test_fit_without_labels_is_the_default_curve(spark):
    nearest = spark.createDataFrame([("odds:a", 1, 0.5)], "key string, game_pk long, gap double")
    slope, intercept = calibrate(nearest, spark.createDataFrame([], "key string, label long"))
    assert (round(slope, 6), round(intercept, 6)) == (12.0, -0.5)


def test_no_side_is_broadcast(spark, data):
    tables = [load(spark, data, n) for n in ("odds_api", "kalshi_markets", "polymarket_events", "teams", "games")]
    plan = retrieve(event_records(*tables[:4]), game_index(tables[4]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_extra_columns_and_nulls(spark, data):
    tables = [load(spark, data, n) for n in ("odds_api", "kalshi_markets", "polymarket_events", "teams", "games")]
    want = {tuple(r)[:2] for r in matched_pairs(*tables).collect()}
    noisy = [t.withColumns({"key": F.lit("x"), "src": F.lit(1), "team": F.lit(None).cast("int"), "game": F.lit(2)}) for t in tables]
    void = [t.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t.schema]) for t in noisy]
    got = {tuple(r)[:2] for r in matched_pairs(*[t.unionByName(v) for t, v in zip(noisy, void)]).collect()}
    assert got == want
