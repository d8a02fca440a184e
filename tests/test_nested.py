"""Problem 5 against a walk over decoded documents."""

import ast
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import nested
from tidemark.operators.nested import child_rows, feed_children, list_items, list_state, market_children, odds_children, odds_variants, subtype_tables
from tidemark.sources import load


def brute_list(text):
    if text is None or not text.strip():
        return []
    try:
        v = json.loads(text)
        return json.loads(v) if isinstance(v, str) else v
    except ValueError:
        return ast.literal_eval(text.strip())


def test_whole_tables(spark, data):
    odds, events, feed = (load(spark, data, n) for n in ("odds_api", "polymarket_events", "mlb_game_feed"))
    want = []
    for r in odds.collect():
        for b, book in enumerate(r.bookmakers or []):
            for m, market in enumerate(book.markets or []):
                for o, out in enumerate(market.outcomes or []):
                    want.append(("odds_api", r.rec_id, f"{b}.{m}.{o}", f"{market.key}|{out.name}"))
    for r in events.collect():
        for m, market in enumerate(r.markets or []):
            prices = brute_list(market.outcomePrices)
            for k, label in enumerate(brute_list(market.outcomes)):
                want.append(("polymarket_events", r.rec_id, f"{m}.{k}", f"{label}|{prices[k] if k < len(prices) else ''}"))
    for r in feed.collect():
        doc = json.loads(r.payload)
        pk = doc["gameData"]["game"].get("pk", doc.get("gamePk"))
        for s in ("home", "away"):
            for n, p in enumerate(doc["liveData"].get("boxscore", {}).get("teams", {}).get(s, {}).get("battingOrder") or []):
                want.append(("mlb_game_feed", r.rec_id, f"{s}.{n}", f"{pk}|{p}"))
        for i in (doc["liveData"].get("linescore") or {}).get("innings") or []:
            for s in ("home", "away"):
                if isinstance(i.get(s), dict) and i[s].get("runs") is not None:
                    want.append(("mlb_game_feed", r.rec_id, f"inning.{i['num']}.{s}", f"{pk}|{i[s]['runs']}"))
    assert sorted(map(tuple, child_rows(odds, events, feed).collect())) == sorted(want)


@pytest.mark.parametrize(
    "text, state, items",
    [
        (None, "absent", None), ("", "absent", None), ("  ", "absent", None), ("[]", "empty", []), ('"[]"', "empty", []),
        ('["a","b c"]', "list", ["a", "b c"]), ("['a', 'b']", "list", ["a", "b"]), ('"[\\"a\\", \\"b\\"]"', "quoted", ["a", "b"]),
        ('[\n "0.5",\n "1"\n]', "list", ["0.5", "1"]), ("[0.50, 1]", "list", ["0.50", "1"]), ("a, b", "loose", ["a", "b"]),
        ('["a", "b"', "list", ["a", "b"]), ("[\"it's\", 'x']", "list", ["it's", "x"]),
    ],
)
def test_lists_in_strings(spark, text, state, items):
    row = spark.createDataFrame([(text,)], "t string").select(list_state(F.col("t")).alias("s"), list_items(F.col("t")).alias("i")).first()
    assert (row.s, row.i) == (state, items)


def test_feed_corner_cases(spark):
    docs = [
        None, "", "junk", "[]", "{}", '{"gamePk": 5}', '{"gamePk": 5, "liveData": null}',
        '{"gameData": {"game": {"pk": null}}, "gamePk": "7", "liveData": {"boxscore": {"teams": {"home": {"battingOrder": ["1", 2, null]}}}}}',
        '{"liveData": {"linescore": {"innings": [{"num": 1, "home": {"runs": 0}, "away": {}}, null]}}}',
    ]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "rec_id long, payload string")
    got = sorted((r.rec_id, r.pos, r.item) for r in feed_children(df).collect())
    assert got == [(7, "home.0", "7|1"), (7, "home.1", "7|2"), (8, "inning.1.home", "|0")]


def test_variants_route_to_subtypes(spark, data):
    for src, children in nested.CHILDREN.items():
        rows = children(load(spark, data, src))
        tables = subtype_tables(src, rows)
        assert sum(t.count() for t in tables.values()) == rows.count()
        states = [{r.state for r in t.select("state").distinct().collect()} for t in tables.values()]
        assert not set.intersection(*states) and all(s <= set(nested.SUBTYPES[src][t][0]) for s, t in zip(states, tables))
    assert odds_variants(load(spark, data, "odds_api")).select("variant").distinct().count() > 2


def test_found_comes_from_the_routed_tables(spark, data):
    plan = child_rows(*[load(spark, data, n) for n in nested.CHILDREN])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("subtype") >= 9 and "Generate" not in plan


def test_odd_shapes_are_routed(spark):
    odds = spark.sql("""SELECT 1L AS rec_id, CAST(NULL AS STRING) AS id, 1 AS state, array(NULL, named_struct('key', 'b', 'title', 't', 'last_update', NULL, 'markets', array(NULL,
        named_struct('key', NULL, 'last_update', NULL, 'outcomes', array(NULL, named_struct('name', 'x', 'price', CAST(NULL AS DOUBLE), 'point', 1.5D), named_struct('name', NULL, 'price', 2D, 'point', CAST(NULL AS DOUBLE))))))) AS bookmakers""")
    got = {t: [tuple(r)[1:4] for r in df.select("src", "pos", "item", "parent").collect()] for t, df in subtype_tables("odds_api", odds_children(odds)).items()}
    assert got == {"line": [], "price": [("1.1.2", "|", ".1.1")], "unpriced": [("1.1.1", "|x", ".1.1")]}
    feed = spark.createDataFrame([(1, '{"liveData": {"boxscore": {"teams": {"away": {"battingOrder": ["ID7", "8"]}}}}}')], "rec_id long, payload string")
    tables = subtype_tables("mlb_game_feed", feed_children(feed))
    assert [(r.pos, r.value) for r in tables["other"].collect()] == [("away.0", "ID7")] and [(r.num, r.number) for r in tables["batter"].collect()] == [(2, 8)]
    events = spark.sql("""SELECT 1L AS rec_id, 'e' AS id, array(named_struct('id', 'm', 'conditionId', 'c', 'outcomes', '["a","b","c"]', 'outcomePrices', '["0.5","high"]', 'clobTokenIds', NULL)) AS markets""")
    assert {t: [r.label for r in df.collect()] for t, df in subtype_tables("polymarket_events", market_children(events)).items()} == {"priced": ["a"], "unpriced": ["c"], "worded": ["b"]}


def test_empty_tables(spark, data):
    empty = [load(spark, data, n).limit(0) for n in ("odds_api", "polymarket_events", "mlb_game_feed")]
    assert child_rows(*empty).count() == 0
    assert market_children(empty[1]).count() == 0
