"""Blocks of time against brute force, tickers, the warehouse, and text helpers."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions import market, text
from tidemark.operators import health, rates, registry, storage, study, temporal, tickers
from tidemark.plans import projector
from tidemark.sources import release, settled, shared_dir

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def series(n: int, seed: int, hot: float = 0.4) -> list[tuple]:
    """Rows of (k, t, i, d); key a holds a good third of all, with ties, and gaps over several days."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = "a" if rng.random() < hot else rng.choice("bcd")
        out.append((k, T0 + timedelta(minutes=rng.choice([rng.randrange(0, 20_000), rng.randrange(0, 400)])), i, rng.choice("xy")))
    return out


SCHEMA = "k string, t timestamp, i int, d string"


@pytest.mark.parametrize("direction, minutes", [("backward", None), ("forward", None), ("backward", 30), ("forward", 30)])
def test_asof_join_against_brute_force(spark, direction, minutes):
    left, right = series(300, 1), series(300, 2)
    tolerance = None if minutes is None else minutes * 60_000_000
    frames = [spark.createDataFrame([*rows, (None, T0, -1, "x"), ("a", None, -2, "x")], SCHEMA) for rows in (left, right)]
    got = temporal.asof_join(frames[0], frames[1], ["k"], "t", "t", ["i"], direction, tolerance, [F.col("i")], block_seconds=7200)
    want = {-1: None, -2: None}
    for k, t, i, _ in left:
        sign = 1 if direction == "backward" else -1
        near = [((sign * (r[1] - T0)), r[2]) for r in right if r[0] == k and sign * (t - r[1]) >= timedelta(0) and (minutes is None or abs(t - r[1]) <= timedelta(minutes=minutes))]
        want[i] = max(near)[1] if near else None
    assert {r.i: r.i_r for r in got.collect()} == want


def test_episodes_and_runs_against_brute_force(spark):
    rows = series(400, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    episode, run = {}, {}
    for k in "abcd":
        mine = sorted((t, i, d) for kk, t, i, d in rows if kk == k)
        for p, (t, i, d) in enumerate(mine):
            before = mine[p - 1] if p else None
            episode[i] = episode[before[1]] + (t - before[0] > timedelta(minutes=45)) if before else 1
            run[i] = run[before[1]] + 1 if before and before[2] == d else 1
    assert {r.i: r.episode for r in temporal.episodes(df, ["k"], "t", 2700, block_seconds=3600).collect()} == episode
    assert {r.i: r.run for r in temporal.identical_runs(df, ["k"], "t", ["i"], "d", block_seconds=3600).collect()} == run


def test_overlap_counts_and_percentiles_against_brute_force(spark):
    rows = series(300, 4)
    spans = [(k, i, t, t + timedelta(minutes=i % 500)) for k, t, i, _ in series(60, 5)] + [("a", 99, None, T0)]
    points = spark.createDataFrame(rows, SCHEMA).select("k", F.col("t").alias("at"))
    got = temporal.interval_overlap_count(points, "at", spark.createDataFrame(spans, "k string, i int, a timestamp, b timestamp"), "a", "b", ["k"])
    want = {i: sum(kk == k and a < t <= b for kk, t, _, _ in rows) if a else 0 for k, i, a, b in spans}
    assert {r.i: r.n for r in got.collect()} == want
    df = spark.createDataFrame([(k, float(i * i % 97)) for k, _, i, _ in rows] + [("z", 5.0)], "k string, v double")
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {r.k: r.percentile for r in rates.nearest_index_percentile(df, ["k"], "v", q, bins=7).collect()}
        for k in "abcd":
            held = sorted(float(i * i % 97) for kk, _, i, _ in rows if kk == k)
            assert got[k] == held[min(int(q * len(held)), len(held) - 1)]
        assert got["z"] == 5.0


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session, "x")
    Session.sparkContext.master = "local[4]"
    assert "/x-" in shared_dir(Session, "x")


def test_release(spark):
    kept = settled(spark.range(3), "gone")
    where = kept.inputFiles()[0]
    assert kept.count() == 3 and release(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(where)


TEAMS = [(1, "AAA"), (2, "BB"), (3, "BBB"), (4, "CCC"), (5, "DUP"), (6, "DUP")]


def test_ticker_forms(spark):
    codes = tickers.code_table(spark.createDataFrame(TEAMS, "team_id int, abbreviation string"))
    names = ["KXG-21JUN081835AAABB-AAA", "KXG-21JUN08AAAZZZ", "KXG-21JUN31AAABB", "KXG-21XYZ08AAABB", "nonsense", None, "KXG-21JUN08QQRR", "kxg-21jun08bbbccc", "KXG-21JUN08DUPAAA"]
    got = {r.ticker: r for r in tickers.parse(spark.createDataFrame([(n,) for n in names], "ticker string"), codes).collect()}
    first = got[names[0]]
    assert (first.status, first.left, first.right, first.minute, first.side) == ("parsed", 1, 2, 18 * 60 + 35, "AAA")
    assert (got[names[1]].status, got[names[1]].unmapped) == ("unmapped", ["ZZZ"])
    assert [got[n].status for n in names[2:6]] == ["unparsed"] * 4 and got[names[6]].unmapped == ["QQRR"]
    assert got[names[7]].left == 3 and got[names[8]].unmapped == ["DUP"]
    assert tickers.parse(spark.createDataFrame([("KXG-21JUN08AAABB",)], "ticker string"), codes.limit(0)).first().status == "unmapped"


def games(spark, rows):
    return spark.createDataFrame(rows, "game_pk long, home int, away int, start string, day string").select("game_pk", "home", "away", F.to_timestamp("start").alias("start"), F.to_date("day").alias("day"))


def test_ticker_join_parts_the_games(spark):
    codes = tickers.code_table(spark.createDataFrame(TEAMS, "team_id int, abbreviation string"))
    slate = games(spark, [
        (10, 1, 2, "2021-06-08 22:35:00+00:00", "2021-06-08"), (11, 3, 4, "2021-06-08 17:05:00+00:00", "2021-06-08"), (12, 3, 4, "2021-06-08 23:05:00+00:00", "2021-06-08"),
        (13, 1, 4, "2021-06-08 20:00:00+00:00", "2021-06-08"), (14, 2, 4, "2021-07-08 17:00:00+00:00", "2021-07-08"), (15, 2, 4, "2021-07-08 21:00:00+00:00", "2021-07-08"),
    ])
    board = ["KXG-21JUN081835AAABB", "KXG-21JUN081305BBBCCC", "KXG-21JUL081500BBCCC"]
    parsed = tickers.parse(spark.createDataFrame([(b,) for b in board], "ticker string"), codes)
    joined, offset = tickers.join_games(parsed, slate)
    assert offset.first().offset == 240
    assert {r.game_pk: r.status for r in joined.collect()} == {10: "matched", 11: "matched", 12: "unlisted", 13: "unmatched", 14: "ambiguous", 15: "ambiguous"}
    assert tickers.clock_offset(spark.createDataFrame([], "utc_minute int, ticker_minute int")).first().offset is None
    assert tickers.clock_offset(spark.createDataFrame([(0, 700)], "utc_minute int, ticker_minute int")).first().offset is None


def test_reasons_come_in_order(spark):
    quotes = [(1, T0 + timedelta(minutes=m), p, team) for m, p, team in [(0, 0.5, "home"), (10, 0.5, "home"), (11, 0.4, "away"), (12, 0.5, None), (13, 0.9, "home"), (14, 0.7, "home"), (90, 0.5, "home"), (200, 0.5, "home")]]
    sharp = [(1, T0 + timedelta(minutes=5), 0.6, "home"), (1, T0 + timedelta(minutes=198), 0.6, "home")]
    frame = lambda rows: spark.createDataFrame(rows, "g int, at timestamp, price double, team string")
    starts = spark.createDataFrame([(1, T0 + timedelta(minutes=180))], "g int, start timestamp")
    got = study.find_gaps(frame(quotes), frame(sharp), starts, "g").orderBy("at").collect()
    assert [r.reason for r in got] == ["stale", "gap", "under floor", "unoriented", "implausible", "gap", "stale", "in play"]
    out = {r.at: r for r in study.attach_outcomes(study.find_gaps(frame(quotes), frame(sharp), starts, "g").where("reason = 'gap'"), frame(quotes), "g").collect()}
    assert [round(r["later_close"], 6) for r in out.values()] == [0.5, 0.5]
    assert study.find_gaps(frame(quotes), frame(sharp).limit(0), starts, "g").where("reason not in ('stale', 'in play')").count() == 0


def test_warehouse_and_ingester(spark, tmp_path):
    schema = spark.createDataFrame([], "k int, as_of_ts timestamp, v string").schema
    specs = [registry.TableSpec(n, kind, ("k",), schema) for n, kind in (("facts", registry.Kind.FACT), ("labels", registry.Kind.OUTCOME), ("ends", registry.Kind.CLOSING))]
    w = storage.Warehouse(spark, str(tmp_path), specs)
    assert w.create_all() == ["ends", "facts", "labels"] and w.table("facts").count() == 0
    rows = spark.createDataFrame([(1, T0, "x", 1), (1, T0, "y", 2), (2, T0, "z", 3)], "k int, as_of_ts timestamp, v string, o int")

    class Source(storage.Ingester):
        writes = frozenset({"facts"})

        def parse(self, raw):
            return {"facts": raw}

    told = []
    assert Source().load(rows, w, "o", lambda *x: told.append(x)) == {"facts": {"offered": 3, "added": 2}} and told == [("facts", 2)]
    assert Source().load(rows, w, "o")["facts"]["added"] == 0
    assert [tuple(r) for r in w.sql("SELECT v FROM facts WHERE k = :k", k=1).collect()] == [("y",)]
    assert w.sql("SELECT v FROM facts WHERE v = :v", v="x' OR '1'='1").count() == 0
    Source.writes = frozenset()
    with pytest.raises(PermissionError):
        Source().load(rows, w, "o")
    keys = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(registry.LeakError):
        w.read_as_of("ends", F.lit(T0))
    with pytest.raises(registry.LeakError):
        w.closing("facts", keys, ["k"])
    assert w.closing("ends", keys, ["k"]).count() == 0 and w.labels("labels", keys, ["k"]).count() == 0
    with pytest.raises(ZeroDivisionError), w.run("bad"):
        1 / 0
    with w.run("good"):
        pass
    assert {r.run: r.event for r in storage.run_states(spark.read.parquet(f"{tmp_path}/runs")).collect()} == {"bad": "failed", "good": "ok"}


def test_throttle(spark):
    rows = [("a", m, f) for m, f in [(0, True), (10, True), (59, True), (60, True), (70, False), (71, True), (100, True)]] + [("b", 5, True), ("b", 6, None), (None, 1, True)]
    df = spark.createDataFrame([(k, T0 + timedelta(minutes=m), f) for k, m, f in rows], "key string, at timestamp, failing boolean")
    base = T0.replace(tzinfo=None)
    got = sorted((r.key, round((r.at - base).total_seconds() / 60)) for r in health.throttle(df, 3600).select("key", F.to_timestamp_ntz(F.date_format("at", "yyyy-MM-dd HH:mm:ss")).alias("at")).collect())
    assert got == [("a", 0), ("a", 60), ("a", 71), ("b", 5)]


def test_text_helpers(spark):
    texts = spark.createDataFrame([(1, "The Cañón Viejo Night-Owls won"), (2, "night owl"), (3, None), (4, ""), (5, "Owls" * 3000)], "i int, t string")
    names = spark.createDataFrame([(7, "Night Owls"), (8, "Canon Viejo"), (9, ""), (10, None)], "n int, name string")
    assert sorted((r.i, r.n) for r in text.mentions(texts, "t", names, "name").collect()) == [(1, 7), (1, 8)]
    with pytest.raises(Exception, match="more than 2 words"):
        text.mentions(texts, "t", spark.createDataFrame([(1, "a b c")], "n int, name string"), "name", longest=2).collect()
    bodies = [(1, '{"title": "a", "x": [{"name": "b", "title": "a"}, {"name": 3}]}'), (2, "{cut"), (3, None), (4, "[]"), (5, "[" * 5000)]
    got = text.labels(spark.createDataFrame(bodies, "i int, p string"), ["i"], "p")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b")]
    d = spark.createDataFrame([("2021-03-14", "America/New_York")], "d string, z string").select(F.to_date("d").alias("d"), "z")
    a, b = text.day_bounds(F.col("d"), F.col("z"))
    assert d.select(F.unix_seconds(b) - F.unix_seconds(a)).first()[0] == 23 * 3600
    assert market.american_to_prob(F.lit(-150)) is not None


def test_prior_pieces(spark):
    one = spark.range(1)
    near = lambda c, want: [round(x, 6) for x in one.select(c.alias("x")).first().x] == want
    means = F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))
    assert near(projector.proxied(means, F.lit(0.9)), [0.6, 0.15, 0.25]) and near(projector.proxied(means, F.lit(None).cast("double")), [0.2, 0.3, 0.5])
    assert near(projector.split_prior(means, F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.0))), [0.000001, 0.375, 0.624999])
    assert one.select(projector.contact_variance(F.lit(2.0), F.lit(1.5), F.lit(4.0), F.lit(10.0)).alias("v")).first().v == pytest.approx((0.375 - 0.25) * 4 / 100)
    assert one.select(projector.contact_variance(F.lit(2.0), F.lit(1.5), F.lit(0.0), F.lit(10.0)).alias("v")).first().v == 0.0
    with pytest.raises(Exception, match="sum to zero"):
        one.select(rates.dirichlet_posterior(F.array(F.lit(0.0)), F.lit(0.0), F.array(F.lit(0.0)), F.array(F.lit(1.0)))).collect()
    with pytest.raises(Exception, match="future"):
        one.select(rates.strict_weight(F.lit(-1), 10.0)).collect()
