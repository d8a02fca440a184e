"""The general operators: corner cases, seeded recovery, metamorphic properties."""

import datetime as dt
import io
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from tidemark.functions import market
from tidemark.operators import health, loading, quality, rates, registry, temporal
from tidemark.plans import projector
from tidemark.sources import load, payloads
from tidemark.streaming import archive

T0 = dt.datetime(2021, 4, 1, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


# -- versions -------------------------------------------------------------------


def versions(spark):
    rows = [(1, at(0), "a", 1), (1, at(10), "b", 2), (1, at(10), "c", 3), (2, at(5), "a", 4), (3, None, "a", 5)]
    return spark.createDataFrame(rows, "k int, known timestamp, v string, rec int")


def test_as_of(spark):
    df = versions(spark)
    read = lambda m, **kw: {(r.k, r.v) for r in temporal.as_of(df, ["k"], "known", F.lit(at(m)), [F.col("rec")], **kw).collect()}
    assert read(10) == {(1, "b"), (2, "a")}
    assert read(10, inclusive=False) == {(1, "a"), (2, "a")}
    assert read(-1) == set()
    assert read(10, where=F.col("v") == "a") == {(1, "a"), (2, "a")}
    assert read(10, collapse=False) == {(1, "a"), (1, "b"), (1, "c"), (2, "a")}


def test_reads_are_monotone(spark, data):
    games = load(spark, data, "games")
    counts = []
    for day in ("2021-04-01", "2021-06-01", "2021-12-01"):
        counts.append(temporal.as_of(games, ["game_pk"], "as_of_ts", F.to_timestamp(F.lit(day)), [F.col("rec_id")]).count())
    assert counts == sorted(counts)


def test_guards(spark):
    schema = StructType([StructField("k", LongType()), StructField("as_of_ts", TimestampType())])
    spec = lambda kind, **kw: registry.TableSpec("t", kind, ("k",), schema, **kw)
    registry.guard(spec(registry.Kind.FACT))
    registry.guard(spec(registry.Kind.OUTCOME), allow_outcomes=True)
    for bad in (spec(registry.Kind.CLOSING), spec(registry.Kind.OUTCOME), spec(registry.Kind.FACT, known_at=None)):
        with pytest.raises(registry.LeakError):
            registry.guard(bad)
    with pytest.raises(ValueError):
        registry.TableSpec("t", registry.Kind.FACT, ("missing",), schema).check()


def test_before_event(spark):
    events = spark.createDataFrame([(1, at(10)), (2, at(5)), (4, at(5))], "k int, start timestamp")
    got = temporal.before_event(versions(spark), ["k"], "known", events, ["k"], "start", ties=[F.col("rec")]).collect()
    assert [(r.k, r.v) for r in got] == [(1, "a")]


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join(spark, direction):
    rng = random.Random(7)
    left = [(k, at(rng.randint(0, 60)), i) for i, k in enumerate(rng.choices("abc", k=60))] + [("z", at(3), 99)]
    right = [(k, at(rng.randint(0, 60)), 100 + i) for i, k in enumerate(rng.choices("ab", k=40))]
    got = temporal.asof_join(
        spark.createDataFrame(left, "k string, t timestamp, i int"), spark.createDataFrame(right, "k string, u timestamp, j int"),
        ["k"], "t", "u", ["j"], direction, 10 * 60_000_000, [F.col("j")],
    ).collect()
    assert len(got) == len(left)
    for r in got:
        if direction == "backward":
            own = [(u, j) for k, u, j in right if k == r.k and u <= r.t]
            best = max(own, default=None)
        else:
            own = [(u, -j) for k, u, j in right if k == r.k and u >= r.t]
            best = min(own, default=None)
            best = best and (best[0], -best[1])
        near = best and abs((best[0] - r.t).total_seconds()) <= 600
        assert r.j_r == (best[1] if near else None)


def test_episodes_and_runs(spark):
    df = spark.createDataFrame([("a", at(0), "x"), ("a", at(45), "x"), ("a", at(91), None), ("a", at(92), None), ("a", at(93), "x")], "k string, t timestamp, d string")
    assert [r.episode for r in temporal.episodes(df, ["k"], "t", 2700).orderBy("t").collect()] == [1, 1, 2, 2, 2]
    assert [r.run for r in temporal.identical_runs(df, ["k"], "t", [], "d").orderBy("t").collect()] == [1, 2, 1, 2, 1]


def test_nearest_and_unique(spark):
    pairs = spark.createDataFrame([("a", 1, at(0), 1), ("a", 5, at(30), 2), ("b", 1, at(0), 1), ("b", 1, at(200), 2), ("c", 3, at(0), 9)], "k string, d int, s timestamp, o int")
    got = {r.k: (r.o, r.status) for r in temporal.nearest_or_refuse(pairs, ["k"], "d", "s", "o", 5400).collect()}
    assert got == {"a": (1, "ambiguous"), "b": (1, "matched"), "c": (9, "matched")}
    assert {r.k: r.o for r in temporal.unique_or_null(pairs, ["k"], "o").collect()} == {"a": None, "b": None, "c": 9}


# -- loading ----------------------------------------------------------------------


def test_append_is_idempotent(spark, tmp_path):
    schema = StructType([StructField("k", LongType()), StructField("line", DoubleType()), StructField("as_of_ts", TimestampType()), StructField("v", StringType())])
    spec = registry.TableSpec("t", registry.Kind.FACT, ("k", "line"), schema, required=("v",))
    rows = spark.createDataFrame([(1, None, at(0), "old", 1), (1, None, at(0), "new", 2), (1, 2.5, at(0), "x", 3), (1, None, at(5), "later", 4)], "k long, line double, as_of_ts timestamp, v string, ord int")
    path = str(tmp_path / "t")
    assert loading.append(spark, rows, path, spec, "ord") == {"offered": 4, "added": 3}
    assert loading.append(spark, rows, path, spec, "ord") == {"offered": 4, "added": 0}
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["later", "new", "x"]
    with pytest.raises(ValueError):
        loading.append(spark, rows.drop("v"), path, spec, "ord")


def test_align(spark):
    df = spark.createDataFrame([("7", "x", 1)], "a string, b string, extra int")
    target = StructType([StructField("b", LongType()), StructField("a", LongType()), StructField("c", StringType())])
    assert tuple(registry.align(df, target).first()) == (None, 7, None)


# -- prices -----------------------------------------------------------------------


def test_prices(spark):
    df = spark.createDataFrame([(150.0,), (-200.0,), (50.0,), (None,)], "v double")
    got = [r[0] for r in df.select(market.american_to_decimal(F.col("v"))).collect()]
    assert got[:2] == [2.5, 1.5] and got[2:] == [None, None]
    back = spark.createDataFrame([(2.5,), (1.5,), (1.0,), (2.0,)], "d double").select(market.decimal_to_american(F.col("d"))).collect()
    assert [r[0] for r in back] == [150.0, -200.0, None, 100.0]
    outs = spark.createDataFrame([("6.2",), ("7",), ("1.3",), (None,), ("",)], "t string").select(market.innings_to_outs(F.col("t"))).collect()
    assert [r[0] for r in outs] == [20, 21, None, None, None]


@pytest.mark.parametrize("q", [[0.55, 0.5], [0.9, 0.15], [0.4, 0.35, 0.3], [0.5, 0.5], [0.6, None], [], [0.7]])
def test_devig(spark, q):
    row = spark.createDataFrame([(q,)], "q array<double>").select(market.devig_all(F.col("q")).alias("d")).first().d
    valid = len(q) >= 2 and all(x for x in q) and sum(q) > 1
    if not valid:
        assert all(v is None for v in row)
        return
    for name in market.DEVIG:
        if row[name] is not None:
            assert math.isclose(sum(row[name]), 1, abs_tol=1e-9)
    if len(q) == 2 and row["additive"]:
        assert all(math.isclose(a, s, abs_tol=1e-6) for a, s in zip(row["additive"], row["shin"]))


def test_books(spark):
    texts = [
        '{"orderbook": {"yes": [[40, 5], [42, 1]], "no": [[55, 3]]}}', '{"orderbook_fp": {"yes": [["0.40", "5"]], "no": [["0.55", "3"]]}}',
        '{"orderbook": {"yes_levels": [[40, 5]], "no": [[65, 1]]}}', '{"orderbook": {"yes": [], "no": [[55, 3]]}}', "cut", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    got = [r.mid for r in archive.book_mids(df).orderBy("i").collect()]
    assert [g and round(g, 4) for g in got] == [0.435, 0.425, None, None, None, None]


# -- rates ------------------------------------------------------------------------


@pytest.mark.parametrize("strength", [120, 400])
def test_prior_strength_is_recovered(spark, strength):
    rng = random.Random(strength)
    rows = []
    for _ in range(1500):
        p, n = rng.betavariate(0.22 * strength, 0.78 * strength), rng.randint(200, 900)
        rows.append((n, sum(rng.random() < p for _ in range(n))))
    fit = rates.eb_constants(spark.createDataFrame(rows, "n int, x int"), "n", "x", [0]).first()
    assert abs(fit.mean - 0.22) < 0.01 and 0.7 < fit.k / strength < 1.3 and not fit.saturated


def test_prior_edges(spark):
    one = rates.eb_constants(spark.createDataFrame([(100, 20)], "n int, x int"), "n", "x", [0, 500]).collect()
    assert [(r.k, r.saturated, r.n_eligible) for r in sorted(one, key=lambda r: r.min_trials)] == [(rates.K_HIGH, True, 1), (rates.K_HIGH, True, 0)]
    flat = rates.eb_constants(spark.createDataFrame([(100, 20), (200, 40)], "n int, x int"), "n", "x", [0]).first()
    assert flat.k == rates.K_HIGH and flat.saturated


def test_pooling(spark):
    df = spark.createDataFrame([("a", "p", 1), ("a", "q", 0), ("b", None, 1), ("a", "p", 1)], "g string, h string, x int")
    got = {(r.depth, r.g, r.h): (r.n, r.rate) for r in rates.pooled_rates(df, ["g", "h"], F.col("x"), F.lit(1), 2.0).collect()}
    root = 0.75
    a = (2 + 2 * root) / 5
    assert got[0, None, None] == (4, root) and math.isclose(got[1, "a", None][1], a)
    assert math.isclose(got[2, "a", "p"][1], (2 + 2 * a) / 4) and (2, "b", "(null)") in got


def test_least_squares(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random(), 1 + rng.random()) for _ in range(300)]
    df = spark.createDataFrame([(0.5 + 2 * a - 3 * b, a, b, w, 1.0) for a, b, w in rows], "y double, a double, b double, w double, c double")
    fit = rates.weighted_least_squares(df, "y", "a", "b", "w").first()
    assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip((fit.b0, fit.b1, fit.b2, fit.r2), (0.5, 2, -3, 1)))
    flat = rates.weighted_least_squares(df, "y", "a", "c", "w").first()
    assert flat.b2 == 0 and flat.n == 300


def test_projection_shrinks(spark):
    rng = random.Random(5)
    rows = []
    for p in range(60):
        rate = rng.betavariate(20, 60)
        for i in range(rng.randint(20, 300)):
            rows.append((p, dt.date(2021, 5, 1) + dt.timedelta(days=i % 30), rng.choice("LR"), "hit" if rng.random() < rate else "out"))
    h = spark.createDataFrame(rows, "player int, day date, opposing string, outcome string")
    got = projector.project(h, ("hit", "out"), ["2021-05-20", "2021-06-15"], 365.0, [0.0]).cache()
    sums = got.groupBy("snapshot", "player", "split").agg(F.sum("p").alias("s")).collect()
    assert all(math.isclose(r.s, 1, abs_tol=1e-9) for r in sums)
    early = projector.project(h.where("day < '2021-05-20'"), ("hit", "out"), ["2021-05-20"], 365.0, [0.0])
    same = early.join(got, ["snapshot", "player", "split", "outcome"]).where(F.abs(early.p - got.p) > 1e-12)
    assert same.count() == 0  # nothing after a snapshot reaches it


# -- checks, health, payloads -----------------------------------------------------------


def test_suite_fires(spark):
    good, bad = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    run = lambda df: quality.gate(quality.suite([quality.check("dup", quality.duplicates(df, ["k"]))])).first().open
    assert run(good) and not run(bad)


def test_health(spark):
    rows = [("v", at(15 * i), "x" if ok else None, None if ok else "e") for i, ok in enumerate([1, 0, 0, 1, 0, 0, 0])] + [("w", at(0), None, "e")]
    df = spark.createDataFrame(rows, "venue string, fetched_at timestamp, payload string, error string")
    got = {r.venue: r for r in health.venue_health(health.ticks(df)).collect()}
    assert (got["v"].longest_failure, got["v"].current_failure, got["v"].failures) == (3, 3, 5)
    assert got["w"].last_success is None and got["w"].current_failure == 1


def test_delimited(spark, tmp_path):
    (tmp_path / "p.csv").write_text("k,n,x,junk\n1,2.0,nan,a\n2,oops,1.5\nNA,3,1,b\n3,,NULL,c,d\n")
    schema = StructType([StructField("k", LongType()), StructField("n", LongType()), StructField("x", DoubleType()), StructField("new", StringType())])
    got = sorted(tuple(r) for r in payloads.read_delimited(spark, str(tmp_path / "p.csv"), schema, ["k"]).collect())
    assert got == [(1, 2, None, None), (2, None, 1.5, None), (3, None, None, None)]


def test_zipped_lines(spark, tmp_path):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("2021X.EVA", "id,G1\ninfo,hometeam,AAA\ninfo,visteam,BBB\nplay,1,0,p1,00,X,S8\nid,G2\ninfo,hometeam,CCC\nplay,1,0,p2,00,X,K\n".encode("latin-1"))
        z.writestr("notes.txt", "ignored")
    (tmp_path / "a.zip").write_bytes(box.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    lines = payloads.read_zipped_lines(spark, str(tmp_path / "*.zip"))
    assert lines.where("member is not null").count() == 7 and lines.where("record = 'unreadable'").count() == 1
    plays = payloads.carry_headers(lines).where("record = 'play'").orderBy("ord").collect()
    assert [(r.game_id, r.home, r.away) for r in plays] == [("G1", "AAA", "BBB"), ("G2", "CCC", None)]


def test_aliases(spark):
    texts = ['[{"xMLBAMID": "5", "PA": "10", "K%": "21.5%"}]', '{"data": [{"playerid": "6", "PA": "x"}]}', "junk", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    cols = {"player_id": (["xMLBAMID", "playerid"], "bigint"), "pa": (["PA"], "int"), "k_rate": (["K%"], "double")}
    got = [(r.i, r.player_id, r.pa, r.k_rate) for r in payloads.read_aliased(df, ["data", "results"], cols).orderBy("i").collect()]
    assert got == [(0, 5, 10, 21.5), (1, 6, None, None)]


def test_export_import(spark, tmp_path):
    tables = {"a": spark.range(5), "b": spark.range(0)}
    counts = payloads.export_tables(tables, str(tmp_path / "x"))
    assert counts == {"a": 5, "b": 0}
    assert payloads.import_tables(spark, str(tmp_path / "x"), counts)["a"].count() == 5
    with pytest.raises(ValueError):
        payloads.import_tables(spark, str(tmp_path / "x"), {"a": 6})


def test_coverage(spark):
    e = spark.createDataFrame([("v", 1), ("v", 2), ("w", 1)], "venue string, game int")
    l = spark.createDataFrame([("v", 1), ("v", 9)], "venue string, game int")
    got = {r.venue: (r.expected, r.covered, r.missing, r.unlisted, r.status) for r in health.coverage(e, l, "game", "venue").collect()}
    assert got == {"v": (2, 1, 1, 1, "partial"), "w": (1, 0, 1, 0, "unknown")}


def test_greedy_assignment(spark):
    pairs = spark.createDataFrame([("g", 1, "a", 5), ("g", 1, "b", 1), ("g", 2, "b", 0), ("g", 2, "a", 9), ("h", 3, "a", 4), ("h", None, "a", 1)], "k string, l int, r string, d int")
    got = {(r.k, r.l, r.r) for r in temporal.greedy_assignment(pairs, ["k"], "l", "r", "d").collect()}
    assert got == {("g", 2, "b"), ("g", 1, "a"), ("h", 3, "a")}


def test_stream_import_is_exactly_once(spark, tmp_path):
    schema = StructType([StructField("k", LongType()), StructField("as_of_ts", TimestampType()), StructField("v", StringType())])
    spec = registry.TableSpec("t", registry.Kind.FACT, ("k",), schema)
    rows = lambda ks: spark.createDataFrame([(k, at(0), "x") for k in ks], schema)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    parse = lambda df: df.withColumn("ord", F.lit(1))
    rows([1, 2]).write.mode("append").parquet(source)
    assert archive.stream_import(spark, source, schema, target, spec, parse, "ord") == 2
    rows([2, 3]).write.mode("append").parquet(source)
    assert archive.stream_import(spark, source, schema, target, spec, parse, "ord") == 1
    assert archive.stream_import(spark, source, schema, target, spec, parse, "ord") == 0
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_sessions_and_archive_layout(spark, tmp_path):
    rows = [("v", at(0), 1), ("v", at(44), 2), ("v", at(100), 3), ("w", at(0), 4)]
    df = spark.createDataFrame(rows, "venue string, fetched_at timestamp, n int")
    assert sorted((r.venue, r.records) for r in archive.fetch_sessions(df).collect()) == [("v", 1), ("v", 2), ("w", 1)]
    archive.write_archive(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).where("venue = 'v' and dt = '2021-04-01'").count() == 3


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 70


def test_contact_table(spark):
    from tidemark.plans import contact

    rows = [(95.0, 12.0, "hit")] * 30 + [(95.0, 12.0, "out")] * 10 + [(80.0, 12.0, "out")] * 20 + [(None, 5.0, "hit"), (99.0, 90.0, "out"), (-1.0, -90.5, "out")]
    balls = spark.createDataFrame(rows, "speed double, angle double, outcome string")
    table = contact.contact_table(balls, ("hit", "out"), 40.0)
    got = {(r.band, r.speed): (r.n, r.p) for r in table.collect()}
    root = 30 / 62
    band = (30 + 40 * root) / 100
    assert math.isclose(got["10..25", 47][1][0], (30 + 40 * band) / 80) and got["10..25", 47][0] == 40
    assert got["out_of_range", 49][0] == 1 and got["out_of_range", -1][0] == 1
    out = contact.predict(balls.withColumn("n", F.lit(0)), table, contact.marginal_shares(balls, ("hit", "out"))).collect()
    assert len(out) == len(rows) and [r.source for r in out if r.speed is None] == ["marginal"]
    assert all(math.isclose(sum(r.p), 1) for r in out)
    empty = contact.marginal_shares(balls.limit(0), ("hit", "out")).first().marginal
    assert empty == [0.5, 0.5]


def test_load_pins_the_clock(spark, data):
    spark.conf.unset("spark.sql.session.timeZone")
    load(spark, data, "region")
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
