"""Registered queries: the market study, the warehouse and the raw store, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import market
from tidemark.operators import registry, storage, study, temporal
from tidemark.sources import load, shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


# -- the study: one book as the sharp side, another as the market -----------------------

SHARP, MARKET = "pinehall", "betgrove"


def _quotes(spark: SparkSession, base: str, book: str) -> DataFrame:
    """game_pk, at, price, team of a book's head-to-head markets; one quote per game and time."""
    odds = load(spark, base, "odds_api").where("game_pk is not null").select("rec_id", "game_pk", F.col("as_of_ts").alias("at"), "home_team", "away_team", F.posexplode("bookmakers").alias("b", "k"))
    m = odds.where(F.col("k.key") == book).select("*", F.posexplode("k.markets").alias("m", "mk")).where("mk.key = 'h2h' and size(mk.outcomes) = 2")
    q = [market.american_to_prob(F.col("mk.outcomes")[i]["price"]) for i in (0, 1)]
    name = F.col("mk.outcomes")[0]["name"]
    team = F.when(name == F.col("home_team"), "home").when(name == F.col("away_team"), "away")
    rows = m.select("game_pk", "at", "rec_id", "b", "m", (q[0] / (q[0] + q[1])).alias("price"), team.alias("team")).where("price is not null")
    best = rows.groupBy("game_pk", "at").agg(F.max_by(F.struct("price", "team"), F.struct("rec_id", -F.col("b"), -F.col("m"))).alias("q"))
    return best.select("game_pk", "at", "q.price", "q.team")


def _starts(spark: SparkSession, base: str) -> DataFrame:
    g = load(spark, base, "games").where("game_pk is not null and scheduled_start_ts is not null")
    return g.groupBy("game_pk").agg(F.max_by("scheduled_start_ts", F.struct("as_of_ts", -F.col("rec_id"))).alias("start"))


def _scanned(spark: SparkSession, base: str) -> DataFrame:
    return study.find_gaps(_quotes(spark, base, MARKET), _quotes(spark, base, SHARP), _starts(spark, base), "game_pk", stale_minutes=240)


def _outcomes(spark: SparkSession, base: str) -> DataFrame:
    return study.attach_outcomes(_scanned(spark, base).where("reason = 'gap'"), _quotes(spark, base, MARKET), "game_pk")


_STUDY = f"""WITH o AS (SELECT rec_id, game_pk, as_of_ts AS at_ts, home_team, away_team, unnest(bookmakers) AS k, generate_subscripts(bookmakers, 1) AS b FROM odds_api WHERE game_pk IS NOT NULL),
mm AS (SELECT *, unnest(k.markets) AS mk, generate_subscripts(k.markets, 1) AS m FROM o),
pr AS (SELECT rec_id, game_pk, at_ts, k.key AS book, b, m, CASE mk.outcomes[1].name WHEN home_team THEN 'home' WHEN away_team THEN 'away' END AS team, mk.outcomes[1].price AS p1, mk.outcomes[2].price AS p2 FROM mm WHERE mk.key = 'h2h' AND len(mk.outcomes) = 2),
q AS (SELECT *, CASE WHEN p1 >= 100 THEN 1 / (1 + p1 / 100) WHEN p1 <= -100 THEN 1 / (1 - 100 / p1) END AS q1, CASE WHEN p2 >= 100 THEN 1 / (1 + p2 / 100) WHEN p2 <= -100 THEN 1 / (1 - 100 / p2) END AS q2 FROM pr),
quotes AS (SELECT game_pk, at_ts, book, q1 / (q1 + q2) AS price, team FROM (SELECT *, row_number() OVER (PARTITION BY game_pk, book, at_ts ORDER BY rec_id DESC, b, m) AS rn FROM q WHERE q1 IS NOT NULL AND q2 IS NOT NULL) WHERE rn = 1),
st AS (SELECT game_pk, scheduled_start_ts AS start_ts FROM (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY as_of_ts DESC, rec_id) AS rn FROM games WHERE scheduled_start_ts IS NOT NULL AND game_pk IS NOT NULL) WHERE rn = 1),
mq AS (SELECT quotes.*, start_ts FROM quotes JOIN st USING (game_pk) WHERE book = '{MARKET}'), sq AS (SELECT game_pk, at_ts AS s_at, price AS s_price, team AS s_team FROM quotes WHERE book = '{SHARP}'),
j AS (SELECT mq.game_pk, at_ts, start_ts, CASE WHEN mq.at_ts - s_at <= INTERVAL 240 MINUTE THEN s_at END AS s_at, s_price, s_team, price, team FROM mq ASOF LEFT JOIN sq ON mq.game_pk = sq.game_pk AND mq.at_ts >= sq.s_at),
w AS (SELECT *, CASE WHEN s_at IS NULL THEN NULL WHEN team = s_team THEN price WHEN team IS NOT NULL AND s_team IS NOT NULL THEN 1 - price END AS own, CASE WHEN s_at IS NOT NULL THEN s_price END AS sharp FROM j),
f AS (SELECT *, abs(sharp - own) AS size, 0.07 * own * (1 - own) + 0.01 AS floor FROM w),
scan AS (SELECT *, CASE WHEN at_ts >= start_ts THEN 'in play' WHEN s_at IS NULL THEN 'stale' WHEN own IS NULL THEN 'unoriented' WHEN size <= floor THEN 'under floor' WHEN size > 0.25 THEN 'implausible' ELSE 'gap' END AS reason FROM f),
gaps AS (SELECT * FROM scan WHERE reason = 'gap'), mkt AS (SELECT game_pk, at_ts AS l_at, price AS l_price, team AS l_team FROM quotes WHERE book = '{MARKET}'),
due AS (SELECT *, at_ts + INTERVAL 15 MINUTE AS d1, at_ts + INTERVAL 60 MINUTE AS d2 FROM gaps),
a1 AS (SELECT due.*, CASE WHEN l_team = s_team THEN l_price WHEN l_team IS NOT NULL AND s_team IS NOT NULL THEN 1 - l_price END AS l1 FROM due ASOF LEFT JOIN mkt ON due.game_pk = mkt.game_pk AND due.d1 <= mkt.l_at),
a2 AS (SELECT a1.*, CASE WHEN l_team = s_team THEN l_price WHEN l_team IS NOT NULL AND s_team IS NOT NULL THEN 1 - l_price END AS l2 FROM a1 ASOF LEFT JOIN mkt ON a1.game_pk = mkt.game_pk AND a1.d2 <= mkt.l_at),
a3 AS (SELECT a2.*, CASE WHEN mkt.l_at > at_ts THEN CASE WHEN l_team = s_team THEN l_price WHEN l_team IS NOT NULL AND s_team IS NOT NULL THEN 1 - l_price END END AS l3 FROM a2 ASOF LEFT JOIN mkt ON a2.game_pk = mkt.game_pk AND a2.start_ts >= mkt.l_at),
mv AS (SELECT *, (later - own) * CASE WHEN sharp > own THEN 1 ELSE -1 END AS move FROM (SELECT *, '+1 snapshot' AS horizon, l1 AS later FROM a3 UNION ALL SELECT *, '+1 hour', l2 FROM a3 UNION ALL SELECT *, 'close', l3 FROM a3) WHERE later IS NOT NULL) """


@query(_STUDY + "SELECT reason, count(*) AS n, round(avg(size), 6) AS mean_size FROM scan GROUP BY reason")
def gap_reasons(spark: SparkSession, base: str) -> DataFrame:
    return _scanned(spark, base).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("size")).alias("mean_size"))


@query(_STUDY + "SELECT game_pk, epoch_us(at_ts) AS at_us, round(own, 6) AS own, round(sharp, 6) AS sharp, round(l1, 6) AS next, round(l2, 6) AS hour, round(l3, 6) AS close FROM a3")
def gap_outcomes(spark, base):
    o = _outcomes(spark, base)
    return o.select(
        "game_pk", F.unix_micros("at").alias("at_us"), r6("own").alias("own"), r6("sharp").alias("sharp"), r6(F.col("`later_+1 snapshot`")).alias("next"),
        r6(F.col("`later_+1 hour`")).alias("hour"), r6("later_close").alias("close"),
    )


@query(_STUDY + "SELECT horizon, count(*) AS n, round(avg(move), 6) AS mean, round(median(move), 6) AS median, round(avg(floor), 6) AS floor, count(*) FILTER (move > 0) AS toward FROM mv GROUP BY horizon")
def convergence_by_horizon(spark, base):
    got = study.summarise(study.moves(_outcomes(spark, base)))
    return got.select("horizon", "n", r6("mean").alias("mean"), r6("median").alias("median"), r6("floor").alias("floor"), "toward")


@query(_STUDY + """, sb AS (SELECT *, CASE WHEN size < 0.04 THEN '0.00-0.04' WHEN size < 0.06 THEN '0.04-0.06' WHEN size < 0.10 THEN '0.06-0.10' WHEN size < 0.25 THEN '0.10-0.25' END AS bucket FROM mv WHERE horizon = 'close')
SELECT bucket, count(*) AS n, round(avg((move > 0)::INT), 6) AS toward, round(avg((move = 0)::INT), 6) AS still, round(avg(floor), 6) AS floor,
round(CASE WHEN avg(size) > 0 THEN least(1, 0.5 + avg(floor) / (2 * avg(size))) ELSE 1 END, 6) AS breakeven FROM sb WHERE bucket IS NOT NULL GROUP BY bucket""")
def size_bucket_table(spark, base):
    got = study.size_table(study.moves(_outcomes(spark, base)))
    return got.select("bucket", "n", *[r6(c).alias(c) for c in ("toward", "still", "floor", "breakeven")])


@query(_STUDY + """, nb AS (SELECT *, CASE WHEN size >= 0.010 AND size < 0.015 THEN '0.0100-0.0150' WHEN size >= 0.015 AND size < 0.020 THEN '0.0150-0.0200' WHEN size >= 0.020 AND size < 0.0275 THEN '0.0200-0.0275' END AS band FROM scan WHERE reason = 'under floor')
SELECT band, count(*) AS n, round(avg(own), 6) AS mean_price, round(avg(floor), 6) AS mean_floor, count(*) FILTER (size > 0.07 * 0.8 * 0.2 + 0.01) AS would FROM nb WHERE band IS NOT NULL GROUP BY band""")
def near_miss_bands(spark, base):
    got = study.near_misses(_scanned(spark, base))
    return got.select("band", "n", r6("mean_price").alias("mean_price"), r6("mean_floor").alias("mean_floor"), "would")


@query(_STUDY + """, s AS (SELECT game_pk, team, count(*) AS n FROM quotes WHERE book = 'betgrove' AND team IS NOT NULL GROUP BY ALL), h AS (SELECT game_pk, arg_max(s_team, s_at) AS st FROM sq WHERE s_team IS NOT NULL GROUP BY 1)
SELECT game_pk, team, n FROM (SELECT s.*, row_number() OVER (PARTITION BY s.game_pk ORDER BY (team = st)::INT DESC, n DESC, team) AS rn FROM s JOIN h USING (game_pk)) WHERE rn = 1""")
def one_side_per_game(spark, base):
    sides = _quotes(spark, base, MARKET).where("team is not null").groupBy("game_pk", "team").agg(F.count(F.lit(1)).alias("n"))
    sharp = _quotes(spark, base, SHARP).where("team is not null").groupBy("game_pk").agg(F.max_by("team", "at").alias("st"))
    return study.one_side(sides.join(sharp, "game_pk"), "game_pk", "st")


_FETCHES = "f AS (SELECT DISTINCT fetched_at AS t FROM poll_archive WHERE endpoint = 'odds')"


@query(f"""WITH {_FETCHES}, st AS (SELECT game_pk, scheduled_start_ts AS s FROM (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY as_of_ts DESC, rec_id) AS rn FROM games WHERE scheduled_start_ts IS NOT NULL AND game_pk IS NOT NULL) WHERE rn = 1),
l AS (SELECT game_pk, count(t) AS n FROM st LEFT JOIN f ON t > s + INTERVAL 15 MINUTE AND t <= s + INTERVAL 180 MINUTE GROUP BY game_pk)
SELECT count(*) AS games, count(*) FILTER (n > 0) AS live_games, CAST(sum(n) AS BIGINT) AS moments FROM l""")
def in_play_moments(spark, base):
    fetches = load(spark, base, "poll_archive").where("endpoint = 'odds'").select("fetched_at").distinct()
    live = study.live_moments(_starts(spark, base), fetches, "game_pk", "fetched_at")
    return live.agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("n") > 0).alias("live_games"), F.sum("n").alias("moments"))


@query(f"WITH {_FETCHES} SELECT round(median(epoch_us(t) - epoch_us(p)) / 60000000, 6) AS minutes FROM (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM f) WHERE p IS NOT NULL")
def fetch_cadence(spark, base):
    return study.median_cadence(load(spark, base, "poll_archive").where("endpoint = 'odds'"), "fetched_at").select(r6("minutes").alias("minutes"))


@query(_STUDY + """, m AS (SELECT (epoch_us(at_ts) - epoch_us(start_ts)) / 60000000.0 AS d FROM mq)
SELECT CASE WHEN d <= 5 THEN '0-5' WHEN d <= 15 THEN '5-15' WHEN d <= 30 THEN '15-30' WHEN d <= 60 THEN '30-60' WHEN d <= 120 THEN '60-120' WHEN d <= 180 THEN '120-180' ELSE '180+' END AS band, count(*) AS n FROM m WHERE d >= 0 GROUP BY ALL""")
def minutes_past_start(spark, base):
    q = _quotes(spark, base, MARKET).join(_starts(spark, base), "game_pk")
    band = study.minute_band((F.unix_micros("at") - F.unix_micros("start")) / 60_000_000)
    return q.select(band.alias("band")).where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(_STUDY + """, e AS (SELECT game_pk, at_ts, CASE WHEN at_ts - lag(at_ts) OVER (PARTITION BY game_pk ORDER BY at_ts) <= INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS s FROM gaps) SELECT game_pk, CAST(sum(s) AS BIGINT) AS episodes FROM e GROUP BY game_pk""")
def gap_episodes(spark, base):
    e = temporal.episodes(_scanned(spark, base).where("reason = 'gap'"), ["game_pk"], "at", 45 * 60)
    return e.groupBy("game_pk").agg(F.max("episode").alias("episodes"))


@query("""WITH o AS (SELECT rec_id, home_team, away_team, unnest(bookmakers) AS k, generate_subscripts(bookmakers, 1) - 1 AS b FROM odds_api), m AS (SELECT *, unnest(k.markets) AS mk FROM o WHERE k.key = 'pinehall'),
x AS (SELECT rec_id, b, home_team, away_team, unnest(mk.outcomes) AS u FROM m WHERE mk.key = 'h2h'), p AS (SELECT rec_id, CAST(b AS INT) AS b, max(u.price) FILTER (u.name = home_team) AS home, max(u.price) FILTER (u.name = away_team) AS away FROM x GROUP BY ALL)
SELECT * FROM (SELECT rec_id, b, max(home) AS home, max(away) AS away FROM p GROUP BY ALL) WHERE home IS NOT NULL AND away IS NOT NULL""")
def reference_prices(spark, base):
    """Home and away price of one book, only where both are there."""
    x = load(spark, base, "odds_api").select("rec_id", "home_team", "away_team", F.posexplode("bookmakers").alias("b", "k")).where(F.col("k.key") == SHARP)
    x = x.select("rec_id", "b", "home_team", "away_team", F.explode("k.markets").alias("m")).where("m.key = 'h2h'").select("rec_id", "b", "home_team", "away_team", F.explode("m.outcomes").alias("u"))
    price = lambda side: F.max(F.when(F.col("u.name") == F.col(side), F.col("u.price")))
    return x.groupBy("rec_id", "b").agg(price("home_team").alias("home"), price("away_team").alias("away")).where("home is not null and away is not null")


@query("""WITH o AS (SELECT rec_id, unnest(bookmakers) AS k FROM odds_api), m AS (SELECT rec_id, k.key AS book, unnest(k.markets) AS mk FROM o), p AS (SELECT rec_id, book, mk.outcomes[1].price AS p1, mk.outcomes[2].price AS p2 FROM m WHERE mk.key = 'h2h' AND len(mk.outcomes) = 2),
d AS (SELECT rec_id, CASE book WHEN 'pinehall' THEN 3.0 WHEN 'oddsmoor' THEN 2.0 WHEN 'fanmark' THEN 0.0 ELSE 1.0 END AS w, CASE WHEN p1 >= 100 THEN 1 / (1 + p1 / 100) WHEN p1 <= -100 THEN 1 / (1 - 100 / p1) END AS q1,
CASE WHEN p2 >= 100 THEN 1 / (1 + p2 / 100) WHEN p2 <= -100 THEN 1 / (1 - 100 / p2) END AS q2 FROM p)
SELECT rec_id, round(sum(w * q1 / (q1 + q2)) / nullif(sum(w), 0), 6) AS fair, CAST(count(*) FILTER (w > 0) AS BIGINT) AS books FROM d WHERE q1 > 0 AND q2 > 0 AND q1 + q2 > 1 GROUP BY rec_id""")
def consensus_price(spark, base):
    """Weighted mean of the books' fair prices; unknown books weigh 1, recreational ones nothing."""
    m = load(spark, base, "odds_api").select("rec_id", F.explode("bookmakers").alias("k")).select("rec_id", F.col("k.key").alias("book"), F.explode("k.markets").alias("mk"))
    m = m.where("mk.key = 'h2h' and size(mk.outcomes) = 2").select("rec_id", "book", F.transform("mk.outcomes", lambda o: market.american_to_prob(o["price"])).alias("q"))
    return market.consensus(m.withColumn("fair", F.get(market.devig_multiplicative(F.col("q")), F.lit(0))), ["rec_id"], "book", "fair", {"pinehall": 3.0, "oddsmoor": 2.0, "fanmark": 0.0})


# -- the warehouse and the raw store ---------------------------------------------------------


@query("SELECT endpoint, count(*) AS n FROM poll_archive WHERE venue = 'kalshi' AND http_status >= 200 GROUP BY endpoint")
def bound_sql(spark, base):
    """Parameters are bound by name; the table is passed as a frame."""
    return storage.bound(spark, "SELECT endpoint, count(*) AS n FROM {a} WHERE venue = :venue AND http_status >= :least GROUP BY endpoint", {"a": load(spark, base, "poll_archive")}, venue="kalshi", least=200)


@query("""SELECT 'games' AS name, 'fact' AS kind, (SELECT count(*) FROM (SELECT DISTINCT game_pk, as_of_ts FROM games)) AS n UNION ALL SELECT 'venues', 'dimension', 0""")
def warehouse_status(spark, base):
    games = load(spark, base, "games")
    specs = [registry.TableSpec("games", registry.Kind.FACT, ("game_pk",), games.schema), registry.TableSpec("venues", registry.Kind.DIMENSION, ("venue_id",), load(spark, base, "venues").schema)]
    w = storage.Warehouse(spark, shared_dir(spark, "warehouse"), specs)
    w.create_all()
    rows = games.withColumn("ordinal", F.col("rec_id"))
    w.append("games", rows, "ordinal")
    w.append("games", rows, "ordinal")  # adds nothing
    return w.status()


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY game_pk, as_of_ts ORDER BY rec_id DESC) AS rn FROM games) SELECT season, count(*) AS n, min(rec_id) AS first_rec FROM d WHERE rn = 1 GROUP BY season""")
def glob_scan(spark, base):
    load(spark, base, "games")
    g = storage.read_glob(spark, f"{base}/game[s].parquet", ["game_pk", "as_of_ts"], "rec_id")
    return g.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first_rec"))


_RAW = """WITH r AS (SELECT *, sha256(payload) AS s FROM poll_archive WHERE payload IS NOT NULL), v AS (SELECT *, s IS DISTINCT FROM lag(s) OVER (PARTITION BY venue, endpoint, key ORDER BY fetched_at, file_path, file_row) AS new FROM r) """


def _raw(spark, base):
    return storage.raw_versions(load(spark, base, "poll_archive"), ["venue", "endpoint", "key"], "fetched_at", ["file_path", "file_row"], "payload")


@query(_RAW + "SELECT venue, endpoint, count(*) AS versions, count(DISTINCT s) AS bodies FROM v WHERE new GROUP BY ALL")
def raw_versions(spark, base):
    return _raw(spark, base).groupBy("venue", "endpoint").agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("sha256").alias("bodies"))


@query(_RAW + """SELECT venue, endpoint, key, s AS sha256 FROM (SELECT *, row_number() OVER (PARTITION BY venue, endpoint, key ORDER BY fetched_at DESC, file_path DESC, file_row DESC) AS rn FROM v WHERE new AND fetched_at <= TIMESTAMPTZ '2021-07-01 00:00:00+00') WHERE rn = 1""")
def raw_latest_as_of(spark, base):
    got = storage.latest_as_of(_raw(spark, base), ["venue", "endpoint", "key"], "fetched_at", [F.col("file_path").desc(), F.col("file_row").desc()], F.to_timestamp(F.lit("2021-07-01 00:00:00+00:00")))
    return got.select("venue", "endpoint", "key", "sha256")


@query("""WITH e AS (SELECT DISTINCT venue, endpoint, key, fetched_at, sha256(payload) AS s FROM poll_archive WHERE payload IS NOT NULL)
SELECT venue, endpoint, count(*) AS n FROM e WHERE fetched_at >= TIMESTAMPTZ '2021-07-01 00:00:00+00' GROUP BY ALL""")
def manifest_missing(spark, base):
    """Entries not in a manifest that was last written on July 1."""
    key = ["venue", "endpoint", "key", "fetched_at", "sha256"]
    raw = load(spark, base, "poll_archive").where("payload is not null").withColumn("sha256", F.sha2("payload", 256))
    manifest = raw.where(F.col("fetched_at") < F.to_timestamp(F.lit("2021-07-01 00:00:00+00:00"))).select(*key)
    return storage.manifest_rows(raw, manifest, key).groupBy("venue", "endpoint").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT file_path AS run, CASE WHEN count(error) > 0 THEN 'failed' ELSE 'ok' END AS event, CAST(epoch_us(max(fetched_at)) // 1000000 - epoch_us(min(fetched_at)) // 1000000 AS BIGINT) AS seconds, min(error) AS error FROM poll_archive GROUP BY file_path""")
def run_audit(spark, base):
    """Start and end rows of a run per file; the latest state of each."""
    runs = load(spark, base, "poll_archive").groupBy(F.col("file_path").alias("run")).agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b"), F.min("error").alias("error"))
    end = F.when(F.col("error").isNotNull(), "failed").otherwise("ok")
    log = runs.select("run", F.inline(F.array(F.struct(F.lit("running").alias("event"), F.col("a").alias("at"), F.lit(None).cast("string").alias("error")), F.struct(end.alias("event"), F.col("b").alias("at"), F.col("error").alias("error")))))
    return storage.run_states(log)


@query("SELECT file_path, sha256(string_agg(sha256(coalesce(payload, '')), '' ORDER BY file_row)) AS digest FROM poll_archive GROUP BY file_path")
def file_content_hash(spark, base):
    return storage.content_hash(load(spark, base, "poll_archive"), "file_path", "file_row", "payload")


@query("SELECT venue, strftime(date_trunc('month', fetched_at), '%Y-%m') AS month, count(*) AS requests FROM poll_archive GROUP BY ALL")
def monthly_requests(spark, base):
    a = load(spark, base, "poll_archive")
    return a.groupBy("venue", F.date_format(F.date_trunc("month", "fetched_at"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("requests"))


@query("""SELECT file_path, file_row, row_number() OVER (PARTITION BY file_path ORDER BY CASE endpoint WHEN 'markets' THEN 0 WHEN 'clob_events' THEN 0 WHEN 'odds' THEN 1 WHEN 'orderbook' THEN 2 WHEN 'book' THEN 2 ELSE 99 END, file_row) AS place FROM poll_archive""")
def endpoint_order(spark, base):
    from pyspark.sql import Window

    first = F.create_map(*[F.lit(x) for x in ("markets", 0, "clob_events", 0, "odds", 1, "orderbook", 2, "book", 2)])
    rank = F.coalesce(F.try_element_at(first, F.col("endpoint")), F.lit(99))
    span = Window.partitionBy("file_path").orderBy(rank, "file_row")  # the rows of one file
    return load(spark, base, "poll_archive").select("file_path", "file_row", F.row_number().over(span).alias("place"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' ORDER BY l_orderkey, l_linenumber")
def ordered_terminals(spark, base):
    """A global order: a range partition and a sort of each part."""
    return load(spark, base, "lineitem").where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber")


@query("""WITH b AS (SELECT file_path, file_row, key, fetched_at FROM poll_archive WHERE endpoint = 'orderbook' AND key IS NOT NULL), m AS (SELECT key, fetched_at AS m_at, TRY_CAST(json_extract_string(payload, '$.yes_bid') AS DOUBLE) AS bid,
row_number() OVER (PARTITION BY key, fetched_at ORDER BY file_path DESC, file_row DESC) AS rn FROM poll_archive WHERE endpoint = 'markets' AND key IS NOT NULL AND json_valid(payload))
SELECT b.file_path, b.file_row, m.bid FROM b ASOF LEFT JOIN (SELECT * FROM m WHERE rn = 1) m ON b.key = m.key AND b.fetched_at >= m.m_at""")
def book_to_summary(spark, base):
    """Each order book with the latest market summary of its ticker."""
    a = load(spark, base, "poll_archive").where("key is not null")
    books = a.where("endpoint = 'orderbook'").select("key", "fetched_at", "file_path", "file_row")
    whole = a.where("endpoint = 'markets'").where(F.try_parse_json("payload").isNotNull())
    markets = whole.select("key", F.col("fetched_at").alias("m_at"), F.get_json_object("payload", "$.yes_bid").try_cast("double").alias("bid"), F.col("file_path").alias("p"), F.col("file_row").alias("r"))
    return temporal.asof_join(books, markets, ["key"], "fetched_at", "m_at", ["bid"], ties=[F.col("p"), F.col("r")], suffix="").select("file_path", "file_row", "bid")
