"""The registered queries over payloads and the polling archive, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import market
from tidemark.functions.timetext import read_times
from tidemark.operators import health, temporal
from tidemark.plans import projector
from tidemark.sources import load, payloads

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_GAMES = """WITH d AS (SELECT rec_id, unnest(dates) AS d FROM mlb_schedule), g AS (SELECT rec_id, unnest(d.games) AS g FROM d) """


@query(_GAMES + """SELECT rec_id, g.gamePk AS game_pk, TRY_CAST(g.season AS INTEGER) AS season, g.gameType AS game_type, g.status.detailedState AS status,
g.teams.home.team.id AS home_team_id, g.teams.away.team.id AS away_team_id, g.venue.id AS venue_id, g.gameNumber AS game_number
FROM g WHERE g.gamePk IS NOT NULL AND g.gameDate IS NOT NULL""")
def schedule_scan(spark: SparkSession, base: str) -> DataFrame:
    return payloads.schedule_rows(load(spark, base, "mlb_schedule")).drop("teams", "as_of_ts")


@query(_GAMES + """SELECT rec_id, game_pk, side, p.id AS player_id, p.pitchHand.code AS hand, false AS confirmed FROM (
SELECT rec_id, g.gamePk AS game_pk, 'home' AS side, g.teams.home.probablePitcher AS p FROM g WHERE g.gamePk IS NOT NULL AND g.gameDate IS NOT NULL UNION ALL
SELECT rec_id, g.gamePk, 'away', g.teams.away.probablePitcher FROM g WHERE g.gamePk IS NOT NULL AND g.gameDate IS NOT NULL) WHERE p.id IS NOT NULL""")
def probable_pitchers(spark, base):
    return payloads.probable_pitchers(load(spark, base, "mlb_schedule"))


_FEED = """WITH d AS (SELECT rec_id, payload, TRY_CAST(coalesce(json_extract_string(payload, '$.gameData.game.pk'), json_extract_string(payload, '$.gamePk')) AS BIGINT) AS game_pk,
coalesce(json_extract_string(payload, '$.gameData.status.statusCode') IN ('F', 'FR', 'FT', 'O', 'DI', 'CR', 'DC'), false) AS final FROM mlb_game_feed),
s AS (SELECT rec_id, game_pk, final, 'home' AS side, json_extract(payload, '$.liveData.boxscore.teams.home') AS box FROM d WHERE game_pk IS NOT NULL UNION ALL
SELECT rec_id, game_pk, final, 'away', json_extract(payload, '$.liveData.boxscore.teams.away') FROM d WHERE game_pk IS NOT NULL) """


def _docs(spark, base) -> DataFrame:
    return payloads.feed_documents(load(spark, base, "mlb_game_feed"))


@query(_FEED + """, n AS (SELECT *, CAST(coalesce(json_array_length(box, '$.battingOrder'), 0) AS BIGINT) AS k FROM s), i AS (SELECT *, unnest(range(1, least(9, k) + 1)) AS slot FROM n WHERE k > 0),
p AS (SELECT *, json_extract_string(box, '$.battingOrder[' || (slot - 1) || ']') AS id FROM i)
SELECT rec_id, game_pk, side, CAST(slot AS INTEGER) AS slot, TRY_CAST(id AS BIGINT) AS player_id, json_extract_string(box, '$.players.ID' || id || '.position.abbreviation') AS position, k >= 9 AS confirmed FROM p""")
def feed_lineups(spark, base):
    return payloads.lineups(_docs(spark, base))


@query(_FEED + "SELECT rec_id, game_pk, side, TRY_CAST(json_extract_string(box, '$.pitchers[0]') AS BIGINT) AS player_id FROM s WHERE TRY_CAST(json_extract_string(box, '$.pitchers[0]') AS BIGINT) IS NOT NULL")
def feed_starters(spark, base):
    return payloads.starters(_docs(spark, base))


@query("""WITH d AS (SELECT rec_id, TRY_CAST(coalesce(json_extract_string(payload, '$.gameData.game.pk'), json_extract_string(payload, '$.gamePk')) AS BIGINT) AS game_pk,
unnest(CAST(json_extract(payload, '$.liveData.boxscore.officials') AS JSON[])) AS o FROM mlb_game_feed)
SELECT rec_id, game_pk, json_extract_string(o, '$.officialType') AS role, TRY_CAST(json_extract_string(o, '$.official.id') AS BIGINT) AS umpire_id FROM d WHERE game_pk IS NOT NULL""")
def feed_officials(spark, base):
    return payloads.officials(_docs(spark, base))


_BOX = _FEED + """, k AS (SELECT s.*, unnest(json_keys(box, '$.players')) AS pid FROM s WHERE final), l AS (SELECT *, json_extract(box, '$.players.' || pid || '.stats.{0}') AS st FROM k)
SELECT rec_id, game_pk, side, TRY_CAST(regexp_extract(pid, '(\\d+)$', 1) AS BIGINT) AS player_id, CAST(nullif(list_position(coalesce(CAST(json_extract(box, '$.battingOrder') AS VARCHAR[]), []), regexp_extract(pid, '(\\d+)$', 1)), 0) AS INTEGER) AS slot,
{1} FROM l WHERE len(json_keys(st)) > 0"""


@query(_BOX.format("batting", "TRY_CAST(json_extract_string(st, '$.hits') AS INTEGER) AS hits"))
def feed_box_lines(spark, base):
    rows = payloads.box_lines(_docs(spark, base), "batting")
    return rows.withColumn("hits", F.try_element_at("stats", F.lit("hits")).try_cast("int")).drop("stats")


@query(_BOX.format("pitching", "CASE WHEN regexp_full_match(json_extract_string(st, '$.inningsPitched'), '\\d+(\\.[012]?)?') THEN TRY_CAST(split_part(json_extract_string(st, '$.inningsPitched'), '.', 1) AS INTEGER) * 3 + coalesce(TRY_CAST(nullif(split_part(json_extract_string(st, '$.inningsPitched'), '.', 2), '') AS INTEGER), 0) END AS outs"))
def feed_pitching_lines(spark, base):
    rows = payloads.box_lines(_docs(spark, base), "pitching")
    return rows.withColumn("outs", market.innings_to_outs(F.try_element_at("stats", F.lit("inningsPitched")))).drop("stats")


@query(_FEED + """, i AS (SELECT rec_id, game_pk, unnest(CAST(json_extract(payload, '$.liveData.linescore.innings') AS JSON[])) AS x FROM d WHERE final AND game_pk IS NOT NULL),
a AS (SELECT rec_id, count(*) AS innings, sum(coalesce(TRY_CAST(json_extract_string(x, '$.home.runs') AS INTEGER), 0)) AS h, sum(coalesce(TRY_CAST(json_extract_string(x, '$.away.runs') AS INTEGER), 0)) AS w,
sum(coalesce(TRY_CAST(json_extract_string(x, '$.home.runs') AS INTEGER), 0)) FILTER (CAST(json_extract_string(x, '$.num') AS INTEGER) <= 5) AS h5,
sum(coalesce(TRY_CAST(json_extract_string(x, '$.away.runs') AS INTEGER), 0)) FILTER (CAST(json_extract_string(x, '$.num') AS INTEGER) <= 5) AS w5,
bool_or(CAST(json_extract_string(x, '$.num') AS INTEGER) = 5) AS five, coalesce(json_extract_string(last(x), '$.home.runs') IS NOT NULL, false) AS half9 FROM i GROUP BY rec_id)
SELECT d.rec_id, d.game_pk, CAST(coalesce(TRY_CAST(json_extract_string(payload, '$.liveData.linescore.teams.home.runs') AS INTEGER), h) AS INTEGER) AS home_runs,
CAST(coalesce(TRY_CAST(json_extract_string(payload, '$.liveData.linescore.teams.away.runs') AS INTEGER), w) AS INTEGER) AS away_runs,
CAST(CASE WHEN five THEN h5 END AS INTEGER) AS home_f5, CAST(CASE WHEN five THEN w5 END AS INTEGER) AS away_f5, CAST(innings AS INTEGER) AS innings, innings > 9 AS extras, half9 AS home_half_9_played
FROM d JOIN a USING (rec_id) WHERE final AND game_pk IS NOT NULL""")
def feed_results(spark, base):
    return payloads.results(_docs(spark, base))


@query("""WITH t AS (SELECT venue, time_bucket(INTERVAL 15 MINUTE, fetched_at) AS tick, count(payload) AS r, count(error) AS e FROM poll_archive GROUP BY ALL),
i AS (SELECT *, r > e AS ok, sum((r > e)::INT) OVER (PARTITION BY venue ORDER BY tick) AS i FROM t), f AS (SELECT venue, i, count(*) AS n FROM i WHERE NOT ok GROUP BY ALL),
w AS (SELECT venue, count(*) AS ticks, count(*) FILTER (NOT ok) AS failures, max(i) AS top, epoch_us(max(tick) FILTER (ok)) AS last_success FROM i GROUP BY venue)
SELECT w.venue, last_success, ticks, failures, coalesce((SELECT max(n) FROM f WHERE f.venue = w.venue), 0) AS longest_failure,
coalesce((SELECT max(n) FROM f WHERE f.venue = w.venue AND f.i = w.top), 0) AS current_failure FROM w""")
def venue_health(spark, base):
    return health.venue_health(health.ticks(load(spark, base, "poll_archive"))).withColumn("last_success", F.unix_micros("last_success"))


@query("""WITH e AS (SELECT DISTINCT CAST(strftime(game_date_local, '%m') AS INTEGER) AS month, game_pk FROM games WHERE game_date_local IS NOT NULL),
l AS (SELECT DISTINCT CAST(strftime(g.game_date_local, '%m') AS INTEGER) AS month, game_pk FROM odds_api JOIN games g USING (game_pk) WHERE g.game_date_local IS NOT NULL),
b AS (SELECT coalesce(e.month, l.month) AS month, e.game_pk AS eg, l.game_pk AS lg FROM e FULL JOIN l ON e.month = l.month AND e.game_pk = l.game_pk)
SELECT month, count(eg) AS expected, count(*) FILTER (eg IS NOT NULL AND lg IS NOT NULL) AS covered, count(*) FILTER (lg IS NULL) AS missing, count(*) FILTER (eg IS NULL) AS unlisted,
CASE WHEN count(lg) = 0 THEN 'unknown' WHEN count(*) FILTER (lg IS NULL) = 0 THEN 'complete' ELSE 'partial' END AS status FROM b GROUP BY month""")
def coverage_report(spark, base):
    games = load(spark, base, "games").where("game_date_local is not null").select("game_pk", F.month("game_date_local").alias("month")).distinct()
    listed = load(spark, base, "odds_api").where("game_pk is not null").select("game_pk").distinct().join(games, "game_pk")
    return health.coverage(games, listed, "game_pk", "month")


@query("""WITH b AS (SELECT as_of_ts, unnest(bookmakers) AS b FROM odds_api), u AS (SELECT b.key AS book, as_of_ts, TRY_CAST(b.last_update AS TIMESTAMPTZ) AS seen FROM b WHERE b.last_update IS NOT NULL)
SELECT book, count(*) AS n, count(*) FILTER ((epoch_us(as_of_ts) - epoch_us(seen)) / 60000000.0 > 30) AS stale, round(max((epoch_us(as_of_ts) - epoch_us(seen)) / 60000000.0), 4) AS worst_minutes FROM u GROUP BY book""")
def quote_staleness(spark, base):
    b = load(spark, base, "odds_api").select("as_of_ts", F.explode("bookmakers").alias("b")).where("b.last_update is not null")
    at = F.transform(read_times(F.array("b.last_update")), lambda p: p["instant"])[0]
    got = health.price_staleness(b.select(F.col("b.key").alias("book"), "as_of_ts", at.alias("at")), "book", "at", "as_of_ts", 30)
    return got.withColumn("worst_minutes", F.round("worst_minutes", 4))


@query("""WITH v AS (SELECT venue_id, min(timezone) AS tz FROM venues WHERE timezone IS NOT NULL GROUP BY 1)
SELECT rec_id, game_pk, strftime(timezone(tz, scheduled_start_ts), '%Y-%m-%d') AS slate FROM games JOIN v USING (venue_id) WHERE scheduled_start_ts IS NOT NULL""")
def local_slate_date(spark, base):
    zones = load(spark, base, "venues").where("timezone is not null").groupBy("venue_id").agg(F.min("timezone").alias("tz"))
    g = load(spark, base, "games").where("scheduled_start_ts is not null").join(zones, "venue_id")
    return g.select("rec_id", "game_pk", F.date_format(F.from_utc_timestamp("scheduled_start_ts", F.col("tz")), "yyyy-MM-dd").alias("slate"))


@query("""WITH w AS (SELECT rec_id, venue_id, unnest(hourly.wind_speed_10m) AS s, unnest(hourly.wind_direction_10m) AS f FROM open_meteo),
b AS (SELECT venue_id, max(cf_bearing_deg) AS c FROM venues GROUP BY 1)
SELECT rec_id, count(*) AS n, round(avg(s * cos(radians(f - ((c + 180) - 360 * floor((c + 180) / 360))))), 4) AS outward, round(avg(s * sin(radians(f - ((c + 180) - 360 * floor((c + 180) / 360))))), 4) AS across
FROM w JOIN b USING (venue_id) WHERE s IS NOT NULL AND f IS NOT NULL AND c IS NOT NULL GROUP BY rec_id""")
def wind_components(spark, base):
    bearing = load(spark, base, "venues").groupBy("venue_id").agg(F.max("cf_bearing_deg").alias("c"))
    w = load(spark, base, "open_meteo").select("rec_id", "venue_id", F.inline(F.arrays_zip(F.col("hourly.wind_speed_10m").alias("s"), F.col("hourly.wind_direction_10m").alias("f"))))
    out, across = market.wind_components(F.col("s"), F.col("f"), F.col("c"))
    rows = w.join(bearing, "venue_id").where("s is not null and f is not null and c is not null")
    return rows.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(out), 4).alias("outward"), F.round(F.avg(across), 4).alias("across"))


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY as_of_ts DESC, rec_id) AS rn FROM venues),
g AS (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY as_of_ts DESC, rec_id) AS rn FROM games)
SELECT g.venue_id, any_value(v.name) AS name, strftime(min(game_date_local), '%Y-%m-%d') AS first_day, strftime(max(game_date_local), '%Y-%m-%d') AS last_day, count(*) AS games
FROM g JOIN v ON v.venue_id = g.venue_id AND v.rn = 1 WHERE g.rn = 1 GROUP BY g.venue_id""")
def venue_plan(spark, base):
    order = [F.col("as_of_ts").desc(), F.col("rec_id")]
    venues = temporal.latest(load(spark, base, "venues"), ["venue_id"], order).select("venue_id", "name")
    games = temporal.latest(load(spark, base, "games"), ["game_pk"], order).select("venue_id", "game_date_local")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return games.join(venues, "venue_id").groupBy("venue_id").agg(
        F.max("name").alias("name"), day(F.min("game_date_local")).alias("first_day"), day(F.max("game_date_local")).alias("last_day"), F.count(F.lit(1)).alias("games")
    )


_SHARES = ("view", "signup", "error", "click", "purchase")
_X = ", ".join(f"sum(w * (outcome = '{o}')::INT) AS x_{o}" for o in _SHARES)
_EACH = lambda f: ", ".join(f(o) for o in _SHARES)


@query(f"""WITH s AS (SELECT unnest([DATE '2024-01-15', DATE '2024-01-29']) AS snapshot), h AS (SELECT user_id AS player, CAST(ts AS DATE) AS day, CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'R' END AS opposing, event_type AS outcome FROM events),
e AS (SELECT snapshot, player, unnest(['ALL', opposing]) AS split, outcome, exp(-ln(2) * date_diff('day', day, snapshot) / 30.0) AS w FROM h JOIN s ON day < snapshot), t AS (SELECT snapshot, player, split, sum(w) AS n, {_X} FROM e GROUP BY ALL),
l AS (UNPIVOT (SELECT snapshot, player, n, {_EACH(lambda o: f"x_{o} AS {o}")} FROM t WHERE split = 'ALL') ON {_EACH(lambda o: o)} INTO NAME outcome VALUE x), mn AS (SELECT snapshot, outcome, sum(x) / sum(n) AS mean, count(*) AS c FROM l WHERE n >= 20 GROUP BY ALL),
vr AS (SELECT snapshot, outcome, any_value(mean) AS mean, any_value(c) AS c, sum(n * pow(x / n - mean, 2)) / sum(n) - any_value(mean) * (1 - any_value(mean)) * count(*) / sum(n) AS tv FROM l JOIN mn USING (snapshot, outcome) WHERE n >= 20 GROUP BY ALL),
kk AS (SELECT snapshot, outcome, mean, CASE WHEN c < 2 OR tv <= 0 THEN 100000.0 ELSE greatest(1.0, least(100000.0, mean * (1 - mean) / tv - 1)) END AS k FROM vr),
r AS (SELECT l.snapshot, player, outcome, n, k, (x + k * mean) / (n + k) AS raw FROM l JOIN kk USING (snapshot, outcome)), a AS (SELECT *, raw / sum(raw) OVER (PARTITION BY snapshot, player) AS p FROM r),
lg AS (UNPIVOT (SELECT snapshot, split, {_EACH(lambda o: f"sum(x_{o}) / sum(n) AS {o}")} FROM t GROUP BY ALL) ON {_EACH(lambda o: o)} INTO NAME outcome VALUE q), dl AS (SELECT b.snapshot, b.split, b.outcome, b.q - w.q AS delta FROM lg b JOIN lg w ON b.snapshot = w.snapshot AND b.outcome = w.outcome AND w.split = 'ALL' WHERE b.split <> 'ALL'),
sl AS (UNPIVOT (SELECT snapshot, player, split, n, {_EACH(lambda o: f"x_{o} AS {o}")} FROM t WHERE split <> 'ALL') ON {_EACH(lambda o: o)} INTO NAME outcome VALUE x), sm AS (SELECT sl.*, greatest(a.p + delta, 1e-6) AS m0 FROM sl JOIN a USING (snapshot, player, outcome) JOIN dl USING (snapshot, split, outcome)),
sn AS (SELECT *, m0 / sum(m0) OVER (PARTITION BY snapshot, player, split) AS m FROM sm), sp AS (SELECT *, (x + 2000 * m) / (n + 2000) AS raw FROM sn),
fin AS (SELECT snapshot, player, 'ALL' AS split, outcome, n, k, p, 'league' AS label FROM a UNION ALL SELECT snapshot, player, split, outcome, n, 2000.0, raw / sum(raw) OVER (PARTITION BY snapshot, player, split), 'league+platoon' FROM sp),
cc AS (SELECT *, 1 / sum(p / (n + k)) OVER (PARTITION BY snapshot, player, split) AS conc FROM fin)
SELECT strftime(snapshot, '%Y-%m-%d') AS snapshot, player, split, outcome, round(p, 6) AS p, round(conc, 3) AS concentration, round(greatest(conc - n, 0) / conc, 5) AS prior_weight, label FROM cc""")
def projected_rates(spark, base):
    """Shrunken event-type rates per user at two snapshots of the events table, over all and by side."""
    e = load(spark, base, "events").select(
        F.col("user_id").alias("player"), F.to_date("ts").alias("day"), F.when(F.pmod("event_id", F.lit(2)) == 0, "L").otherwise("R").alias("opposing"), F.col("event_type").alias("outcome")
    )
    got = projector.project(e, _SHARES, ["2024-01-15", "2024-01-29"], 30.0, [0.0, 20.0])
    return got.select(
        F.date_format("snapshot", "yyyy-MM-dd").alias("snapshot"), "player", "split", "outcome", F.round("p", 6).alias("p"), F.round("concentration", 3).alias("concentration"), F.round("prior_weight", 5).alias("prior_weight"), "label"
    )
