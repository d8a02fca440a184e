"""Registered queries: tickers, slates, coverage, integrity and scalar functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import market, text
from tidemark.operators import health, quality, temporal, tickers
from tidemark.operators.timestamps import normalise
from tidemark.plans.time_sql import reading_sql
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


def r6(c) -> F.Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def _newest(spark: SparkSession, base: str) -> DataFrame:
    g = load(spark, base, "games").where("game_pk is not null")
    return temporal.latest(g, ["game_pk"], [F.col("as_of_ts").desc(), F.col("rec_id")])


_NEW = "g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY as_of_ts DESC, rec_id) AS rn FROM games WHERE game_pk IS NOT NULL) WHERE rn = 1)"
_AT = "TIMESTAMPTZ '2021-06-23 17:00:00+00'"


def _at() -> F.Column:
    return F.to_timestamp(F.lit("2021-06-23 17:00:00+00:00"))


# -- tickers -------------------------------------------------------------------------------

_MONTH = "list_position(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'], mon)"
_PARSED = rf"""WITH c AS (SELECT upper(abbreviation) AS code, min(team_id) AS team FROM teams WHERE abbreviation IS NOT NULL GROUP BY 1 HAVING count(DISTINCT team_id) = 1),
t AS (SELECT DISTINCT event_ticker AS ticker FROM kalshi_markets WHERE event_ticker IS NOT NULL), x AS (SELECT ticker, regexp_extract(upper(trim(ticker)), '{tickers.FORM}', ['series', 'yy', 'mon', 'dd', 'hhmm', 'blob', 'side']) AS r FROM t),
y AS (SELECT ticker, r.*, TRY_CAST('20' || yy || '-' || lpad(CAST({_MONTH} AS VARCHAR), 2, '0') || '-' || dd AS DATE) AS day FROM (SELECT ticker, r, r.yy AS yy, r.mon AS mon, r.dd AS dd FROM x)),
k AS (SELECT ticker, blob, unnest(range(2, len(blob) - 1)) AS k FROM y WHERE len(blob) >= 4), h AS (SELECT ticker, blob[1:k] AS a, blob[k + 1:] AS b FROM k),
z AS (SELECT h.*, ca.team AS ta, cb.team AS tb FROM h LEFT JOIN c ca ON ca.code = a LEFT JOIN c cb ON cb.code = b),
s AS (SELECT ticker, count(*) FILTER (ta IS NOT NULL AND tb IS NOT NULL) AS n, any_value(ta) FILTER (ta IS NOT NULL AND tb IS NOT NULL) AS l, any_value(tb) FILTER (ta IS NOT NULL AND tb IS NOT NULL) AS r2,
list_sort(list(DISTINCT CASE WHEN ta IS NOT NULL AND tb IS NULL THEN b WHEN tb IS NOT NULL AND ta IS NULL THEN a END) FILTER ((ta IS NULL) <> (tb IS NULL))) AS halves FROM z GROUP BY ticker),
p AS (SELECT y.ticker, nullif(series, '') AS series, y.day, CASE WHEN hhmm <> '' THEN CAST(hhmm[1:2] AS INTEGER) * 60 + CAST(hhmm[3:4] AS INTEGER) END AS minute, CASE WHEN s.n = 1 AND y.day IS NOT NULL THEN l END AS "left", CASE WHEN s.n = 1 AND y.day IS NOT NULL THEN r2 END AS "right",
CASE WHEN blob = '' OR y.day IS NULL THEN 'unparsed' WHEN s.n = 1 THEN 'parsed' WHEN s.n > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status, CASE WHEN blob <> '' AND y.day IS NOT NULL AND coalesce(s.n, 0) = 0 THEN CASE WHEN len(halves) > 0 THEN halves ELSE [blob] END END AS unmapped FROM y LEFT JOIN s USING (ticker)) """


def _tickers(spark, base) -> DataFrame:
    t = load(spark, base, "kalshi_markets").where("event_ticker is not null").select(F.col("event_ticker").alias("ticker")).distinct()
    return tickers.parse(t, tickers.code_table(load(spark, base, "teams")))


def _slate(spark, base) -> DataFrame:
    g = _newest(spark, base).where("scheduled_start_ts is not null and home_team_id is not null and away_team_id is not null")
    return g.select("game_pk", F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"), F.col("scheduled_start_ts").alias("start"), F.col("game_date_local").alias("day"))


@query(_PARSED + """SELECT ticker, series, strftime(day, '%Y-%m-%d') AS day, minute, "left", "right", status, array_to_string(unmapped, ',') AS unmapped FROM p""")
def ticker_parse(spark, base):
    t = _tickers(spark, base)
    return t.select("ticker", "series", F.date_format("day", "yyyy-MM-dd").alias("day"), "minute", "left", "right", "status", F.array_join("unmapped", ",").alias("unmapped"))


_JOINED = _PARSED + f""", {_NEW}, gg AS (SELECT game_pk, least(home_team_id, away_team_id) || '-' || greatest(home_team_id, away_team_id) AS pair, game_date_local AS gday, CAST(scheduled_start_ts AS DATE) AS sday, epoch_us(scheduled_start_ts) // 60000000 AS at_m
FROM g WHERE scheduled_start_ts IS NOT NULL AND home_team_id IS NOT NULL AND away_team_id IS NOT NULL),
cd AS (SELECT p.ticker, p.day, minute, gg.*, count(*) OVER w AS n, min(at_m % 1440) OVER w AS lo, max(at_m % 1440) OVER w AS hi, min(at_m) OVER w AS first FROM p JOIN gg ON gg.pair = least("left", "right") || '-' || greatest("left", "right") AND abs(date_diff('day', p.day, sday)) <= 1 WHERE p.status = 'parsed' WINDOW w AS (PARTITION BY p.ticker)),
sm AS (SELECT at_m % 1440 AS u, minute AS t FROM cd WHERE minute IS NOT NULL AND at_m = first AND (n = 1 OR hi - lo <= 2)),
oc AS (SELECT o, i, sum(least(abs((u - o + 1440) % 1440 - t), 1440 - abs((u - o + 1440) % 1440 - t))) AS cost, count(*) AS k FROM sm, (VALUES (0, 0), (240, 1), (300, 2)) v(o, i) GROUP BY o, i),
ot AS (SELECT CASE WHEN any_value(cost / k ORDER BY cost, i) <= 60 THEN any_value(o ORDER BY cost, i) END AS off FROM (SELECT * FROM oc ORDER BY cost, i LIMIT 1)),
ct AS (SELECT cd.*, abs(at_m - (date_diff('day', DATE '1970-01-01', day) * 1440 + minute + off)) AS d FROM cd, ot WHERE n > 1), rk AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d, game_pk) AS rn, lead(d) OVER (PARTITION BY ticker ORDER BY d, game_pk) AS d2 FROM ct),
jd AS (SELECT ticker, game_pk, coalesce(d <= 180 AND d IS DISTINCT FROM d2, false) AS sure FROM rk WHERE rn = 1), hit AS (SELECT game_pk, ticker FROM cd WHERE n = 1 UNION ALL SELECT game_pk, ticker FROM jd WHERE sure),
mt AS (SELECT game_pk, min(ticker) AS ticker FROM hit GROUP BY 1), db AS (SELECT DISTINCT ct.game_pk FROM ct JOIN jd USING (ticker) WHERE NOT sure),
al AS (SELECT gg.game_pk, pair, gday, mt.ticker, db.game_pk IS NOT NULL AS doubt, count(*) OVER (PARTITION BY pair, gday) AS size, count(mt.ticker) OVER (PARTITION BY pair, gday) AS listed FROM gg LEFT JOIN mt USING (game_pk) LEFT JOIN db ON db.game_pk = gg.game_pk) """


@query(_JOINED + "SELECT game_pk, ticker, CASE WHEN ticker IS NOT NULL THEN 'matched' WHEN doubt THEN 'ambiguous' WHEN size > 1 AND listed < size THEN 'unlisted' ELSE 'unmatched' END AS status FROM al")
def ticker_games(spark, base):
    return tickers.join_games(_tickers(spark, base), _slate(spark, base))[0]


@query(_JOINED + "SELECT off AS \"offset\" FROM ot")
def ticker_clock(spark, base):
    return tickers.join_games(_tickers(spark, base), _slate(spark, base))[1]


@query("SELECT team_id AS team, array_to_string(list_sort(list(DISTINCT upper(abbreviation))), ',') AS codes FROM teams WHERE upper(abbreviation) IN (SELECT upper(abbreviation) FROM teams GROUP BY 1 HAVING count(DISTINCT team_id) = 1) GROUP BY 1")
def team_codes(spark, base):
    return tickers.codes_for(load(spark, base, "teams")).select("team", F.array_join("codes", ",").alias("codes"))


@query(r"""SELECT ticker, kind, team FROM (SELECT DISTINCT ticker, CASE WHEN regexp_matches(title, '(?i)\btotal\b|over/under|\bruns\b.*\d+\.5') THEN 'total' WHEN regexp_matches(title, '(?i)by (?:more than )?\d+') THEN 'spread'
WHEN regexp_matches(title, '(?i)^will (.+?) beat (.+?)\s*\??$') THEN 'beat' WHEN regexp_matches(title, '(?i)^will (.+?) win\s*\??$') THEN 'win' WHEN regexp_matches(title, '(?i)^(.+?) (?:vs\.?|v|at|@) (.+?)(?: winner)?\s*\??(?: - .+)?$') THEN 'winner' END AS kind,
CASE WHEN kind = 'beat' THEN regexp_extract(title, '(?i)^will (.+?) beat (.+?)\s*\??$', 1) WHEN kind = 'win' THEN regexp_extract(title, '(?i)^will (.+?) win\s*\??$', 1)
WHEN kind = 'winner' THEN regexp_extract(title, '(?i)^(.+?) (?:vs\.?|v|at|@) (.+?)(?: winner)?\s*\??(?: - .+)?$', 1) END AS team FROM kalshi_markets)""")
def title_kinds(spark, base):
    kind, team = tickers.classify_title(F.col("title"))
    return load(spark, base, "kalshi_markets").select("ticker", kind.alias("kind"), team.alias("team")).distinct()


@query(f"""WITH {_NEW}, r AS {reading_sql("(SELECT rec_id, ticker, close_time AS t, 'America/New_York' AS tz FROM kalshi_markets)")}, c AS (SELECT upper(abbreviation) AS code, min(team_id) AS team FROM teams WHERE abbreviation IS NOT NULL GROUP BY 1 HAVING count(DISTINCT team_id) = 1),
a AS (SELECT rec_id AS id, team, coalesce(instant, early) AS close FROM r JOIN c ON code = regexp_extract(ticker, '-([A-Z]+)$', 1) WHERE coalesce(instant, early) IS NOT NULL),
s AS (SELECT game_pk, scheduled_start_ts AS st, home_team_id AS team, 'home' AS side FROM g WHERE scheduled_start_ts IS NOT NULL AND home_team_id IS NOT NULL AND away_team_id IS NOT NULL UNION ALL SELECT game_pk, scheduled_start_ts, away_team_id, 'away' FROM g WHERE scheduled_start_ts IS NOT NULL AND home_team_id IS NOT NULL AND away_team_id IS NOT NULL),
f AS (SELECT id, count(*) AS n, min(game_pk) AS game_pk, min(side) AS side FROM a JOIN s ON a.team = s.team AND st BETWEEN close - INTERVAL 12 HOUR AND close GROUP BY id)
SELECT a.id, a.team, CASE WHEN n = 1 THEN game_pk END AS game_pk, CASE WHEN n = 1 THEN side END AS side FROM a LEFT JOIN f USING (id)""")
def team_window_match(spark, base):
    k = load(spark, base, "kalshi_markets")
    close = normalise(F.col("close_time"), F.lit("America/New_York"))
    codes = tickers.code_table(load(spark, base, "teams"))
    asks = k.select(F.col("rec_id").alias("id"), F.regexp_extract("ticker", "-([A-Z]+)$", 1).alias("code"), close.alias("close")).where("close is not null").join(F.broadcast(codes), "code")
    return tickers.team_in_window(asks.select("id", "team", "close"), _slate(spark, base)).select("id", "team", "game_pk", "side")


@query(r"""SELECT ticker, arg_min(endpoint, (file_path, file_row)) AS endpoint, count(*) AS n FROM (SELECT DISTINCT file_path, file_row, endpoint, unnest(list_distinct(regexp_extract_all(payload, '\b[A-Z0-9]{4,}-\d{2}[A-Z]{3}\d{2}[A-Z0-9-]*\b|\bKX[A-Z]+-\d+-[A-Z]+\b'))) AS ticker FROM poll_archive WHERE payload IS NOT NULL) GROUP BY ticker""")
def tickers_found(spark, base):
    """Every ticker-shaped text once, with where it was first seen."""
    form = r"\b[A-Z0-9]{4,}-\d{2}[A-Z]{3}\d{2}[A-Z0-9-]*\b|\bKX[A-Z]+-\d+-[A-Z]+\b"
    a = load(spark, base, "poll_archive").where("payload is not null")
    each = a.select("file_path", "file_row", "endpoint", F.explode(F.array_distinct(F.regexp_extract_all("payload", F.lit(form), F.lit(0)))).alias("ticker"))
    return each.groupBy("ticker").agg(F.min_by("endpoint", F.struct("file_path", "file_row")).alias("endpoint"), F.count(F.lit(1)).alias("n"))


# -- slates and coverage ---------------------------------------------------------------------


@query(f"WITH {_NEW} SELECT game_pk FROM g WHERE scheduled_start_ts BETWEEN {_AT} - INTERVAL 5 HOUR AND {_AT} + INTERVAL 12 HOUR")
def slate_window(spark, base):
    return health.in_window(_newest(spark, base), "scheduled_start_ts", _at()).select("game_pk")


@query(f"""WITH {_NEW} SELECT game_pk, CASE WHEN scheduled_start_ts - {_AT} > INTERVAL 6 HOUR THEN 'not_yet' WHEN {_AT} - scheduled_start_ts > INTERVAL 4 HOUR THEN 'no_longer' ELSE 'expected_now' END AS horizon FROM g WHERE scheduled_start_ts IS NOT NULL""")
def quote_horizon(spark, base):
    g = _newest(spark, base).where("scheduled_start_ts is not null")
    return g.select("game_pk", health.quote_horizon(F.col("scheduled_start_ts"), _at()).alias("horizon"))


@query("""WITH e AS (SELECT DISTINCT venue_id, game_pk FROM games WHERE venue_id IS NOT NULL), l AS (SELECT DISTINCT game_pk FROM odds_api WHERE game_pk IS NOT NULL)
SELECT venue_id, count(*) AS expected, count(l.game_pk) AS covered, count(*) - count(l.game_pk) AS missing, 0 AS unlisted, CASE WHEN count(l.game_pk) = 0 THEN 'unknown' WHEN count(*) = count(l.game_pk) THEN 'complete' ELSE 'partial' END AS status
FROM e LEFT JOIN l USING (game_pk) GROUP BY venue_id""")
def venue_coverage(spark, base):
    e = load(spark, base, "games").where("venue_id is not null").select("venue_id", "game_pk").distinct()
    listed = load(spark, base, "odds_api").where("game_pk is not null").select("game_pk").distinct().join(e, "game_pk")
    return health.coverage(e, listed, "game_pk", "venue_id")


@query(f"""WITH {_NEW}, o AS (SELECT DISTINCT game_pk FROM odds_api WHERE game_pk IS NOT NULL), e AS (SELECT DISTINCT game_pk FROM odds_api o2, (SELECT unnest(bookmakers) AS k, rec_id FROM odds_api) b WHERE o2.rec_id = b.rec_id AND o2.game_pk IS NOT NULL AND len(b.k.markets) > 0)
SELECT g.game_pk, CASE WHEN e.game_pk IS NOT NULL THEN 'counted' WHEN scheduled_start_ts IS NULL THEN 'no start' WHEN scheduled_start_ts - {_AT} > INTERVAL 6 HOUR THEN 'not yet' WHEN {_AT} - scheduled_start_ts > INTERVAL 4 HOUR THEN 'no longer' WHEN o.game_pk IS NOT NULL THEN 'listed, no price' ELSE 'absent' END AS diagnosis
FROM g LEFT JOIN o ON o.game_pk = g.game_pk LEFT JOIN e ON e.game_pk = g.game_pk""")
def coverage_diagnosis(spark, base):
    odds = load(spark, base, "odds_api").where("game_pk is not null")
    priced = F.exists("bookmakers", lambda k: F.size(k["markets"]) > 0)
    seen = odds.groupBy("game_pk").agg(F.bool_or(F.coalesce(priced, F.lit(False))).alias("priced"))
    g = _newest(spark, base).join(seen, "game_pk", "left")
    return g.select("game_pk", health.diagnosis(F.col("scheduled_start_ts"), _at(), F.col("priced")).alias("diagnosis"))


@query(f"""WITH {_NEW}, t AS (SELECT venue, time_bucket(INTERVAL 15 MINUTE, fetched_at) AS tick, count(payload) > count(error) AS ok FROM poll_archive WHERE fetched_at <= {_AT} GROUP BY ALL), v AS (SELECT DISTINCT venue FROM poll_archive),
s AS (SELECT v.venue, max(tick) FILTER (ok) AS last FROM v LEFT JOIN t USING (venue) GROUP BY v.venue), a AS (SELECT count(*) > 0 AS active FROM g WHERE scheduled_start_ts BETWEEN {_AT} - INTERVAL 5 HOUR AND {_AT} + INTERVAL 6 HOUR)
SELECT venue, CASE WHEN NOT active THEN 'quiet' WHEN last IS NULL THEN 'critical' WHEN {_AT} - last > INTERVAL 45 MINUTE THEN 'stale' ELSE 'ok' END AS state FROM s, a""")
def venue_alerts(spark, base):
    return health.alerts(load(spark, base, "poll_archive"), _newest(spark, base), "scheduled_start_ts", _at())


@query()
def alert_throttle(spark, base):
    """Failed ticks as alerts, at most one an hour and venue, at once again after a recovery."""
    ticks = health.ticks(load(spark, base, "poll_archive"))
    return health.throttle(ticks.select(F.col("venue").alias("key"), F.col("tick").alias("at"), (~F.col("succeeded")).alias("failing")), 3600).select("key", F.unix_micros("at").alias("at_us"))


@query(r"""WITH n AS (SELECT team_id, min(name) AS name FROM teams GROUP BY 1), t AS (SELECT DISTINCT title, ' ' || trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS x FROM polymarket_events WHERE title IS NOT NULL)
SELECT team_id, count(*) AS titles FROM n JOIN t ON contains(x, ' ' || trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) || ' ') GROUP BY team_id""")
def team_mentions(spark, base):
    """Titles that name a team: runs of their words met with the names by an equi-join."""
    names = load(spark, base, "teams").groupBy("team_id").agg(F.min("name").alias("name"))
    titles = load(spark, base, "polymarket_events").where("title is not null").select("title").distinct()
    return text.mentions(titles, "title", names, "name").groupBy("team_id").agg(F.count_distinct("title").alias("titles"))


@query(r"""SELECT label, count(*) AS n FROM (SELECT DISTINCT file_path, file_row, json_extract_string(t.atom, '$') AS label FROM poll_archive p, json_tree(p.payload) t
WHERE json_valid(p.payload) AND t.key IN ('title', 'subtitle', 'sub_title', 'yes_sub_title', 'no_sub_title', 'name', 'ticker', 'event_ticker', 'series_ticker', 'home_team', 'away_team', 'rules_primary') AND t.type = 'VARCHAR') WHERE label <> '' GROUP BY label""")
def payload_labels(spark, base):
    return text.labels(load(spark, base, "poll_archive"), ["file_path", "file_row"], "payload").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# -- integrity ---------------------------------------------------------------------------------

_CHECKS = f"""WITH {_NEW}, h AS (SELECT rec_id, is_observation, as_of_ts, unnest(hourly.temperature_2m) AS v FROM open_meteo),
c AS (SELECT 'game_pk_unique' AS name, 'error' AS severity, (SELECT count(*) FROM (SELECT game_pk FROM g GROUP BY 1 HAVING count(*) > 1)) AS metric, 0 AS allowed
UNION ALL SELECT 'required_values', 'error', (SELECT count(*) FROM odds_api WHERE id IS NULL OR as_of_ts IS NULL), 0
UNION ALL SELECT 'publication_lag', 'error', (SELECT count(*) FROM games WHERE as_of_ts > make_timestamptz(season, 12, 31, 23, 59, 59.0)), 0
UNION ALL SELECT 'ingested_after_known', 'error', (SELECT count(*) FROM games WHERE ingested_at < as_of_ts), 0
UNION ALL SELECT 'revised_games', 'info', (SELECT count(*) FROM (SELECT game_pk FROM games WHERE game_pk IS NOT NULL GROUP BY 1 HAVING count(DISTINCT as_of_ts) > 1)), NULL
UNION ALL SELECT 'in_play_snapshots', 'info', (SELECT count(*) FROM odds_api o JOIN g USING (game_pk) WHERE o.as_of_ts > g.scheduled_start_ts), NULL
UNION ALL SELECT 'bearing_in_range', 'warning', (SELECT count(*) FROM venues WHERE cf_bearing_deg IS NOT NULL AND NOT (cf_bearing_deg >= 0 AND cf_bearing_deg < 360)), 0
UNION ALL SELECT 'children_have_games', 'error', (SELECT count(DISTINCT game_pk) FROM odds_api WHERE game_pk IS NOT NULL AND game_pk NOT IN (SELECT game_pk FROM g)), 0) """


def _suite(spark, base) -> DataFrame:
    games, odds, venues = (load(spark, base, n) for n in ("games", "odds_api", "venues"))
    newest = _newest(spark, base)
    start = newest.select("game_pk", "scheduled_start_ts")
    year_end = F.make_timestamp(F.col("season"), F.lit(12), F.lit(31), F.lit(23), F.lit(59), F.lit(59))
    children = odds.where("game_pk is not null").select("game_pk").distinct()
    return quality.suite([
        quality.check("game_pk_unique", quality.duplicates(newest, ["game_pk"])),
        quality.check("required_values", odds.where("id is null or as_of_ts is null")),
        quality.check("publication_lag", games.where(F.col("as_of_ts") > year_end)),
        quality.check("ingested_after_known", games.where("ingested_at < as_of_ts")),
        quality.check("revised_games", quality.revisions(games.where("game_pk is not null"), ["game_pk"], "as_of_ts"), "info"),
        quality.check("in_play_snapshots", odds.select("game_pk", F.col("as_of_ts").alias("seen")).join(start, "game_pk").where("seen > scheduled_start_ts"), "info"),
        quality.check("bearing_in_range", venues.where("cf_bearing_deg is not null and not (cf_bearing_deg >= 0 and cf_bearing_deg < 360)"), "warning"),
        quality.check("children_have_games", quality.orphans(children, newest, ["game_pk"])),
    ])


@query(_CHECKS + "SELECT name, coalesce(metric <= allowed, true) AS passed, severity, metric FROM c")
def integrity_checks(spark, base):
    return _suite(spark, base).withColumn("passed", F.col("passed") | (F.col("severity") == "info"))


@query(_CHECKS + "SELECT count(*) FILTER (severity = 'error' AND metric > allowed) = 0 AS open, count(*) FILTER (severity = 'error' AND metric > allowed) AS failed FROM c")
def integrity_gate(spark, base):
    return quality.gate(_suite(spark, base))


@query("""SELECT 'readable_payloads' AS name, round(avg((json_valid(payload))::INT), 6) AS ratio, avg((json_valid(payload))::INT) >= 0.995 AS passed FROM poll_archive WHERE payload IS NOT NULL
UNION ALL SELECT 'resolved_odds', round(avg((game_pk IS NOT NULL)::INT), 6), avg((game_pk IS NOT NULL)::INT) >= 0.95 FROM odds_api""")
def quality_ratios(spark, base):
    a = load(spark, base, "poll_archive").where("payload is not null")
    return quality.ratio("readable_payloads", a, F.try_parse_json("payload").isNotNull(), 0.995).unionByName(quality.ratio("resolved_odds", load(spark, base, "odds_api"), F.col("game_pk").isNotNull(), 0.95))


@query("""SELECT rec_id, coalesce(cf_bearing_deg >= 0 AND cf_bearing_deg < 360, false) AS bearing_ok, name IS NOT NULL AND timezone IS NOT NULL AND lower(coalesce(roof, '')) NOT LIKE '%dome%' AS open_air FROM venues""")
def park_checks(spark, base):
    d = F.col("cf_bearing_deg")
    ok = F.coalesce((d >= 0) & (d < 360), F.lit(False))
    open_air = F.col("name").isNotNull() & F.col("timezone").isNotNull() & ~F.lower(F.coalesce("roof", F.lit(""))).contains("dome")
    return load(spark, base, "venues").select("rec_id", ok.alias("bearing_ok"), open_air.alias("open_air"))


@query("""WITH e AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), c AS (SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'counted' WHEN event_type = 'error' THEN 'excluded' WHEN event_type = 'signup' THEN 'other' ELSE 'unknown' END AS class, n FROM e)
SELECT class, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (SELECT sum(n) FROM c), 6) AS share FROM c GROUP BY class""")
def extraction_report(spark, base):
    classes = {"view": "counted", "click": "counted", "purchase": "counted", "error": "excluded", "signup": "other"}
    return quality.classes(load(spark, base, "events"), "event_type", classes)


@query("""WITH r AS (SELECT DISTINCT f.rec_id, TRY_CAST(coalesce(json_extract_string(payload, '$.gameData.game.pk'), json_extract_string(payload, '$.gamePk')) AS BIGINT) AS game_pk, TRY_CAST(json_extract_string(o.value, '$.official.id') AS BIGINT) AS umpire_id, as_of_ts
FROM mlb_game_feed f, json_each(payload, '$.liveData.boxscore.officials') o WHERE json_extract_string(o.value, '$.officialType') = 'Home Plate' AND json_extract_string(o.value, '$.official.id') IS NOT NULL),
u AS (SELECT game_pk, umpire_id FROM (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY as_of_ts DESC, rec_id) AS rn FROM r WHERE game_pk IS NOT NULL) WHERE rn = 1), n AS (SELECT game_pk, status FROM (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY as_of_ts DESC, rec_id) AS rn FROM games WHERE game_pk IS NOT NULL) WHERE rn = 1)
SELECT n.game_pk, umpire_id, status FROM n JOIN u USING (game_pk)""")
def plate_umpire_join(spark, base):
    """Both sides reduced to the latest version before they meet."""
    feed = load(spark, base, "mlb_game_feed")
    officials = payloads.officials(payloads.feed_documents(feed)).where("role = 'Home Plate' and umpire_id is not null").join(feed.select("rec_id", "as_of_ts"), "rec_id")
    latest = temporal.latest(officials, ["game_pk"], [F.col("as_of_ts").desc(), F.col("rec_id")]).select("game_pk", "umpire_id")
    return _newest(spark, base).select("game_pk", "status").join(latest, "game_pk")


# -- scalar functions ----------------------------------------------------------------------------


@query(r"""SELECT rec_id, round(yes_ask / 100.0, 6) AS p, round(CASE WHEN yes_ask > 0 THEN 100.0 / yes_ask END, 6) AS dec, CASE WHEN yes_ask > 0 AND yes_ask < 100 THEN CASE WHEN yes_ask <= 50 THEN CAST(round_even((1 / (yes_ask / 100.0) - 1) * 100, 0) AS BIGINT) ELSE CAST(-round_even(100.0 / (1 / (yes_ask / 100.0) - 1), 0) AS BIGINT) END END AS american,
round(CASE WHEN yes_ask - yes_bid > 0 THEN least(1, 0.5 + 0.01 / (2 * ((yes_ask - yes_bid) / 100.0))) ELSE 1 END, 6) AS breakeven, least(abs(yes_bid * 17 - yes_ask * 13) % 1440, 1440 - abs(yes_bid * 17 - yes_ask * 13) % 1440) AS apart,
CASE WHEN last_price % 10 <= 2 THEN last_price // 10 * 3 + last_price % 10 END AS outs FROM kalshi_markets WHERE yes_bid IS NOT NULL AND yes_ask IS NOT NULL AND last_price IS NOT NULL""")
def price_functions(spark, base):
    k = load(spark, base, "kalshi_markets").where("yes_bid is not null and yes_ask is not null and last_price is not null")
    p = market.cents_to_prob(F.col("yes_ask"))
    innings = F.concat((F.col("last_price") / 10).cast("int").cast("string"), F.lit("."), (F.col("last_price") % 10).cast("string"))
    return k.select(
        "rec_id", r6(p).alias("p"), r6(market.prob_to_decimal(p)).alias("dec"), market.decimal_to_american(market.prob_to_decimal(p)).cast("bigint").alias("american"),
        r6(market.breakeven_rate((F.col("yes_ask") - F.col("yes_bid")) / 100.0, F.lit(0.01))).alias("breakeven"),
        market.circular_minutes(F.col("yes_bid") * 17, F.col("yes_ask") * 13).alias("apart"), market.innings_to_outs(innings).alias("outs"),
    )


@query("""WITH v AS (SELECT venue_id, min(timezone) AS tz FROM venues WHERE timezone IS NOT NULL GROUP BY 1) SELECT DISTINCT venue_id, strftime(game_date_local, '%Y-%m-%d') AS day, epoch_us(timezone(tz, CAST(game_date_local AS TIMESTAMP))) AS start_us,
epoch_us(timezone(tz, CAST(game_date_local + 1 AS TIMESTAMP))) AS stop_us FROM games JOIN v USING (venue_id) WHERE game_date_local IS NOT NULL""")
def day_bounds(spark, base):
    zones = load(spark, base, "venues").where("timezone is not null").groupBy("venue_id").agg(F.min("timezone").alias("tz"))
    d = load(spark, base, "games").where("game_date_local is not null").select("venue_id", "game_date_local").distinct().join(zones, "venue_id")
    start, stop = text.day_bounds(F.col("game_date_local"), F.col("tz"))
    return d.select("venue_id", F.date_format("game_date_local", "yyyy-MM-dd").alias("day"), F.unix_micros(start).alias("start_us"), F.unix_micros(stop).alias("stop_us"))


@query("""WITH b AS (SELECT min(game_date_local) AS a, max(game_date_local) AS z FROM games) SELECT strftime(s, '%Y-%m-%d') AS start, strftime(least(CAST(s AS DATE) + 2, z), '%Y-%m-%d') AS stop FROM b, generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 3 DAY) t(s)""")
def date_chunks(spark, base):
    ends = load(spark, base, "games").agg(F.min("game_date_local").alias("a"), F.max("game_date_local").alias("z"))
    return ends.select(F.inline(text.date_chunks(F.col("a"), F.col("z"), 3))).select(F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("stop", "yyyy-MM-dd").alias("stop"))


@query(r"""SELECT file_path, file_row, regexp_replace(request_url || '?apiKey=secret' || file_row || '&x=1', '(?i)((?:api_?key|token)=)[^&]*', '\1***', 'g') AS url, regexp_replace(lower(venue || '/' || coalesce(key, '')), '[^a-z0-9._-]+', '_', 'g') AS part FROM poll_archive""")
def redacted_requests(spark, base):
    url = F.concat("request_url", F.lit("?apiKey=secret"), F.col("file_row").cast("string"), F.lit("&x=1"))
    return load(spark, base, "poll_archive").select("file_path", "file_row", text.redact(url).alias("url"), text.safe_component(F.concat("venue", F.lit("/"), F.coalesce("key", F.lit("")))).alias("part"))


@query("""WITH s AS (SELECT venue, epoch_us(fetched_at) // 1000000 AS t FROM poll_archive), c AS (SELECT venue, count(*) OVER (PARTITION BY venue ORDER BY t RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS n FROM s) SELECT venue, max(n) AS most FROM c GROUP BY venue""")
def request_window(spark, base):
    """The most requests any 60 seconds held."""
    s = load(spark, base, "poll_archive").select("venue", F.date_trunc("second", "fetched_at").alias("at"))
    return health.busiest_window(s, "venue", "at", 60)


@query("""SELECT venue, file_path, file_row, round(CASE WHEN quota_remaining > 0 THEN greatest(900.0, (32 - CAST(strftime(fetched_at, '%d') AS INTEGER)) * 86400.0 / quota_remaining) ELSE 3600 END, 4) AS seconds FROM poll_archive WHERE quota_remaining IS NOT NULL""")
def adaptive_interval(spark, base):
    a = load(spark, base, "poll_archive").where("quota_remaining is not null")
    return a.select("venue", "file_path", "file_row", F.round(health.adaptive_interval(32 - F.dayofmonth("fetched_at"), F.col("quota_remaining"), 900.0), 4).alias("seconds"))


@query(f"""WITH {_NEW} SELECT season, game_type, count(*) AS n FROM g WHERE game_date_local < DATE '2021-08-01' AND year(game_date_local) IN (2020, 2021) GROUP BY ALL""")
def season_scope(spark, base):
    got = temporal.expanding_aggregate(_newest(spark, base), "game_date_local", F.lit("2021-08-01").cast("date"), ["season", "game_type"], seasons=[2020, 2021], n=F.count(F.lit(1)))
    return got.select("season", "game_type", "n")


@query("SELECT event_id FROM events WHERE event_type IN ('__none__')")
def empty_in_list(spark, base):
    """An empty list selects nothing."""
    return load(spark, base, "events").where(F.col("event_type").isin([])).select("event_id")


@query(r"""WITH n AS (SELECT venue_id, min(name) AS name FROM venues WHERE name IS NOT NULL GROUP BY 1), o AS (SELECT regexp_replace(lower(slug), '[^\p{L}\p{N}]', '', 'g') AS k, max(altitude_ft) AS alt FROM venues WHERE slug IS NOT NULL GROUP BY 1)
SELECT venue_id, name, alt FROM n LEFT JOIN o ON k = regexp_replace(lower(name), '[^\p{L}\p{N}]', '', 'g')""")
def venue_override(spark, base):
    """Venues with the values a second list holds under their normalised name."""
    v = load(spark, base, "venues")
    named = v.where("name is not null").groupBy("venue_id").agg(F.min("name").alias("name")).withColumn("k", tickers.normal_name(F.col("name")))
    over = v.where("slug is not null").groupBy(tickers.normal_name(F.col("slug")).alias("k")).agg(F.max("altitude_ft").alias("alt"))
    return named.join(over, "k", "left").select("venue_id", "name", "alt")
