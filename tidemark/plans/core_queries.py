"""The registered queries of the general problems (1, 2, 3, 5, 6) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import attributes, compaction, drift, nested, timestamps
from tidemark.plans.time_sql import HOURS_SQL, reading_sql
from tidemark.sources import load


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    names = ("mlb_schedule", "venues", "teams", "open_meteo", "kalshi_markets")
    return timestamps.changed_texts(timestamps.normalised_texts(*[load(spark, base, n) for n in names]))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    done = compaction.compact(load(spark, base, "poll_archive"))
    return done.surplus(spark).select("file_path", F.col("file_row").cast("int").alias("file_row"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return drift.drift_report(load(spark, base, "poll_archive"), load(spark, base, "payload_fields"))


def p3_fields(spark: SparkSession, base: str) -> DataFrame:
    return drift.consistent_fields(load(spark, base, "poll_archive"), load(spark, base, "payload_fields"))


def _table_of(endpoint: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, base: drift.consistent_table(load(spark, base, "poll_archive"), load(spark, base, "payload_fields"), endpoint)


#: The declared endpoints; p3_fields takes them from payload_fields.
ENDPOINTS = ("markets", "orderbook", "odds", "book", "clob_events", "forecast")


def _nested(spark: SparkSession, base: str) -> list[DataFrame]:
    return [load(spark, base, n) for n in ("odds_api", "polymarket_events", "mlb_game_feed")]


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return nested.child_rows(*_nested(spark, base))


def _subtype_of(src: str, subtype: str) -> Callable[[SparkSession, str], DataFrame]:
    """A typed subtype table; the variant's number is a hash that SQL hasn't got."""
    return lambda spark, base: nested.subtype_table(src, nested.CHILDREN[src](load(spark, base, src)), subtype).drop("src", "variant")


#: query -> (source, subtype)
SUBTYPE_QUERIES = {f"p5_{src.split('_')[0]}_{t}": (src, t) for src, held in nested.SUBTYPES.items() for t in held}


def p5_variants(spark: SparkSession, base: str) -> DataFrame:
    return nested.variant_counts(*_nested(spark, base))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    known = attributes.games_as_known(load(spark, base, "games"), load(spark, base, "venues"))
    return known.select("game_pk", "game_rec_id", "venue_rec_id")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_fields": p3_fields,
    **{f"p3_{e}_table": _table_of(e) for e in ENDPOINTS},
    "p5_found": p5_found,
    "p5_variants": p5_variants,
    **{q: _subtype_of(*of) for q, of in SUBTYPE_QUERIES.items()},
    "p6_found": p6_found,
}

_LIST = """CASE WHEN {0} IS NULL OR trim({0}) = '' THEN NULL WHEN {0} LIKE '"%' THEN CAST(json_extract_string('{{"v":' || {0} || '}}', '$.v') AS JSON)
ELSE CAST(replace({0}, chr(39), '"') AS JSON) END"""

_CHILDREN = f"""WITH ob AS (SELECT rec_id, id AS event_id, unnest(bookmakers) AS bk, generate_subscripts(bookmakers, 1) - 1 AS b FROM odds_api),
om AS (SELECT rec_id, event_id, b, bk.key AS book_key, unnest(bk.markets) AS mk, generate_subscripts(bk.markets, 1) - 1 AS m FROM ob),
oo AS (SELECT rec_id, event_id, b, m, book_key, mk.key AS k, unnest(mk.outcomes) AS o, generate_subscripts(mk.outcomes, 1) - 1 AS i FROM om),
oc AS (SELECT 'odds_api' AS src, rec_id, b || '.' || m || '.' || i AS pos, coalesce(k, '') || '|' || coalesce(o.name, '') AS item, coalesce(event_id, '') || '.' || b || '.' || m AS parent,
       event_id, book_key, k AS market_key, o.name AS outcome, o.price AS price, o.point AS point FROM oo WHERE o IS NOT NULL),
pm AS (SELECT rec_id, id AS event_id, unnest(markets) AS mk, generate_subscripts(markets, 1) - 1 AS m FROM polymarket_events),
pl AS (SELECT rec_id, event_id, m, mk.conditionId AS condition_id, CAST({_LIST.format("mk.outcomes")} AS VARCHAR[]) AS ls, CAST({_LIST.format("mk.outcomePrices")} AS VARCHAR[]) AS ps,
       CAST({_LIST.format("mk.clobTokenIds")} AS VARCHAR[]) AS ts FROM pm),
pi AS (SELECT rec_id, event_id, m, condition_id, ps, ts, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM pl),
pc AS (SELECT 'polymarket_events' AS src, rec_id, m || '.' || (i - 1) AS pos, coalesce(l, '') || '|' || coalesce(ps[i], '') AS item, coalesce(event_id, '') || '.' || m AS parent, event_id, condition_id,
       l AS label, ps[i] AS price_text, ts[i] AS token FROM pi),
fd AS (SELECT rec_id, payload, coalesce(json_extract_string(payload, '$.gameData.game.pk'), json_extract_string(payload, '$.gamePk')) AS pk FROM mlb_game_feed),
fb AS (SELECT rec_id, pk, 'home' AS side, CAST(json_extract(payload, '$.liveData.boxscore.teams.home.battingOrder') AS VARCHAR[]) AS bo FROM fd UNION ALL
       SELECT rec_id, pk, 'away', CAST(json_extract(payload, '$.liveData.boxscore.teams.away.battingOrder') AS VARCHAR[]) FROM fd),
fe AS (SELECT rec_id, pk, side, unnest(bo) AS value, generate_subscripts(bo, 1) - 1 AS n FROM fb),
fi AS (SELECT rec_id, pk, unnest(CAST(json_extract(payload, '$.liveData.linescore.innings') AS JSON[])) AS x FROM fd),
fr AS (SELECT rec_id, pk, json_extract_string(x, '$.num') AS num, 'home' AS side, json_extract_string(x, '$.home.runs') AS value FROM fi UNION ALL
       SELECT rec_id, pk, json_extract_string(x, '$.num'), 'away', json_extract_string(x, '$.away.runs') FROM fi),
fa AS (SELECT rec_id, pk AS parent, side || '.' || n AS pos, 'batter' AS label, CAST(n + 1 AS VARCHAR) AS num, side, value FROM fe WHERE value IS NOT NULL UNION ALL
       SELECT rec_id, pk, 'inning.' || num || '.' || side, 'runs', num, side, value FROM fr WHERE value IS NOT NULL),
fc AS (SELECT 'mlb_game_feed' AS src, *, coalesce(parent, '') || '|' || value AS item FROM fa) """

_PLAIN = r"'\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ'"
_STAMP = "'%Y-%m-%dT%H:%M:%SZ'"

SQL = {
    "p1_found": rf"""
        WITH v AS (SELECT venue_id, min(timezone) AS zone_of FROM venues WHERE timezone IS NOT NULL GROUP BY 1),
        k AS (SELECT team_id, min(home_venue_id) AS park FROM teams GROUP BY 1),
        sd AS (SELECT rec_id, unnest(dates) AS dd, generate_subscripts(dates, 1) - 1 AS d FROM mlb_schedule),
        sg AS (SELECT rec_id, d, unnest(dd.games) AS g, generate_subscripts(dd.games, 1) - 1 AS i FROM sd),
        s AS (SELECT rec_id, d || '.' || i AS pos, g.gameDate AS gd, g.officialDate AS od, coalesce(g.venue.id, park) AS vid FROM sg LEFT JOIN k ON team_id = g.teams.home.team.id),
        lone AS (SELECT 'mlb_schedule.gameDate' AS src, rec_id, pos, gd AS t, zone_of AS tz FROM s LEFT JOIN v ON venue_id = vid
                 UNION ALL SELECT 'mlb_schedule.officialDate', rec_id, pos, od, 'UTC' FROM s
                 UNION ALL SELECT 'kalshi_markets.close_time', rec_id, '0', close_time, 'America/New_York' FROM kalshi_markets),
        r AS (SELECT src, rec_id, pos, t, loc, coalesce(instant, early) AS at_ts FROM {reading_sql("lone")})
        SELECT src, rec_id, pos, strftime(at_ts, {_STAMP}) AS utc FROM r WHERE src <> 'mlb_schedule.officialDate' AND at_ts IS NOT NULL AND NOT regexp_full_match(t, {_PLAIN})
        UNION ALL SELECT src, rec_id, pos, strftime(loc, '%Y-%m-%d') FROM r WHERE src = 'mlb_schedule.officialDate' AND loc IS NOT NULL AND NOT regexp_full_match(t, '\d{{4}}-\d\d-\d\d')
        UNION ALL SELECT 'open_meteo.hourly.time', rec_id, CAST(pos AS VARCHAR), strftime(at_ts, {_STAMP}) FROM {HOURS_SQL} WHERE at_ts IS NOT NULL AND NOT regexp_full_match(t, {_PLAIN})
    """,
    "p5_found": _CHILDREN + "SELECT src, rec_id, pos, item FROM oc UNION ALL SELECT src, rec_id, pos, item FROM pc UNION ALL SELECT src, rec_id, pos, item FROM fc",
    **{f"p5_odds_{t}": f"{_CHILDREN} SELECT rec_id, pos, item, parent, 'outcome(' || if(price IS NULL, 'absent', 'value') || ',' || if(point IS NULL, 'absent', 'value') || ')' AS state, event_id, book_key, market_key, outcome{more} FROM oc WHERE {where}"
       for t, where, more in (("line", "price IS NOT NULL AND point IS NOT NULL", ", price, point"), ("price", "price IS NOT NULL AND point IS NULL", ", price"), ("unpriced", "price IS NULL", ", point"))},
    **{f"p5_polymarket_{t}": f"{_CHILDREN} SELECT rec_id, pos, item, parent, 'label(' || if(label IS NULL, 'absent', 'value') || ',{held},' || if(token IS NULL, 'absent', 'value') || ')' AS state, event_id, condition_id, label{more}, token FROM pc WHERE {where}"
       for t, held, where, more in (("priced", "number", "TRY_CAST(price_text AS DOUBLE) IS NOT NULL", ", TRY_CAST(price_text AS DOUBLE) AS price"), ("unpriced", "absent", "coalesce(price_text, '') = ''", ""),
                                    ("worded", "text", "price_text <> '' AND TRY_CAST(price_text AS DOUBLE) IS NULL", ", price_text"))},
    **{f"p5_mlb_{t}": f"{_CHILDREN} SELECT rec_id, pos, item, parent, label || '({held})' AS state, TRY_CAST(parent AS BIGINT) AS game_pk, side, TRY_CAST(num AS INTEGER) AS num, {value} FROM fc WHERE {where}"
       for t, held, value, where in (("batter", "number", "TRY_CAST(value AS BIGINT) AS number", "label = 'batter' AND TRY_CAST(value AS DOUBLE) IS NOT NULL"), ("runs", "number", "TRY_CAST(value AS BIGINT) AS number", "label = 'runs' AND TRY_CAST(value AS DOUBLE) IS NOT NULL"),
                                     ("other", "text", "value", "TRY_CAST(value AS DOUBLE) IS NULL"))},
    "p6_found": """
        WITH t AS (
            SELECT game_pk, scheduled_start_ts AS start_ts FROM (
                SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY as_of_ts DESC, rec_id) AS rn
                FROM games WHERE game_pk IS NOT NULL AND as_of_ts IS NOT NULL) WHERE rn = 1 AND scheduled_start_ts IS NOT NULL),
        g AS (
            SELECT game_pk, start_ts, rec_id AS game_rec_id, venue_id FROM (
                SELECT t.game_pk, t.start_ts, g.rec_id, g.venue_id,
                       row_number() OVER (PARTITION BY t.game_pk ORDER BY g.as_of_ts DESC, g.rec_id) AS rn
                FROM t JOIN games g ON g.game_pk = t.game_pk AND g.as_of_ts < t.start_ts) WHERE rn = 1)
        SELECT game_pk, game_rec_id, venue_rec_id FROM (
            SELECT g.game_pk, g.game_rec_id, v.rec_id AS venue_rec_id,
                   row_number() OVER (PARTITION BY g.game_pk ORDER BY v.as_of_ts DESC, v.rec_id) AS rn
            FROM g JOIN venues v ON v.venue_id = g.venue_id AND v.as_of_ts < g.start_ts) WHERE rn = 1
    """,
}
