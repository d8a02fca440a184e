"""The registered queries of the training-data problems (4, 7, 8, 9, 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import leakage, linkage, mojibake, nearest, packing
from tidemark.plans.time_sql import HOURS_SQL
from tidemark.sources import load


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return nearest.game_partners(*[load(spark, base, n) for n in ("games", "open_meteo", "odds_api")])


def _sources(spark: SparkSession, base: str) -> list[DataFrame]:
    return [load(spark, base, n) for n in ("odds_api", "kalshi_markets", "polymarket_events", "teams", "games")]


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return linkage.matched_pairs(*_sources(spark, base)).select("key_a", "key_b")


def p7_confidence(spark: SparkSession, base: str) -> DataFrame:
    pairs = linkage.matched_pairs(*_sources(spark, base))
    return pairs.select("key_a", "key_b", F.round("confidence", 4).alias("confidence"))


def p8_packed(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(load(spark, base, "documents"))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return leakage.leaked_items(load(spark, base, "documents"), load(spark, base, "eval_items"))


def p9_removed(spark: SparkSession, base: str) -> DataFrame:
    cut = leakage.remove_leaks(load(spark, base, "documents"), load(spark, base, "eval_items"))
    return cut.select("doc_id", F.length("text").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.damaged_documents(load(spark, base, "documents"))


def p10_restored(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.restored_documents(load(spark, base, "documents"))


QUERIES = {
    "p4_found": p4_found,
    "p7_found": p7_found,
    "p7_confidence": p7_confidence,
    "p8_packed": p8_packed,
    "p9_found": p9_found,
    "p9_removed": p9_removed,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}

SQL = {
    "p4_found": f"""
        WITH g AS (SELECT game_pk, venue_id, scheduled_start_ts AS s FROM (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY as_of_ts DESC, rec_id) AS rn
                   FROM games WHERE game_pk IS NOT NULL AND as_of_ts IS NOT NULL) WHERE rn = 1 AND scheduled_start_ts IS NOT NULL),
        b AS (SELECT game_pk, rec_id, unnest(bookmakers) AS k, generate_subscripts(bookmakers, 1) - 1 AS pos FROM odds_api WHERE game_pk IS NOT NULL),
        c AS (SELECT g.game_pk, 'weather' AS partner, h.rec_id, h.pos, h.at_ts, g.s, 45 AS minutes FROM g JOIN {HOURS_SQL} h ON h.venue_id = g.venue_id
              AND h.at_ts BETWEEN g.s - INTERVAL 45 MINUTE AND g.s + INTERVAL 45 MINUTE
              UNION ALL SELECT g.game_pk, b.k.key, b.rec_id, b.pos, TRY_CAST(b.k.last_update AS TIMESTAMPTZ), g.s, 20 FROM g JOIN b USING (game_pk) WHERE b.k.key IS NOT NULL
              AND TRY_CAST(b.k.last_update AS TIMESTAMPTZ) BETWEEN g.s - INTERVAL 20 MINUTE AND g.s + INTERVAL 20 MINUTE)
        SELECT game_pk, partner, rec_id, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY game_pk, partner
            ORDER BY abs(epoch_us(at_ts) - epoch_us(s)), at_ts, rec_id, pos) AS rn FROM c WHERE at_ts IS NOT NULL) WHERE rn = 1
    """,
}
