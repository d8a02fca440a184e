"""Typed tables from recorded payloads: schedules, game feeds, text archives, alias lists."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Codes of a game that is over.
FINAL_CODES = ("F", "FR", "FT", "O", "DI", "CR", "DC")
#: Texts that mean null in delimited files.
NULL_TEXTS = ("", "null", "NULL", "NA", "nan")


# -- delimited text ---------------------------------------------------------------


def read_delimited(spark: SparkSession, path: str, schema: StructType, required: Sequence[str]) -> DataFrame:
    """A delimited file with header, cast to ``schema``.

    Columns are found by name; several texts mean null; values that don't cast
    are null; short and long lines are kept; rows without a required value are
    dropped; columns the file lacks are null.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    held = {c.strip(): c for c in raw.columns}

    def one(f):
        if f.name not in held:
            return F.lit(None).cast(f.dataType).alias(f.name)
        text = F.trim(F.col(f"`{held[f.name]}`"))
        text = F.when(~text.isin(*NULL_TEXTS), text)
        whole = f.dataType.typeName() in ("integer", "long")
        # "3.0" is the integer 3
        return (text.try_cast("double").try_cast(f.dataType) if whole else text.try_cast(f.dataType)).alias(f.name)

    return raw.select(*[one(f) for f in schema]).dropna(subset=list(required))


# -- archives of text files -----------------------------------------------------------


def read_zipped_lines(spark: SparkSession, path: str, suffixes: Sequence[str] = (".EVA", ".EVN", ".EVE")) -> DataFrame:
    """file, member, ord, record, fields: the lines of text members of ZIP files, in order.

    Members of other names give no line; text is Latin-1.  An unreadable
    archive gives one line of record ``unreadable``, to be counted.
    """
    blobs = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, blob in zip(pdf["path"], pdf["content"]):
                try:
                    box = zipfile.ZipFile(io.BytesIO(blob))
                except zipfile.BadZipFile:
                    yield pd.DataFrame({"file": [name], "member": [None], "ord": [0], "line": ["unreadable"]})
                    continue
                for member in sorted(box.namelist()):
                    if member.upper().endswith(tuple(suffixes)):
                        lines = [x for x in box.read(member).decode("latin-1").splitlines() if x.strip()]
                        yield pd.DataFrame({"file": name, "member": member, "ord": range(len(lines)), "line": lines})

    lines = blobs.mapInPandas(run, "file string, member string, ord bigint, line string")
    fields = F.split("line", ",")
    return lines.select("file", "member", "ord", fields[0].alias("record"), F.slice(fields, 2, F.greatest(F.size(fields), F.lit(1))).alias("fields"))


def carry_headers(lines: DataFrame) -> DataFrame:
    """``lines`` with game_id, and season, home and away as told by the records before them."""
    span = Window.partitionBy("file", "member").orderBy("ord")
    is_id = F.when(F.col("record") == "id", F.element_at("fields", 1))
    game = lines.withColumn("game_id", F.last(is_id, ignorenulls=True).over(span)).where("game_id is not null")
    within = Window.partitionBy("file", "member", "game_id").orderBy("ord")
    info = lambda k: F.last(F.when((F.col("record") == "info") & (F.try_element_at("fields", F.lit(1)) == k), F.try_element_at("fields", F.lit(2))), ignorenulls=True).over(within)
    return game.withColumns({"home": info("hometeam"), "away": info("visteam"), "date": info("date")})


# -- records under changing names ---------------------------------------------------------


def pick_alias(record: Column, names: Sequence[str]) -> Column:
    """First non-empty value of a text map under any of the names."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(record, F.lit(n))), F.lit("")) for n in names])


def read_aliased(payloads: DataFrame, wrappers: Sequence[str], columns: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Rows of a JSON list, bare or under a wrapper name, as typed columns plus ``extras``.

    ``columns``: name -> (aliases, type); percent signs are stripped before a
    cast.  ``extras`` keeps the whole record as JSON.  Unreadable payloads give
    no row.
    """
    text = F.trim(F.col("payload"))
    inner = F.when(text.startswith("["), text).otherwise(F.coalesce(*[F.get_json_object(text, f"$.{w}") for w in wrappers]))
    rows = payloads.select("*", F.explode(F.from_json(inner, "array<map<string,string>>")).alias("_r"))
    typed = [
        (pick_alias(F.col("_r"), names) if kind == "string" else F.regexp_replace(pick_alias(F.col("_r"), names), "%$", "").try_cast(kind)).alias(c)
        for c, (names, kind) in columns.items()
    ]
    return rows.select(*[c for c in payloads.columns if c != "payload"], *typed, F.to_json("_r").alias("extras"))


# -- schedules ----------------------------------------------------------------------------


def schedule_rows(schedule: DataFrame) -> DataFrame:
    """rec_id, as_of_ts and one row per game of a schedule payload; games without pk or date are skipped."""
    games = schedule.select("rec_id", "as_of_ts", F.explode("dates").alias("day")).select("rec_id", "as_of_ts", F.explode("day.games").alias("g"))
    return games.where("g.gamePk is not null and g.gameDate is not null").select(
        "rec_id", "as_of_ts", F.col("g.gamePk").alias("game_pk"), F.col("g.season").try_cast("int").alias("season"), F.col("g.gameType").alias("game_type"),
        F.col("g.status.detailedState").alias("status"), F.col("g.teams.home.team.id").alias("home_team_id"), F.col("g.teams.away.team.id").alias("away_team_id"),
        F.col("g.venue.id").alias("venue_id"), F.col("g.gameNumber").alias("game_number"), F.col("g.teams").alias("teams"),
    )


def probable_pitchers(schedule: DataFrame) -> DataFrame:
    """rec_id, game_pk, side, player_id, hand, confirmed (never): one row per announced pitcher."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"teams.{s}.probablePitcher").alias("p")) for s in ("home", "away")])
    rows = schedule_rows(schedule).select("rec_id", "game_pk", F.inline(sides)).where("p.id is not null")
    return rows.select("rec_id", "game_pk", "side", F.col("p.id").alias("player_id"), F.col("p.pitchHand.code").alias("hand"), F.lit(False).alias("confirmed"))


# -- game feeds -------------------------------------------------------------------------------

_PLAYER = "struct<person: struct<fullName: string>, position: struct<abbreviation: string>, stats: struct<pitching: map<string,string>, batting: map<string,string>>>"
_SIDE = f"struct<team: struct<id: string, name: string>, battingOrder: array<string>, pitchers: array<string>, players: map<string,{_PLAYER}>>"
FULL_FEED = (
    "gamePk string, gameData struct<game: struct<pk: string, type: string, season: string>, status: struct<detailedState: string, statusCode: string>>, "
    f"liveData struct<boxscore: struct<teams: struct<home: {_SIDE}, away: {_SIDE}>, officials: array<struct<official: struct<id: string, fullName: string>, officialType: string>>>, "
    "linescore: struct<teams: struct<home: struct<runs: string>, away: struct<runs: string>>, innings: array<struct<num: string, home: struct<runs: string>, away: struct<runs: string>>>>>"
)


def feed_documents(feed: DataFrame) -> DataFrame:
    """rec_id, game_pk, final, doc: one parse that all tables of a feed are selected from."""
    doc = feed.select("rec_id", F.from_json("payload", FULL_FEED).alias("doc"))
    pk = F.coalesce("doc.gameData.game.pk", "doc.gamePk").try_cast("bigint")
    final = F.coalesce(F.col("doc.gameData.status.statusCode").isin(*FINAL_CODES), F.lit(False))
    return doc.select("rec_id", pk.alias("game_pk"), final.alias("final"), "doc").where("game_pk is not null")


def _sides(docs: DataFrame) -> DataFrame:
    both = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"doc.liveData.boxscore.teams.{s}").alias("box")) for s in ("home", "away")])
    return docs.select("rec_id", "game_pk", "final", F.inline(both))


def lineups(docs: DataFrame) -> DataFrame:
    """rec_id, game_pk, side, slot (1-9), player_id, position, confirmed (nine or more named)."""
    rows = _sides(docs).select("rec_id", "game_pk", "side", "box.players", (F.size("box.battingOrder") >= 9).alias("confirmed"), F.posexplode(F.slice("box.battingOrder", 1, 9)).alias("i", "id"))
    player = F.try_element_at("players", F.concat(F.lit("ID"), "id"))
    return rows.select("rec_id", "game_pk", "side", (F.col("i") + 1).alias("slot"), F.col("id").try_cast("bigint").alias("player_id"), player["position"]["abbreviation"].alias("position"), "confirmed")


def starters(docs: DataFrame) -> DataFrame:
    """rec_id, game_pk, side, player_id: the first pitcher of each side."""
    first = F.try_element_at("box.pitchers", F.lit(1)).try_cast("bigint")
    return _sides(docs).select("rec_id", "game_pk", "side", first.alias("player_id")).where("player_id is not null")


def officials(docs: DataFrame) -> DataFrame:
    rows = docs.select("rec_id", "game_pk", F.explode("doc.liveData.boxscore.officials").alias("o"))
    return rows.select("rec_id", "game_pk", F.col("o.officialType").alias("role"), F.col("o.official.id").try_cast("bigint").alias("umpire_id"))


def box_lines(docs: DataFrame, kind: str) -> DataFrame:
    """rec_id, game_pk, side, player_id, slot, stats of final games: one row per player with such stats (batting or pitching)."""
    rows = _sides(docs).where("final").select("rec_id", "game_pk", "side", "box.battingOrder", F.explode("box.players").alias("pid", "p"))
    id_ = F.regexp_extract("pid", r"(\d+)$", 1)
    slot = F.nullif(F.array_position(F.coalesce("battingOrder", F.array().cast("array<string>")), id_), F.lit(0))
    stats = F.col(f"p.stats.{kind}")
    return rows.where(F.size(F.coalesce(stats, F.create_map().cast("map<string,string>"))) > 0).select(
        "rec_id", "game_pk", "side", id_.try_cast("bigint").alias("player_id"), slot.cast("int").alias("slot"), stats.alias("stats")
    )


def results(docs: DataFrame) -> DataFrame:
    """rec_id, game_pk, home and away runs, runs of the first five innings, innings, extras, home_half_9_played of final games with innings.

    The first-five sums are null unless a fifth inning is there; runs missing
    from the line score are summed from its innings.
    """
    inn = F.coalesce(F.col("doc.liveData.linescore.innings"), F.array().cast("array<struct<num:string,home:struct<runs:string>,away:struct<runs:string>>>"))
    num = lambda i: i["num"].try_cast("int")
    runs = lambda xs, s: F.aggregate(xs, F.lit(0), lambda a, i: a + F.coalesce(i[s]["runs"].try_cast("int"), F.lit(0)))
    five = lambda s: F.when(F.exists(inn, lambda i: num(i) == 5), runs(F.filter(inn, lambda i: num(i) <= 5), s))
    total = lambda s: F.coalesce(F.col(f"doc.liveData.linescore.teams.{s}.runs").try_cast("int"), F.when(F.size(inn) > 0, runs(inn, s)))
    return docs.where("final").where(F.size(inn) > 0).select(
        "rec_id", "game_pk", total("home").alias("home_runs"), total("away").alias("away_runs"), five("home").alias("home_f5"), five("away").alias("away_f5"),
        F.size(inn).alias("innings"), (F.size(inn) > 9).alias("extras"), F.coalesce(F.try_element_at(inn, F.lit(-1))["home"]["runs"].isNotNull(), F.lit(False)).alias("home_half_9_played"),
    )


# -- export and import -----------------------------------------------------------------------------


def export_tables(tables: Mapping[str, DataFrame], path: str) -> dict[str, int]:
    """Each table under ``path``; returns their row counts, read back from the files."""
    out = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    return out


def import_tables(spark: SparkSession, path: str, counts: Mapping[str, int]) -> dict[str, DataFrame]:
    """The exported tables; ValueError if one holds another number of rows than was exported."""
    out = {name: spark.read.parquet(f"{path}/{name}") for name in counts}
    if bad := [n for n, df in out.items() if df.count() != counts[n]]:
        raise ValueError(f"row counts differ: {sorted(bad)}")
    return out
