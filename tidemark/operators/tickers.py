"""Tickers that hold a date, a clock and two team codes, joined to the games of a schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.market import circular_minutes

#: The form of a ticker, month names, the clocks it may be in, and how far a start may lie from it.
FORM = r"^([A-Z0-9]+)-(\d{2})([A-Z]{3})(\d{2})(\d{4})?([A-Z]{4,})(?:-(.*))?$"
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
OFFSETS = (0, 240, 300)
MOST_RESIDUAL, TOLERANCE = 60.0, 180


def normal_name(c: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def code_table(teams: DataFrame) -> DataFrame:
    """code, team: the codes that stand for one team only."""
    per = teams.where("abbreviation is not null").groupBy(F.upper("abbreviation").alias("code")).agg(F.count_distinct("team_id").alias("n"), F.min("team_id").alias("team"))
    return per.where("n = 1").drop("n")


def codes_for(teams: DataFrame) -> DataFrame:
    """team, codes: all codes of each team, sorted."""
    return code_table(teams).groupBy("team").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def parse(tickers: DataFrame, codes: DataFrame) -> DataFrame:
    """ticker, series, day, minute, left, right, side, status, unmapped.

    A blob of codes must part in exactly one way into two known ones: else the
    status is ``ambiguous`` (several), ``unmapped`` (none; ``unmapped`` lists the
    unknown halves, or the blob), or ``unparsed`` (no ticker of a game).
    ``codes`` is the fixed code table; it joins every ticker as one map.
    """
    table = codes.agg(F.map_from_entries(F.collect_list(F.struct("code", "team"))).alias("_codes")).withColumn("_one", F.lit(1))
    text = F.upper(F.trim("ticker"))
    part = lambda k: F.nullif(F.regexp_extract(text, FORM, k), F.lit(""))
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(3)), F.lit(0))
    day = F.expr("try_cast(concat(_y, '-', lpad(_m, 2, '0'), '-', _d) as date)")
    got = tickers.select("*", part(1).alias("series"), (part(2).cast("int") + 2000).cast("string").alias("_y"), month.cast("string").alias("_m"), part(4).alias("_d"), part(5).alias("_t"), part(6).alias("_blob"), part(7).alias("side"), F.lit(1).alias("_one"))
    got = got.join(F.broadcast(table), "_one", "left").withColumn("day", day)  # one row
    known = lambda c: F.coalesce(F.map_contains_key(F.coalesce("_codes", F.create_map().cast("map<string,int>")), c), F.lit(False))
    cuts = F.when(F.length("_blob") >= 4, F.transform(F.sequence(F.lit(2), F.length("_blob") - 2), lambda k: F.struct(F.substr("_blob", F.lit(1), k).alias("a"), F.substr("_blob", k + 1).alias("b"))))
    got = got.withColumn("_cuts", F.coalesce(cuts, F.array().cast("array<struct<a:string,b:string>>")))
    both = F.filter("_cuts", lambda c: known(c["a"]) & known(c["b"]))
    halves = F.flatten(F.transform("_cuts", lambda c: F.when(known(c["a"]) & ~known(c["b"]), F.array(c["b"])).when(known(c["b"]) & ~known(c["a"]), F.array(c["a"])).otherwise(F.array().cast("array<string>"))))
    got = got.withColumns({"_both": both, "_halves": F.array_sort(F.array_distinct(halves))})
    status = F.when(F.col("_blob").isNull() | F.col("day").isNull(), "unparsed").when(F.size("_both") == 1, "parsed").when(F.size("_both") > 1, "ambiguous").otherwise("unmapped")
    got = got.withColumn("status", status)
    pick = lambda k: F.when(F.col("status") == "parsed", F.try_element_at("_codes", F.col("_both")[0][k]))
    minute = F.substr("_t", F.lit(1), F.lit(2)).cast("int") * 60 + F.substr("_t", F.lit(3), F.lit(2)).cast("int")
    missing = F.when(F.col("status") == "unmapped", F.when(F.size("_halves") > 0, F.col("_halves")).otherwise(F.array("_blob")))
    return got.select(*tickers.columns, "series", "day", minute.alias("minute"), pick("a").alias("left"), pick("b").alias("right"), "side", "status", missing.alias("unmapped"))


def clock_offset(samples: DataFrame) -> DataFrame:
    """One row, offset: the clock that fits the samples (utc_minute, ticker_minute) best; null without samples or a good fit.

    The first of equally good clocks wins.
    """
    costs = [F.sum(circular_minutes(F.pmod(F.col("utc_minute") - o, F.lit(1440)), F.col("ticker_minute"))).alias(f"c{i}") for i, o in enumerate(OFFSETS)]
    one = samples.agg(F.count(F.lit(1)).alias("n"), *costs)
    rank = F.array_min(F.array(*[F.struct(F.col(f"c{i}").alias("cost"), F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(OFFSETS)]))
    best = one.select("n", rank.alias("b"))
    return best.select(F.when((F.col("n") > 0) & (F.col("b.cost") / F.col("n") <= MOST_RESIDUAL), F.col("b.o")).alias("offset"))


def join_games(parsed: DataFrame, games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(game_pk, ticker, status of every game; the clock offset).

    games: game_pk, home, away, start, day.  A ticker with one game of its two
    teams within a day of its date is matched and teaches the clock, as do games
    that start at one time of day; then contested tickers go to the game nearest
    to their start, unless two are equally near or none within TOLERANCE.
    matched, ambiguous, unlisted (a matchup with fewer tickers than games) and
    unmatched part the games.
    """
    pair = lambda a, b: F.concat_ws("-", F.least(a, b), F.greatest(a, b))
    g = games.select("game_pk", pair("home", "away").alias("pair"), "start", "day", (F.unix_seconds("start") / 60).cast("bigint").alias("at"))
    near = g.withColumn("on", F.explode(F.array(*[F.date_add(F.to_date("start"), d) for d in (-1, 0, 1)])))
    p = parsed.where("status = 'parsed'").select("ticker", pair("left", "right").alias("pair"), F.col("day").alias("on"), "minute").distinct()
    cand = p.join(near, ["pair", "on"])
    per = cand.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min(F.pmod("at", F.lit(1440))).alias("lo"), F.max(F.pmod("at", F.lit(1440))).alias("hi"), F.min("at").alias("first"))
    cand = cand.join(per, "ticker")
    samples = cand.where("minute is not null and at = first and (n = 1 or hi - lo <= 2)").select(F.pmod("at", F.lit(1440)).alias("utc_minute"), F.col("minute").alias("ticker_minute"))
    offset = clock_offset(samples)
    stated = cand.where("n > 1").withColumn("_one", F.lit(1)).join(F.broadcast(offset.withColumn("_one", F.lit(1))), "_one")
    far = F.abs(F.col("at") - (F.unix_date("on") * 1440 + F.col("minute") + F.col("offset")))
    ranked = stated.withColumn("d", far).groupBy("ticker").agg(F.min(F.struct("d", "game_pk")).alias("b"), F.array_sort(F.collect_list("d")).alias("ds"), F.collect_list("game_pk").alias("all"))
    sure = F.coalesce((F.col("b.d") <= TOLERANCE) & (F.get("ds", F.lit(0)) != F.coalesce(F.get("ds", F.lit(1)), F.lit(-1))), F.lit(False))
    judged = ranked.withColumn("sure", sure)
    hit = cand.where("n = 1").select("game_pk", "ticker").unionByName(judged.where("sure").select(F.col("b.game_pk").alias("game_pk"), "ticker"))
    matched = hit.groupBy("game_pk").agg(F.min("ticker").alias("ticker"))
    doubt = judged.where("not sure").select(F.explode("all").alias("game_pk")).distinct().withColumn("doubt", F.lit(True))
    all_ = g.join(matched, "game_pk", "left").join(doubt, "game_pk", "left")
    groups = all_.groupBy("pair", "day").agg(F.count(F.lit(1)).alias("size"), F.count("ticker").alias("listed"))
    both = all_.join(groups, ["pair", "day"])
    status = F.when(F.col("ticker").isNotNull(), "matched").when(F.col("doubt"), "ambiguous").when((F.col("size") > 1) & (F.col("listed") < F.col("size")), "unlisted").otherwise("unmatched")
    return both.select("game_pk", "ticker", status.alias("status")), offset


#: What a title says, the first that fits.
TITLES = (
    ("total", r"(?i)\btotal\b|over/under|\bruns\b.*(?P<line>\d+\.5)"), ("spread", r"(?i)by (?:more than )?\d+"), ("beat", r"(?i)^will (.+?) beat (.+?)\s*\??$"),
    ("win", r"(?i)^will (.+?) win\s*\??$"), ("winner", r"(?i)^(.+?) (?:vs\.?|v|at|@) (.+?)(?: winner)?\s*\??(?: - .+)?$"),
)


def classify_title(title: Column) -> tuple[Column, Column]:
    """(kind, team text) of the first form that fits; null if none does."""
    kind, team = F.when(title.isNull(), None), F.when(title.isNull(), None)
    for name, form in TITLES:
        java = form.replace("(?P<", "(?<")
        kind = kind.when(title.rlike(java), name)
        team = team.when(title.rlike(java), F.regexp_extract(title, java, 1) if name in ("beat", "win", "winner") else F.lit(None).cast("string"))
    return kind, team


def team_in_window(asks: DataFrame, games: DataFrame, hours: int = 12) -> DataFrame:
    """asks (id, team, close) with game_pk and side where exactly one game of the team, on either side, starts within ``hours`` before the close.

    Games stand once per side; days keep a team with many games from forming one group.
    """
    sides = games.select("game_pk", "start", F.inline(F.array(F.struct(F.col("home").alias("team"), F.lit("home").alias("side")), F.struct(F.col("away").alias("team"), F.lit("away").alias("side")))))
    days = F.transform(F.sequence(F.lit(0), F.lit(-(-hours // 24))), lambda k: F.date_sub(F.to_date("close"), k))
    found = asks.withColumn("_day", F.explode(days)).join(sides.withColumn("_day", F.to_date("start")), ["team", "_day"])
    inside = found.where((F.col("start") <= F.col("close")) & (F.col("start") >= F.col("close") - F.make_dt_interval(hours=F.lit(hours))))
    one = inside.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("game_pk", "side")).alias("g"))
    return asks.join(one.where("n = 1").select("id", "g.game_pk", "g.side"), "id", "left")
