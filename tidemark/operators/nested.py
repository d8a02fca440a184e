"""Problem 5: nested records into flat child tables with parent links.

Structural-variant tables: a bottom-up tree automaton gives every node a state
from its label and its children's states, so the state of an object names its
shape and a record's root state the shape of the whole.  Each child object is
routed by its state to the typed subtype table of its shape; the routed rows
are written once, one partition per subtype, and every subtype table is read
with its own columns.  All subtype tables keep the keys of the supertype table
(src, rec_id, pos, item), the parent's own key and the record's variant.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import shared_dir


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


# -- lists inside strings ------------------------------------------------------


def list_state(text: Column) -> Column:
    """Leaf state of a text that should hold a list.

    absent (null or blank), empty, list (JSON), quoted (a JSON string that holds
    a list), loose (anything else, split at commas).
    """
    t = F.trim(text)
    return (
        F.when(t.isNull() | (t == "") | (F.lower(t) == "null"), "absent")
        .when(t.rlike(r'^"?\s*\[\s*\]\s*"?$'), "empty")
        .when(t.startswith('"'), "quoted")
        .when(t.startswith("["), "list")
        .otherwise("loose")
    )


def _strict_list(t: Column) -> Column:
    # the reader takes single quotes as well as double ones; bare numbers keep their spelling
    return F.when(~t.rlike("[\"']"), _loose_list(t)).otherwise(F.from_json(t, "array<string>", {"allowSingleQuotes": "true"}))


def _loose_list(t: Column) -> Column:
    bare = F.regexp_replace(F.trim(t), r"^\[|\]$", "")
    return F.transform(F.split(bare, ","), lambda x: F.regexp_replace(F.trim(x), r"""^['"]|['"]$""", ""))


def list_items(text: Column) -> Column:
    """The elements as texts; null if absent, [] if empty, null elements kept."""

    def parse(t: Column) -> Column:
        s = list_state(t)
        inner = F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v")
        unquoted = F.when(list_state(inner) == "list", F.coalesce(_strict_list(inner), _loose_list(inner))).otherwise(_loose_list(inner))
        return (
            F.when(s == "absent", F.lit(None).cast("array<string>"))
            .when(s == "empty", F.array().cast("array<string>"))
            .when(s == "list", F.coalesce(_strict_list(t), _loose_list(t)))
            .when(s == "quoted", F.coalesce(unquoted, _loose_list(t)))
            .otherwise(_loose_list(t))
        )

    return let(F.trim(text), parse)


# -- the automaton ---------------------------------------------------------------


def node(label: str, *children: Column) -> Column:
    """Automaton transition: the state of an inner node."""
    return F.concat(F.lit(label + "("), F.concat_ws(",", *children), F.lit(")"))


def state_of(value: Column, present: str = "value") -> Column:
    return F.when(value.isNull(), "absent").otherwise(present)


def text_state(text: Column) -> Column:
    """Leaf state of a text that may hold a number."""
    return F.when(text.isNull() | (text == ""), "absent").when(text.try_cast("double").isNotNull(), "number").otherwise("text")


def array_state(values: Column, each) -> Column:
    """Absent, empty, or the set of the elements' states: order and length don't make a variant."""
    return (
        F.when(values.isNull(), "absent")
        .when(F.size(values) == 0, "empty")
        .otherwise(F.concat(F.lit("["), F.array_join(F.array_sort(F.array_distinct(F.transform(values, each))), "|"), F.lit("]")))
    )


def _known(x: Column, state: Column) -> Column:
    return F.when(x.isNull(), "absent").otherwise(state)


def _states(values: Column) -> Column:
    return array_state(values, lambda v: F.coalesce(v["state"], F.lit("absent")))


def odds_variants(odds: DataFrame) -> DataFrame:
    """rec_id, event_id, books with the state of every node beside it, and the root state in ``variant``."""
    outcome = lambda o: F.when(o.isNotNull(), F.struct(o["name"].alias("name"), o["price"].alias("price"), o["point"].alias("point"), node("outcome", state_of(o["price"]), state_of(o["point"])).alias("state")))
    market = lambda m: let(
        F.struct(m["key"].alias("key"), F.transform(m["outcomes"], outcome).alias("outcomes")),
        lambda x: F.struct(x["key"].alias("key"), x["outcomes"].alias("outcomes"), _known(m, node("market", state_of(x["key"]), _states(x["outcomes"]))).alias("state")),
    )
    book = lambda b: let(
        F.struct(b["key"].alias("key"), F.transform(b["markets"], market).alias("markets")),
        lambda x: F.struct(x["key"].alias("key"), x["markets"].alias("markets"), _known(b, node("book", state_of(b["last_update"]), _states(x["markets"]))).alias("state")),
    )
    read = odds.select("rec_id", F.col("id").alias("event_id"), F.transform("bookmakers", book).alias("books"))
    return read.withColumn("variant", node("event", _states(F.col("books"))))


def market_variants(events: DataFrame) -> DataFrame:
    """rec_id, event_id, markets with their lists read and their state beside them, and the root state in ``variant``."""
    market = lambda m: F.struct(
        m["conditionId"].alias("condition_id"), list_items(m["outcomes"]).alias("labels"), list_items(m["outcomePrices"]).alias("prices"),
        list_items(m["clobTokenIds"]).alias("tokens"), _known(m, node("market", list_state(m["outcomes"]), list_state(m["outcomePrices"]), list_state(m["clobTokenIds"]))).alias("state"),
    )
    read = events.select("rec_id", F.col("id").alias("event_id"), F.transform("markets", market).alias("held"))
    return read.withColumn("variant", node("event", _states(F.col("held"))))


#: Only what the child tables need; ids and runs are read as text, number or string alike.
FEED_SCHEMA = (
    "gamePk string, gameData struct<game: struct<pk: string>>, liveData struct<"
    "boxscore: struct<teams: struct<home: struct<battingOrder: array<string>>, away: struct<battingOrder: array<string>>>>, "
    "linescore: struct<innings: array<struct<num: string, home: struct<runs: string>, away: struct<runs: string>>>>>"
)


def feed_variants(feed: DataFrame) -> DataFrame:
    """rec_id, pk, the parsed document and its root state.

    Payloads that are no JSON object have no pk and no members, so no children.
    """
    doc = F.from_json("payload", FEED_SCHEMA)
    read = feed.select("rec_id", doc.alias("doc"))
    side = lambda s: array_state(F.col(f"doc.liveData.boxscore.teams.{s}.battingOrder"), text_state)
    innings = array_state(
        F.col("doc.liveData.linescore.innings"), lambda i: node("inning", text_state(i["home"]["runs"]), text_state(i["away"]["runs"]))
    )
    where_pk = F.when(F.col("doc.gameData.game.pk").isNotNull(), "inner").when(F.col("doc.gamePk").isNotNull(), "outer").otherwise("none")
    return read.select(
        "rec_id", F.coalesce("doc.gameData.game.pk", "doc.gamePk").alias("pk"), "doc",
        node("feed", where_pk, side("home"), side("away"), innings).alias("variant"),
    )


# -- children ------------------------------------------------------------------------

#: Keys of the supertype table, the link to the parent object, and the shapes.
KEYS = ("src", "rec_id", "pos", "item")
LINKS = ("parent", "variant", "state")


def _child(src: str, pos: Column, item: Column, parent: Column) -> list[Column]:
    return [F.lit(src).alias("src"), F.col("rec_id"), pos.alias("pos"), item.alias("item"), parent.cast("string").alias("parent"), F.xxhash64("variant").alias("variant"), F.col("state")]


def odds_children(odds: DataFrame) -> DataFrame:
    """One row per outcome with its parents' keys and positions, its state and its record's variant.

    Null or empty arrays and null members give no row; a null market key or
    outcome name reads as an empty text in ``item``.
    """
    return (
        odds_variants(odds)
        .select("rec_id", "event_id", "variant", F.posexplode("books").alias("b", "book"))
        .select("rec_id", "event_id", "variant", "b", F.col("book.key").alias("book_key"), F.posexplode("book.markets").alias("m", "market"))
        .select("rec_id", "event_id", "variant", "b", "book_key", "m", F.col("market.key").alias("market_key"), F.posexplode("market.outcomes").alias("o", "outcome"))
        .where("outcome is not null")
        .select("*", F.col("outcome.state").alias("state"))
        .select(
            *_child(
                "odds_api", F.concat_ws(".", "b", "m", "o"), F.concat(F.coalesce("market_key", F.lit("")), F.lit("|"), F.coalesce("outcome.name", F.lit(""))),
                F.concat_ws(".", F.coalesce("event_id", F.lit("")), "b", "m"),
            ),
            "event_id", "book_key", "market_key", F.col("outcome.name").alias("outcome"), F.col("outcome.price").alias("price"), F.col("outcome.point").alias("point"),
        )
    )


def market_children(events: DataFrame) -> DataFrame:
    """One row per label of ``outcomes`` with the price and token at its position, its state and its record's variant.

    Absent or empty label lists give no row; a shorter price list leaves the
    price empty; a null label reads as an empty text.
    """
    lists = market_variants(events).select("rec_id", "event_id", "variant", F.posexplode("held").alias("m", "h")).select("rec_id", "event_id", "variant", "m", "h.condition_id", "h.labels", "h.prices", "h.tokens")
    rows = lists.select("*", F.posexplode("labels").alias("k", "label"))
    rows = rows.withColumns({"price_text": F.get("prices", F.col("k")), "token": F.get("tokens", F.col("k"))})
    rows = rows.withColumn("state", node("label", state_of(F.col("label")), text_state(F.col("price_text")), state_of(F.col("token"))))
    return rows.select(
        *_child(
            "polymarket_events", F.concat_ws(".", "m", "k"), F.concat(F.coalesce("label", F.lit("")), F.lit("|"), F.coalesce("price_text", F.lit(""))),
            F.concat_ws(".", F.coalesce("event_id", F.lit("")), "m"),
        ),
        "event_id", "condition_id", "label", F.col("price_text").try_cast("double").alias("price"), "price_text", "token",
    )


def feed_children(feed: DataFrame) -> DataFrame:
    """Batting-order entries and innings sides with runs, linked by the game's pk, with their state and their record's variant.

    Absent, empty or null lists and sides without runs give no row.
    """
    read = feed_variants(feed)
    teams = "doc.liveData.boxscore.teams"
    cell = lambda label, pos, num, side, value: F.struct(F.lit(label).alias("label"), pos.alias("pos"), num.cast("string").alias("num"), F.lit(side).alias("side"), value.alias("value"))
    none = F.array().cast("array<struct<label:string,pos:string,num:string,side:string,value:string>>")

    def batters(side: str) -> Column:
        return F.transform(F.col(f"{teams}.{side}.battingOrder"), lambda x, i: cell("batter", F.concat(F.lit(f"{side}."), i.cast("string")), i + 1, side, x))

    def runs(side: str) -> Column:
        return F.transform("doc.liveData.linescore.innings", lambda i: cell("runs", F.concat_ws(".", F.lit("inning"), i["num"], F.lit(side)), i["num"], side, i[side]["runs"]))

    parts = [batters("home"), batters("away"), runs("home"), runs("away")]
    rows = read.select("rec_id", "pk", "variant", F.inline(F.flatten(F.array(*[F.coalesce(p, none) for p in parts])))).where("value is not null")
    rows = rows.withColumn("state", F.concat(F.col("label"), F.lit("("), text_state(F.col("value")), F.lit(")")))
    return rows.select(
        *_child("mlb_game_feed", F.col("pos"), F.concat(F.coalesce("pk", F.lit("")), F.lit("|"), "value"), F.col("pk")),
        F.col("pk").try_cast("bigint").alias("game_pk"), F.col("num").try_cast("int").alias("num"), "side", F.col("value").try_cast("bigint").alias("number"), "value",
    )


# -- subtype tables --------------------------------------------------------------------

#: src -> subtype -> (states that are routed to it, its typed columns).
SUBTYPES: dict[str, dict[str, tuple[tuple[str, ...], tuple[str, ...]]]] = {
    "odds_api": {
        "line": (("outcome(value,value)",), ("event_id", "book_key", "market_key", "outcome", "price", "point")),
        "price": (("outcome(value,absent)",), ("event_id", "book_key", "market_key", "outcome", "price")),
        "unpriced": (("outcome(absent,absent)", "outcome(absent,value)"), ("event_id", "book_key", "market_key", "outcome", "point")),
    },
    "polymarket_events": {
        "priced": (("label(value,number,value)", "label(value,number,absent)", "label(absent,number,value)", "label(absent,number,absent)"), ("event_id", "condition_id", "label", "price", "token")),
        "unpriced": (("label(value,absent,value)", "label(value,absent,absent)", "label(absent,absent,value)", "label(absent,absent,absent)"), ("event_id", "condition_id", "label", "token")),
        "worded": (("label(value,text,value)", "label(value,text,absent)", "label(absent,text,value)", "label(absent,text,absent)"), ("event_id", "condition_id", "label", "price_text", "token")),
    },
    "mlb_game_feed": {
        "batter": (("batter(number)",), ("game_pk", "side", "num", "number")),
        "runs": (("runs(number)",), ("game_pk", "side", "num", "number")),
        "other": (("batter(text)", "batter(absent)", "runs(text)", "runs(absent)"), ("game_pk", "side", "num", "value")),
    },
}


def routed(src: str, children: DataFrame) -> DataFrame:
    """``children`` with the subtype its state is routed to; a state without a table of its own raises, so no row is lost."""
    state = F.col("state")
    subtype = reduce(lambda out, kv: out.when(state.isin(*kv[1][0]), kv[0]), SUBTYPES[src].items(), F.when(F.lit(False), ""))
    return children.withColumn("subtype", F.coalesce(subtype, F.raise_error(F.concat(F.lit("no subtype table for state "), state)).cast("string")))


def _columns(src: str, subtype: str) -> Sequence[str]:
    return [*KEYS, *LINKS, *SUBTYPES[src][subtype][1]]


def subtype_tables(src: str, children: DataFrame) -> dict[str, DataFrame]:
    """subtype -> its typed table.  The routed rows are written once to the shared folder, a partition per subtype."""
    path = shared_dir(children.sparkSession, f"variants-{src}")
    rows = routed(src, children)
    rows.write.partitionBy("subtype").parquet(path)
    held = children.sparkSession.read.schema(rows.schema).parquet(path)
    return {t: held.where(F.col("subtype") == t).select(*_columns(src, t)) for t in SUBTYPES[src]}


def subtype_table(src: str, children: DataFrame, subtype: str) -> DataFrame:
    """One typed subtype table, where the others aren't needed."""
    return routed(src, children).where(F.col("subtype") == subtype).select(*_columns(src, subtype))


CHILDREN = {"odds_api": odds_children, "polymarket_events": market_children, "mlb_game_feed": feed_children}


def child_rows(odds: DataFrame, events: DataFrame, feed: DataFrame) -> DataFrame:
    """The supertype table, src, rec_id, pos, item: the union of the keys of all subtype tables of the three sources."""
    frames = {"odds_api": odds, "polymarket_events": events, "mlb_game_feed": feed}
    tables = [t.select(*KEYS) for src, df in frames.items() for t in subtype_tables(src, CHILDREN[src](df)).values()]
    return reduce(DataFrame.unionByName, tables)


def variant_counts(odds: DataFrame, events: DataFrame, feed: DataFrame) -> DataFrame:
    """src, variant, n: how many records have each root state."""
    views = [("odds_api", odds_variants(odds)), ("polymarket_events", market_variants(events)), ("mlb_game_feed", feed_variants(feed))]
    rows = [v.select(F.lit(s).alias("src"), "variant") for s, v in views]
    return reduce(DataFrame.unionByName, rows).groupBy("src", "variant").agg(F.count(F.lit(1)).alias("n"))
