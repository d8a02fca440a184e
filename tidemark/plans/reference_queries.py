"""The registered queries of the general operators, on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import market
from tidemark.operators import loading, nested, quality, rates, registry, temporal
from tidemark.plans import contact, projector
from tidemark.sources import load
from tidemark.streaming import archive

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


CUT = "2024-01-20 00:00:00"
BY_TS = ("ts", "event_id")


# -- reads of versions -----------------------------------------------------------


@query(f"""SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) rn
FROM events WHERE ts <= TIMESTAMP '{CUT}') WHERE rn = 1""")
def asof_latest_per_key(spark: SparkSession, base: str) -> DataFrame:
    got = temporal.as_of(load(spark, base, "events"), ["user_id", "event_type"], "ts", ntz(CUT), [F.col("event_id")])
    return got.select("event_id", "user_id", "event_type")


@query("""WITH c AS (SELECT user_id, min(ts) AS cutoff FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT event_id, user_id, event_type FROM (SELECT e.*, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.ts DESC, e.event_id) rn
FROM events e JOIN c USING (user_id) WHERE e.ts < c.cutoff) WHERE rn = 1""")
def asof_strict_cutoff(spark, base):
    e = load(spark, base, "events")
    cut = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("cutoff"))
    got = temporal.before_event(e, ["user_id", "event_type"], "ts", cut, ["user_id"], "cutoff", ties=[F.col("event_id")])
    return got.select("event_id", "user_id", "event_type")


@query(f"""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) rn
FROM events WHERE ts <= TIMESTAMP '{CUT}' AND event_type = 'click') WHERE rn = 1""")
def asof_where_below_rank(spark, base):
    e = load(spark, base, "events")
    return temporal.as_of(e, ["user_id"], "ts", ntz(CUT), [F.col("event_id")], where=F.col("event_type") == "click").select("event_id", "user_id")


@query(f"""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) rn
FROM events WHERE ts <= TIMESTAMP '{CUT}') WHERE rn = 1 AND event_type = 'click'""")
def latest_then_filter(spark, base):
    got = temporal.as_of(load(spark, base, "events"), ["user_id"], "ts", ntz(CUT), [F.col("event_id")])
    return got.where("event_type = 'click'").select("event_id", "user_id")


@query(f"SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts < TIMESTAMP '{CUT}' GROUP BY user_id")
def all_versions_before(spark, base):
    got = temporal.as_of(load(spark, base, "events"), ["user_id"], "ts", ntz(CUT), inclusive=False, collapse=False)
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("""SELECT game_pk, rec_id, status FROM (SELECT *, row_number() OVER (PARTITION BY game_pk ORDER BY as_of_ts DESC, rec_id) rn
FROM games WHERE as_of_ts <= TIMESTAMPTZ '2021-07-01 00:00:00+00') WHERE rn = 1""")
def games_as_of(spark, base):
    games = load(spark, base, "games")
    spec = registry.TableSpec("games", registry.Kind.FACT, ("game_pk",), games.schema, event_at="scheduled_start_ts")
    spec.check()
    cutoff = F.to_timestamp(F.lit("2021-07-01 00:00:00+00:00"))
    return temporal.read_as_of(games, spec, cutoff, ties=[F.col("rec_id")]).select("game_pk", "rec_id", "status")


@query("""SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_custkey""")
def expanding_aggregate(spark, base):
    got = temporal.expanding_aggregate(
        load(spark, base, "orders"), "o_orderdate", ntz("1996-01-01"), ["o_custkey"], n=F.count(F.lit(1)), total=F.sum("o_totalprice")
    )
    return got.select("o_custkey", "n", F.round("total", 2).alias("total"))


@query("""WITH s AS (SELECT CAST(d AS DATE) AS snapshot FROM range(DATE '2024-01-01', DATE '2024-04-02', INTERVAL 7 DAY) t(d))
SELECT event_type, snapshot, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN s ON CAST(ts AS DATE) < snapshot GROUP BY ALL""")
def snapshots_expanding(spark, base):
    got = temporal.expanding_snapshots(
        load(spark, base, "events"), F.to_date("ts"), "2024-01-01", "2024-04-01", 7, ["event_type"], F.col("value")
    )
    return got.select("event_type", "snapshot", "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, round(sum(w * (event_type = 'purchase')::INT) / sum(w), 6) AS rate FROM (
SELECT user_id, event_type, exp(-ln(2) * greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01'), 0) / 14.0) AS w FROM events) GROUP BY user_id""")
def recency_weighted_rates(spark, base):
    w = rates.recency_weight(F.datediff(F.to_date(F.lit("2024-02-01")), F.to_date("ts")), 14.0)
    e = load(spark, base, "events").select("user_id", (F.col("event_type") == "purchase").cast("int").alias("hit"), w.alias("w"))
    return e.groupBy("user_id").agg(r6(F.sum(F.col("w") * F.col("hit")) / F.sum("w")).alias("rate"))


# -- joins ------------------------------------------------------------------------


@query("""SELECT t.l_orderkey, t.l_linenumber, c.n_lines, c.n_returned, c.n_open FROM lineitem t JOIN (
SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS n_returned, count(*) FILTER (l_linestatus = 'O') AS n_open,
max(l_linenumber) AS last_line FROM lineitem GROUP BY l_orderkey) c ON t.l_orderkey = c.l_orderkey AND t.l_linenumber = c.last_line""")
def conditional_counts_terminal(spark, base):
    lines = load(spark, base, "lineitem")
    counts = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_open"), F.max("l_linenumber").alias("l_linenumber"),
    )
    return lines.select("l_orderkey", "l_linenumber").join(counts, ["l_orderkey", "l_linenumber"])


def _taxonomy() -> Column:
    return F.create_map(*[F.lit(x) for x in ("view", "reach", "click", "act", "purchase", "act", "signup", "join")])


@query("""SELECT CASE event_type WHEN 'view' THEN 'reach' WHEN 'click' THEN 'act' WHEN 'purchase' THEN 'act' WHEN 'signup' THEN 'join' END AS bucket,
CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN event_type END AS unknown, count(*) AS n FROM events GROUP BY ALL""")
def taxonomy_map_unknowns(spark, base):
    e = load(spark, base, "events").withColumn("bucket", F.try_element_at(_taxonomy(), F.col("event_type")))
    return e.groupBy("bucket", F.when(F.col("bucket").isNull(), F.col("event_type")).alias("unknown")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH base AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal FROM customer), held AS (SELECT * FROM base WHERE c_acctbal >= 5000)
SELECT o.c_custkey, o.segment, o.c_acctbal FROM base o WHERE NOT EXISTS (SELECT 1 FROM held h
WHERE h.c_custkey IS NOT DISTINCT FROM o.c_custkey AND h.segment IS NOT DISTINCT FROM o.segment)""")
def idempotent_append(spark, base):
    """All customers offered, twice each, to a table that holds those of a large balance."""
    c = load(spark, base, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), "c_acctbal")
    held = c.where("c_acctbal >= 5000")
    twice = c.withColumn("ordinal", F.lit(2)).unionByName(c.withColumns({"c_acctbal": F.lit(0.0), "ordinal": F.lit(1)}))
    spec = registry.TableSpec("customer", registry.Kind.FACT, ("c_custkey", "segment"), held.schema, known_at=None)
    return loading.rows_to_append(twice, held, spec, "ordinal")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) rn
FROM events) WHERE rn = 1""")
def dedupe_keep_last(spark, base):
    e = load(spark, base, "events").select("user_id", "event_type", "event_id", "value")
    return loading.dedupe_keep_last(e, ["user_id", "event_type"], "event_id")


@query("""SELECT p_partkey AS s_suppkey, TRY_CAST(p_size AS VARCHAR) AS s_name, TRY_CAST(p_brand AS INTEGER) AS s_nationkey, p_retailprice AS s_acctbal,
CAST(NULL AS VARCHAR) AS note FROM part""")
def align_evolve(spark, base):
    part = load(spark, base, "part").select(
        F.col("p_partkey").alias("s_suppkey"), F.col("p_size").alias("s_name"), F.col("p_brand").alias("s_nationkey"),
        F.col("p_retailprice").alias("s_acctbal"), F.col("p_type").alias("dropped"),
    )
    supplier = registry.evolve(load(spark, base, "supplier"), spark.createDataFrame([], "note string"))
    return registry.align(part, supplier.schema)


_CLICKS = "SELECT user_id, ts AS c_ts, event_id AS click_id, value AS c_value FROM events WHERE event_type = 'click'"
_BUYS = "SELECT user_id, ts AS p_ts, event_id, value FROM events WHERE event_type = 'purchase'"


def _series(spark, base, kind: str, at: str) -> DataFrame:
    e = load(spark, base, "events").where(F.col("event_type") == kind)
    return e.select("user_id", F.col("ts").alias(at), "event_id", "value")


def _joined(spark, base, direction: str, tolerance_us: int | None) -> DataFrame:
    clicks = _series(spark, base, "click", "c_ts").withColumnsRenamed({"event_id": "click_id", "value": "c_value"})
    return temporal.asof_join(
        _series(spark, base, "purchase", "p_ts"), clicks, ["user_id"], "p_ts", "c_ts", ["click_id", "c_value"], direction, tolerance_us, [F.col("click_id")], ""
    )


@query(f"SELECT p.event_id, p.user_id, c.click_id FROM ({_BUYS}) p ASOF LEFT JOIN ({_CLICKS}) c ON p.user_id = c.user_id AND p.p_ts >= c.c_ts")
def asof_join_backward(spark, base):
    return _joined(spark, base, "backward", None).select("event_id", "user_id", "click_id")


@query(f"""SELECT p.event_id, CASE WHEN p.p_ts - c.c_ts <= INTERVAL 6 HOUR THEN c.click_id END AS click_id
FROM ({_BUYS}) p ASOF LEFT JOIN ({_CLICKS}) c ON p.user_id = c.user_id AND p.p_ts >= c.c_ts""")
def asof_join_tolerance(spark, base):
    return _joined(spark, base, "backward", 6 * 3_600_000_000).select("event_id", "click_id")


@query(f"SELECT p.event_id, c.click_id FROM ({_BUYS}) p ASOF LEFT JOIN ({_CLICKS}) c ON p.user_id = c.user_id AND p.p_ts <= c.c_ts")
def asof_join_forward(spark, base):
    return _joined(spark, base, "forward", None).select("event_id", "click_id")


_GAPS = f"""SELECT p.event_id, p.user_id, p.p_ts, p.value, c.c_value,
CASE WHEN c.click_id IS NULL OR p.p_ts - c.c_ts > INTERVAL 12 HOUR THEN 'stale' WHEN abs(p.value - c.c_value) <= 5 THEN 'below floor'
WHEN abs(p.value - c.c_value) > 80 THEN 'implausible' ELSE 'gap' END AS reason
FROM ({_BUYS}) p ASOF LEFT JOIN ({_CLICKS}) c ON p.user_id = c.user_id AND p.p_ts >= c.c_ts"""


def _gaps(spark, base) -> DataFrame:
    j = _joined(spark, base, "backward", 12 * 3_600_000_000)
    size = F.abs(F.col("value") - F.col("c_value"))
    reason = F.when(F.col("click_id").isNull(), "stale").when(size <= 5, "below floor").when(size > 80, "implausible").otherwise("gap")
    return j.withColumns({"reason": reason, "size": size})


@query(f"SELECT reason, count(*) AS n FROM ({_GAPS}) GROUP BY reason")
def gap_reason_cascade(spark, base):
    return _gaps(spark, base).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT CASE WHEN s < 10 THEN '05-10' WHEN s < 25 THEN '10-25' WHEN s < 50 THEN '25-50' ELSE '50+' END AS bucket, count(*) AS n,
round(avg(s), 6) AS mean_size, round(median(s), 6) AS median_size, count(*) FILTER (value > c_value) AS n_up
FROM (SELECT *, abs(value - c_value) AS s FROM ({_GAPS}) WHERE reason = 'gap') GROUP BY ALL""")
def convergence_summary(spark, base):
    s = F.col("size")
    bucket = F.when(s < 10, "05-10").when(s < 25, "10-25").when(s < 50, "25-50").otherwise("50+")
    return _gaps(spark, base).where("reason = 'gap'").groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(s)).alias("mean_size"), r6(F.median(s)).alias("median_size"),
        F.count_if(F.col("value") > F.col("c_value")).alias("n_up"),
    )


@query(f"""SELECT strftime(p_ts, '%Y-%m-%d') AS day, count(*) AS quotes, count(*) FILTER (reason = 'stale') AS stale, count(*) FILTER (reason = 'gap') AS gaps
FROM ({_GAPS}) GROUP BY ALL""")
def per_day_tally(spark, base):
    g = _gaps(spark, base)
    return g.groupBy(F.date_format("p_ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("quotes"), F.count_if(F.col("reason") == "stale").alias("stale"), F.count_if(F.col("reason") == "gap").alias("gaps")
    )


@query(f"SELECT event_id, round(abs(value - c_value), 6) AS size FROM ({_GAPS}) WHERE reason = 'gap' ORDER BY abs(value - c_value) DESC, event_id LIMIT 20")
def largest_gaps(spark, base):
    """Top-k report: the limit is the feature."""
    g = _gaps(spark, base).where("reason = 'gap'")
    return g.orderBy(F.desc("size"), "event_id").limit(20).select("event_id", r6(F.col("size")).alias("size"))


@query("""SELECT user_id, CAST(max(run) AS BIGINT) AS episodes FROM (SELECT user_id, sum(flag) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS flag FROM events)) GROUP BY user_id""")
def episodes_lag(spark, base):
    got = temporal.episodes(load(spark, base, "events"), ["user_id"], "ts", 45 * 60)
    return got.groupBy("user_id").agg(F.max("episode").alias("episodes"))


@query("""WITH c AS (SELECT o.o_custkey, o.o_orderkey, o.o_orderdate, p.o_orderkey AS other, p.o_orderdate AS other_date, abs(date_diff('day', o.o_orderdate, p.o_orderdate)) AS d
FROM orders o JOIN orders p ON o.o_custkey = p.o_custkey AND o.o_orderkey <> p.o_orderkey AND p.o_orderdate BETWEEN o.o_orderdate - INTERVAL 60 DAY AND o.o_orderdate + INTERVAL 60 DAY),
r AS (SELECT *, row_number() OVER w AS rn, lead(other_date) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY o_orderkey ORDER BY d, other))
SELECT o_orderkey, other, CASE WHEN abs(epoch(other_date) - epoch(nxt)) < 864000 THEN 'ambiguous' ELSE 'matched' END AS status FROM r WHERE rn = 1""")
def nearest_match_refuse(spark, base):
    o = load(spark, base, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    other = o.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("o_orderdate").alias("other_date"))
    window = F.make_dt_interval(days=F.lit(60))
    near = F.col("other_date").between(F.col("o_orderdate") - window, F.col("o_orderdate") + window)
    # a 60-day range beside the customer: blocks of 60 days keep a busy customer from forming one group
    block = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 5_184_000)
    left = o.withColumn("_b", F.explode(F.array(*[block("o_orderdate") + k for k in (-1, 0, 1)])))
    pairs = left.join(other.withColumn("_b", block("other_date")), ["o_custkey", "_b"]).where(near & (F.col("o_orderkey") != F.col("other")))
    pairs = pairs.withColumn("d", F.abs(F.datediff(F.to_date("o_orderdate"), F.to_date("other_date"))))
    got = temporal.nearest_or_refuse(pairs, ["o_orderkey"], "d", "other_date", "other", 864_000)
    return got.select("o_orderkey", "other", "status")


@query("""SELECT n_nationkey, CASE WHEN count(s_suppkey) = 1 THEN min(s_suppkey) END AS s_suppkey, count(s_suppkey) AS candidates
FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_nationkey""")
def unique_match_or_null(spark, base):
    pairs = load(spark, base, "supplier").where("s_acctbal > 5000").join(load(spark, base, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return temporal.unique_or_null(pairs, ["n_nationkey"], "s_suppkey")


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'F') GROUP BY l_orderkey""")
def orphans(spark, base):
    parents = load(spark, base, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return quality.orphans(load(spark, base, "lineitem"), parents, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s.event_id, count(e.event_id) FILTER (e.ts > s.ts + INTERVAL 15 MINUTE AND e.ts <= s.ts + INTERVAL 3 HOUR) AS n
FROM events s LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type = 'view' WHERE s.event_type = 'signup' GROUP BY s.event_id""")
def interval_overlap_count(spark, base):
    e = load(spark, base, "events")
    spans = e.where("event_type = 'signup'").select(
        "user_id", "event_id", (F.col("ts") + F.make_dt_interval(mins=F.lit(15))).alias("start"), (F.col("ts") + F.make_dt_interval(hours=F.lit(3))).alias("stop")
    )
    points = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"))
    return temporal.interval_overlap_count(points, "at", spans, "start", "stop", ["user_id"]).select("event_id", "n")


# -- checks and fingerprints --------------------------------------------------------


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def key_collision_check(spark, base):
    return quality.duplicates(load(spark, base, "orders").withColumn("day", F.to_date("o_orderdate")), ["o_custkey", "day"])


@query("SELECT game_pk, count(DISTINCT scheduled_start_ts) AS versions FROM games GROUP BY game_pk HAVING count(DISTINCT scheduled_start_ts) > 1")
def revision_count(spark, base):
    return quality.revisions(load(spark, base, "games"), ["game_pk"], "scheduled_start_ts")


@query("""WITH l AS (SELECT venue, epoch_us(time_bucket(INTERVAL 15 MINUTE, fetched_at)) AS tick_us, coalesce(key, '') || ':' || sha256(payload) AS line, key, payload FROM poll_archive WHERE error IS NULL AND payload IS NOT NULL)
SELECT venue, tick_us, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, count(DISTINCT key) AS keys, count(DISTINCT payload) AS bodies, CAST(sum(strlen(payload)) AS BIGINT) AS n_bytes FROM l GROUP BY ALL""")
def digest_fingerprint(spark, base):
    """One digest per venue and tick: what a single poll brought."""
    a = load(spark, base, "poll_archive").where("error is null and payload is not null")
    ticks = a.withColumn("tick_us", F.unix_micros(F.window("fetched_at", "15 minutes")["start"]))
    return quality.tick_fingerprint(ticks, ["venue", "tick_us"], "key", "payload")


def _counts(spark, base) -> DataFrame:
    tables = {"orders": F.unix_micros(F.col("o_orderdate").cast("timestamp")), "events": F.unix_micros(F.col("ts").cast("timestamp")), "games": F.unix_micros("as_of_ts"), "venues": F.unix_micros("as_of_ts")}
    return quality.table_counts({n: (load(spark, base, n), c) for n, c in tables.items()})


@query("""SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint, count(*) AS tables FROM (
SELECT 'orders|' || count(*) || '|' || epoch_us(max(o_orderdate)) AS line FROM orders UNION ALL
SELECT 'events|' || count(*) || '|' || epoch_us(max(ts)) FROM events UNION ALL SELECT 'games|' || count(*) || '|' || epoch_us(max(as_of_ts)) FROM games UNION ALL
SELECT 'venues|' || count(*) || '|' || epoch_us(max(as_of_ts)) FROM venues)""")
def warehouse_fingerprint(spark, base):
    return quality.counts_fingerprint(_counts(spark, base))


_STATE = """SELECT 'odds_api' AS name, count(*) AS n, max(as_of_ts) AS newest FROM odds_api WHERE {0} UNION ALL SELECT 'games', count(*), max(as_of_ts) FROM games WHERE {0} UNION ALL
SELECT 'venues', count(*), max(as_of_ts) FROM venues WHERE {0} UNION ALL SELECT 'teams', count(*), NULL FROM teams"""


@query(f"""WITH b AS (SELECT * FROM ({_STATE.format("as_of_ts < TIMESTAMPTZ '2021-06-20 00:00:00+00'")}) WHERE name <> 'odds_api'), a AS (SELECT * FROM ({_STATE.format("as_of_ts < TIMESTAMPTZ '2021-06-27 00:00:00+00'")}))
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' ELSE 'moved' END AS change FROM a FULL JOIN b ON a.name = b.name
WHERE a.name IS NULL OR b.name IS NULL OR a.n IS DISTINCT FROM b.n OR a.newest IS DISTINCT FROM b.newest""")
def warehouse_diff(spark, base):
    """What moved in a week: the tables as known on June 20 (before odds were taken in) and on June 27."""
    def state(day: str, *names: str) -> DataFrame:
        known = F.to_timestamp(F.lit(f"{day} 00:00:00+00:00"))
        tables = {n: (load(spark, base, n).where(F.col("as_of_ts") < known), F.unix_micros("as_of_ts")) for n in names}
        return quality.table_counts({**tables, "teams": (load(spark, base, "teams"), F.lit(None).cast("bigint"))})

    return quality.counts_diff(state("2021-06-20", "games", "venues"), state("2021-06-27", "odds_api", "games", "venues"))


@query("""WITH f AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM f),
r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS run FROM g)
SELECT user_id, max(run) AS longest, count(*) FILTER (run >= 2) AS alerts FROM r GROUP BY user_id""")
def frozen_runs(spark, base):
    got = temporal.identical_runs(load(spark, base, "events"), ["user_id"], "ts", ["event_id"], "event_type")
    return got.groupBy("user_id").agg(F.max("run").cast("bigint").alias("longest"), F.count_if(F.col("run") >= 2).alias("alerts"))


@query("""SELECT l_returnflag, percentile FROM (SELECT l_returnflag, l_extendedprice AS percentile, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i,
count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE i = least(CAST(floor(0.9 * n) AS BIGINT), n - 1)""")
def nearest_index_percentile(spark, base):
    return rates.nearest_index_percentile(load(spark, base, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9)


@query("""SELECT venue, endpoint, http_status, error, count(*) AS n FROM poll_archive WHERE error IS NOT NULL GROUP BY ALL""")
def error_rollup(spark, base):
    a = load(spark, base, "poll_archive").where("error is not null")
    return a.groupBy("venue", "endpoint", "http_status", "error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT key, count(*) AS n FROM poll_archive WHERE key IS NOT NULL GROUP BY key ORDER BY n DESC, key LIMIT 8")
def topk_common(spark, base):
    """Top-k report: the limit is the feature."""
    keys = load(spark, base, "poll_archive").where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return keys.orderBy(F.desc("n"), "key").limit(8)


@query("""SELECT venue, count(DISTINCT file_path) AS files, count(*) AS records, count(payload) AS payloads, CAST(sum(strlen(payload)) AS BIGINT) AS n_bytes, epoch_us(min(fetched_at)) AS first_us, epoch_us(max(fetched_at)) AS last_us
FROM poll_archive GROUP BY venue""")
def archive_stats(spark, base):
    return load(spark, base, "poll_archive").groupBy("venue").agg(
        F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("records"), F.count("payload").alias("payloads"), F.sum(F.octet_length("payload")).alias("n_bytes"),
        F.unix_micros(F.min("fetched_at")).alias("first_us"), F.unix_micros(F.max("fetched_at")).alias("last_us"),
    )


@query("""SELECT 'orders_unique' AS name, count(*) = 0 AS passed, 'error' AS severity, count(*) AS metric FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'lines_have_orders', count(*) = 0, 'error', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'games_unique_version', count(*) = 0, 'warning', count(*) FROM (SELECT game_pk, as_of_ts FROM games GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'games_have_venues', count(*) = 0, 'error', count(*) FROM games WHERE NOT EXISTS (SELECT 1 FROM venues v WHERE v.venue_id = games.venue_id)
UNION ALL SELECT 'odds_before_start', count(*) = 0, 'warning', count(*) FROM odds_api o JOIN (SELECT game_pk, arg_max(scheduled_start_ts, as_of_ts) AS s FROM games GROUP BY 1) g USING (game_pk) WHERE o.as_of_ts > g.s""")
def integrity_suite(spark, base):
    t = {n: load(spark, base, n) for n in ("orders", "lineitem", "games", "venues", "odds_api")}
    starts = t["games"].groupBy("game_pk").agg(F.max_by("scheduled_start_ts", "as_of_ts").alias("start"))
    return quality.suite([
        quality.check("orders_unique", quality.duplicates(t["orders"], ["o_orderkey"])),
        quality.check("lines_have_orders", t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        quality.check("games_unique_version", quality.duplicates(t["games"], ["game_pk", "as_of_ts"]), "warning"),
        quality.check("games_have_venues", quality.orphans(t["games"], t["venues"], ["venue_id"])),
        quality.check("odds_before_start", t["odds_api"].join(starts, "game_pk").where("as_of_ts > start"), "warning"),
    ])


# -- rates ----------------------------------------------------------------------------


@query("""WITH b AS (SELECT l_suppkey, (l_returnflag = 'R')::INT AS hit, CAST(floor(l_quantity / 10) AS BIGINT) AS x, CAST(floor(l_discount / 0.03) AS BIGINT) AS z FROM lineitem),
c AS (SELECT x, z, avg(hit) AS rate, count(*) AS cn FROM b GROUP BY 1, 2 HAVING count(*) >= 50)
SELECT l_suppkey, count(*) AS n, round(avg(hit - rate), 6) AS excess, round(avg(hit - rate) * count(*) / (count(*) + 200), 6) AS shrunk
FROM b JOIN c USING (x, z) GROUP BY l_suppkey HAVING count(*) >= 100""")
def cell_rate_over_expected(spark, base):
    b = load(spark, base, "lineitem").withColumns({"x": F.floor(F.col("l_quantity") / 10), "z": F.floor(F.col("l_discount") / 0.03)})
    got = rates.cell_rates(b, ["x", "z"], "l_suppkey", F.col("l_returnflag") == "R", 50, 100, 200)
    return got.select("l_suppkey", "n", r6(F.col("excess")).alias("excess"), r6(F.col("shrunk")).alias("shrunk"))


_OUT = ("A", "N", "R")
_BALLS = """WITH balls AS (SELECT l_suppkey AS player, CASE WHEN l_linenumber < 7 THEN l_quantity * 2 END AS speed, l_discount * 1500 - 40 AS angle, l_returnflag AS outcome FROM lineitem),
ms AS (SELECT *, CASE WHEN angle >= -90 AND angle < 0 THEN '-90..0' WHEN angle >= 0 AND angle < 10 THEN '0..10' WHEN angle >= 10 AND angle < 25 THEN '10..25' WHEN angle >= 25 AND angle < 50 THEN '25..50' WHEN angle >= 50 AND angle < 90 THEN '50..90' ELSE 'out_of_range' END AS band,
CAST(floor(speed / 2) AS BIGINT) AS sb, CAST(floor(angle / 3) AS BIGINT) AS ab FROM balls), mm AS (SELECT * FROM ms WHERE speed IS NOT NULL AND angle IS NOT NULL),
lg AS (SELECT avg((outcome = 'A')::INT) AS a, avg((outcome = 'N')::INT) AS n, avg((outcome = 'R')::INT) AS r FROM balls), rt AS (SELECT count(*) AS k, avg((outcome = 'A')::INT) AS a, avg((outcome = 'N')::INT) AS n, avg((outcome = 'R')::INT) AS r FROM mm),
bd AS (SELECT band, count(*) AS k, (count(*) FILTER (outcome = 'A') + 40 * any_value(rt.a)) / (count(*) + 40) AS a, (count(*) FILTER (outcome = 'N') + 40 * any_value(rt.n)) / (count(*) + 40) AS n, (count(*) FILTER (outcome = 'R') + 40 * any_value(rt.r)) / (count(*) + 40) AS r FROM mm, rt GROUP BY band),
cl AS (SELECT mm.band, sb, count(*) AS k, (count(*) FILTER (outcome = 'A') + 40 * any_value(bd.a)) / (count(*) + 40) AS a, (count(*) FILTER (outcome = 'N') + 40 * any_value(bd.n)) / (count(*) + 40) AS n, (count(*) FILTER (outcome = 'R') + 40 * any_value(bd.r)) / (count(*) + 40) AS r FROM mm JOIN bd USING (band) GROUP BY 1, 2) """


def _balls(spark, base) -> DataFrame:
    line = load(spark, base, "lineitem")
    return line.select(F.col("l_suppkey").alias("player"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity") * 2).alias("speed"), (F.col("l_discount") * 1500 - 40).alias("angle"), F.col("l_returnflag").alias("outcome"))


def _p(*names: str) -> list[Column]:
    return [r6(F.col("p")[i]).alias(n) for i, n in enumerate(names)]


@query(_BALLS + "SELECT 'cell' AS level, band, sb AS speed, k AS n, round(a, 6) AS pa, round(n, 6) AS pn, round(r, 6) AS pr FROM cl UNION ALL SELECT 'band', band, NULL, k, round(a, 6), round(n, 6), round(r, 6) FROM bd UNION ALL SELECT 'all', NULL, NULL, k, round(a, 6), round(n, 6), round(r, 6) FROM rt")
def contact_fit(spark, base):
    return contact.contact_table(_balls(spark, base), _OUT).select("level", "band", "speed", "n", *_p("pa", "pn", "pr"))


@query(_BALLS + """, pr AS (SELECT ms.player, CASE WHEN speed IS NULL THEN lg.a ELSE cl.a END AS a, CASE WHEN speed IS NULL THEN lg.n ELSE cl.n END AS n, CASE WHEN speed IS NULL THEN lg.r ELSE cl.r END AS r, speed IS NULL AS un FROM ms CROSS JOIN lg LEFT JOIN cl ON cl.band = ms.band AND cl.sb = ms.sb)
SELECT player, round(avg(a), 6) AS pa, round(avg(n), 6) AS pn, round(avg(r), 6) AS pr, count(*) FILTER (un) AS unmeasured FROM pr GROUP BY player""")
def contact_expected(spark, base):
    balls = _balls(spark, base)
    got = contact.predict(balls, contact.contact_table(balls, _OUT), contact.marginal_shares(balls, _OUT))
    shares = contact.expected_shares(got, ["player"], F.lit(1.0), 3)
    odd = got.groupBy("player").agg(F.count_if(F.col("source") == "marginal").alias("unmeasured"))
    return shares.join(odd, "player").select("player", *_p("pa", "pn", "pr"), "unmeasured")


@query(_BALLS + """, ct AS (SELECT sb, ab, count(*) AS k FROM mm GROUP BY 1, 2), md AS (SELECT *, (ab + 0.5) * 3 AS ang FROM ct), mb AS (SELECT *, CASE WHEN ang >= -90 AND ang < 0 THEN '-90..0' WHEN ang >= 0 AND ang < 10 THEN '0..10' WHEN ang >= 10 AND ang < 25 THEN '10..25' WHEN ang >= 25 AND ang < 50 THEN '25..50' WHEN ang >= 50 AND ang < 90 THEN '50..90' ELSE 'out_of_range' END AS band FROM md)
SELECT mb.sb AS speed_bucket, mb.ab AS angle_bucket, mb.k AS n, round(coalesce(cl.a, bd.a, rt.a), 6) AS pa, round(coalesce(cl.n, bd.n, rt.n), 6) AS pn, round(coalesce(cl.r, bd.r, rt.r), 6) AS pr FROM mb LEFT JOIN cl ON cl.band = mb.band AND cl.sb = mb.sb LEFT JOIN bd ON bd.band = mb.band CROSS JOIN rt""")
def contact_cells(spark, base):
    balls = _balls(spark, base)
    got = contact.cell_rows(balls, contact.contact_table(balls, _OUT), contact.marginal_shares(balls, _OUT))
    return got.select("speed_bucket", "angle_bucket", "n", *_p("pa", "pn", "pr"))


@query("""SELECT b.bucket, round(coalesce(count(l_returnflag) FILTER (l_returnflag = b.bucket) / nullif(count(*), 0), 0.25), 6) AS share
FROM lineitem, (VALUES ('A'), ('N'), ('R'), ('X')) b(bucket) GROUP BY b.bucket""")
def marginal(spark, base):
    buckets = ("A", "N", "R", "X")
    one = load(spark, base, "lineitem").agg(F.count(F.lit(1)).alias("all_rows"), *[F.count_if(F.col("l_returnflag") == b).alias(f"flag_{b}") for b in buckets])
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), r6(F.coalesce(F.try_divide(f"flag_{b}", "all_rows"), F.lit(0.25))).alias("share")) for b in buckets])
    return one.select(F.inline(rows))


@query("""WITH b AS (SELECT CAST(n_regionkey AS VARCHAR) AS region, CAST(n_nationkey AS VARCHAR) AS nation, (c_mktsegment = 'BUILDING')::INT AS hit FROM customer JOIN nation ON c_nationkey = n_nationkey),
r0 AS (SELECT sum(hit) AS x, count(*) AS n, sum(hit) / count(*) AS rate FROM b),
r1 AS (SELECT region, sum(hit) AS x, count(*) AS n, (sum(hit) + 40 * (SELECT rate FROM r0)) / (count(*) + 40) AS rate FROM b GROUP BY 1),
r2 AS (SELECT b.region, nation, sum(hit) AS x, count(*) AS n, (sum(hit) + 40 * any_value(r1.rate)) / (count(*) + 40) AS rate FROM b JOIN r1 USING (region) GROUP BY 1, 2)
SELECT 0 AS depth, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS nation, CAST(x AS BIGINT) AS x, n, round(rate, 6) AS rate FROM r0
UNION ALL SELECT 1, region, NULL, CAST(x AS BIGINT), n, round(rate, 6) FROM r1 UNION ALL SELECT 2, region, nation, CAST(x AS BIGINT), n, round(rate, 6) FROM r2""")
def hierarchical_pooling(spark, base):
    b = load(spark, base, "customer").join(load(spark, base, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    b = b.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("hit"))
    got = rates.pooled_rates(b, ["region", "nation"], F.col("hit"), F.lit(1), 40.0)
    return got.select("depth", "region", "nation", "x", "n", r6(F.col("rate")).alias("rate"))


_PER_USER = "SELECT user_id, count(*) AS n, sum((event_type = 'purchase')::INT) AS x FROM events GROUP BY user_id"


@query(f"""WITH t AS (SELECT u.*, m.min_trials FROM ({_PER_USER}) u, (VALUES (0.0), (20.0)) m(min_trials) WHERE u.n >= m.min_trials),
m AS (SELECT min_trials, sum(x) / sum(n) AS mean, count(*) AS k FROM t GROUP BY 1),
v AS (SELECT min_trials, any_value(mean) AS mean, any_value(k) AS n_eligible, sum(n * pow(x / n - mean, 2)) / sum(n) AS var, count(*) / sum(n) AS inv FROM t JOIN m USING (min_trials) GROUP BY 1)
SELECT CAST(min_trials AS DOUBLE) AS min_trials, n_eligible, round(mean, 6) AS mean, round(CASE WHEN n_eligible < 2 OR var <= mean * (1 - mean) * inv THEN 100000
ELSE greatest(1, least(100000, mean * (1 - mean) / (var - mean * (1 - mean) * inv) - 1)) END, 2) AS k FROM v""")
def eb_constants(spark, base):
    u = load(spark, base, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("x"))
    return rates.eb_constants(u, "n", "x", [0, 20]).select("min_trials", "n_eligible", r6(F.col("mean")).alias("mean"), F.round("k", 2).alias("k"))


@query(f"""WITH t AS (SELECT u.*, x / n * (1 - x / n) / (4 * n) AS v FROM ({_PER_USER}) u WHERE n >= 20), m AS (SELECT sum(x) / sum(n) AS mean FROM t),
w AS (SELECT any_value(mean) AS mean, sum(n * pow(x / n - mean, 2)) / sum(n) - sum(n * v) / sum(n) AS tv FROM t, m)
SELECT round(mean, 6) AS mean, round(greatest(tv, 0), 8) AS var_true, round(CASE WHEN tv <= 0 THEN 100000 ELSE greatest(1, least(100000, mean * (1 - mean) / tv - 1)) END, 2) AS k FROM w""")
def eb_supplied_noise(spark, base):
    """Rates with a sampling variance of their own: a quarter of the binomial one."""
    u = load(spark, base, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("x"))
    u = u.withColumn("v", projector.sampling_variance(F.col("x"), F.col("n")) / 4)
    return rates.eb_constants(u, "n", "x", [20], noise="v").select(r6(F.col("mean")).alias("mean"), F.round("var_true", 8).alias("var_true"), F.round("k", 2).alias("k"))


@query("""WITH b AS (SELECT c_nationkey, CAST(n_regionkey AS VARCHAR) AS region, CAST(n_nationkey AS VARCHAR) AS nation, (c_mktsegment = 'BUILDING')::INT AS hit FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey NOT IN (3, 7) AND n_regionkey <> 2),
r0 AS (SELECT sum(hit) / count(*) AS rate FROM b), r1 AS (SELECT region, (sum(hit) + 40 * (SELECT rate FROM r0)) / (count(*) + 40) AS rate FROM b GROUP BY 1), r2 AS (SELECT region, nation, (sum(hit) + 40 * any_value(r1.rate)) / (count(*) + 40) AS rate FROM b JOIN r1 USING (region) GROUP BY 1, 2)
SELECT CAST(n_nationkey AS VARCHAR) AS nation, round(coalesce(r2.rate, r1.rate, r0.rate), 6) AS mean, CASE WHEN r2.rate IS NOT NULL THEN n.n_regionkey || '|' || n_nationkey WHEN r1.rate IS NOT NULL THEN CAST(n.n_regionkey AS VARCHAR) ELSE 'root' END AS label
FROM nation n CROSS JOIN r0 LEFT JOIN r1 ON r1.region = CAST(n_regionkey AS VARCHAR) LEFT JOIN r2 ON r2.nation = CAST(n_nationkey AS VARCHAR)""")
def prior_lookup(spark, base):
    """Nations without customers of their own fall back to their region, or to all."""
    nation = load(spark, base, "nation").select(F.col("n_regionkey").cast("string").alias("region"), F.col("n_nationkey").cast("string").alias("nation"))
    c = load(spark, base, "customer").join(nation, F.col("c_nationkey").cast("string") == F.col("nation")).where("nation not in ('3', '7') and region <> '2'")
    table = rates.pooled_rates(c, ["region", "nation"], (F.col("c_mktsegment") == "BUILDING").cast("int"), F.lit(1), 40.0)
    got = rates.prior_lookup(nation, table, ["region", "nation"])
    return got.select("nation", r6(F.col("mean")).alias("mean"), "label")


_TYPES = ("view", "signup", "error", "click", "purchase")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS x FROM events GROUP BY 1, 2), n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
g AS (SELECT * FROM n, (VALUES ('view', 0.4, 50.0), ('signup', 0.1, 80.0), ('error', 0.1, 80.0), ('click', 0.3, 60.0), ('purchase', 0.1, 90.0)) p(event_type, m, k)),
r AS (SELECT g.user_id, g.event_type, (coalesce(c.x, 0) + g.k * g.m) / (g.n + g.k) AS p FROM g LEFT JOIN c USING (user_id, event_type))
SELECT user_id, event_type, round(p / sum(p) OVER (PARTITION BY user_id), 6) AS p FROM r""")
def dirichlet_posterior(spark, base):
    u = load(spark, base, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("event_type") == t) for t in _TYPES]).alias("x")
    )
    lits = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    post = rates.dirichlet_posterior(F.col("x"), F.col("n"), lits((0.4, 0.1, 0.1, 0.3, 0.1)), lits((50, 80, 80, 60, 90)))
    types = F.array(*[F.lit(t) for t in _TYPES])
    return u.select("user_id", F.inline(F.arrays_zip(types.alias("event_type"), post.alias("p")))).select("user_id", "event_type", r6(F.col("p")).alias("p"))


@query("""WITH b AS (SELECT l_returnflag AS own, l_linestatus AS split, l_quantity, (l_discount > 0.05)::INT AS hi, (l_tax > 0.04)::INT AS tx FROM lineitem),
s AS (SELECT own, split, avg(hi) AS hi, avg(tx) AS tx FROM b GROUP BY 1, 2), w AS (SELECT own, avg(hi) AS hi, avg(tx) AS tx FROM b GROUP BY 1)
SELECT own, split, 'hi' AS bucket, round(s.hi - w.hi, 6) AS delta FROM s JOIN w USING (own) UNION ALL SELECT own, split, 'tx', round(s.tx - w.tx, 6) FROM s JOIN w USING (own)""")
def platoon_deltas(spark, base):
    b = load(spark, base, "lineitem").withColumnsRenamed({"l_returnflag": "own", "l_linestatus": "split"})
    got = rates.split_deltas(b, "own", "split", {"hi": (F.col("l_discount") > 0.05).cast("int"), "tx": (F.col("l_tax") > 0.04).cast("int")}, F.lit(1))
    return got.select("own", "split", "bucket", r6(F.col("delta")).alias("delta"))


_CUST = """SELECT o_custkey, count(*) AS w, avg(o_totalprice) / 1000 AS y, count(*) FILTER (o_orderstatus = 'F') / count(*) AS x1,
count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) AS x2 FROM orders GROUP BY 1"""


@query(f"""WITH d AS ({_CUST}), m AS (SELECT sum(w*y)/sum(w) my, sum(w*x1)/sum(w) m1, sum(w*x2)/sum(w) m2, count(*) n FROM d),
s AS (SELECT any_value(n) n, any_value(my) my, any_value(m1) m1, any_value(m2) m2, sum(w*(x1-m1)*(x1-m1)) s11, sum(w*(x2-m2)*(x2-m2)) s22, sum(w*(x1-m1)*(x2-m2)) s12,
sum(w*(x1-m1)*(y-my)) s1y, sum(w*(x2-m2)*(y-my)) s2y, sum(w*(y-my)*(y-my)) syy FROM d, m),
b AS (SELECT *, (s22*s1y - s12*s2y)/(s11*s22 - s12*s12) b1, (s11*s2y - s12*s1y)/(s11*s22 - s12*s12) b2 FROM s)
SELECT n, round(my - b1*m1 - b2*m2, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, round((b1*s1y + b2*s2y)/syy, 6) AS r2 FROM b""")
def wls_proxy(spark, base):
    d = load(spark, base, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("w"), (F.avg("o_totalprice") / 1000).alias("y"),
        (F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("x1"),
        (F.count_if(F.col("o_orderpriority") == "1-URGENT") / F.count(F.lit(1))).alias("x2"),
    )
    fit = rates.weighted_least_squares(d, "y", "x1", "x2", "w")
    return fit.select("n", *[F.round(c, 4).alias(c) for c in ("b0", "b1", "b2")], r6(F.col("r2")).alias("r2"))


# -- prices ----------------------------------------------------------------------------


@query("""WITH o AS (SELECT rec_id, unnest(bookmakers) AS b FROM odds_api), m AS (SELECT rec_id, b.key AS book, unnest(b.markets) AS m FROM o),
x AS (SELECT rec_id, book, m.key AS market, unnest(m.outcomes) AS u FROM m), d AS (SELECT *, CASE WHEN u.price >= 100 THEN 1 + u.price / 100 WHEN u.price <= -100 THEN 1 - 100 / u.price END AS dec FROM x)
SELECT book, market, count(*) AS n, round(avg(dec), 6) AS mean_decimal, round(avg(1 / dec), 6) AS mean_prob FROM d GROUP BY ALL""")
def american_decimal(spark, base):
    d = nested.odds_children(load(spark, base, "odds_api")).withColumn("dec", market.american_to_decimal(F.col("price")))
    return d.groupBy(F.col("book_key").alias("book"), F.col("market_key").alias("market")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("dec")).alias("mean_decimal"), r6(F.avg(market.implied(F.col("dec")))).alias("mean_prob")
    )


def _markets(spark, base) -> DataFrame:
    """rec_id, b, m, q: implied probabilities of every two-way market."""
    books = load(spark, base, "odds_api").select("rec_id", F.posexplode("bookmakers").alias("b", "book"))
    m = books.select("rec_id", "b", F.posexplode("book.markets").alias("m", "market")).where("size(market.outcomes) = 2")
    return m.select("rec_id", "b", "m", F.transform("market.outcomes", lambda o: market.american_to_prob(o["price"])).alias("q"))


_Q = """WITH RECURSIVE o AS (SELECT rec_id, unnest(bookmakers) AS bk, generate_subscripts(bookmakers, 1) - 1 AS b FROM odds_api),
m AS (SELECT rec_id, b, unnest(bk.markets) AS mk, generate_subscripts(bk.markets, 1) - 1 AS m FROM o),
p AS (SELECT rec_id, b, m, mk.outcomes[1].price AS p1, mk.outcomes[2].price AS p2 FROM m WHERE len(mk.outcomes) = 2),
d AS (SELECT rec_id, CAST(b AS INT) AS b, CAST(m AS INT) AS m, CASE WHEN p1 >= 100 THEN 1 / (1 + p1 / 100) WHEN p1 <= -100 THEN 1 / (1 - 100 / p1) END AS q1,
CASE WHEN p2 >= 100 THEN 1 / (1 + p2 / 100) WHEN p2 <= -100 THEN 1 / (1 - 100 / p2) END AS q2 FROM p),
v AS (SELECT *, q1 > 0 AND q2 > 0 AND q1 + q2 > 1 AS ok FROM d) """
_SHIN = """, u AS (SELECT DISTINCT q1, q2, q1 + q2 AS s FROM v WHERE ok), z AS (SELECT q1, q2, s, 0 AS i, 0.0::DOUBLE AS lo, 0.99::DOUBLE AS hi FROM u UNION ALL SELECT q1, q2, s, i + 1, CASE WHEN f > 1 THEN mid ELSE lo END, CASE WHEN f > 1 THEN hi ELSE mid END FROM (
SELECT *, (sqrt(mid * mid + 4 * (1 - mid) * q1 * q1 / s) - mid) / (2 * (1 - mid)) + (sqrt(mid * mid + 4 * (1 - mid) * q2 * q2 / s) - mid) / (2 * (1 - mid)) AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM z WHERE i < 60))),
sh AS (SELECT q1, q2, s, (lo + hi) / 2 AS y FROM z WHERE i = 60), shin AS (SELECT q1, q2, a / (a + c) AS fair FROM (SELECT q1, q2, (sqrt(y * y + 4 * (1 - y) * q1 * q1 / s) - y) / (2 * (1 - y)) AS a, (sqrt(y * y + 4 * (1 - y) * q2 * q2 / s) - y) / (2 * (1 - y)) AS c FROM sh)) """
_POWER = """, pz AS (SELECT DISTINCT q1, q2, 0 AS i, 1.0::DOUBLE AS lo, 20.0::DOUBLE AS hi FROM v WHERE ok UNION ALL SELECT q1, q2, i + 1, CASE WHEN f > 1 THEN mid ELSE lo END, CASE WHEN f > 1 THEN hi ELSE mid END FROM (
SELECT *, pow(q1, mid) + pow(q2, mid) AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM pz WHERE i < 60))), pw AS (SELECT q1, q2, pow(q1, (lo + hi) / 2) / (pow(q1, (lo + hi) / 2) + pow(q2, (lo + hi) / 2)) AS fair FROM pz WHERE i = 60) """


def _first(spark, base, method: str, digits: int = 6) -> DataFrame:
    return _markets(spark, base).select("rec_id", "b", "m", F.round(F.get(market.DEVIG[method](F.col("q")), F.lit(0)), digits).alias("fair"))


@query(_Q + "SELECT rec_id, b, m, CASE WHEN ok THEN round(q1 / (q1 + q2), 6) END AS fair FROM v")
def devig_multiplicative(spark, base):
    return _first(spark, base, "multiplicative")


@query(_Q + """SELECT rec_id, b, m, CASE WHEN ok AND q1 > (q1 + q2 - 1) / 2 AND q2 > (q1 + q2 - 1) / 2 THEN round(q1 - (q1 + q2 - 1) / 2, 6) END AS fair FROM v""")
def devig_additive(spark, base):
    return _first(spark, base, "additive")


@query(_Q + _SHIN + "SELECT rec_id, b, m, round(shin.fair, 5) AS fair FROM v LEFT JOIN shin ON v.ok AND v.q1 = shin.q1 AND v.q2 = shin.q2")
def devig_shin(spark, base):
    return _first(spark, base, "shin", 5)


@query(_Q + _POWER + "SELECT rec_id, b, m, round(pw.fair, 5) AS fair FROM v LEFT JOIN pw ON v.ok AND v.q1 = pw.q1 AND v.q2 = pw.q2")
def devig_power(spark, base):
    return _first(spark, base, "power", 5)


@query(_Q + _SHIN + _POWER + """, w AS (SELECT v.*, CASE WHEN ok THEN v.q1 / (v.q1 + v.q2) END AS mu, CASE WHEN ok AND v.q1 > (v.q1 + v.q2 - 1) / 2 AND v.q2 > (v.q1 + v.q2 - 1) / 2 THEN v.q1 - (v.q1 + v.q2 - 1) / 2 END AS ad, shin.fair AS sf, pw.fair AS pf
FROM v LEFT JOIN shin ON ok AND v.q1 = shin.q1 AND v.q2 = shin.q2 LEFT JOIN pw ON ok AND v.q1 = pw.q1 AND v.q2 = pw.q2) SELECT rec_id, b, m, round(greatest(mu, ad, sf, pf) - least(mu, ad, sf, pf), 5) AS spread FROM w""")
def devig_spread(spark, base):
    m = _markets(spark, base).withColumn("all", market.devig_all(F.col("q")))
    return m.select("rec_id", "b", "m", F.round(market.spread_across_methods(F.col("all"), 0), 5).alias("spread"))


@query(_Q + _POWER + "SELECT rec_id, b, m, round(coalesce(pw.fair, CASE WHEN ok THEN v.q1 / (v.q1 + v.q2) END), 5) AS fair FROM v LEFT JOIN pw ON v.ok AND v.q1 = pw.q1 AND v.q2 = pw.q2")
def sharp_fair(spark, base):
    return _markets(spark, base).select("rec_id", "b", "m", F.round(F.get(market.sharp_fair(F.col("q")), F.lit(0)), 5).alias("fair"))


@query("""SELECT ticker, rec_id, round(0.07 * p * (1 - p), 6) AS fee, round(0.07 * p * (1 - p) + half + 0.005, 6) AS floor FROM (
SELECT ticker, rec_id, (yes_bid + yes_ask) / 200.0 AS p, (yes_ask - yes_bid) / 200.0 AS half FROM kalshi_markets WHERE yes_bid IS NOT NULL AND yes_ask IS NOT NULL)""")
def fee_floor(spark, base):
    k = load(spark, base, "kalshi_markets").where("yes_bid is not null and yes_ask is not null")
    k = k.withColumns({"p": (F.col("yes_bid") + F.col("yes_ask")) / 200.0, "half": (F.col("yes_ask") - F.col("yes_bid")) / 200.0})
    return k.select("ticker", "rec_id", r6(market.fee(F.col("p"))).alias("fee"), r6(market.floor_of(F.col("p"), F.col("half"), F.lit(0.005))).alias("floor"))


# -- payloads and text --------------------------------------------------------------------


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def nested_json_field(spark, base):
    e = load(spark, base, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '(\d+)-mph', 1))) AS INT) AS n_speeds, nullif(regexp_extract(text, 'in ([A-Z][a-z]+) is expected', 1), '') AS place
FROM documents WHERE regexp_matches(text, '\d+-mph|is expected')""")
def payload_regex_extract(spark, base):
    d = load(spark, base, "documents").where(F.col("text").rlike(r"\d+-mph|is expected"))
    speeds = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d+)-mph"), F.lit(1)))
    place = F.nullif(F.regexp_extract("text", "in ([A-Z][a-z]+) is expected", 1), F.lit(""))
    return d.select("doc_id", F.size(speeds).alias("n_speeds"), place.alias("place"))


@query(r"""SELECT endpoint, key, count(*) AS n, count(*) FILTER (NOT json_valid(payload)) AS cut FROM poll_archive WHERE payload IS NOT NULL GROUP BY ALL""")
def payload_split(spark, base):
    a = load(spark, base, "poll_archive").where("payload is not null")
    return a.groupBy("endpoint", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.try_parse_json("payload").isNull()).alias("cut"))


_BOXES = (("orderbook_fp", 1), ("orderbook", 100), ("book", 100), ("", 100))


def _levels_sql(names: tuple[str, ...]) -> str:
    one = lambda box, n, scale: f"list_transform(CAST(json_extract(payload, '$.{box + '.' if box else ''}{n}') AS DOUBLE[][]), lambda l: list_transform(l, lambda v: v / {scale}))"
    return "coalesce(" + ", ".join(one(box, n, scale) for box, scale in _BOXES for n in names) + ")"


_LEVELS = f"""WITH p AS (SELECT file_path, file_row, {_levels_sql(archive.YES)} AS ys, {_levels_sql(archive.NO)} AS ns FROM poll_archive WHERE endpoint = 'orderbook' AND json_valid(payload)) """


def _books(spark, base) -> DataFrame:
    return load(spark, base, "poll_archive").where("endpoint = 'orderbook'").where(F.try_parse_json("payload").isNotNull())


@query(_LEVELS + """, q AS (SELECT *, list_max(list_transform(ys, lambda l: l[1])) AS y, list_max(list_transform(ns, lambda l: l[1])) AS n FROM p)
SELECT file_path, file_row, CASE WHEN y > 0 AND y < 1 AND n > 0 AND n < 1 AND y <= 1 - n + 1e-9 THEN round((y + 1 - n) / 2, 6) END AS mid FROM q""")
def order_book_mid(spark, base):
    """Books of any shape: cents under orderbook, book or at the root; decimal texts under orderbook_fp."""
    return archive.book_mids(_books(spark, base)).select("file_path", "file_row", r6(F.col("mid")).alias("mid"))


@query(_LEVELS + """SELECT file_path, file_row, len(ys) AS yes_levels, len(ns) AS no_levels, greatest(coalesce(len(ys), 0), coalesce(len(ns), 0)) AS deepest,
round((coalesce(list_sum(list_transform(ys, lambda l: l[2])), 0) + coalesce(list_sum(list_transform(ns, lambda l: l[2])), 0)) * 100, 4) AS contracts FROM p""")
def book_depth(spark, base):
    d = archive.book_depths(_books(spark, base))
    return d.select("file_path", "file_row", F.col("yes_levels").cast("bigint").alias("yes_levels"), F.col("no_levels").cast("bigint").alias("no_levels"), F.col("deepest").cast("bigint").alias("deepest"), F.round(F.col("contracts") * 100, 4).alias("contracts"))


@query(_LEVELS + ", d AS (SELECT greatest(coalesce(len(ys), 0), coalesce(len(ns), 0)) AS deepest FROM p) SELECT deepest, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 6) AS share FROM d GROUP BY deepest")
def depth_histogram(spark, base):
    d = archive.book_depths(_books(spark, base)).groupBy(F.col("deepest").cast("bigint").alias("deepest")).agg(F.count(F.lit(1)).alias("n"))
    whole = F.broadcast(d.agg(F.sum("n").alias("_all")).withColumn("_one", F.lit(1)))  # one row
    return d.withColumn("_one", F.lit(1)).join(whole, "_one").select("deepest", "n", r6(F.col("n") / F.col("_all")).alias("share"))


@query("""WITH p AS (SELECT file_path, file_row, CAST(coalesce(json_extract(payload, '$.bids.levels'), json_extract(payload, '$.bids')) AS JSON[]) AS bs, CAST(coalesce(json_extract(payload, '$.asks.levels'), json_extract(payload, '$.asks')) AS JSON[]) AS xs FROM poll_archive WHERE endpoint = 'book' AND json_valid(payload)),
l AS (SELECT *, list_transform(bs, lambda x: CAST(coalesce(json_extract_string(x, '$.price'), json_extract_string(x, '$[0]')) AS DOUBLE)) AS b, list_transform(xs, lambda x: CAST(coalesce(json_extract_string(x, '$.price'), json_extract_string(x, '$[0]')) AS DOUBLE)) AS a FROM p)
SELECT file_path, file_row, list_max(b) AS best_bid, list_min(a) AS best_ask, CAST(coalesce(len(b), 0) + coalesce(len(a), 0) AS BIGINT) AS levels FROM l""")
def clob_best(spark, base):
    """Best bid and ask of books whose levels are objects or pairs."""
    books = load(spark, base, "poll_archive").where("endpoint = 'book'").where(F.try_parse_json("payload").isNotNull())
    bids, asks = (archive.clob_levels(F.col("payload"), s) for s in ("bids", "asks"))
    best = lambda c, f: f(F.transform(c, lambda x: x["price"]))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    got = books.select("file_path", "file_row", bids.alias("b"), asks.alias("a"))
    return got.select("file_path", "file_row", best("b", F.array_max).alias("best_bid"), best("a", F.array_min).alias("best_ask"), (F.greatest(size("b"), F.lit(0)) + F.greatest(size("a"), F.lit(0))).cast("bigint").alias("levels"))


@query("""SELECT venue_id, round(avg(t), 4) AS mean_f, count(*) AS hours FROM (SELECT venue_id, unnest(hourly.temperature_2m) AS t FROM open_meteo) WHERE t IS NOT NULL GROUP BY venue_id""")
def weather_zip(spark, base):
    m = load(spark, base, "open_meteo").select("venue_id", F.inline(F.arrays_zip("hourly.time", "hourly.temperature_2m")))
    return m.where("temperature_2m is not null").groupBy("venue_id").agg(F.round(F.avg("temperature_2m"), 4).alias("mean_f"), F.count(F.lit(1)).alias("hours"))


# -- state and streams -------------------------------------------------------------------


@query()
def ordered_fold_state(spark, base):
    """Bases-and-outs style state over each user's ordered events, folded without a user function."""
    return archive.fold_state(load(spark, base, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(SQL["asof_latest_per_key"])
def stream_latest_equals_batch(spark, base):
    e = load(spark, base, "events")
    return archive.stream_latest(spark, f"{base}/events.parquet", e.schema, ["user_id", "event_type"], "ts", "event_id", CUT).select("event_id", "user_id", "event_type")


@query("""SELECT window_start, event_type, count(*) AS n FROM (SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS window_start, event_type FROM events) GROUP BY ALL""")
def stream_tumbling_counts(spark, base):
    e = load(spark, base, "events")
    return archive.stream_window_counts(spark, f"{base}/events.parquet", e.schema, "ts", "event_type", "1 day")


@query("""WITH f AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS c FROM events),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM f),
r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS run FROM g) SELECT user_id, CAST(max(run) AS BIGINT) AS longest FROM r GROUP BY user_id""")
def stream_frozen_feed(spark, base):
    e = load(spark, base, "events")
    return archive.stream_frozen(spark, f"{base}/events.parquet", e.schema, "user_id", "ts", "event_id", "event_type")

