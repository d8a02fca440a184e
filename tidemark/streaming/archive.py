"""The polling archive as a stream, and ordered state over its records."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.sources import shared_dir

LEVELS = "array<array<string>>"


def write_archive(records: DataFrame, path: str) -> None:
    """Append records to the archive, one directory per venue and day; readers prune by both."""
    day = F.date_format("fetched_at", "yyyy-MM-dd").alias("dt")
    records.select("*", day).repartition("venue", "dt").write.mode("append").partitionBy("venue", "dt").option("compression", "zstd").parquet(path)


#: Names a side goes by, in any of the containers.
YES, NO = ("yes", "yes_levels", "yes_dollars"), ("no", "no_levels", "no_dollars")


def book_levels(payload: Column) -> tuple[Column, Column]:
    """(yes, no) levels in dollars of an order book of any known shape.

    Whole cents under ``orderbook`` or ``book`` or at the root, decimal texts
    under ``orderbook_fp``.  Null: unreadable, which is not the same as empty.
    """
    def side(*names: str) -> Column:
        found = []
        for box, scale in (("orderbook_fp.", 1.0), ("orderbook.", 100.0), ("book.", 100.0), ("", 100.0)):
            for n in names:
                levels = F.from_json(F.get_json_object(payload, f"$.{box}{n}"), LEVELS)
                found.append(F.transform(levels, lambda x: F.transform(x, lambda v: v.try_cast("double") / scale)))
        return F.coalesce(*found)

    return side(*YES), side(*NO)


def book_depths(books: DataFrame) -> DataFrame:
    """``books`` with yes_levels, no_levels (null: unreadable), deepest, contracts (summed sizes, in the unit of the levels)."""
    yes, no = book_levels(F.col("payload"))
    read = books.withColumns({"_yes": yes, "_no": no})
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    size = lambda c: F.coalesce(F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + F.coalesce(F.get(x, F.lit(1)), F.lit(0.0))), F.lit(0.0))
    deepest = F.greatest(F.coalesce(count("_yes"), F.lit(0)), F.coalesce(count("_no"), F.lit(0)))
    return read.select(*books.columns, count("_yes").alias("yes_levels"), count("_no").alias("no_levels"), deepest.alias("deepest"), (size("_yes") + size("_no")).alias("contracts"))


def clob_levels(payload: Column, side: str) -> Column:
    """Levels (price, size) of a side whose levels are objects or pairs; null if absent."""
    text = F.coalesce(F.get_json_object(payload, f"$.{side}.levels"), F.get_json_object(payload, f"$.{side}"))
    objects = F.from_json(text, "array<struct<price:string,size:string>>")
    pairs = F.from_json(text, LEVELS)
    number = lambda c: c.try_cast("double")
    level = lambda p, s: F.struct(number(p).alias("price"), number(s).alias("size"))
    of_pairs = F.transform(pairs, lambda x: level(F.get(x, F.lit(0)), F.get(x, F.lit(1))))
    return F.when(text.rlike(r"^\[\s*\["), of_pairs).otherwise(F.transform(objects, lambda x: level(x["price"], x["size"])))


def book_mids(books: DataFrame) -> DataFrame:
    """``books`` with ``mid``, null where one-sided, crossed, out of range or unreadable."""
    from tidemark.functions.market import mid_of_book

    yes, no = book_levels(F.col("payload"))
    return books.withColumns({"_yes": yes, "_no": no}).withColumn("mid", mid_of_book(F.col("_yes"), F.col("_no"))).drop("_yes", "_no")


def fold_state(df: DataFrame, key: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
    """key, outs, scored, halves: a small state machine over each key's ordered records.

    view puts a runner on, click moves runners on by one (those on third
    score), purchase clears the bases, error is an out, three outs end the half.
    The fold runs in the JVM over the key's ordered array, so a key must be one
    game or session, not an open-ended entity.
    """
    start = F.struct(F.lit(0).alias("on"), F.lit(0).alias("outs"), F.lit(0).alias("scored"), F.lit(0).alias("halves"))

    def pack(on, outs, scored, halves):
        over = outs >= 3
        return F.struct(
            F.when(over, 0).otherwise(on).cast("int").alias("on"), F.when(over, 0).otherwise(outs).cast("int").alias("outs"),
            scored.cast("int").alias("scored"), (halves + F.when(over, 1).otherwise(0)).cast("int").alias("halves"),
        )

    def step(s, x):
        k = x["kind"]
        on = F.when(k == "view", s["on"] * 2 + 1).when(k == "click", s["on"] * 2).when(k == "purchase", 0).otherwise(s["on"])
        runs = F.when(k == "purchase", F.bit_count(s["on"]) + 1).otherwise(F.shiftright(on, 3))
        return pack(on.bitwiseAND(7), s["outs"] + F.when(k == "error", 1).otherwise(0), s["scored"] + runs, s["halves"])

    rows = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("kind")))).alias("_rows"))
    return rows.select(*key, F.aggregate("_rows", start, step).alias("s")).select(*key, "s.outs", "s.scored", "s.halves")


def _run(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _source(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    glob = path if path.endswith("/") else path + "*"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(glob)


def stream_latest(spark: SparkSession, path: str, schema: StructType, key: Sequence[str], at: str, tie: str, cutoff: str) -> DataFrame:
    """Latest record per key up to ``cutoff``, kept by a stream over the files of ``path``.

    Every micro-batch writes the latest rows of its own to a folder named by
    its number, so a repeated batch replaces itself; late rows need no
    watermark, since the reader picks by time.
    """
    out, mark = shared_dir(spark, "latest"), shared_dir(spark, "latest-mark")
    best = F.max_by(F.struct("*"), F.struct(F.col(at), -F.col(tie))).alias("row")

    def keep(batch: DataFrame, number: int) -> None:
        batch.where(F.col(at) <= F.lit(cutoff).cast(schema[at].dataType)).groupBy(*key).agg(best).select("row.*").write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run(_source(spark, path, schema).writeStream.foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start())
    return spark.read.schema(schema).parquet(out).groupBy(*key).agg(best).select("row.*")


def stream_window_counts(spark: SparkSession, path: str, schema: StructType, at: str, kind: str, width: str) -> DataFrame:
    """window_start, kind, n: tumbling counts with a watermark; every batch writes the windows it changed.

    The watermark, wider than the data's disorder, lets closed windows leave the
    state.  Counts only grow, so the greatest of a window's rows is its count,
    whether it has closed or not; a batch that is repeated replaces its folder.
    """
    out, mark = shared_dir(spark, "windows"), shared_dir(spark, "windows-mark")
    counts = (
        _source(spark, path, schema)
        .withColumn("_at", F.col(at).cast("timestamp"))
        .withWatermark("_at", "1 day")
        .groupBy(F.window("_at", width).alias("w"), F.col(kind))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("window_start"), kind, "n")
    )
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    _run(counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start())
    return spark.read.schema(counts.schema).parquet(out).groupBy("window_start", kind).agg(F.max("n").alias("n"))


def stream_frozen(spark: SparkSession, path: str, schema: StructType, key: str, at: str, tie: str, digest: str) -> DataFrame:
    """key, longest: longest run of equal digests per feed, in keyed state.

    The state holds the last digest, the current and the longest run, so a feed
    may be endless.  Within a micro-batch rows are ordered by time; feeds
    deliver batches in order.
    """
    out, mark = shared_dir(spark, "frozen"), shared_dir(spark, "frozen-mark")

    def track(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run, longest = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["_at", "_tie"])
        for d in rows["_digest"]:
            run = run + 1 if d == last and run else 1
            last, longest = d, max(longest, run)
        state.update((last, run, longest))
        yield pd.DataFrame({key: [k[0]], "longest": [longest]})

    rows = _source(spark, path, schema).select(key, F.col(at).cast("timestamp").alias("_at"), F.col(tie).alias("_tie"), F.col(digest).cast("string").alias("_digest"))
    kind = schema[key].dataType.simpleString()
    tracked = rows.groupBy(key).applyInPandasWithState(
        track, f"{key} {kind}, longest bigint", "last string, run bigint, longest bigint", "update", GroupStateTimeout.NoTimeout
    )
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    _run(tracked.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start())
    return spark.read.schema(f"{key} {kind}, longest bigint").parquet(out).groupBy(key).agg(F.max("longest").alias("longest"))


def stream_import(spark: SparkSession, source: str, schema: StructType, target: str, spec, parse, ordinal: str) -> int:
    """Import new files of an archive into a versioned table, each row once; returns the rows added.

    The file source's checkpoint (kept beside the target) remembers imported
    files; the append leaves out rows already held, so a batch that is repeated
    after a failure adds nothing twice.  ``parse`` maps archive rows to table
    rows and must keep an ordinal column.
    """
    from tidemark.operators.loading import append

    added: list[int] = []

    def load_batch(batch: DataFrame, number: int) -> None:
        added.append(append(spark, parse(batch), target, spec, ordinal)["added"])

    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
    _run(rows.writeStream.foreachBatch(load_batch).option("checkpointLocation", f"{target}.imported").trigger(availableNow=True).start())
    return sum(added)


def fetch_sessions(archive: DataFrame, pause: str = "45 minutes") -> DataFrame:
    """venue, start, records: bursts of polling, parted by pauses (the same on a stream with a watermark)."""
    return archive.groupBy("venue", F.session_window("fetched_at", pause).alias("w")).agg(F.count(F.lit(1)).alias("records")).select(
        "venue", F.col("w.start").alias("start"), "records"
    )
