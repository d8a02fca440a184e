"""Problem 2: many tiny files into few well-sized ones, each record once.

The steps follow a frozen manifest: (1) one scan digests every record and is
written down, so that every later step sees the same rows; (2) pieces of files
are packed into bins, first-fit decreasing; (3) each bin is rewritten as one
file, without the surplus copies; (4) counts and checksums of every bin are
held against the manifest; (5) a pointer file, created in one step or not at
all, commits.  Nothing but totals and counts of bins reaches the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.jsontext import value_text
from tidemark.sources import shared_dir

#: Rows of one file beyond this many form a further piece, so that a huge file can't fill a task.
PIECE_ROWS = 100_000
#: Pieces that one packing task sees at most, in expectation.
PLAN_PIECES = 50_000

# columns of the rewrite that no archive should have
_PIECE, _BIN = "tidemark_piece", "tidemark_bin"
_ADDRESS = ["file_path", "file_row"]
_IDENTITY = ["venue", "endpoint", "key", "fetched_us", "request_params", "payload", "error"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for venue, endpoint, key, at, params, payload, error in zip(*(batch[c].to_pylist() for c in _IDENTITY)):
            p, v = value_text(params), value_text(payload)
            record = (
                venue, endpoint, key, at, params if p is None else "", p,
                payload if v is None else "", v, error if v is None else "",
            )
            out.append(hashlib.blake2b(json.dumps(record).encode(), digest_size=16).digest())
        keep = [batch[c] for c in ("file_path", "file_row", "row_hash", "bytes")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.binary())], ["file_path", "file_row", "row_hash", "bytes", "digest"])


def record_digests(archive: DataFrame) -> DataFrame:
    """file_path, file_row, row_hash, bytes, digest of every record.

    Equal digests mean the same record: equal venue, endpoint, key (null equals
    null) and fetched_at, request_params and payload equal as JSON values, or,
    where the payload is null or no JSON, equal payload text and error.
    """
    sizes = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in archive.schema.fields]
    total = sizes[0]
    for s in sizes[1:]:
        total = total + s
    rows = archive.select(
        "file_path",
        F.col("file_row").cast("bigint").alias("file_row"),
        F.xxhash64(*archive.columns).alias("row_hash"),
        total.cast("bigint").alias("bytes"),
        "venue", "endpoint", "key", F.unix_micros("fetched_at").alias("fetched_us"), "request_params", "payload", "error",
    )
    return rows.mapInArrow(_digests, "file_path string, file_row bigint, row_hash bigint, bytes bigint, digest binary")


def surplus_records(digests: DataFrame) -> DataFrame:
    """Address of each row whose record another row holds at an earlier address.

    Only digests that repeat take part in the join back; the count per digest is
    combined before its shuffle, so a record copied into a third of all rows
    costs one row there, and the skew join splits it here.
    """
    address = F.struct(*_ADDRESS)
    repeated = (
        digests.groupBy("digest")
        .agg(F.min(address).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    return digests.join(repeated, "digest").where(address != F.col("first")).select(*_ADDRESS, "row_hash", "bytes")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each size.  A size of the capacity or more has its own bin."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins, tree_n = [0] * len(sizes), 1
    while tree_n < max(1, len(sizes)):
        tree_n *= 2
    room = [0] * (2 * tree_n)  # a max tree over the room left in each opened bin
    opened = 0
    for i in order:
        need = min(sizes[i], capacity)
        if room[1] >= need and opened and need > 0:
            at = 1
            while at < tree_n:
                at = 2 * at if room[2 * at] >= need else 2 * at + 1
            b = at - tree_n
        elif need == 0 and opened:
            b = 0
        else:
            b, opened = opened, opened + 1
            room[tree_n + b] = capacity
        at = tree_n + b
        room[at] -= need
        at //= 2
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at //= 2
        bins[i] = b
    return bins


def plan_bins(digests: DataFrame, groups: int, target_bytes: int) -> DataFrame:
    """file_path, piece, bin, rows, bytes: the packing plan.

    Pieces are packed within groups that equal the hash partitions of the
    rewrite, so a bin never spans two tasks and the rows move only once.
    """

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["file_path", "piece"], ignore_index=True)
        bins = first_fit_decreasing(pdf["bytes"].tolist(), target_bytes)
        return pdf.assign(bin=[f"{int(g):06d}-{b:05d}" for g, b in zip(pdf["grp"], bins)])[
            ["file_path", "piece", "bin", "rows", "bytes"]
        ]

    pieces = (
        digests.groupBy("file_path", (F.col("file_row") / PIECE_ROWS).cast("bigint").alias("piece"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
        .withColumn("grp", F.pmod(F.hash("file_path", "piece"), F.lit(groups)))
    )
    return pieces.groupBy("grp").applyInPandas(pack, "file_path string, piece bigint, bin string, rows bigint, bytes bigint")


@dataclass(frozen=True)
class Compacted:
    """Where a committed compaction lies, and its totals."""

    path: str
    files_in: int
    files_out: int
    rows_in: int
    rows_out: int

    def data(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/data").drop(_BIN)

    def surplus(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/surplus").select(*_ADDRESS)

    def plan(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/plan")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files as an archive: its columns with the file and the row's place in it."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("file_row"))


#: The file that says which run of a target counts.
_POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commit(spark: SparkSession, target: str, run: str) -> None:
    """Point the target to a run.  The file is created only if there is none, so of two writers one fails, on object stores too."""
    fs, pointer = _fs(spark, f"{target}/{_POINTER}")
    try:
        out = fs.create(pointer, False)
    except Exception as e:
        raise RuntimeError(f"the compaction could not be committed to {target}") from e
    out.write(bytearray(run.encode()))
    out.close()


def committed(spark: SparkSession, target: str) -> str | None:
    """The folder of the target's committed run; null if there is none."""
    fs, pointer = _fs(spark, f"{target}/{_POINTER}")
    if not fs.exists(pointer):
        return None
    return f"{target}/{spark.read.text(f'{target}/{_POINTER}').first().value}"


def compact(archive: DataFrame, target: str | None = None, target_bytes: int = 128 << 20) -> Compacted:
    """Rewrite ``archive`` (file_path, file_row, ...) into bins of ``target_bytes``.

    ``target`` must not exist; by default it is made in the shared folder.  Rows
    are never dropped but as copies of a record that stays.  Extra columns are
    carried.  Empty archives commit no file.  Raises if a bin's rows or checksum
    differ from the manifest; then nothing is committed.
    """
    spark = archive.sparkSession
    target = target or shared_dir(spark, "compacted")
    if committed(spark, target):
        raise RuntimeError(f"{target} holds a committed compaction")
    run = f"run-{uuid.uuid4().hex}"
    stage = f"{target}/{run}"
    try:
        done = _rewrite(archive, stage, target_bytes)
        _commit(spark, target, run)
    except BaseException:
        fs, path = _fs(spark, stage)
        fs.delete(path, True)  # a failed run leaves nothing
        raise
    return done


def _rewrite(archive: DataFrame, stage: str, target_bytes: int) -> Compacted:
    spark = archive.sparkSession
    record_digests(archive).write.parquet(f"{stage}/manifest")
    digests = spark.read.parquet(f"{stage}/manifest")
    totals = digests.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_distinct("file_path").alias("files")
    ).first()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(
        1,
        ceil(totals.bytes / (4 * target_bytes)),
        ceil(totals.files / PLAN_PIECES),
        min(ceil(totals.bytes / target_bytes), width),
    )
    plan_bins(digests, groups, target_bytes).write.parquet(f"{stage}/plan")
    plan = spark.read.parquet(f"{stage}/plan")
    surplus_records(digests).write.parquet(f"{stage}/surplus")
    surplus = spark.read.parquet(f"{stage}/surplus")

    piece = (F.col("file_row") / PIECE_ROWS).cast("bigint").alias(_PIECE)
    key = ["file_path", _PIECE]
    bins = plan.select("file_path", F.col("piece").alias(_PIECE), F.col("bin").alias(_BIN))
    strict = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(strict)
    spark.conf.set(strict, "false")  # the address join then keeps the partitioning by file and piece
    try:
        kept = (
            archive.select("*", piece)
            .repartition(groups, *key)
            .join(surplus.select(*_ADDRESS, piece).repartition(groups, *key), [*key, "file_row"], "left_anti")
            .join(bins.repartition(groups, *key), key)
            .select(*archive.columns, _BIN)
        )
        kept.sortWithinPartitions(_BIN, *_ADDRESS).write.partitionBy(_BIN).option("compression", "zstd").parquet(f"{stage}/data")
    finally:
        spark.conf.set(strict, before)

    rows_out = 0
    if totals.rows:
        written = spark.read.schema(StructType([*archive.schema.fields, StructField(_BIN, StringType())])).parquet(f"{stage}/data")
        rows_out = _verify(written, archive.columns, digests, surplus, plan)
    files_out = plan.select("bin").distinct().count()
    return Compacted(stage, totals.files, files_out, totals.rows, rows_out)


def _verify(written: DataFrame, columns: list[str], digests: DataFrame, surplus: DataFrame, plan: DataFrame) -> int:
    """Rows written; raises unless every bin has the rows and checksum of the manifest."""
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    got = written.select(F.col(_BIN).alias("bin"), F.xxhash64(*columns).alias("h")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), big("h").alias("h"))
    piece = (F.col("file_row") / PIECE_ROWS).cast("bigint").alias("piece")
    per_piece = lambda df, sign: df.groupBy("file_path", piece).agg(
        (F.count(F.lit(1)) * sign).alias("n"), (big("row_hash") * sign).cast("decimal(38,0)").alias("h")
    )
    want = (
        per_piece(digests, 1).unionByName(per_piece(surplus, -1))
        .join(plan.select("file_path", "piece", "bin"), ["file_path", "piece"])
        .groupBy("bin")
        .agg(F.sum("n").alias("want_n"), F.sum("h").alias("want_h"))
    )
    found = got.join(want.where("want_n > 0"), "bin", "full").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(~(F.col("n").eqNullSafe(F.col("want_n")) & F.col("h").eqNullSafe(F.col("want_h")))).alias("bad"),
    ).first()
    if found.bad:
        raise RuntimeError(f"{found.bad} bins differ from the manifest; nothing was committed")
    return found.rows
