"""Problem 8: texts into containers of a fixed number of tokens.

Space-filling-curve order: a text's hashed word vector is projected to a few
dimensions, the grid cell's Hilbert key orders all texts, a range sort lays
them out along the curve, and each task packs its stretch of the curve.  Packed
neighbours are alike.  Within a stretch a window of neighbours is packed best
fit, largest first, over the containers that the last windows left open, so
little room is lost and neighbours stay together.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import shared_dir, spread

CAPACITY = 2048
DIMENSIONS, BITS = 4, 8
#: Neighbours on the curve that are packed together, and how many windows a container stays open for: both are
#: parameters of ``pack``, since they decide which texts may share a container.
WINDOW_ITEMS, OPEN_WINDOWS = 4096, 4
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

_MEASURED = "doc_id bigint, n_tokens bigint, curve bigint"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A tiktoken encoding over a rank file; ``path`` may be a bare name of a public file."""
    import public_tokenizers as public
    import tiktoken

    where = path if "/" in path else public.path(path)
    with open(where, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hilbert_key(cell: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points, one per row (Skilling's transform)."""
    x = cell.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def project(tokens: list[int]) -> np.ndarray:
    """Few-dimensional unit-range image of the hashed token counts of a text."""
    if not tokens:
        return np.zeros(DIMENSIONS)
    ids, counts = np.unique(np.asarray(tokens, dtype=np.uint64), return_counts=True)
    w = np.sqrt(counts)
    out = np.empty(DIMENSIONS)
    for d in range(DIMENSIONS):
        h = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d * 0xBF58476D1CE4E5B9 % 2**64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
        out[d] = np.dot(w, np.where(h & np.uint64(1), 1.0, -1.0)) / np.sqrt(np.dot(w, w))
    return out


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for batch in batches:
            ids, sizes, points = batch["doc_id"], [], []
            for text in batch["text"].to_pylist():
                tokens = enc.encode_ordinary(text) if text else []
                sizes.append(len(tokens))
                points.append(project(tokens))
            cell = np.clip((np.tanh(np.array(points).reshape(-1, DIMENSIONS) / 2.0) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(hilbert_key(cell), pa.int64())], ["doc_id", "n_tokens", "curve"]
            )

    return run


def measure(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, curve of every text (null and empty texts: 0 tokens)."""
    slim = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id")
    return slim.mapInArrow(_measure(vocabulary), _MEASURED)


class _Open:
    """Open containers by room left: best fit in constant time per look-up of a room."""

    def __init__(self, capacity: int):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit r set: some container has r tokens of room left

    def put(self, room: int, name: int) -> None:
        if room:
            self.by_room[room].append(name)
            self.mask |= 1 << room

    def close_before(self, name: int) -> None:
        """Containers of an earlier number take nothing more."""
        for room, names in enumerate(self.by_room):
            if names and (kept := [n for n in names if n >= name]) != names:
                self.by_room[room] = kept
                if not kept:
                    self.mask &= ~(1 << room)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, container) with the least room that holds ``need``."""
        rest = self.mask >> need
        if not rest:
            return None
        room = need + ((rest & -rest).bit_length() - 1)
        name = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return room, name


def pack_window(sizes: list[int], capacity: int, opened: _Open, fresh: int) -> tuple[list[int], int]:
    """Container of each size, largest first, best fit; returns the next fresh number too."""
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        hit = opened.take(sizes[i])
        if hit is None:
            hit, fresh = (capacity, fresh), fresh + 1
        opened.put(hit[0] - sizes[i], hit[1])
        out[i] = hit[1]
    return out, fresh


def _pack(capacity: int, window: int, open_windows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, fresh, held, firsts = _Open(capacity), 0, [], []

        def flush(items: list[tuple]) -> pd.DataFrame:
            nonlocal fresh
            firsts.append(fresh)
            opened.close_before(firsts[max(0, len(firsts) - open_windows)])
            names, fresh = pack_window([x[3] for x in items], capacity, opened, fresh)
            rows = [(f"{part:06d}-{n:08d}", *x[1:]) for n, x in zip(names, items) for part in (x[0],)]
            return pd.DataFrame(rows, columns=["container_id", "doc_id", "start_token", "n_tokens"])

        for pdf in frames:
            for part, doc, n in pdf[["part", "doc_id", "n_tokens"]].itertuples(index=False):
                for start in range(0, n, capacity):  # a text is split only beyond the capacity
                    held.append((int(part), doc, start, min(capacity, n - start)))
            while len(held) >= window:
                yield flush(held[:window])
                held = held[window:]
        if held:
            yield flush(held)

    return run


def pack(
    documents: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, rows_per_task: int = 250_000,
    window_items: int = WINDOW_ITEMS, open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """container_id, doc_id, start_token, n_tokens: every token of every text once.

    Texts of no tokens take no room and give no row.  A text longer than the
    capacity gives full pieces and a remainder that is packed like any other.
    Copies share a curve key; the sort goes on by doc_id, so a group of copies
    of any size is cut into tasks like the rest.  The measures are written down
    before the range sort, which would else tokenise twice.  A container takes
    texts of ``open_windows`` windows of ``window_items`` neighbours, so texts
    far apart on the curve never share one.
    """
    spark = documents.sparkSession
    path = shared_dir(spark, "measured")
    measure(documents, vocabulary).write.parquet(path)
    measured = spark.read.parquet(path)
    tasks = max(1, -(-measured.count() // rows_per_task))
    laid = measured.where("n_tokens > 0").repartitionByRange(tasks, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    laid = laid.select("doc_id", "n_tokens", F.spark_partition_id().alias("part"))
    return laid.mapInPandas(_pack(capacity, window_items, open_windows), "container_id string, doc_id bigint, start_token bigint, n_tokens bigint")
