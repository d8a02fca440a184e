"""Problem 8: every token once, no container overfull, little room lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.packing import CAPACITY, _Open, hilbert_key, measure, pack, pack_window
from tidemark.sources import load


def test_whole_table(spark, data):
    docs = load(spark, data, "documents")
    got = pack(docs).cache()
    sizes = {r.doc_id: r.n_tokens for r in measure(docs).collect()}
    pieces = {}
    for r in got.collect():
        pieces.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
    assert set(pieces) == {d for d, n in sizes.items() if n}
    for d, p in pieces.items():
        p.sort()
        assert [s for s, _ in p] == list(np.cumsum([0] + [n for _, n in p])[:-1])
        assert sum(n for _, n in p) == sizes[d]
        assert len(p) == 1 or sizes[d] > CAPACITY
    fill = got.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    worst, count = fill.agg(F.max("n"), F.count("n")).first()
    assert worst <= CAPACITY
    assert count <= -(-sum(sizes.values()) // CAPACITY) * 1.02 + 1


def test_corner_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 5000), (4, "a"), (5, "a"), (None, "a b")], "doc_id long, text string")
    got = [(r.doc_id, r.start_token, r.n_tokens) for r in pack(docs.withColumn("n_tokens", F.lit(0))).collect()]
    assert sorted(x for x in got if x[0] == 3)[0] == (3, 0, CAPACITY)
    assert {x[0] for x in got} == {None, 3, 4, 5}
    assert pack(docs.limit(0)).count() == 0


def test_capacity_is_a_parameter(spark):
    docs = spark.createDataFrame([(i, "strike " * (i % 9 + 1)) for i in range(200)], "doc_id long, text string")
    fill = pack(docs, capacity=16).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    assert fill.agg(F.max("n")).first()[0] <= 16


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_unit_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_key(cells, bits)
    order = np.argsort(keys)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_best_fit():
    names, fresh = pack_window([5, 5, 3, 7, 2, 8], 10, _Open(10), 0)
    assert fresh == 3
    assert names == [2, 2, 1, 1, 0, 0]


def test_texts_far_apart_share_no_container(spark):
    docs = spark.createDataFrame([(i, "ball " * (i % 13 + 1)) for i in range(900)], "doc_id long, text string")
    curve = {r.doc_id: r.curve for r in measure(docs).collect()}
    place = {d: p for p, d in enumerate(sorted(curve, key=lambda d: (curve[d], d)))}
    held = {}
    for r in pack(docs, capacity=64, window_items=50, open_windows=2).collect():
        held.setdefault(r.container_id, []).append(place[r.doc_id])
    assert max(max(p) - min(p) for p in held.values()) < 100
    assert len(held) <= -(-sum(i % 13 + 1 for i in range(900)) // 64) * 1.2 + 1
