"""Problem 2 against a plain set of canonical records."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.jsontext import value_text
from tidemark.operators import compaction
from tidemark.operators.compaction import compact, first_fit_decreasing
from tidemark.sources import load


def canon(text):
    try:
        return 1, json.dumps(json.loads(text, parse_float=lambda x: int(float(x)) if float(x).is_integer() else float(x)), sort_keys=True)
    except (ValueError, TypeError):
        return 0, text


def surplus(rows):
    seen, out = set(), set()
    for r in sorted(rows, key=lambda r: (r.file_path, r.file_row)):
        body = canon(r.payload)
        k = (r.venue, r.endpoint, r.key, r.fetched_at, canon(r.request_params), body, None if body[0] else r.error)
        if k in seen:
            out.add((r.file_path, r.file_row))
        seen.add(k)
    return out


def test_whole_table(spark, data):
    archive = load(spark, data, "poll_archive")
    rows = archive.collect()
    done = compact(archive, target_bytes=1 << 20)
    assert {tuple(r) for r in done.surplus(spark).collect()} == surplus(rows)
    out = done.data(spark)
    assert out.count() == done.rows_out == len(rows) - len(surplus(rows))
    assert done.files_out < done.files_in / 50
    assert out.columns == archive.columns
    left = archive.join(done.surplus(spark), ["file_path", "file_row"], "left_anti").select(archive.columns)
    assert left.exceptAll(out).count() == 0
    sizes = done.plan(spark).groupBy("bin").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b <= 1 << 20 or r.n == 1 for r in sizes)


def test_a_target_is_never_overwritten(spark, data, tmp_path):
    archive = load(spark, data, "poll_archive").limit(20)
    target = str(tmp_path / "out")
    compact(archive, target)
    with pytest.raises(RuntimeError):
        compact(archive, target)


def test_corner_rows(spark, data):
    schema = load(spark, data, "poll_archive").schema
    at = load(spark, data, "poll_archive").first().fetched_at
    base = ["f1", 0, "v", "e", None, at, 200, None, None, None, None, None, None, None]

    def row(**kw):
        return tuple(kw.get(f.name, b) for f, b in zip(schema, base))

    rows = [
        row(), row(file_row=1), row(file_row=2, error="x"), row(file_path="f0", file_row=5, payload='{"a": 1, "b": [1.0]}'),
        row(file_row=3, payload='{"b":[1],"a":1e0}', error="other", http_status=500), row(file_row=4, payload='{"a": 1, "b": [1.5]}'),
        row(file_row=6, payload='{"a": 1'), row(file_row=7, payload='{"a": 1'), row(file_row=8, payload='{"a": 1', error="y"),
        row(file_row=9, key="null"), row(file_row=10, payload="x" * 300_000), row(file_row=11, payload="[" * 5000), row(file_row=12, payload=""),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in compact(df).surplus(spark).collect()}
    assert got == {("f1", 1), ("f1", 3), ("f1", 7)}
    wide = df.withColumn("digest", F.lit("clash")).withColumns({"bytes": F.lit(None).cast("string"), "piece": F.lit(7), "bin": F.lit("b"), "n": F.lit(1)})
    done = compact(wide)
    assert done.rows_out == len(rows) - 3
    assert done.data(spark).where("piece = 7 and bin = 'b'").count() == done.rows_out
    empty = compact(df.limit(0))
    assert (empty.rows_in, empty.files_out) == (0, 0) and empty.surplus(spark).count() == 0


def test_one_file_with_a_third_of_the_rows(spark, data):
    archive = load(spark, data, "poll_archive")
    hot = archive.withColumn("file_path", F.when(F.col("file_row") == 0, F.lit("hot")).otherwise(F.col("file_path")))
    hot = hot.withColumn("file_row", F.pmod(F.xxhash64("fetched_at", "payload", "request_params", "key"), F.lit(2_000_000_000)).cast("int"))
    done = compact(hot, target_bytes=1 << 20)
    assert done.rows_out + done.surplus(spark).count() == hot.count()


def test_first_fit_decreasing():
    sizes = [4, 8, 1, 4, 2, 1, 12, 0]
    bins = first_fit_decreasing(sizes, 10)
    fill = {}
    for b, s in zip(bins, sizes):
        fill.setdefault(b, []).append(s)
    assert all(sum(v) <= 10 or len([x for x in v if x]) == 1 for v in fill.values())
    assert len(fill) == 3
    assert first_fit_decreasing([], 10) == []


@pytest.mark.parametrize("a, b, same", [('{"a":1}', '{ "a" : 1.0 }', True), ("1", "true", False), ('"\\u00e9"', '"é"', True), ("1e2", "100", True), ("NaN", "NaN", None), ("1.5", "1.50", True)])
def test_json_values(a, b, same):
    assert (value_text(a) == value_text(b) if same is not None else value_text(a)) == same


def test_a_failed_run_leaves_nothing(spark, data, tmp_path, monkeypatch):
    archive = load(spark, data, "poll_archive").limit(50)
    target = tmp_path / "out"

    def broken(*_):
        raise RuntimeError("bins differ")

    with monkeypatch.context() as m:
        m.setattr(compaction, "_verify", broken)
        with pytest.raises(RuntimeError, match="differ"):
            compact(archive, str(target))
    assert compaction.committed(spark, str(target)) is None and not list(target.glob("run-*"))
    done = compact(archive, str(target))
    assert compaction.committed(spark, str(target)) == done.path and done.data(spark).count() == done.rows_out


def test_a_folder_of_files(spark, data, tmp_path):
    rows = load(spark, data, "poll_archive").limit(40).drop("file_path", "file_row")
    for k in range(3):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    archive = compaction.read_folder(spark, str(tmp_path / "in"))
    assert archive.select("file_path").distinct().count() == 3 and archive.select("file_path", "file_row").distinct().count() == 120
    done = compact(archive)
    assert (done.rows_in, done.files_in) == (120, 3) and done.rows_out <= 40 and done.files_out == 1
