"""Problem 3: planted departures, and the whole table against a walk with known renames."""

import json
from collections import Counter

import pytest

from tidemark.operators.drift import consistent_fields, consistent_table, declared_shapes, drift_report, fits, json_type, promote
from tidemark.plans.core_queries import ENDPOINTS, QUERIES
from tidemark.sources import load

FIELDS = [
    ("e", "id", "string", True), ("e", "n", "integer", True), ("e", "x", "number", True), ("e", "o", "object", True),
    ("e", "o.stamp", "string", True), ("e", "o.list", "array", False), ("e", "note", "string", False),
]


def run(spark, payloads):
    archive = spark.createDataFrame([(f"f{i}", 0, "e", p) for i, p in enumerate(payloads)], "file_path string, file_row int, endpoint string, payload string")
    fields = spark.createDataFrame(FIELDS, "endpoint string, field_path string, json_type string, is_required boolean")
    return archive, fields


def good(i, **over):
    d = {"id": f"ab{i:04d}", "n": i + 10, "x": i + 0.25, "o": {"stamp": f"2021-01-{i % 27 + 1:02d}T00:00:00Z"}}
    d.update(over)
    return d


def test_planted(spark):
    plain = [good(i) for i in range(30)]
    odd = [
        good(1, extra=True), good(2, n="7"), good(3, n=7.5), good(4, n=7.0), good(5, x=3), good(6, x=None), good(7, note=5),
        {k: v for k, v in good(8).items() if k != "n"}, good(9, o={"when": "2021-02-03T10:00:00Z"}), good(10, o={"stamp": "2021-02-03T10:00:00Z", "deep": {"a": 1}}),
        good(11, o="gone"), {**{k: v for k, v in good(12).items() if k != "id"}, "remark": "see the notice, please"},
    ]
    texts = [json.dumps(p) for p in plain + odd] + ['{"id": "cut', None, "[1, 2]", "3", ""]
    archive, fields = run(spark, texts)
    got = {(int(r.file_path[1:]) - 30, r.field_path, r.change_kind) for r in drift_report(archive.unionAll(archive), fields).collect()}
    assert got == {
        (0, "extra", "added"), (1, "n", "type"), (2, "n", "type"), (6, "note", "type"), (7, "n", "removed"), (8, "o.stamp", "renamed"),
        (9, "o.deep", "added"), (10, "o", "type"), (10, "o.stamp", "removed"), (11, "id", "removed"), (11, "remark", "added"),
    }
    table = {r.file_path: r for r in consistent_table(archive, fields, "e").collect()}
    assert len(table) == 42
    assert table["f38"].o_stamp == "2021-02-03T10:00:00Z" and table["f0"].x == 0.25 and table["f31"].n == "7"


def test_whole_table(spark, data):
    archive, fields = load(spark, data, "poll_archive"), load(spark, data, "payload_fields")
    types, required = declared_shapes(fields)
    renames = {
        "asset_id": "token_id", "endDate": "end_date_iso", "hourly.temperature_2m": "hourly.temp_2m", "longitude": "lon", "close_time": "closeTime",
        "volume": "contracts_traded", "bookmaker.last_update": "bookmaker.updated", "commence_time": "start_time", "orderbook.yes": "orderbook.yes_levels",
    }
    want = set()
    for r in archive.select("file_path", "endpoint", "payload").collect():
        try:
            doc = json.loads(r.payload)
        except (ValueError, TypeError):
            continue
        view, todo = {}, [("", doc)]
        while todo:
            pre, obj = todo.pop()
            for k, v in obj.items():
                view[pre + k] = json_type(v)
                if isinstance(v, dict) and types[r.endpoint].get(pre + k) == "object":
                    todo.append((pre + k + ".", v))
        new = set()
        for f in required[r.endpoint]:
            if f not in view:
                hit = renames.get(f) in view
                want.add((r.file_path, r.endpoint, f, "renamed" if hit else "removed"))
                new |= {renames[f]} if hit else set()
        for f, t in view.items():
            if f not in types[r.endpoint] and f not in new:
                want.add((r.file_path, r.endpoint, f, "added"))
            elif f in types[r.endpoint] and not fits(types[r.endpoint][f], t):
                want.add((r.file_path, r.endpoint, f, "type"))
    got = [tuple(r) for r in drift_report(archive, fields).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want and Counter(x[3] for x in want).keys() == {"renamed", "removed", "added", "type"}


def test_empty(spark):
    archive, fields = run(spark, [])
    assert drift_report(archive, fields).count() == 0
    archive, fields = run(spark, [None, "{}"])
    assert drift_report(archive, fields.limit(0)).count() == 0


@pytest.mark.parametrize("a, b, both", [("null", "array", "array"), ("integer", "number", "number"), ("boolean", "integer", "string"), ("object", "object", "object"), ("array", "string", "string")])
def test_lattice(a, b, both):
    assert promote(a, b) == promote(b, a) == both


def test_every_endpoint_has_its_table(spark, data):
    archive, fields = load(spark, data, "poll_archive"), load(spark, data, "payload_fields")
    declared = {r.endpoint for r in fields.collect()}
    assert set(ENDPOINTS) == declared and all(f"p3_{e}_table" in QUERIES for e in declared)
    want: dict = {}
    for r in archive.select("endpoint", "file_path", "file_row", "payload").collect():
        try:
            doc = json.loads(r.payload)
        except (ValueError, TypeError):
            continue
        if r.endpoint in declared and isinstance(doc, dict):
            want[r.endpoint, r.file_path, r.file_row] = doc
    got: dict = {}
    for r in consistent_fields(archive, fields).collect():
        got.setdefault((r.endpoint, r.file_path, r.file_row), {})[r.field] = r.value
    assert got.keys() == want.keys() and {e for e, _, _ in got} == declared
    for key, doc in want.items():
        for name, value in doc.items():
            if isinstance(value, str) and name in got[key]:
                assert got[key][name] == value, (key, name)
    table = QUERIES["p3_odds_table"](spark, data)
    assert table.count() == sum(e == "odds" for e, _, _ in want)
    for r in table.collect():
        cells = got["odds", r.file_path, r.file_row]
        assert r.bookmaker_last_update == cells["bookmaker.last_update"] and r.id == cells["id"]


def test_whole_numbers_with_a_point(spark):
    archive, fields = run(spark, [json.dumps(good(1)), json.dumps(good(2, n=7.0))])
    assert {r.file_path: r.n for r in consistent_table(archive, fields, "e").collect()} == {"f0": 11, "f1": 7}
    assert consistent_fields(archive, fields.limit(0)).count() == 0


def test_profiles_see_whole_texts_and_lists():
    from tidemark.operators.drift import value_shapes

    assert set(value_shapes("a" * 300)) != set(value_shapes("a" * 150 + "7" + "a" * 149))  # the middle counts
    assert set(value_shapes([1, "a"])) == {"ln1.0", "lsa1"} and set(value_shapes([["x"], [2.5]])) == {"llsa1", "lln1.1"}
    assert tuple(value_shapes([])) == ("l",) and tuple(value_shapes(None)) == ("",) and tuple(value_shapes(True)) == ("b",)
