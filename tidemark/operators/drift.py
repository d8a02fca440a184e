"""Problem 3: payload schemas that change by endpoint, file and time.

One parallel scan reads the header (member paths and JSON types) of every
payload and folds it: headers per file, distinct headers, and a profile of the
values under each path.  All later steps work on those folds: types climb a
promotion lattice, renames are told by value profiles, and every departure from
the declared shape is logged once per file.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.jsontext import decode
from tidemark.operators.nested import let
from tidemark.sources import shared_dir

#: A missing field and a new one hold the same content from this overlap of their value profiles on.
SAME_CONTENT = 0.5

_SCAN = "kind string, file_path string, endpoint string, header string, path string, detail string, n bigint"
_CHANGES = "endpoint string, header string, field_path string, change_kind string, new_path string"


def json_type(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "integer" if v.is_integer() else "number"
    return "array" if isinstance(v, list) else "object"


def promote(a: str, b: str) -> str:
    """Least type that holds both: null < boolean, integer < number, array, object < string."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    return "number" if {a, b} == {"integer", "number"} else "string"


def fits(declared: str, seen: str) -> bool:
    return seen in ("null", declared) or (declared == "number" and seen == "integer")


_CLASSES = {**{c: "9" for c in "0123456789"}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}}
_TABLE = {ord(k): v for k, v in _CLASSES.items()} | {c: "w" for c in range(192, 592)}


def _shape_of(s: str) -> str:
    marks = set(s.translate(_TABLE))
    return "s" + "".join(sorted(m for m in marks if m in "9aAw -:./?_[{(,")) + str(len(s).bit_length())


_short_shape = lru_cache(maxsize=1 << 14)(_shape_of)


def value_shapes(v) -> Iterable[str]:
    """Coarse looks of a value, of a list one for each kind of element at any depth: bounded in number, stable under new data of the same kind."""
    if v is None:
        return ("",)
    if isinstance(v, bool):
        return ("b",)
    if isinstance(v, str):
        return (_short_shape(v) if len(v) < 200 else _shape_of(v),)  # only short texts are remembered
    if isinstance(v, (int, float)):
        whole, _, part = repr(abs(v)).partition(".")
        return (f"n{'-' if v < 0 else ''}{min(len(whole), 12)}.{min(len(part.rstrip('0')), 6) and 1}",)
    if isinstance(v, list):
        return {"l" + s for x in v for s in value_shapes(x)} or ("l",)
    return ("o",)


def _scan(declared: dict[str, dict[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile: Counter = Counter()
        headers: set = set()
        names: dict = {}
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in _SCAN.split(", ")])

        def rows(values: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*values), schema)], schema=schema)

        for batch in batches:
            files: Counter = Counter()
            for file_path, endpoint, payload in zip(*(batch[c].to_pylist() for c in ("file_path", "endpoint", "payload"))):
                known = declared.get(endpoint)
                if known is None or payload is None:
                    continue
                try:
                    value = decode(payload)
                except ValueError:
                    continue
                if not isinstance(value, dict):
                    continue
                header, todo = [], [("", value)]
                while todo:
                    prefix, obj = todo.pop()
                    for k, v in obj.items():
                        path, kind = prefix + k, json_type(v)
                        header.append((path, kind))
                        for shape in value_shapes(v):
                            profile[endpoint, path, shape] += 1
                        if kind == "object" and known.get(path) == "object":
                            todo.append((path + ".", v))
                header = tuple(sorted(header))
                name = names.get((endpoint, header))
                if name is None:
                    text = json.dumps(header)
                    name = names[endpoint, header] = hashlib.blake2b(f"{endpoint}\0{text}".encode(), digest_size=12).hexdigest()
                    headers.add((endpoint, name, text))
                files[file_path, endpoint, name] += 1
            if files:
                yield rows([("file", f, e, h, None, None, n) for (f, e, h), n in files.items()])
        if headers:
            yield rows([("header", None, e, h, None, text, 1) for e, h, text in headers])
            yield rows([("value", None, e, None, p, shape, n) for (e, p, shape), n in profile.items()])

    return run


def declared_shapes(payload_fields: DataFrame) -> tuple[dict, dict]:
    """Types and required fields by endpoint.  The declaration is a fixed table, small by nature."""
    types: dict = {}
    required: dict = {}
    for r in payload_fields.where("endpoint is not null and field_path is not null").collect():
        types.setdefault(r.endpoint, {})[r.field_path] = r.json_type
        if r.is_required:
            required.setdefault(r.endpoint, set()).add(r.field_path)
    return types, required


def scan_headers(archive: DataFrame, types: dict) -> DataFrame:
    """The folded headers of all whole-JSON payloads, written once to the shared folder."""
    path = shared_dir(archive.sparkSession, "headers")
    archive.where("payload is not null").select("file_path", "endpoint", "payload").mapInArrow(_scan(types), _SCAN).write.parquet(path)
    return archive.sparkSession.read.parquet(path)


def _overlap(a: Counter, b: Counter) -> float:
    """Share of values alike between two profiles, nulls aside."""
    na, nb = sum(v for k, v in a.items() if k), sum(v for k, v in b.items() if k)
    if not na or not nb:
        return 0.0
    return sum(min(v / na, b[k] / nb) for k, v in a.items() if k)


def _parent(path: str) -> str:
    return path.rpartition(".")[0]


def header_changes(endpoint: str, headers: list[tuple[str, list]], profile: dict[str, Counter], types: dict, required: set) -> list[tuple]:
    """(header, field_path, change_kind, new_path) of one endpoint's distinct headers."""
    views = [(name, dict(fields)) for name, fields in headers]
    beside: Counter = Counter()
    for _, view in views:
        for new in view:
            if new not in types:
                for old in required:
                    if _parent(old) == _parent(new) and old in view:
                        beside[old, new] += 1
    score: dict = {}

    def likeness(old: str, new: str) -> float:
        # a field that stands beside the declared one anywhere is not its new name
        if (old, new) not in score:
            score[old, new] = 0.0 if beside[old, new] else _overlap(profile.get(old, Counter()), profile.get(new, Counter()))
        return score[old, new]

    out = []
    for name, view in views:
        missing = [f for f in required if f not in view]
        extra = [f for f in view if f not in types]
        pairs = sorted(
            ((-likeness(o, n), o, n) for o in missing for n in extra if _parent(o) == _parent(n) and likeness(o, n) >= SAME_CONTENT)
        )
        renamed: dict = {}
        for _, o, n in pairs:
            if o not in renamed and n not in renamed.values():
                renamed[o] = n
        out += [(name, o, "renamed", n) for o, n in renamed.items()]
        out += [(name, f, "removed", None) for f in missing if f not in renamed]
        taken = set(renamed.values())
        out += [(name, f, "added", None) for f in extra if f not in taken]
        out += [(name, f, "type", None) for f, kind in view.items() if f in types and not fits(types[f], kind)]
    return out


def classify_headers(scanned: DataFrame, types: dict, required: dict) -> DataFrame:
    """endpoint, header, field_path, change_kind, new_path for every distinct header.

    One task per endpoint sees that endpoint's distinct headers and its value
    profile; both depend on how many shapes there are, not on how many rows.
    """
    folded = scanned.where("kind <> 'file'").groupBy("kind", "endpoint", "header", "path", "detail").agg(F.sum("n").alias("n"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        endpoint = pdf["endpoint"].iloc[0]
        heads = [(h, json.loads(t)) for h, t in pdf.loc[pdf["kind"] == "header", ["header", "detail"]].itertuples(index=False)]
        profile: dict[str, Counter] = {}
        for path, shape, n in pdf.loc[pdf["kind"] == "value", ["path", "detail", "n"]].itertuples(index=False):
            profile.setdefault(path, Counter())[shape] += n
        found = header_changes(endpoint, heads, profile, types.get(endpoint, {}), required.get(endpoint, set()))
        return pd.DataFrame([(endpoint, *x) for x in found], columns=[c.split()[0] for c in _CHANGES.split(", ")])

    return folded.groupBy("endpoint").applyInPandas(work, _CHANGES)


def drift_report(archive: DataFrame, payload_fields: DataFrame) -> DataFrame:
    """file_path, endpoint, field_path, change_kind: one row per file and departure.

    Null payloads, cut JSON, JSON that is no object, and endpoints without a
    declaration give no row; repeated rows change nothing; an empty archive
    gives an empty report.
    """
    types, required = declared_shapes(payload_fields)
    scanned = scan_headers(archive, types)
    changes = classify_headers(scanned, types, required)
    files = scanned.where("kind = 'file'").select("file_path", "endpoint", "header").distinct()
    return files.join(changes.drop("new_path"), ["endpoint", "header"]).select("file_path", "endpoint", "field_path", "change_kind").distinct()


# -- the consistent table ----------------------------------------------------

_SQL_TYPES = {"boolean": "boolean", "integer": "bigint", "number": "double", "null": "string"}


def union_schemas(scanned: DataFrame, types: dict, changes: DataFrame) -> dict[str, dict[str, tuple[str, list[str]]]]:
    """endpoint -> path -> (promoted JSON type, names it goes by), folded over all headers of every declared endpoint."""
    seen = (
        scanned.where("kind = 'header'").select("endpoint", F.explode(F.from_json("detail", "array<array<string>>")).alias("f"))
        .select("endpoint", F.col("f")[0].alias("path"), F.col("f")[1].alias("type"))
        .distinct()
    )
    names = changes.where("change_kind = 'renamed'").select("endpoint", "field_path", "new_path").distinct()
    also: dict[str, dict[str, list[str]]] = {e: {} for e in types}
    for r in names.collect():  # pairs of field names: as many as the endpoints have fields
        also[r.endpoint].setdefault(r.field_path, []).append(r.new_path)
    aliases = {(e, n): o for e, fields in also.items() for o, ns in fields.items() for n in ns}
    out: dict[str, dict[str, str]] = {e: dict(t) for e, t in types.items()}
    for r in sorted(seen.collect()):
        path, fields = aliases.get((r.endpoint, r.path), r.path), out[r.endpoint]
        fields[path] = promote(fields.get(path, "null"), r.type)
    return {e: {p: (t, [p, *sorted(also[e].get(p, []))]) for p, t in sorted(fields.items())} for e, fields in out.items()}


def _picks(fields: dict[str, tuple[str, list[str]]], declared: dict[str, str]) -> tuple[str, dict]:
    """Schema to read an endpoint's payloads with, and path -> function of the value read to its typed column."""
    objects = {p for p, t in declared.items() if t == "object"}
    leaves = {p: v for p, v in fields.items() if p not in objects}
    tree: dict = {}
    for path, (_, names) in leaves.items():
        for n in names:
            parent, _, leaf = n.rpartition(".")
            tree.setdefault(parent if parent in objects else "", set()).add(leaf if parent in objects else n)
    ddl = [f"`{n}` string" for n in sorted(tree.get("", ()))]
    ddl += [f"`{p}` struct<{', '.join(f'`{n}`: string' for n in sorted(tree[p]))}>" for p in sorted(objects) if p in tree]

    def pick(kind: str, names: list[str]):
        def of(v: Column) -> Column:
            got = F.coalesce(*[v[n.rpartition(".")[0]][n.rpartition(".")[2]] if n.rpartition(".")[0] in objects else v[n] for n in names])
            typed = got.try_cast(_SQL_TYPES.get(kind, "string"))
            return F.coalesce(typed, got.try_cast("double").try_cast("bigint")) if kind == "integer" else typed  # 7.0 is an integer too

        return of

    return ", ".join(ddl), {p: pick(*v) for p, v in leaves.items()}


def _schemas(archive: DataFrame, payload_fields: DataFrame, endpoint: str | None = None) -> dict[str, tuple[str, dict]]:
    """endpoint -> what _picks gives, of every declared endpoint (or the one asked for), by one header scan."""
    types, required = declared_shapes(payload_fields)
    if endpoint is not None:
        archive, types = archive.where(F.col("endpoint") == endpoint), {endpoint: types.get(endpoint, {})}
    scanned = scan_headers(archive, types)
    unions = union_schemas(scanned, types, classify_headers(scanned, types, required))
    return {e: _picks(fields, types[e]) for e, fields in unions.items()}


def _whole(archive: DataFrame) -> DataFrame:
    return archive.where(F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{"))


def consistent_table(archive: DataFrame, payload_fields: DataFrame, endpoint: str) -> DataFrame:
    """All whole payloads of an endpoint as one table of the union schema.

    Renamed fields come back under their declared name; scalars are cast to
    their promoted type (null if a text can't be cast); arrays and undeclared
    objects stay JSON text.  Nested declared fields become ``parent_child``
    columns.  file_path and file_row tell where each row is from.
    """
    ddl, picks = _schemas(archive, payload_fields, endpoint)[endpoint]
    whole = _whole(archive.where(F.col("endpoint") == endpoint)).select("file_path", "file_row", F.from_json("payload", ddl).alias("v"))
    return whole.select("file_path", "file_row", *[of(F.col("v")).alias(p.replace(".", "_")) for p, of in picks.items()])


def _cells(value: Column, picks: dict) -> Column:
    typed = {p: of(value) for p, of in picks.items()}
    return F.array(*[F.struct(F.lit(p).alias("field"), F.typeof(c).alias("type"), c.cast("string").alias("value")) for p, c in typed.items()])


def consistent_fields(archive: DataFrame, payload_fields: DataFrame) -> DataFrame:
    """The consistent tables of all declared endpoints as one long table: endpoint, file_path, file_row, field, type, value.

    One header scan serves all endpoints, one more scan casts.  A row per whole
    payload and field of its endpoint's union schema; value is the text of the
    cast value, null where the payload hasn't got the field.
    """
    cells, found = None, _schemas(archive, payload_fields)
    for endpoint, (ddl, picks) in found.items():
        hit, value = F.col("endpoint") == endpoint, let(F.from_json("payload", ddl), lambda v: _cells(v, picks))  # noqa: B023
        cells = F.when(hit, value) if cells is None else cells.when(hit, value)
    if cells is None:
        cells = F.lit(None).cast("array<struct<field:string,type:string,value:string>>")
    whole = _whole(archive.where(F.col("endpoint").isin(*found)))
    return whole.select("endpoint", "file_path", "file_row", F.inline(cells))
