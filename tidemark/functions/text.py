"""Text and calendar helpers: names met in texts, labels inside payloads, day bounds, redaction."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members whose texts are worth showing.
LABELS = (
    "title", "subtitle", "sub_title", "yes_sub_title", "no_sub_title", "name", "ticker", "event_ticker", "series_ticker", "home_team", "away_team", "rules_primary",
)

# letters with marks, and what they are without
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def folded(c: Column) -> Column:
    """Lower case without marks; anything but letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), _MARKED, _PLAIN), "[^a-z0-9]+", " "))


def mentions(texts: DataFrame, text: str, names: DataFrame, name: str, longest: int = 6) -> DataFrame:
    """Rows of ``texts`` beside the rows of ``names`` whose name stands in them as whole words.

    Every run of up to ``longest`` words meets the names by an equi-join;
    longer names raise, so none is missed.
    """
    words = F.split(folded(F.col(text)), " ")
    runs = lambda k: F.when(F.size("_w") >= k, F.transform(F.sequence(F.lit(1), F.size("_w") - k + 1), lambda i: F.array_join(F.slice("_w", i, k), " "))).otherwise(F.array().cast("array<string>"))
    each = texts.withColumn("_w", words).withColumn("_run", F.explode(F.array_distinct(F.flatten(F.array(*[runs(k) for k in range(1, longest + 1)]))))).drop("_w")
    key = folded(F.col(name))
    checked = F.when(F.size(F.split(key, " ")) > longest, F.raise_error(F.lit(f"a name of more than {longest} words")).cast("string")).otherwise(key)
    return each.join(names.withColumn("_run", checked).where("_run <> ''"), "_run").drop("_run")


def _walk(value, out: list[str]) -> None:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                if k in LABELS and isinstance(x, str):
                    out.append(x)
                else:
                    todo.append(x)
        elif isinstance(v, list):
            todo.extend(v)


def labels(payloads: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """keys, label: the distinct texts under label members at any depth of each JSON payload; unreadable payloads give none."""
    slim = payloads.where(F.col(body).isNotNull()).select(*keys, F.col(body).alias("_body"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in slim.schema if f.name != '_body')}, label string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch["_body"].to_pylist()):
                held: list[str] = []
                try:
                    _walk(json.loads(text), held)
                except (ValueError, RecursionError):
                    continue
                new = [x for x in dict.fromkeys(held) if x]
                found += new
                rows += [i] * len(new)
            if rows:
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch[k].take(at) for k in keys], pa.array(found, pa.string())], [*keys, "label"])

    return slim.mapInArrow(run, schema)


def day_bounds(day: Column, zone: Column) -> tuple[Column, Column]:
    """The instants at which a local day starts and ends; a day with a clock change has 23 or 25 hours."""
    midnight = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone)
    return midnight(day), midnight(F.date_add(day, 1))


def date_chunks(start: Column, stop: Column, days: int) -> Column:
    """Array of (start, stop) of ``days`` days each, both ends inclusive; the last may be shorter."""
    firsts = F.sequence(start, stop, F.make_dt_interval(days=F.lit(days)))
    return F.transform(firsts, lambda d: F.struct(d.cast("date").alias("start"), F.least(F.date_add(d.cast("date"), days - 1), stop).alias("stop")))


def redact(url: Column) -> Column:
    """Keys and tokens of a query string are blotted out."""
    return F.regexp_replace(url, "(?i)((?:api_?key|token)=)[^&]*", "$1***")


def safe_component(c: Column) -> Column:
    """A text that may stand in a path."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9._-]+", "_")
