"""Table specifications and the guards that keep labels and closing prices out of features."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


class Kind(Enum):
    META = "meta"
    DIMENSION = "dimension"
    FACT = "fact"
    OUTCOME = "outcome"
    CLOSING = "closing"


class LeakError(PermissionError):
    """A read that would show a feature what it must not know."""


@dataclass(frozen=True)
class TableSpec:
    """What a versioned table promises: its key, its clocks, and who may read it."""

    name: str
    kind: Kind
    key: tuple[str, ...]
    schema: StructType = field(hash=False)
    known_at: str | None = "as_of_ts"
    event_at: str | None = None
    dynamic: bool = False
    required: tuple[str, ...] = ()

    def check(self) -> None:
        """Raise ValueError unless key, clocks and required columns are in the schema."""
        names = set(self.schema.fieldNames())
        wanted = {*self.key, *self.required, *filter(None, (self.known_at, self.event_at))}
        if missing := wanted - names:
            raise ValueError(f"{self.name} lacks {sorted(missing)}")
        if self.kind is not Kind.META and not self.known_at:
            raise ValueError(f"{self.name} has no availability column")


def guard(spec: TableSpec, allow_outcomes: bool = False) -> None:
    """Refuse closing tables always, outcomes unless asked for, and tables without an availability column."""
    if spec.kind is Kind.CLOSING:
        raise LeakError(f"{spec.name} holds closing values; use the sanctioned reader")
    if spec.kind is Kind.OUTCOME and not allow_outcomes:
        raise LeakError(f"{spec.name} holds outcomes")
    if spec.known_at is None:
        raise LeakError(f"{spec.name} has no availability column")


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The frame itself; ValueError if it lacks a required column."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing required columns {missing}")
    return df


def align(df: DataFrame, target: StructType) -> DataFrame:
    """Project to the target's columns in order; bad values and missing columns become null, others fall away."""
    held = {f.name: f.dataType for f in df.schema}

    def one(name: str, to: DataType) -> F.Column:
        if name not in held:
            return F.lit(None).cast(to).alias(name)
        return (F.col(name) if held[name] == to else F.col(name).try_cast(to)).alias(name)

    return df.select(*[one(f.name, f.dataType) for f in target])


def evolve(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """``table`` with typed nulls for the columns only the incoming frame has."""
    new = [f for f in incoming.schema if f.name not in table.columns]
    return table.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])
