"""What commands are given, and how they are found by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Command, Query
from ..functions.values import col

if TYPE_CHECKING:
    from ..engine import Engine

COMMANDS: dict[str, Callable[[DataFrame, Command, Context], DataFrame]] = {}
#: Traits: aggregate (rows of a result depend on many), sequential (needs a finished input), sorts (fixes the order of rows).
TRAITS: dict[str, frozenset[str]] = {}


@dataclass
class Context:
    engine: Engine
    query: Query
    now: datetime = field(default_factory=lambda: datetime.now(UTC))
    earliest: datetime | None = None
    latest: datetime | None = None
    aggregated: bool = False


def command(*names: str, traits: tuple[str, ...] = ()):
    def register(f):
        for n in names:
            COMMANDS[n] = f
            TRAITS[n] = frozenset(traits)
        return f

    return register


def event_order(df: DataFrame) -> list[Column]:
    """The order of events: _time, offset, then a hash of the row."""
    have = [col(c) for c in ("_time", "offset") if c in df.columns]
    return [*have, F.xxhash64(*[col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()])]


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection: columns replaced where they are, new ones at the end; names are taken literally."""
    kept = [new[c].alias(c) if c in new else col(c) for c in df.columns]
    return df.select(*kept, *[v.alias(c) for c, v in new.items() if c not in df.columns])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to clash with no column of df (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
