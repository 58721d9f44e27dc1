"""The engine: queries to DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import col
from .operators import aggregate, columns, joins, order, search, system  # noqa: F401 (they register their commands)
from .operators.base import COMMANDS, TRAITS, Context
from .operators.search import filter_frame, time_range
from .plans import ast
from .plans.lexer import QueryError
from .plans.parser import parse
from .sources import sinks
from .sources.events import EVENT_COLUMNS, empty

RECALL_SIZE = 10_000
#: Settings of a query besides the recall size.
SETTINGS = {"post-limit": 0, "query-timeout": 0, "trigger": "0 milliseconds", "mail-server": "localhost:25", "syslog-port": 1601}


class Engine:
    """Plans and runs queries.

    catalog maps index names to event frames (TableCatalog does); or source is one frame of all events. networks is the table of iplocation.
    senders take the payloads of kafka, syslog, metric, bloom and mail commands: (payload, options); those not given go to Kafka, a syslog port,
    a metric endpoint, a JDBC table and a mail server, as their options say. recall_size is the number of rows that
    sorted and delivered results are cut to; None cuts nothing.
    """

    def __init__(self, spark: SparkSession, catalog=None, source: DataFrame | None = None, recall_size: int | None = RECALL_SIZE, config: dict | None = None, networks: DataFrame | None = None, senders: dict[str, Callable] | None = None, now: datetime | None = None, restricted_mail: bool = False) -> None:
        self.spark, self.catalog, self.frame, self.recall_size = spark, catalog, source, recall_size
        self.config = SETTINGS | {"recall-size": recall_size} | (config or {})
        self.networks, self.senders, self.now, self.restricted_mail = networks, senders or {}, now, restricted_mail

    # What commands use

    def capped(self, df: DataFrame) -> DataFrame:
        return df if self.recall_size is None else df.limit(self.recall_size)

    def send(self, kind: str, payload: DataFrame, options: dict) -> None:
        given = self.senders | {k: f for k, f in sinks.SENDERS.items() if k not in self.senders}
        if kind not in given:
            raise QueryError(f"the engine has no sender for {kind}")
        given[kind](payload, options)

    def send_mail(self, mail, options: dict) -> None:
        self.senders.get("mail", sinks.send_mail)(mail, options)

    def set_config(self, key: str, value: str) -> None:
        """An existing setting, of the type it has."""
        if key not in self.config:
            raise QueryError(f"no setting {key}")
        old = self.config[key]
        try:
            new = value.lower() in ("true", "t") if isinstance(old, bool) else type(old)(value) if old is not None else int(value)
        except ValueError as e:
            raise QueryError(f"{key} can't be {value}") from e
        self.config[key] = new
        if key == "recall-size":
            self.recall_size = new

    def source(self, condition: object | None) -> DataFrame:
        """The events that a condition can be about: of the indexes it names, if a catalog has them apart."""
        if self.frame is not None:
            return self.frame
        if self.catalog is None or condition is None:
            return empty(self.spark)
        positive = self._indexes(condition)
        names = [n for n in self.catalog.names() if positive is None or any(_matches(n, p) for p in positive)]
        if not names:
            return empty(self.spark)
        if len(names) == 1:
            return self.catalog[names[0]]
        return reduce(lambda a, b: a.unionByName(b), [self.catalog[n].select(*[col(c) for c in EVENT_COLUMNS]) for n in names])

    def _indexes(self, node: object) -> list[str] | None:
        """Patterns of which the index must match one; None if it may be any."""
        if isinstance(node, ast.Compare) and node.field.lower() == "index" and node.op == "=":
            return [node.value]
        if isinstance(node, ast.Member) and node.field.lower() == "index":
            return list(node.values)
        if isinstance(node, ast.Logic):
            a, b = self._indexes(node.left), self._indexes(node.right)
            if node.op == "or":
                return None if a is None or b is None else a + b
            return b if a is None else a
        return None

    # Planning

    def plan(self, query: ast.Query | str, outer: Context | None = None) -> DataFrame:
        if isinstance(query, str):
            query = parse(query)
        ctx = Context(self, query)
        if outer is not None:
            ctx.now = outer.now
        elif self.now is not None:
            ctx.now = self.now
        if query.search is None:
            df = empty(self.spark) if self.frame is None else self.frame
        else:
            ctx.earliest, ctx.latest = time_range(query.search, ctx.now)
            df = filter_frame(self.source(query.search), query.search, ctx)
        return self.apply(df, query.commands, ctx)

    def apply(self, df: DataFrame, commands: tuple[ast.Command, ...], ctx: Context) -> DataFrame:
        for c in commands:
            if "needs_aggregate" in TRAITS[c.name] and not ctx.aggregated:
                raise QueryError(f"Step '{c.name}' requires a preceding aggregate!")
            df = COMMANDS[c.name](df, c, ctx)
            ctx.aggregated = ctx.aggregated or "aggregate" in TRAITS[c.name]
        return df

    def run(self, query: str) -> DataFrame:
        """The query's whole result."""
        return self.plan(query)

    def deliver(self, query: str, consumer: Callable[[DataFrame, bool], None] | None = None) -> DataFrame:
        """The result as it is shown: the newest events, as many as the recall size, unless a command has ordered or aggregated them."""
        parsed = parse(query)
        df = self.plan(parsed)
        aggregated = any("aggregate" in TRAITS[c.name] for c in parsed.commands)
        if not aggregated and not any("sorts" in TRAITS[c.name] for c in parsed.commands) and "_time" in df.columns:
            df = self.capped(df.orderBy(F.desc("_time")))
        most = self.config.get("post-limit")
        if most:
            df = df.limit(int(most))
        if consumer:
            consumer(df, aggregated)
        return df

    def latest_time(self, query: str) -> DataFrame:
        """(latest): of the events that the query's search finds."""
        parsed = parse(query)
        return self.plan(ast.Query(parsed.search)).agg(F.max("_time").alias("latest"))


def _matches(name: str, pattern: str) -> bool:
    return re.fullmatch(".*".join(map(re.escape, pattern.lower().split("*"))), name.lower()) is not None

