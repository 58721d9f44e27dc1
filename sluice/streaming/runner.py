"""Queries over streams: the part that Spark can keep incrementally as a streaming plan, the rest on each micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..functions.values import col, number, text
from ..operators.base import TRAITS, Context, event_order, fresh
from ..operators.columns import value_of
from ..operators.search import filter_frame, time_range
from ..plans import ast
from ..plans.lexer import QueryError
from ..plans.parser import parse
from ..sources.shared import shared_folder

#: Commands that may run on the stream itself, before any aggregate.
ROWWISE = frozenset("search where regex fields table rename eval fillnull strcat replace rex rex4j convert rangemap dedup accum".split())


def split(commands: tuple[ast.Command, ...]) -> tuple[tuple[ast.Command, ...], ast.Command | None, tuple[ast.Command, ...]]:
    """Commands on the stream, an aggregate on it or None, and those on each batch of what these give."""
    head = []
    for i, c in enumerate(commands):
        path = c.options.get("path") or (c.args[0] if c.name == "spath" and c.args else None)
        if c.name in ROWWISE or c.name == "spath" and path:
            head.append(c)
        elif c.name in ("stats", "chart", "timechart"):
            return tuple(head), c, commands[i + 1 :]
        else:
            return tuple(head), None, commands[i:]
    return tuple(head), None, ()


def running_total(df: DataFrame, cmd: ast.Command) -> DataFrame:
    """accum over a stream: the sum so far is the state of one group, as whole and other parts, so that no digit of whole numbers is lost and
    nulls leave it as it is. Only the number and the order of each row pass through the group's task; the row itself goes along as it is."""
    (name,) = cmd.args
    target = cmd.options["as"] or name
    v = value_of(df, name)
    t, n = text(v), number(v)
    whole = v.column.cast("bigint") if v.kind in ("int", "long") else t.try_cast("bigint")
    row, w, p, place, everything = fresh(df, "_row", "_whole", "_part", "_place", "_all")
    kept = [f for f in df.schema.fields if f.name != target]
    packed = df.select(
        F.struct(*[col(f.name) for f in kept]).alias(row), F.when(whole.isNotNull(), whole.cast("string")).alias(w), F.when(whole.isNull(), n).alias(p), F.lit(1).alias(everything),
        F.coalesce(F.date_format(F.to_timestamp(col("_time")), "yyyy-MM-dd HH:mm:ss.SSSSSS") if "_time" in df.columns else F.lit(""), F.lit("")).alias(place),
        (F.coalesce(col("offset").cast("bigint"), F.lit(0)) if "offset" in df.columns else F.lit(0).cast("bigint")).alias(f"{place}2"),
        (F.lit(None).cast("string") if cmd.options["as"] else t).alias("own"),
    )
    packed = packed.withColumn(row, F.to_json(F.struct(col(row).alias("r"))))  # pandas would change columns of whole numbers that have nulls
    state_type = T.StructType([T.StructField("whole", T.StringType()), T.StructField("part", T.DoubleType()), T.StructField("parts", T.BooleanType())])
    schema = T.StructType([T.StructField(row, T.StringType()), T.StructField(target, T.StringType())])

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before, part, parts = state.get if state.exists else ("0", 0.0, False)
        total = int(before)
        rows = pd.concat(list(frames)).sort_values([place, f"{place}2"], kind="stable")
        out = []
        for x, y, own in zip(rows[w], rows[p], rows["own"]):
            if x is None and pd.isna(y):
                out.append(own)
                continue
            if x is not None:
                total += int(x)
            else:
                part, parts = part + float(y), True
            out.append(str(total + part) if parts else str(total))
        state.update((str(total), part, parts))
        yield pd.DataFrame({row: rows[row].to_numpy(), target: out})

    found = packed.groupBy(everything).applyInPandasWithState(step, schema, state_type, "append", "NoTimeout")
    own = T.StructType([T.StructField("r", T.StructType([T.StructField(f.name, f.dataType, True) for f in kept]), True)])
    back = found.select(F.from_json(col(row), own)["r"].alias(row), col(target).alias(target))
    return back.select(*[col(row)[f.name].alias(f.name) for f in kept], col(target))


class StreamRunner:
    """Runs queries over streaming frames with the engine's commands.

    consumer is called with each batch's result and whether it is an aggregate's. Results of aggregates are complete ones, others are the
    batch's rows, the newest first, as many as the recall size.
    """

    def __init__(self, engine: Engine, checkpoint: str | None = None) -> None:
        self.engine, self.checkpoint = engine, checkpoint

    def plan(self, query: str | ast.Query, stream: DataFrame) -> tuple[DataFrame, str, Callable[[DataFrame, int], DataFrame], Context, bool]:
        parsed = parse(query) if isinstance(query, str) else query
        ctx = Context(self.engine, parsed)
        if self.engine.now is not None:
            ctx.now = self.engine.now
        df = stream
        if parsed.search is not None:
            ctx.earliest, ctx.latest = time_range(parsed.search, ctx.now)
            df = filter_frame(df, parsed.search, ctx)
        head, aggregate, tail = split(parsed.commands)
        for c in head:
            df = running_total(df, c) if c.name == "accum" else self.engine.apply(df, (c,), ctx)
        if aggregate is not None:
            df = self.engine.apply(df, (aggregate,), ctx)
        elif any("needs_aggregate" in TRAITS[c.name] for c in tail[:1]):
            raise QueryError(f"Step '{tail[0].name}' requires a preceding aggregate!")
        fixed = aggregate is not None or any("sorts" in TRAITS[c.name] or "aggregate" in TRAITS[c.name] for c in tail)

        def finish(batch: DataFrame, _: int) -> DataFrame:
            inner = Context(self.engine, parsed, ctx.now, ctx.earliest, ctx.latest, aggregate is not None)
            out = self.engine.apply(batch, tail, inner)
            if not fixed and "_time" in out.columns:
                out = self.engine.capped(out.orderBy(col("_time").desc(), *event_order(out)[1:]))
            return out

        return df, "complete" if aggregate is not None else "append", finish, ctx, fixed

    def start(self, query: str | ast.Query, stream: DataFrame, consumer: Callable[[DataFrame, bool], None], processing_time: str | None = None) -> StreamingQuery:
        """Over what is there now, or, with a processing time, on and on."""
        df, mode, finish, _, aggregated = self.plan(query, stream)
        writer = df.writeStream.outputMode(mode).foreachBatch(lambda batch, n: consumer(finish(batch, n), aggregated))
        writer = writer.option("checkpointLocation", self.checkpoint or f"{shared_folder(self.engine.spark)}/stream-{uuid.uuid4().hex}")
        return (writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)).start()

    def run(self, query: str | ast.Query, stream: DataFrame, consumer: Callable[[DataFrame, bool], None], timeout: float | None = None) -> None:
        """Until all that is there is consumed; the first cause of an error is raised."""
        running = self.start(query, stream, consumer)
        try:
            running.awaitTermination(timeout)
        finally:
            running.stop()
