"""join with a subsearch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import col
from ..plans import ast
from ..plans.lexer import QueryError
from .base import Context, command, event_order


@command("join")
def join(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """Rows with those of the subsearch's first max rows (0: all of them) that have the same keys.

    The subsearch's columns that clash fill nulls of the left ones if overwrite is on, and come as R_name if not. With usetime a match must be
    earlier, or later, than the left row.
    """
    o = cmd.options
    right = ctx.engine.plan(o["query"], ctx)
    for side, frame in (("left", df), ("right", right)):
        missing = [k for k in cmd.args if k not in frame.columns]
        if missing:
            raise QueryError(f"join: the {side} side has no field {', '.join(missing)}")
    if o["max"]:
        right = right.orderBy(*event_order(right)).limit(o["max"])
    renamed = right.select(*[col(c).alias(f"R_{c}") for c in right.columns])
    condition = reduce(lambda p, q: p & q, [col(k) == col(f"R_{k}") for k in cmd.args])
    if o["usetime"]:
        condition = condition & (col("_time") >= col("R__time") if o["earlier"] else col("_time") <= col("R__time"))
    joined = df.join(renamed, condition, "inner" if o["type"] == "inner" else "left")
    extra = [c for c in right.columns if c not in cmd.args]
    if not o["overwrite"]:
        return joined.select(*[col(c) for c in df.columns], *[col(f"R_{c}") for c in extra])
    clash = [c for c in extra if c in df.columns]
    left = [F.coalesce(col(c), col(f"R_{c}").cast(df.schema[c].dataType)).alias(c) if c in clash else col(c) for c in df.columns]
    return joined.select(*left, *[col(f"R_{c}") for c in extra if c not in clash])
