"""sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import NUMERIC, Value, col, kind_of, number, text
from ..plans import ast
from ..plans.lexer import QueryError
from .base import Context, command


def address_parts(ip: Column) -> Column:
    """The four numbers of a dotted address, whatever their size; null for other texts."""
    parts = F.split(ip, r"\.")
    return F.when(ip.rlike(r"^\d{1,18}(\.\d{1,18}){3}$"), F.array(*[F.get(parts, k).try_cast("bigint") for k in range(4)]))


def sort_columns(df: DataFrame, key: ast.SortKey) -> list[Column]:
    """Ordering columns of a key. auto goes by the column's type; texts that are numbers come first, by value, then addresses, by their four numbers (ip
    goes by these too, also where one is over 255), then other texts."""
    if key.field not in df.columns:
        raise QueryError(f"sort: no field {key.field}")
    v = Value(col(key.field), kind_of(df.schema[key.field].dataType))
    if key.kind == "str":
        keys = [text(v)]
    elif key.kind == "num":
        keys = [v.column if v.kind in NUMERIC else number(v)]
    elif key.kind == "ip":
        keys = [address_parts(text(v)), text(v)]
    elif v.kind == "str":
        address = address_parts(text(v))
        keys = [F.coalesce(F.when(number(v).isNotNull(), 0), F.when(address.isNotNull(), 1), F.lit(2)), number(v), address, text(v)]
    else:
        keys = [v.column if v.kind != "mv" else text(v)]
    return [k.desc() if key.descending else k.asc() for k in keys]


@command("sort", traits=("sequential", "sorts"))
def sort(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """Sorted, and limited to the number given or the engine's recall size: planned as a top-k."""
    out = df.orderBy(*[c for k in cmd.args for c in sort_columns(df, k)])
    return out.limit(cmd.options["limit"]) if cmd.options["limit"] else ctx.engine.capped(out)
