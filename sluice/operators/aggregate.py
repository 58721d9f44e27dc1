"""Commands that aggregate, number or fold rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Aggregates
from ..functions.values import col, kind_of, number, text
from ..plans import ast
from ..plans.lexer import QueryError
from ..plans.timespec import span_seconds
from .base import Context, command, event_order, fresh, with_columns
from .columns import expand, value_of
from .order import sort_columns


def grouped(df: DataFrame, by: tuple[str, ...], aggregates: tuple[ast.Aggregate, ...]) -> DataFrame:
    missing = [b for b in by if b not in df.columns]
    if missing:
        raise QueryError(f"no field {', '.join(missing)}")
    compiled = Aggregates(df)
    return df.groupBy(*[col(b).alias(b) for b in by]).agg(*[compiled(a) for a in aggregates])


@command("stats", "chart", traits=("aggregate", "sorts"))
def stats(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """One row for each group, in the order of the BY fields, as many as the engine's recall size. chart has its column field as one more group field."""
    by = cmd.options["by"]
    out = grouped(df, by, cmd.args)
    if by:
        out = out.orderBy(*[c for b in (by if cmd.name == "stats" else by[:1]) for c in sort_columns(out, ast.SortKey(b))])
    return ctx.engine.capped(out)


def default_span(ctx: Context) -> int:
    """By the query's time range."""
    if ctx.earliest is None or ctx.latest is None:
        return 86400
    seconds = (ctx.latest - ctx.earliest).total_seconds()
    return next((s for most, s in ((900, 10), (3600, 60), (14400, 300), (86400, 1800)) if seconds <= most), 86400)


@command("timechart", traits=("aggregate", "sorts"))
def timechart(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """Groups by windows of _time and the BY fields, one row each. Windows without events get a row of zeros, over the query's time range or, where
    that is open, over the data's."""
    span = span_seconds(cmd.options["span"]) if "span" in cmd.options else default_span(ctx)
    by = cmd.options["by"]
    compiled = Aggregates(df)
    window, at_name = fresh(df, "_window", "_at")
    groups = df.groupBy(F.window("_time", f"{span} seconds").alias(window), *[col(b).alias(b) for b in by]).agg(*[compiled(a) for a in cmd.args])
    out = groups.select(col(window)["start"].alias("_time"), *[col(c) for c in groups.columns if c != window])
    if df.isStreaming:
        return out
    at = lambda t: F.lit(int(t.timestamp())).cast("bigint")
    ends = df.agg(F.unix_timestamp(F.min("_time")).alias("lo"), F.unix_timestamp(F.max("_time")).alias("hi"))
    lo = F.col("lo") if ctx.earliest is None else at(ctx.earliest)
    hi = F.col("hi") if ctx.latest is None else at(ctx.latest)
    step = lambda t: F.floor(t / span) * span
    if ctx.earliest is not None and ctx.latest is not None:
        ends = df.sparkSession.range(1)
    times = ends.where(lo.isNotNull()).select(F.explode(F.sequence(step(lo), step(hi), F.lit(span).cast("bigint"))).alias(at_name))
    times = times.select(F.timestamp_seconds(at_name).alias(at_name))
    filled = times.join(out, F.col(at_name) == F.col("_time"), "left")
    zero = {"str": F.lit("0"), "int": F.lit(0), "long": F.lit(0), "double": F.lit(0.0)}
    columns = [F.col(at_name).alias("_time")]
    for f in out.schema.fields[1:]:
        z = zero.get(kind_of(f.dataType))
        columns.append(col(f.name) if z is None else F.coalesce(col(f.name), z.cast(f.dataType)).alias(f.name))
    return filled.select(*columns).orderBy("_time", *[col(b) for b in by])


@command("eventstats", traits=("aggregate",))
def eventstats(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """Each row with its group's aggregates: these are made with partial aggregation and joined, so that a big group isn't sorted into one task."""
    by = cmd.options["by"]
    found = grouped(df, by, cmd.args)
    names = [c for c in found.columns if c not in by]
    if not by:
        return df.crossJoin(found) if not set(names) & set(df.columns) else df.drop(*names).crossJoin(found)
    keys = fresh(df, *[f"_by{i}" for i in range(len(by))])
    right = found.select(*[col(b).alias(k) for b, k in zip(by, keys)], *[col(n) for n in names])
    joined = df.drop(*names).join(right, reduce(lambda p, q: p & q, [col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)]), "left")
    return joined.drop(*keys)


@command("top")
def top(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """The first rows; the fields don't matter."""
    return df.limit(cmd.options["limit"])


@command("dedup")
def dedup(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """The first event, or first n, of each combination of the fields, in the order of events or of sortby.

    keepempty keeps rows with a null field (they go otherwise, but for a plain dedup, where null is a value); keepevents keeps all rows and
    empties the fields of the further ones; consecutive looks at runs of equal rows only.
    """
    o, names = cmd.options, list(cmd.args)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise QueryError(f"dedup: no field {', '.join(missing)}")
    if df.isStreaming:
        return df.withWatermark("_time", "1 hour").dropDuplicatesWithinWatermark(names)
    order = [c for k in o["sortby"] for c in sort_columns(df, k)] + event_order(df)
    plain = o["n"] == 1 and not any(o.get(k) for k in ("keepevents", "keepempty", "consecutive"))
    if plain and not o["sortby"]:
        # partial aggregation: a frequent key costs no more than others
        row = F.struct(*[col(c) for c in df.columns])
        return df.groupBy(*[col(n).alias(f"_k{i}") for i, n in enumerate(names)]).agg(F.min_by(row, F.struct(*event_order(df))).alias("_row")).select("_row.*")
    (place,) = fresh(df, "_n")
    if o.get("consecutive"):
        marked = run_starts(df, names, order, not o["sortby"])
        new = marked.columns[-1]
        numbered = marked.withColumn(place, F.when(col(new), 1).otherwise(o["n"] + 1)).drop(new)
    else:
        numbered = df.withColumn(place, F.row_number().over(Window.partitionBy(*[col(n) for n in names]).orderBy(*order)))
    keep = F.col(place) <= o["n"]
    if o.get("keepempty"):
        keep = keep | reduce(lambda p, q: p | q, [col(n).isNull() for n in names])
    if o.get("keepevents"):
        return with_columns(numbered, {n: F.when(keep, col(n)) for n in names}).drop(place)
    return numbered.where(keep).drop(place)


@command("addtotals", traits=("sequential",))
def addtotals(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """The sum of each row's numbers in a column, and with col=true a last row of the columns' sums (all columns are then texts)."""
    o = cmd.options
    on = lambda k, default: o.get(k, default).lower() in ("t", "true", "1")
    names = expand(df, cmd.args) if cmd.args else [c for c in df.columns if c != "_time"]
    target, out = o.get("fieldname", "Total"), df
    if on("row", "true"):
        numbers = [number(value_of(df, n)) for n in names if kind_of(df.schema[n].dataType) not in ("time", "mv", "other")]
        out = with_columns(out, {target: reduce(lambda p, q: p + q, [F.coalesce(n, F.lit(0.0)) for n in numbers], F.lit(0.0)).cast("string")})
    if not on("col", "false"):
        return out
    label_at, label = o.get("labelfield"), o.get("label", "Total")
    if label_at and label_at not in out.columns:
        out = with_columns(out, {label_at: F.lit(None).cast("string")})
    summed = [*names, *([target] if on("row", "true") else [])]
    numbers_of = {c: value_of(out, c) for c in out.columns}

    def total(c: str) -> Column:
        if c == label_at:
            return F.lit(label)
        if c not in summed or numbers_of[c].kind in ("time", "mv", "other"):
            return F.lit("")
        n = number(numbers_of[c])
        s = F.sum(numbers_of[c].column).cast("string") if numbers_of[c].kind in ("int", "long") else F.sum(n).cast("string")
        return F.coalesce(s, F.lit(""))

    totals = out.agg(*[total(c).alias(c) for c in out.columns])
    as_text = lambda c: col(c).cast("string") if numbers_of[c].kind == "time" else text(numbers_of[c])
    return out.select(*[as_text(c).alias(c) for c in out.columns]).unionByName(totals.select(*[col(c).cast("string").alias(c) for c in out.columns]))


#: Pieces of the time line that are worked on apart where all rows are in one order.
PIECES = 256


def piece_of(df: DataFrame) -> Column:
    """The piece of the time line, cut at quantiles of _time, that a row is in; null times come before all."""
    cuts = sorted(set(df.agg(F.percentile_approx(F.unix_micros("_time"), [i / PIECES for i in range(1, PIECES)], 1000)).first()[0] or []))
    at = F.coalesce(F.unix_micros("_time"), F.lit(-(2**62)))

    def among(lo: int, hi: int) -> Column:
        """How many of the cuts are below at, if it is lo to hi: by halving."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at > F.lit(cuts[mid]), among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, len(cuts))


def running_sums(df: DataFrame, **sums: Column) -> DataFrame:
    """df with the sum of each column over all rows up to each one in the order of events: the sum within the row's piece and the sums of the
    pieces before, so that no task sorts all rows. The names must be new."""
    order, names = event_order(df), list(sums)
    if "_time" not in df.columns or df.isStreaming:
        return df.withColumns({n: F.sum(x).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) for n, x in sums.items()})
    piece, *parts = fresh(df.withColumns(sums), "_piece", *[f"_before{i}" for i in range(len(names))])
    rows = df.withColumns({piece: piece_of(df)} | sums)
    totals = rows.groupBy(piece).agg(*[F.sum(n).alias(n) for n in names])
    past = Window.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(piece, *[F.sum(n).over(past).alias(b) for n, b in zip(names, parts)])
    inside = Window.partitionBy(piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({n: F.sum(n).over(inside) for n in names}).join(before, piece)
    total = lambda n, b: F.when(F.col(n).isNotNull() | F.col(b).isNotNull(), F.coalesce(n, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return out.withColumns({n: total(n, b) for n, b in zip(names, parts)}).drop(piece, *parts)


def run_starts(df: DataFrame, names: list[str], order: list[Column], by_time: bool) -> DataFrame:
    """df with a last column: whether a row differs in the names from the one before it. In the order of events a piece of the time line needs only
    the last row of the piece before."""
    new, last, piece, end, earlier = fresh(df, "_new", "_last", "_piece", "_end", "_before")
    differs = lambda row: reduce(lambda p, q: p | q, [~col(n).eqNullSafe(row[f"k{i}"]) for i, n in enumerate(names)])
    keys = F.struct(*[col(n).alias(f"k{i}") for i, n in enumerate(names)])
    if not by_time or "_time" not in df.columns:
        rows = df.withColumn(last, F.lag(keys).over(Window.orderBy(*order)))
        return rows.withColumn(new, F.col(last).isNull() | differs(F.col(last))).drop(last)
    rows = df.withColumn(piece, piece_of(df))
    ends = rows.groupBy(piece).agg(F.max_by(keys, F.struct(*order)).alias(end))
    before = ends.select(piece, F.lag(end).over(Window.orderBy(piece)).alias(earlier))
    within = rows.withColumn(last, F.lag(keys).over(Window.partitionBy(piece).orderBy(*order)))
    found = within.join(before, piece).withColumn(last, F.coalesce(last, earlier))
    return found.withColumn(new, F.col(last).isNull() | differs(F.col(last))).drop(piece, last, earlier)


@command("accum", traits=("sorts",))
def accum(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """The running sum in the order of events, as a text; whole until the first number with decimals. Rows that are no number keep their
    text, or are null in a new column."""
    (name,) = cmd.args
    if name not in df.columns:
        raise QueryError(f"accum: no field {name}")
    v, target = value_of(df, name), cmd.options["as"]
    t, n = text(v), number(v)
    total, parts = fresh(df, "_sum", "_parts")
    if v.kind in ("int", "long"):
        out = running_sums(df, **{total: v.column.cast("bigint")})
        value = F.col(total).cast("string")
    else:
        whole = t.try_cast("bigint")
        out = running_sums(df, **{total: F.when(whole.isNull(), n), parts: F.when(n.isNotNull() & whole.isNull(), 1.0), fresh(df, "_whole")[0]: whole.cast("decimal(19,0)")})
        rest = out.columns[-1]
        value = F.when(F.coalesce(F.col(parts), F.lit(0.0)) > 0, (F.col(total) + F.coalesce(col(rest).cast("double"), F.lit(0.0))).cast("string")).otherwise(col(rest).cast("string"))
    shown = F.when(n.isNotNull(), value) if target else F.when(n.isNotNull(), value).otherwise(t)
    done = with_columns(out, {target or name: shown})
    return done.drop(*[c for c in out.columns if c not in df.columns and c != target]).orderBy(*[c for c in (col(x) for x in ("_time", "offset") if x in df.columns and x != (target or name))] or [F.lit(1)])


@command("format", traits=("aggregate",))
def format_rows(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """All rows, in the order in which they come, as one search expression."""
    row_start, col_start, col_by, col_end, row_by, row_end = cmd.args or ("(", "(", "AND", ")", "OR", ")")
    limit = int(cmd.options.get("maxresults", 0))
    if limit:
        df = df.limit(limit)
    mv_by = cmd.options.get("mvsep", "OR")
    cells = []
    for f in df.schema.fields:
        v, start = value_of(df, f.name), F.lit(f'{f.name}="')
        if v.kind == "mv":
            cells.append(F.concat(F.lit("( "), F.array_join(F.transform(v.column.cast("array<string>"), lambda s: F.concat(start, s, F.lit('"'))), f" {mv_by} "), F.lit(" ) ")))
        else:
            cells.append(F.concat(start, col(f.name).cast("string") if v.kind == "time" else text(v), F.lit('"')))
    line = F.concat(F.lit(f"{col_start} "), F.concat_ws(f" {col_by} ", *cells), F.lit(f" {col_end}"))
    rows = df.select(F.monotonically_increasing_id().alias("o"), line.alias("l"))
    gathered = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]), f" {row_by} ").alias("l"))
    return gathered.select(F.concat(F.lit(f"{row_start} "), F.col("l"), F.lit(f" {row_end} ")).alias("search"))


# predict

_E, _W, _Q0, _V0 = 1.22, 1.271, 2.0, 0.02


def kalman(y: list[float], future: int, trend: bool) -> tuple[list[float], list[float]]:
    """States and their variances for the values of y and future steps after, by a filter of the local level, or of that and a trend."""
    q, v, k = _Q0, _V0 if trend else 0.0, _Q0 / (_Q0 + _E)
    mean = sum(y) / len(y)
    mu = mean + v + k * (y[0] - mean)
    states, variances = [mu], [q]
    for t in range(1, len(y) + future):
        mu = mu + v + k * (y[min(t, len(y)) - 1] - mu)
        v += _W if trend else 0.0
        q = (1 - k) * q + _W
        k = q / (q + _E) if t <= len(y) else 1.0
        states.append(mu)
        variances.append(q)
    return states, variances


@command("predict", traits=("sequential", "needs_aggregate", "sorts"))
def predict(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """The series, its filtered prediction with bounds, and rows for steps to come, whose values are null. The series is a chart's, so one task can hold it."""
    o, (name, new) = cmd.options, cmd.args[0]
    if o["algorithm"].upper() not in ("LL", "LLT"):
        raise QueryError(f"predict has no algorithm {o['algorithm']}")
    if name not in df.columns or "_time" not in df.columns:
        raise QueryError(f"predict needs _time and {name}")
    bounds = {side: (level, label) for side, level, label in o["bounds"]}
    upper, lower = bounds.get("upper", (95, None)), bounds.get("lower", (95, None))
    up = f"{upper[1]}({new})" if upper[1] else f"upper{upper[0]}({new})"
    low = f"{lower[1]}({new})" if lower[1] else f"lower{lower[0]}({new})"
    trend, future = o["algorithm"].upper() == "LLT", o["future_timespan"]
    taken = {new, up, low}
    base = df.select(*[col(c) for c in df.columns if c not in taken])
    schema = T.StructType([*base.schema.fields, *[T.StructField(c, T.DoubleType()) for c in (new, up, low)]])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])

    (everything,) = fresh(base, "_all")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_time", kind="stable").drop(columns=everything).reset_index(drop=True)
        y = pd.to_numeric(p[name], errors="coerce").fillna(0.0).tolist()
        states, variances = kalman(y, future, trend)
        if future and len(p) > 1:
            last, step = p["_time"].iloc[-1], p["_time"].iloc[-1] - p["_time"].iloc[-2]
            ahead = pd.DataFrame({c: [None] * future for c in p.columns})
            ahead["_time"] = [last + step * (i + 1) for i in range(future)]
            p = pd.concat([p.astype(object), ahead.astype(object)], ignore_index=True)
        n = len(p)
        p[new] = states[:n]
        for label, sign, level in ((up, 1, upper[0]), (low, -1, lower[0])):
            p[label] = [m + sign * (level / 100 + 1) * v**0.5 for m, v in zip(states[:n], variances[:n])]
        return p

    return base.withColumn(everything, F.lit(1)).groupBy(everything).applyInPandas(run, schema).orderBy("_time")

