"""Search conditions as filters that the optimizer can push down."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import Env
from ..functions.values import NUMERIC, col, glob, is_numeric_text, kind_of, number, text, Value
from ..plans import ast
from ..plans.lexer import QueryError
from ..plans.timespec import instant, is_late
from .base import Context, command


def walk(node: object):
    yield node
    for k in ("left", "right", "of"):
        if (x := getattr(node, k, None)) is not None:
            yield from walk(x)


def time_range(condition: object, now: datetime) -> tuple[datetime | None, datetime | None]:
    """The latest of the early bounds and the earliest of the late ones, wherever they stand in the condition."""
    early = [instant(t.kind, t.value, t.format, now) for t in walk(condition) if isinstance(t, ast.TimeBound) and not is_late(t.kind)]
    late = [instant(t.kind, t.value, t.format, now) for t in walk(condition) if isinstance(t, ast.TimeBound) and is_late(t.kind)]
    return max(early, default=None), min(late, default=None)


def timestamp(t: datetime) -> Column:
    return F.lit(t).cast("timestamp")


def whole_match(c: Column, pattern: str) -> Column:
    """Case-insensitive full match of a wildcard pattern; without a wildcard, plain equality."""
    if "*" not in pattern:
        return F.lower(c) == pattern.lower()
    return c.rlike("(?i)" + glob(pattern))


def prefix_match(c: Column, pattern: str) -> Column:
    """Case-insensitive match at the beginning; all but * is a regular expression."""
    if re.fullmatch(r"[\w-]+\*?", pattern):
        return F.startswith(F.lower(c), F.lit(pattern.rstrip("*").lower()))
    return c.rlike("(?i)^" + pattern.replace("*", ".*"))


def field_compare(v: Value, op: str, value: str) -> Column:
    """Numbers by value; otherwise texts, where = and != take wildcards and match in full."""
    if value and is_numeric_text(value):
        n_value = float(value) if "." in value or "e" in value.lower() else int(value)
        n = F.lit(n_value if abs(n_value) < 2**63 else float(n_value))
        f = {"=": lambda a: a == n, "!=": lambda a: a != n, "<": lambda a: a < n, "<=": lambda a: a <= n, ">": lambda a: a > n, ">=": lambda a: a >= n}[op]
        if v.kind in ("int", "long"):
            n = F.lit(int(value)) if isinstance(n_value, int) and abs(n_value) < 2**63 else F.lit(Decimal(value.strip()))
            return f(v.column)
        if v.kind in NUMERIC:
            return f(v.column)
        x, t, exact = number(v), text(v), text(v).try_cast("decimal(38,18)")
        s = {"=": lambda: t == value, "!=": lambda: t != value, "<": lambda: t < value, "<=": lambda: t <= value, ">": lambda: t > value, ">=": lambda: t >= value}[op]()
        wanted = Decimal(value.strip())
        if wanted.adjusted() < 20 and wanted.as_tuple().exponent >= -18:
            n_exact = F.lit(wanted).cast("decimal(38,18)")
            of = {"=": exact == n_exact, "!=": exact != n_exact, "<": exact < n_exact, "<=": exact <= n_exact, ">": exact > n_exact, ">=": exact >= n_exact}[op]
            return F.when(exact.isNotNull(), of).when(x.isNotNull(), f(x)).otherwise(s)
        return F.when(x.isNotNull(), f(x)).otherwise(s)
    t = text(v)
    if op in ("=", "!="):
        same = t.rlike(glob(value)) if "*" in value else t == value
        return same if op == "=" else ~same
    return {"<": t < value, "<=": t <= value, ">": t > value, ">=": t >= value}[op]


def raw_contains(df: DataFrame, term: str) -> Column:
    """Whether _raw has the term, in any case; one * at either end is dropped, inner ones are literal."""
    if "_raw" not in df.columns:
        return F.lit(False)
    s = term.removeprefix("*").removesuffix("*")
    return F.contains(F.lower(col("_raw").cast("string")), F.lit(s.lower()))


def compile_condition(df: DataFrame, node: object, ctx: Context) -> Column:
    """A filter. Subsearches are left out: filter_frame() joins them."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    field = lambda name: Value(col(name), kinds[name]) if name in kinds else Value(F.lit(None).cast("string"), "null")
    if isinstance(node, ast.Everything):
        return F.lit(True)
    if isinstance(node, ast.Logic):
        a, b = compile_condition(df, node.left, ctx), compile_condition(df, node.right, ctx)
        return a & b if node.op == "and" else a | b
    if isinstance(node, ast.Negation):
        return ~compile_condition(df, node.of, ctx)
    if isinstance(node, ast.Term):
        return raw_contains(df, node.text)
    if isinstance(node, ast.TimeBound):
        at = timestamp(instant(node.kind, node.value, node.format, ctx.now))
        return col("_time") < at if is_late(node.kind) else col("_time") >= at
    if isinstance(node, ast.Member):
        v = field(node.field)
        if node.field.lower() in ("index", "sourcetype"):
            plain = [x.lower() for x in node.values if "*" not in x]
            tests = [F.lower(text(v)).isin(plain)] if plain else []
            return reduce(lambda p, q: p | q, tests + [whole_match(text(v), x) for x in node.values if "*" in x])
        return reduce(lambda p, q: p | q, [field_compare(v, "=", x) for x in node.values])
    if isinstance(node, ast.Compare):
        v, name = field(node.field), node.field.lower()
        if node.op in ("=", "!=") and name in ("index", "host", "sourcetype"):
            same = (whole_match if name == "index" else prefix_match)(text(v), node.value)
            return same if node.op == "=" else ~same
        return field_compare(v, node.op, node.value)
    raise QueryError(f"no search condition: {node}")


def _conjuncts(node: object) -> list[object]:
    if isinstance(node, ast.Logic) and node.op == "and":
        return _conjuncts(node.left) + _conjuncts(node.right)
    return [node]


def filter_frame(df: DataFrame, node: object, ctx: Context) -> DataFrame:
    """Conditions as a filter; a subsearch keeps events whose _raw has one of its cells, by a semi join (an anti join where negated)."""
    plain = [c for c in _conjuncts(node) if not any(isinstance(x, ast.SubSearch) for x in walk(c))]
    if plain:
        df = df.where(reduce(lambda p, q: p & q, [compile_condition(df, c, ctx) for c in plain]))
    for c in _conjuncts(node):
        if c in plain:
            continue
        negated = isinstance(c, ast.Negation)
        sub = c.of if negated else c
        if not isinstance(sub, ast.SubSearch):
            raise QueryError("a subsearch can't be an alternative")
        df = any_cell(df, cells(ctx.engine.plan(sub.query, ctx)), negated)
    return df


#: Cells of a subsearch that are tests of their own, and those that one pass of an automaton finds, which is sent to every executor.
FEW_CELLS, MANY_CELLS, CELL_BYTES = 50, 200_000, 32 << 20


def any_cell(df: DataFrame, found: DataFrame, negated: bool) -> DataFrame:
    """Rows whose _raw has one of the cells (none, if negated). The cells are counted first: a few become conditions, many an automaton (of at most
    MANY_CELLS cells and CELL_BYTES bytes), more than that stay where they are and are met by a join."""
    raw = F.lower(col("_raw"))
    size = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_cell")), F.lit(0))).first()
    if size[0] > MANY_CELLS or size[1] > CELL_BYTES:
        return df.join(found, F.contains(raw, F.col("_cell")), "left_anti" if negated else "left_semi")
    texts = sorted(r[0] for r in found.collect())
    if len(texts) <= FEW_CELLS:
        hit = reduce(lambda p, q: p | q, [F.contains(raw, F.lit(t)) for t in texts], F.lit(False))
    else:
        hit = F.lit(True) if "" in texts else _automaton(df, texts)(raw)
    hit = F.coalesce(hit, F.lit(False))
    return df.where(~hit if negated else hit)


def _automaton(df: DataFrame, texts: list[str]):
    sent = df.sparkSession.sparkContext.broadcast(texts)

    @F.pandas_udf("boolean")
    def has_any(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            import ahocorasick

            words = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for t in sent.value:
                words.add_word(t)
            words.make_automaton()
            test = lambda s: next(words.iter(s), None) is not None
        except ImportError:
            either = re.compile("|".join(map(re.escape, sent.value)))
            test = lambda s: either.search(s) is not None
        for b in batches:
            yield pd.Series([s is not None and test(s) for s in b], dtype=bool)

    return has_any


def cells(found: DataFrame) -> DataFrame:
    """The distinct texts, in lower case, in any cell of a subsearch's result."""
    kinds = {f.name: kind_of(f.dataType) for f in found.schema.fields}
    texts = F.array(*[F.lower(text(Value(col(c), kinds[c]))) for c in found.columns])
    return found.select(F.explode(texts).alias("_cell")).where("_cell IS NOT NULL").distinct()


@command("search")
def search(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    return filter_frame(df, cmd.args[0], ctx)


@command("where")
def where(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    return df.where(environment(df, ctx).condition(cmd.args[0]))


@command("regex")
def regex(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """Rows whose field has a match; with != those that have none."""
    name = cmd.options["field"]
    if name not in df.columns:
        raise QueryError(f"regex: no field {name}")
    hit = col(name).cast("string").rlike(cmd.args[0])
    return df.where(~hit if cmd.options["negated"] else hit)


def environment(df: DataFrame, ctx: Context) -> Env:
    from ..plans.parser import search as parse_search

    return Env(df.schema, ctx.now.timestamp(), lambda s: compile_condition(df, parse_search(s), ctx))
