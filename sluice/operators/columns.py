"""Commands that shape columns row by row."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import ip_number, path_value
from ..functions.values import Value, array, col, kind_of, number, text
from ..plans import ast
from ..plans.lexer import QueryError
from ..plans.timespec import spark_format
from .base import Context, command, with_columns
from .search import environment


def expand(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """The columns that the names stand for: in the names' order, those of one wildcard in the frame's."""
    out: list[str] = []
    for n in names:
        pattern = re.compile(".*".join(map(re.escape, n.split("*"))))
        out += [c for c in df.columns if pattern.fullmatch(c) and c not in out]
    return out


def value_of(df: DataFrame, name: str) -> Value:
    return Value(col(name), kind_of(df.schema[name].dataType))


@command("fields")
def fields(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    found = expand(df, cmd.args)
    if not found:
        raise QueryError(f"fields command is missing field names, or none is there: {', '.join(cmd.args)}")
    if cmd.options["drop"]:
        return df.select(*[col(c) for c in df.columns if c not in found])
    return df.select(*[col(c) for c in found])


@command("table")
def table(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """The fields in the order given; where none of them is there, rows without columns."""
    found = expand(df, cmd.args)
    return df.select(*[col(c) for c in found])


@command("rename")
def rename(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in cmd.args if a in df.columns})


@command("eval")
def evaluate(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """Assignments one after the other; one that doesn't use another's target shares its projection."""
    for name, expression in cmd.args:
        v = environment(df, ctx).compile(expression)
        c = v.column
        if name == "_time" and v.kind != "time":
            c = F.timestamp_seconds(number(v))
        df = with_columns(df, {name: c})
    return df


@command("fillnull")
def fillnull(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """Null becomes the value, as a text unless the column can hold it; a column that isn't there is made."""
    names, value, new = cmd.args or df.columns, cmd.options["value"], {}
    for n in names:
        if n not in df.columns:
            new[n] = F.lit(value)
            continue
        kind = df.schema[n].dataType
        if kind.simpleString() == "string":
            new[n] = F.coalesce(col(n), F.lit(value))
        elif kind_of(kind) == "mv":
            new[n] = F.coalesce(col(n).cast("array<string>"), F.array(F.lit(value)))
        elif kind_of(kind) in ("int", "long", "double") and re.fullmatch(r"-?\d+(\.\d+)?" if kind_of(kind) == "double" else r"-?\d+", value):
            new[n] = F.coalesce(col(n), F.lit(value).cast(kind))
        elif kind_of(kind) == "time":
            continue
        else:
            new[n] = F.coalesce(col(n).cast("string"), F.lit(value))
    return with_columns(df, new)


@command("strcat")
def strcat(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    there = [p for p in cmd.args if isinstance(p, ast.Text) or p.name in df.columns]
    if cmd.options.get("allrequired") and len(there) < len(cmd.args):
        return with_columns(df, {cmd.options["into"]: F.lit(None).cast("string")})
    return with_columns(df, {cmd.options["into"]: F.concat_ws("", *[F.lit(p.value) if isinstance(p, ast.Text) else text(value_of(df, p.name)) for p in there])})


def wildcard_replace(c: Column, pattern: str, by: str) -> Column:
    """A text that matches the whole pattern becomes the other one, whose stars stand for what the pattern's matched."""
    if "*" not in pattern:
        return F.when(c == pattern, F.lit(by)).otherwise(c)
    body = "^(?s)" + "(.*)".join(map(re.escape, pattern.split("*"))) + "$"
    stars, out = iter(range(1, pattern.count("*") + 1)), []
    for i, part in enumerate(by.split("*")):
        if i:
            out.append(f"${n}" if (n := next(stars, None)) else "")
        out.append(part.replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(c.rlike(body), F.regexp_replace(c, body, "".join(out))).otherwise(c)


@command("replace")
def replace(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """Pairs are applied in the order written. Without IN, to all columns but _time."""
    names = [n for n in cmd.options["fields"] if n in df.columns] or [c for c in df.columns if c != "_time"]
    new = {n: reduce(lambda c, p: wildcard_replace(c, *p), cmd.args, text(value_of(df, n))) for n in names if kind_of(df.schema[n].dataType) != "mv"}
    return with_columns(df, new)


_GROUP = re.compile(r"\(\?P?<([A-Za-z]\w*)>")


def named_groups(pattern: str) -> tuple[str, list[tuple[str, int]]]:
    """The pattern with its named groups plain, and their names and numbers. Any name of letters, digits and _ will do."""
    names, number, i, out = [], 0, 0, []
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        elif m := _GROUP.match(pattern, i):
            number += 1
            names.append((m[1], number))
            out.append("(")
            i = m.end()
        elif pattern[i] == "[":
            end = i + 1 + pattern.startswith("]", i + 1)
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            out.append(pattern[i : end + 1])
            i = end + 1
        else:
            number += pattern[i] == "(" and not pattern.startswith("(?", i)
            out.append(pattern[i])
            i += 1
    return "".join(out), names


def sed_parts(text_: str) -> tuple[str, str, str]:
    """Pattern, replacement and flags of s/a/b/flags, with any delimiter."""
    if len(text_) < 4 or text_[0] != "s":
        raise QueryError(f"no sed expression: {text_}")
    d = re.escape(text_[1])
    parts = [p.replace("\\" + text_[1], text_[1]) for p in re.split(rf"(?<!\\){d}", text_[2:])]
    if len(parts) not in (2, 3) or len(parts) == 3 and not re.fullmatch(r"\d*g?", parts[2]):
        raise QueryError(f"no sed expression: {text_}")
    return parts[0], parts[1], parts[2] if len(parts) == 3 else ""


def sed(c: Column, expression: str) -> Column:
    """g replaces all matches, N the Nth, Ng those from the Nth on, nothing the first. The replacement is literal."""
    pattern, by, flags = sed_parts(expression)
    java = by.replace("\\", "\\\\").replace("$", "\\$")
    if flags == "g":
        return F.regexp_replace(c, pattern, java)
    first, onward = int(flags.rstrip("g") or 1), flags.endswith("g")
    compiled = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))

    def one(s):
        if s is None:
            return None
        seen = 0

        def put(m):
            nonlocal seen
            seen += 1
            return by if seen == first or onward and seen > first else m[0]

        return compiled.sub(put, s)

    @F.pandas_udf(T.StringType())
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series([one(s) for s in x], dtype=object)

    return apply(c)


@command("rex", "rex4j")
def rex(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """A column for each named group of the first match, null without one; or sed on the field."""
    field, pattern = cmd.options["field"], cmd.args[0]
    if field not in df.columns:
        raise QueryError(f"{cmd.name}: no field {field}")
    c = text(value_of(df, field))
    if cmd.options.get("mode") == "sed":
        return with_columns(df, {field: sed(c, pattern)})
    body, names = named_groups(pattern)
    if not names:
        raise QueryError(f"{cmd.name} needs a named group")
    if cmd.name == "rex4j":
        return with_columns(df, {n: F.nullif(F.regexp_extract(c, body, i), F.lit("")) for n, i in names})
    return with_columns(df, {n: F.when(c.rlike(body), F.regexp_extract(c, body, i)) for n, i in names})


def _duration(s: Column) -> Column:
    """HH:MM:SS, with D+ before it if need be, in seconds."""
    part = lambda i: F.regexp_extract(s, r"^(?:(\d+)\+)?(\d+):(\d+):(\d+)$", i).try_cast("bigint")
    ok = s.rlike(r"^(?:\d+\+)?\d+:\d+:\d+$")
    return F.when(ok, F.coalesce(part(1), F.lit(0)) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)).when(s.isNotNull(), F.raise_error(F.concat(F.lit("no duration: "), s)))


def _milliseconds(s: Column) -> Column:
    part = lambda i: F.regexp_extract(s, r"^(?:(\d+):)?(\d+)(?:\.(\d{1,3}))?$", i)
    return F.when(s.rlike(r"^(?:\d+:)?\d+(\.\d{1,3})?$"), F.coalesce(part(1).try_cast("bigint"), F.lit(0)) * 60000 + part(2).try_cast("bigint") * 1000 + F.rpad(part(3), 3, "0").try_cast("bigint"))


def _memory(s: Column) -> Column:
    n, unit = F.regexp_extract(s, r"^\s*([\d.]+)", 1).try_cast("double"), F.lower(F.regexp_extract(s, r"([kKmMgG])\s*$", 1))
    return (n * F.when(unit == "m", 1024.0).when(unit == "g", 1048576.0).otherwise(1.0)).cast("float").cast("string")


def _remove_unit(s: Column) -> Column:
    """The number at the beginning, its exponent's letter in upper case; nothing if a second point follows."""
    m = F.regexp_extract(s, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?!\.?\d*\.)", 1)
    return F.when(s.rlike(r"^[+-]?\d*\.\d*\.") | (m == ""), F.when(s.isNotNull(), F.lit(""))).otherwise(F.upper(m))


def conversion(fn: str, v: Value, form: str) -> Column:
    s = text(v)
    if fn == "auto":
        return F.coalesce(s.try_cast("double").cast("string"), s)
    if fn == "num":
        return number(v)
    if fn == "ctime":
        return F.date_format(F.timestamp_seconds(number(v)), spark_format(form))
    if fn == "mktime":
        return F.unix_timestamp(F.try_to_timestamp(s, F.lit(spark_format(form)))).cast("string")
    if fn == "mstime":
        return _milliseconds(s).cast("string")
    if fn == "dur2sec":
        return _duration(s).cast("string")
    if fn == "memk":
        return _memory(s)
    if fn == "rmcomma":
        return F.regexp_replace(s, ",", "")
    if fn == "rmunit":
        return _remove_unit(s)
    raise QueryError(f"convert has no function {fn}")


@command("convert")
def convert(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """The field of a function is a wildcard pattern or a regular expression; each column is converted once; none() leaves columns out."""
    new, left, done = {}, set(), set()
    for fn, names, _ in cmd.args:
        if fn == "none":
            left |= {c for n in names for c in df.columns if re.fullmatch(n.replace("*", ".*").replace("..*", ".*"), c)}
    for fn, names, target in cmd.args:
        if fn == "none":
            continue
        pattern = names[0].replace("*", ".*").replace("..*", ".*") if names else ""
        for c in [c for c in df.columns if re.fullmatch(pattern, c) and c not in left and c not in done]:
            done.add(c)
            new[target or c] = conversion(fn, value_of(df, c), cmd.options["timeformat"])
    return with_columns(df, new)


@command("rangemap")
def rangemap(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """range: the names, in the order written, of the ranges (ends included) that hold the value or one of its values; else the default."""
    field = cmd.options["field"]
    if field not in df.columns:
        raise QueryError(f"rangemap: no field {field}")
    v = value_of(df, field)
    if v.kind == "mv":
        numbers = F.transform(array(v), lambda x: x.try_cast("double"))
        hit = lambda lo, hi: F.exists(numbers, lambda x: x.between(float(lo), float(hi)))
        any_number = F.exists(numbers, lambda x: x.isNotNull())
    else:
        n = number(v)
        hit = lambda lo, hi: n.between(float(lo), float(hi))
        any_number = n.isNotNull()
    names = F.filter(F.array(*[F.when(hit(lo, hi), F.lit(name)) for name, lo, hi in cmd.args]).cast("array<string>"), lambda x: x.isNotNull())
    return with_columns(df, {"range": F.when(any_number & (F.size(names) > 0), names).otherwise(F.array(F.lit(cmd.options["default"])))})


@command("spath")
def spath(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """With a path its value, in output or a column of the path's name; without one a column for each top-level key, found by one job over the data."""
    source = cmd.options.get("input", "_raw")
    path = cmd.options.get("path") or (cmd.args[0] if cmd.args else None)
    if source not in df.columns:
        raise QueryError(f"spath: no field {source}")
    s = text(value_of(df, source))
    if path:
        return with_columns(df, {cmd.options.get("output", path): path_value(s, path)})
    if "output" in cmd.options:
        raise QueryError("spath: output needs a path")
    is_xml = s.rlike(r"^\s*<")
    leaves = F.when(is_xml, xml_leaves(F.when(is_xml, s)))
    keys = df.select(F.explode(F.coalesce(F.json_object_keys(F.when(~is_xml, s)), F.map_keys(leaves))).alias("k")).distinct()
    names = sorted(r["k"] for r in keys.collect())
    return with_columns(df, {n: F.coalesce(F.when(is_xml, F.element_at(leaves, n)).otherwise(F.get_json_object(s, f"$['{n}']")), F.lit("")) for n in names})


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def xml_leaves(x: pd.Series) -> pd.Series:
    """Tags without children and their text; the last of several wins; nothing for a text that is no XML."""
    import xml.etree.ElementTree as ET

    def one(s):
        if s is None:
            return None
        try:
            root = ET.fromstring(s)
        except ET.ParseError:
            return {}
        return {e.tag: (e.text or "").strip() for e in root.iter() if not len(e)}

    return pd.Series([one(s) for s in x], dtype=object)


@command("xmlkv")
def xmlkv(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """A column for each leaf tag, found by one job over the data."""
    source = cmd.args[0] if cmd.args else "_raw"
    if source not in df.columns:
        raise QueryError(f"xmlkv: no field {source}")
    leaves = xml_leaves(text(value_of(df, source)))
    names = sorted(r["k"] for r in df.select(F.explode(F.map_keys(leaves)).alias("k")).distinct().collect())
    return with_columns(df, {n: F.element_at(leaves, n) for n in names})


@command("iplocation")
def iplocation(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    """Columns of the network table (first, last, then text columns) given to the engine, for addresses in [first, last].

    The networks don't overlap, so each address has one candidate: networks and addresses are cut by their first 16 bits and joined on these.
    """
    networks = ctx.engine.networks
    if networks is None or len(cmd.args) != 1:
        raise QueryError("iplocation needs a field, and a network table in the engine")
    field, prefix = cmd.args[0], cmd.options.get("prefix", "")
    if field not in df.columns:
        raise QueryError(f"iplocation: no field {field}")
    wanted = [c for c in networks.columns if c not in ("first", "last") and (c not in ("metroCode", "continent") or cmd.options.get("allfields", "f").lower() in ("t", "true") or set(networks.columns) == {"first", "last", "country", "continent"})]
    cut = networks.select("first", "last", *wanted, F.explode(F.sequence(F.floor(F.col("first") / 65536), F.floor(F.col("last") / 65536))).alias("_cut")).select(F.struct("first", "last", "_cut", *wanted).alias("_net"))
    at = ip_number(text(value_of(df, field)))
    hit = (F.floor(at / 65536) == F.col("_net._cut")) & at.between(F.col("_net.first"), F.col("_net.last"))
    joined = df.join(cut, hit, "left")
    return joined.select(*[col(c) for c in df.columns if c not in {prefix + w for w in wanted}], *[F.col(f"_net.{c}").alias(prefix + c) for c in wanted])


TOKENS = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"


def tokenizer(df: DataFrame, source: str = "_raw", into: str = "tokens", form: str = "string") -> DataFrame:
    """Words and single other signs of a text, in order."""
    tokens = F.regexp_extract_all(F.coalesce(text(value_of(df, source)), F.lit("")), F.lit(TOKENS), 0)
    return with_columns(df, {into: F.transform(tokens, lambda t: F.encode(t, "utf-8")) if form == "bytes" else tokens})


def regex_extract(df: DataFrame, pattern: str, source: str = "_raw", into: str = "tokens") -> DataFrame:
    """All matches in the lower-case text."""
    return with_columns(df, {into: F.regexp_extract_all(F.lower(F.coalesce(text(value_of(df, source)), F.lit(""))), F.lit(pattern), 0)})

