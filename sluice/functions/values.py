"""Typed columns and the language's coercions, without row functions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = ("int", "long", "double")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


@dataclass(frozen=True)
class Value:
    """A column with its kind: int, long, double, str, bool, time, mv (an array of texts), null or other.

    number is the number behind a text that arithmetic made; literal is the Python value of a constant; exact is the value as a decimal, with
    its precision and scale, where these are known.
    """

    column: Column
    kind: str
    number: Column | None = None
    literal: object = None
    exact: tuple[Column, int, int] | None = None

    @property
    def is_number(self) -> bool:
        return self.kind in NUMERIC or self.number is not None


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return "int"
    if isinstance(t, T.LongType):
        return "long"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(t, T.ArrayType):
        return "mv"
    if isinstance(t, T.NullType):
        return "null"
    return "str" if isinstance(t, (T.StringType, T.CharType, T.VarcharType)) else "other"


def constant(value: object) -> Value:
    kind = {bool: "bool", int: "int", float: "double", str: "str", type(None): "null"}[type(value)]
    if kind == "int" and not -(2**31) <= value < 2**31:
        kind = "long"
    return Value(F.lit(value) if value is not None else F.lit(None).cast("string"), kind, None, value)


def decimal(v: Value) -> tuple[Column, int, int] | None:
    """The value as a decimal with its precision and scale, if none of its digits can be lost."""
    if v.exact is not None:
        return v.exact
    if isinstance(v.literal, (int, float)) and not isinstance(v.literal, bool):
        d = Decimal(repr(v.literal))
        if not d.is_finite():
            return None
        d = d.quantize(Decimal(1)) if d == d.to_integral_value() and d.adjusted() < 28 else d
        digits, exponent = d.as_tuple().digits, d.as_tuple().exponent
        precision, scale = max(len(digits), -exponent, 1), max(-exponent, 0)
        return (F.lit(d).cast(f"decimal({precision},{scale})"), precision, scale) if exponent <= 0 and precision <= 30 else None
    if v.kind in ("int", "long"):
        n = 10 if v.kind == "int" else 19
        return v.column.cast(f"decimal({n},0)"), n, 0
    return None


def text(v: Value) -> Column:
    if v.kind == "str":
        return v.column
    if v.kind == "mv":
        return F.when(F.size(v.column) == 1, F.element_at(v.column, 1).cast("string")).otherwise(F.array_join(v.column, "\n"))
    if v.kind == "time":
        return F.unix_timestamp(v.column).cast("string")
    if v.kind == "other":
        return F.to_json(v.column)
    return v.column.cast("string")


def number(v: Value) -> Column:
    """A double, or null where the text is no number."""
    if v.number is not None:
        return v.number.cast("double")
    if v.kind in NUMERIC or v.kind == "bool":
        return v.column.cast("double")
    if v.kind == "time":
        return F.unix_timestamp(v.column).cast("double")
    if v.kind == "null":
        return F.lit(None).cast("double")
    return text(v).try_cast("double")


def whole(v: Value) -> Column:
    """A bigint, or null where the text is no whole number."""
    if v.kind in ("int", "long"):
        return v.column.cast("bigint")
    if v.kind == "time":
        return F.unix_timestamp(v.column)
    if v.exact is not None:
        return v.exact[0].try_cast("bigint")
    if v.kind == "double" or v.number is not None:
        return number(v).try_cast("bigint")
    return text(v).try_cast("bigint")


def array(v: Value) -> Column:
    return v.column.cast("array<string>") if v.kind == "mv" else F.when(text(v).isNotNull(), F.array(text(v)))


def plain(x: Column) -> Column:
    """A double without exponent and trailing zeros, to ten places."""
    digits = F.round(x, 10).try_cast("decimal(38,10)").cast("string")
    return F.coalesce(F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", ""), x.cast("string"))


def shown(x: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def is_numeric_text(s: str) -> bool:
    return bool(re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", s))


def glob(pattern: str, full: bool = True) -> str:
    """A wildcard pattern as a regular expression; only * is a wildcard."""
    body = ".*".join(re.escape(p) for p in pattern.split("*"))
    return f"^{body}$" if full else f"^{body}"
