"""Time expressions: absolute formats, relative offsets and snaps, spans."""

from __future__ import annotations

import math
import re
from calendar import monthrange
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexer import QueryError

_UNITS = {
    "s": "s sec secs second seconds",
    "m": "m min mins minute minutes",
    "h": "h hr hrs hour hours",
    "d": "d day days",
    "w": "w week weeks",
    "mon": "mon month months",
    "q": "q qtr qtrs quarter quarters",
    "y": "y yr yrs year years",
}
UNIT = {word: unit for unit, words in _UNITS.items() for word in words.split()}
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "mon": 2592000, "q": 7776000, "y": 31536000}
_OFFSET = re.compile(r"([+-])(\d*)([a-z]+)", re.I)
_SNAP = re.compile(r"@(w[0-7]|[a-z]+)", re.I)


def span_seconds(text: str) -> int:
    """Seconds of a span like 5m; a month has 30 days."""
    m = re.fullmatch(r"(\d*)\s*([a-z]+)", text.strip(), re.I)
    if not m or m[2].lower() not in UNIT:
        raise QueryError(f"no span: {text}")
    return int(m[1] or 1) * SECONDS[UNIT[m[2].lower()]]


def steps(text: str) -> list[tuple]:
    """A relative time as steps ('add', n, unit) and ('snap', unit)."""
    if text.lower() in ("now", "now()"):
        return []
    out, i = [], 0
    while i < len(text):
        if m := _OFFSET.match(text, i):
            unit = UNIT.get(m[3].lower())
            if not unit:
                raise QueryError(f"Relative timestamp '{text}' can't be parsed: no unit {m[3]}")
            out.append(("add", int(m[1] + (m[2] or "1")), unit))
        elif m := _SNAP.match(text, i):
            word = m[1].lower()
            unit = word if re.fullmatch("w[0-7]", word) else UNIT.get(word)
            if not unit:
                raise QueryError(f"Relative timestamp '{text}' can't be parsed: no unit {word}")
            out.append(("snap", unit))
        else:
            raise QueryError(f"Relative timestamp '{text}' can't be parsed")
        i = m.end()
    if not out:
        raise QueryError("an empty time")
    return out


def shift(t: datetime, n: int, unit: str) -> datetime:
    if unit in ("mon", "q", "y"):
        months = t.year * 12 + t.month - 1 + n * {"mon": 1, "q": 3, "y": 12}[unit]
        year = min(9999, max(1000, months // 12))
        month = months % 12 + 1
        return t.replace(year=year, month=month, day=min(t.day, monthrange(year, month)[1]))
    try:
        out = t + timedelta(seconds=n * SECONDS[unit])
    except OverflowError:
        out = t.replace(year=1000 if n < 0 else 9999)
    return out if out.year >= 1000 else out.replace(year=1000)


def snap(t: datetime, unit: str) -> datetime:
    if unit == "s":
        return t.replace(microsecond=0)
    if unit == "m":
        return t.replace(second=0, microsecond=0)
    if unit == "h":
        return t.replace(minute=0, second=0, microsecond=0)
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "d":
        return day
    if unit[0] == "w":
        return day - timedelta(days=(day.isoweekday() - int(unit[1:] or 0)) % 7)
    return day.replace(day=1, month={"mon": day.month, "q": (day.month - 1) // 3 * 3 + 1, "y": 1}[unit])


def relative(text: str, now: datetime) -> datetime:
    for kind, *rest in steps(text):
        now = shift(now, *rest) if kind == "add" else snap(now, *rest)
    return now


def relative_column(t: Column, text: str) -> Column:
    """The same for a timestamp column."""
    trunc = {"s": "second", "m": "minute", "h": "hour", "d": "day", "mon": "month", "q": "quarter", "y": "year"}
    for kind, *rest in steps(text):
        if kind == "add":
            n, unit = rest
            months = {"mon": 1, "q": 3, "y": 12}.get(unit)
            t = t + (F.make_interval(months=F.lit(n * months)) if months else F.make_dt_interval(secs=F.lit(n * SECONDS[unit])))
        elif rest[0][0] == "w":
            back = F.pmod(F.dayofweek(t) - 1 - int(rest[0][1:] or 0), F.lit(7))
            t = F.date_trunc("day", t) - F.make_dt_interval(days=back)
        else:
            t = F.date_trunc(trunc[rest[0]], t)
    return t


#: strftime letters as patterns of Python and of Spark.
_PYTHON = {"T": "%H:%M:%S", "F": "%Y-%m-%d", "k": "%H", "D": "%m/%d/%y", "R": "%H:%M", "e": "%d"}
_SPARK = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "b": "MMM", "B": "MMMM", "H": "HH", "k": "H", "I": "hh", "M": "mm", "S": "ss", "p": "a", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm", "f": "SSSSSS", "Q": "SSS", "N": "SSSSSSSSS", "Z": "zz", "z": "XXX", "j": "DDD", "a": "EEE", "A": "EEEE", "%": "%"}


def spark_format(text: str) -> str:
    """A strftime format as a datetime pattern of Spark; other letters are quoted."""
    out = []
    for m in re.finditer(r"%\d?(.)|([^%]+)", text, re.S):
        if m[1]:
            if m[1] not in _SPARK:
                raise QueryError(f"no time format letter: %{m[1]}")
            out.append(_SPARK[m[1]])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda w: f"'{w[0]}'", m[2].replace("'", "''")))
    return "".join(out)


def absolute(text: str, form: str | None = None) -> datetime | None:
    """A time in the format given, or in one of the usual ones; UTC unless it has a zone."""
    if form:
        if form == "%s":
            return datetime.fromtimestamp(float(text), UTC)
        for k, v in _PYTHON.items():
            form = form.replace(f"%{k}", v)
        try:
            t = datetime.strptime(text, form)
        except ValueError as e:
            raise QueryError(f"{text} isn't in the format {form}") from e
        return t if t.tzinfo else t.replace(tzinfo=UTC)
    if re.fullmatch(r"\d{2}/\d{2}/\d{4}:\d{2}:\d{2}:\d{2}", text):
        return datetime.strptime(text, "%m/%d/%Y:%H:%M:%S").replace(tzinfo=UTC)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?", text):
        t = datetime.fromisoformat(text)
        return t if t.tzinfo else t.replace(tzinfo=UTC)
    return None


def instant(kind: str, text: str, form: str | None, now: datetime) -> datetime:
    """The instant of a time bound. A late bound with a part of a second is rounded up."""
    if re.fullmatch(r"-?\d+(\.\d+)?", text) and (form in (None, "%s") or "timeu" in kind):
        t = datetime.fromtimestamp(float(text), UTC)
    else:
        t = absolute(text, form) or relative(text, now)
    if is_late(kind) and t.microsecond:
        t = datetime.fromtimestamp(math.ceil(t.timestamp()), UTC)
    return t


def is_late(kind: str) -> bool:
    return kind in ("latest", "_index_latest", "endtimeu")
