"""The aggregate functions of stats, chart, timechart and eventstats, as built-in aggregates with partial aggregation."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Aggregate
from ..plans.lexer import QueryError
from .values import NUMERIC, Value, col, kind_of, number, quoted, text

#: Most values that list() shows.
LIST_LIMIT = 100
#: Whole numbers up to this are doubles, each its own.
DOUBLE_HOLDS = 2**53
#: number() of a column in SQL, by kind.
_NUMBER = {
    "str": "try_cast({} AS double)",
    "bool": "cast({} AS double)",
    "time": "cast(unix_timestamp({}) AS double)",
    "mv": "try_cast(array_join(cast({} AS array<string>), chr(10)) AS double)",
    "null": "cast(null AS double)",
    "other": "try_cast(to_json({}) AS double)",
}


class Aggregates:
    def __init__(self, df: DataFrame) -> None:
        self.first = df.columns[0] if df.columns else None
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.kinds = {name: kind_of(t) for name, t in self.types.items()}
        order = [col(c) for c in ("_time", "offset") if c in self.kinds]
        #: What comes first and last, with a hash of all the row for ties.
        plain = [col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        self.order = F.struct(*order, F.xxhash64(*plain)) if order else None

    def value(self, a: Aggregate) -> Value:
        name = a.field if a.field is not None else self.first
        if name not in self.kinds:
            return Value(F.lit(None).cast("string"), "null")
        return Value(col(name), self.kinds[name])

    def __call__(self, a: Aggregate) -> Column:
        if m := re.fullmatch(r"(exactperc|upperperc|perc|p)(\d+(?:\.\d+)?)", a.function):
            out = self.exact_percentile(a, float(m[2])) if m[1] == "exactperc" else self.percentile(a, Decimal(m[2]))
        else:
            name = {"c": "count", "mean": "avg", "distinct_count": "dc"}.get(a.function, a.function)
            if not hasattr(self, f"of_{name}"):
                raise QueryError(f"no aggregate function {a.function}")
            out = getattr(self, f"of_{name}")(a)
        return out.alias(a.name)

    def of_count(self, a: Aggregate) -> Column:
        if a.field is not None and a.field not in self.kinds:
            return F.count(F.lit(None))
        return F.count(col(a.field or self.first))

    def of_sum(self, a: Aggregate) -> Column:
        """Whole numbers and others are summed apart; texts that are no numbers are skipped; the result is a text."""
        v = self.value(a)
        if v.kind in ("int", "long"):
            return F.sum(v.column.cast("bigint")).cast("string")
        if v.kind == "double":
            return F.sum(v.column.cast("double")).cast("string")
        if v.kind == "mv":
            of = lambda t: F.transform(v.column.cast("array<string>"), lambda x: x.try_cast(t))
            total = lambda x, zero: F.aggregate(F.filter(x, lambda y: y.isNotNull()), zero, lambda p, q: p + q)
            longs, doubles = of("bigint"), F.transform(v.column.cast("array<string>"), lambda x: F.when(x.try_cast("bigint").isNull(), x.try_cast("double")))
            any_of = lambda x: F.exists(x, lambda y: y.isNotNull())
            whole, part = F.sum(F.when(any_of(longs), total(longs, F.lit(0).cast("bigint")))), F.sum(F.when(any_of(doubles), total(doubles, F.lit(0.0))))
        else:
            as_long = text(v).try_cast("bigint")
            whole, part = F.sum(as_long), F.sum(F.when(as_long.isNull(), number(v)))
        return F.when(part.isNull(), whole.cast("string")).otherwise((part + F.coalesce(whole, F.lit(0))).cast("string"))

    def of_avg(self, a: Aggregate) -> Column:
        return F.avg(number(self.value(a)))

    def _extreme(self, a: Aggregate, f) -> Column:
        """By value if all are numbers, else by spelling; without decimals if all are whole; a text."""
        v = self.value(a)
        if v.kind in NUMERIC:
            return f(v.column).cast("string")
        t, n = text(v), number(v)
        no_number = F.max(n.isNull() & t.isNotNull())
        part = F.max(n.isNotNull() & t.try_cast("bigint").isNull())
        best = f(n)
        return F.when(no_number, f(t)).when(part, best.cast("string")).otherwise(f(t.try_cast("bigint")).cast("string"))

    def of_min(self, a: Aggregate) -> Column:
        return self._extreme(a, F.min)

    def of_max(self, a: Aggregate) -> Column:
        return self._extreme(a, F.max)

    def of_range(self, a: Aggregate) -> Column:
        v = self.value(a)
        if v.kind in ("int", "long"):
            return (F.max(v.column) - F.min(v.column)).cast("string")
        t, n = text(v), number(v)
        part = F.max(n.isNotNull() & t.try_cast("bigint").isNull()) if v.kind != "double" else F.lit(True)
        span = F.max(n) - F.min(n)
        shown = F.when(part, span.cast("string")).otherwise(span.try_cast("bigint").cast("string"))
        return F.when(F.max(n.isNull() & t.isNotNull()), F.raise_error(F.lit("range of texts"))).otherwise(shown)

    def of_sumsq(self, a: Aggregate) -> Column:
        return F.sum(F.pow(number(self.value(a)), F.lit(2)))

    def of_var(self, a: Aggregate) -> Column:
        return F.var_samp(number(self.value(a)))

    def of_varp(self, a: Aggregate) -> Column:
        return F.var_pop(number(self.value(a)))

    def of_stdev(self, a: Aggregate) -> Column:
        return F.stddev_samp(number(self.value(a)))

    def of_stdevp(self, a: Aggregate) -> Column:
        return F.stddev_pop(number(self.value(a)))

    def of_median(self, a: Aggregate) -> Column:
        return F.percentile(number(self.value(a)), 0.5)

    def percentile(self, a: Aggregate, p: Decimal) -> Column:
        """The least value that has p percent of all at or below it, found by counts of the different values; of the value's type. It comes as a double,
        so whole numbers that a double can't hold are gathered, if there are any, and looked up by place."""
        v, name = self.value(a), a.field if a.field is not None else self.first
        # a little less than the share, else the double's product with a count is rounded up to the next place (0.07 of 100)
        share = float(p / 100) * (1 - 1e-15)
        found = F.expr(f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY {_NUMBER.get(v.kind, '{}').format(quoted(name or ''))})")
        if v.kind not in NUMERIC:
            return found
        found = found.cast(self.types[name])
        if v.kind != "long":
            return found
        low, high = (F.array_sort(F.collect_list(F.when(c, v.column))) for c in (v.column < -DOUBLE_HOLDS, v.column > DOUBLE_HOLDS))
        n = F.count(v.column)
        at = F.greatest(F.ceil(n.cast("decimal(19,0)") * F.lit(p / 100)).cast("bigint") - 1, F.lit(0))
        from_high = at - (n - F.size(high))
        return F.when(at < F.size(low), F.get(low, at.cast("int"))).when(from_high >= 0, F.get(high, from_high.cast("int"))).otherwise(found)

    def exact_percentile(self, a: Aggregate, p: float) -> Column:
        """The value at the place nearest to p of the way (the lower one of two); of an even number of values the mean with the next one."""
        s = F.array_sort(F.collect_list(number(self.value(a))))
        n = F.size(s)
        at = F.ceil(F.lit(p / 100) * (n - 1) - 0.5).cast("int")
        here, following = F.get(s, at), F.get(s, at + 1)
        return F.when((n % 2 == 0) & (at + 1 < n), (here + following) / 2).otherwise(here)

    def of_mode(self, a: Aggregate) -> Column:
        return F.coalesce(F.mode(text(self.value(a)), True), F.lit(""))

    def of_first(self, a: Aggregate) -> Column:
        v = self.value(a)
        return F.first(v.column) if self.order is None else F.min_by(v.column, self.order)

    def of_last(self, a: Aggregate) -> Column:
        v = self.value(a)
        return F.last(v.column) if self.order is None else F.max_by(v.column, self.order)

    def _need_time(self, a: Aggregate) -> None:
        if "_time" not in self.kinds:
            raise QueryError(f"{a.function} needs _time")

    def of_earliest(self, a: Aggregate) -> Column:
        self._need_time(a)
        return F.coalesce(F.min_by(text(self.value(a)), self.order), F.lit(""))

    def of_latest(self, a: Aggregate) -> Column:
        self._need_time(a)
        return F.coalesce(F.max_by(text(self.value(a)), self.order), F.lit(""))

    def of_earliest_time(self, a: Aggregate) -> Column:
        self._need_time(a)
        return F.unix_timestamp(F.min("_time")).cast("string")

    def of_latest_time(self, a: Aggregate) -> Column:
        self._need_time(a)
        return F.unix_timestamp(F.max("_time")).cast("string")

    def of_rate(self, a: Aggregate) -> Column:
        self._need_time(a)
        n = number(self.value(a))
        seconds = F.unix_timestamp(F.max("_time")) - F.unix_timestamp(F.min("_time"))
        change = F.max_by(n, self.order) - F.min_by(n, self.order)
        return F.when(seconds == 0, F.raise_error(F.lit("rate of events of one time"))).otherwise(F.try_divide(change, seconds))

    def of_values(self, a: Aggregate) -> Column:
        return F.array_join(F.array_sort(F.collect_set(text(self.value(a)))), "\n")

    def of_list(self, a: Aggregate) -> Column:
        t = text(self.value(a))
        if self.order is None:
            return F.array_join(F.slice(F.collect_list(t), 1, LIST_LIMIT), "\n")
        kept = F.slice(F.array_sort(F.collect_list(F.when(t.isNotNull(), F.struct(self.order.alias("o"), t.alias("v"))))), 1, LIST_LIMIT)
        return F.array_join(F.transform(kept, lambda x: x["v"]), "\n")

    def of_dc(self, a: Aggregate) -> Column:
        return F.count_distinct(text(self.value(a))).cast("int")

    def of_estdc(self, a: Aggregate) -> Column:
        return F.approx_count_distinct(self.value(a).column)

    def of_estdc_error(self, a: Aggregate) -> Column:
        exact = F.count_distinct(text(self.value(a)))
        return F.try_divide(F.abs(F.approx_count_distinct(self.value(a).column) - exact), exact)

