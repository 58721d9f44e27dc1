"""Event frames: the schema of events, and tables seen as events."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import col

_STRINGS = ("_raw", "index", "sourcetype", "host", "source", "partition")
EVENT_SCHEMA = T.StructType([T.StructField("_time", T.TimestampType())] + [T.StructField(c, T.StringType()) for c in _STRINGS] + [T.StructField("offset", T.LongType()), T.StructField("origin", T.StringType())])
EVENT_COLUMNS = tuple(EVENT_SCHEMA.names)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)


def as_events(df: DataFrame, index: str, time: Column | None, sourcetype: Column, host: Column, offset: Column, raw: Column | None = None) -> DataFrame:
    """Event columns before the table's own. Unused ones cost nothing: they are pruned."""
    own = [c for c in df.columns if c.lower() not in {e.lower() for e in EVENT_COLUMNS}]
    body = F.to_json(F.struct(*[col(c) for c in df.columns])) if raw is None else raw
    at = F.timestamp_seconds(F.lit(0)) if time is None else time.cast("timestamp")
    made = {"_time": at, "_raw": body, "index": F.lit(index), "sourcetype": sourcetype.cast("string"), "host": host.cast("string"), "source": F.lit(index), "partition": F.pmod(offset.cast("bigint"), F.lit(8)).cast("string"), "offset": offset.cast("bigint"), "origin": F.lit("table")}
    return df.select(*[made[c].alias(c) for c in EVENT_COLUMNS], *[col(c) for c in own])


def _entity(prefix: str, name: str) -> Column:
    return F.concat(F.lit(prefix), F.col(name).cast("string"))


_TABLES: dict[str, Callable[[DataFrame], dict]] = {
    "events": lambda d: {"time": d.ts, "sourcetype": d.event_type, "host": _entity("user-", "user_id"), "offset": d.event_id, "raw": d.props},
    "orders": lambda d: {"time": d.o_orderdate, "sourcetype": d.o_orderstatus, "host": _entity("cust-", "o_custkey"), "offset": d.o_orderkey},
    "lineitem": lambda d: {"time": d.l_shipdate, "sourcetype": d.l_returnflag, "host": _entity("supp-", "l_suppkey"), "offset": d.l_orderkey * 10 + d.l_linenumber},
    "customer": lambda d: {"time": None, "sourcetype": d.c_mktsegment, "host": d.c_name, "offset": d.c_custkey},
    "supplier": lambda d: {"time": None, "sourcetype": F.lit("supplier"), "host": d.s_name, "offset": d.s_suppkey},
    "part": lambda d: {"time": None, "sourcetype": d.p_brand, "host": d.p_name, "offset": d.p_partkey},
    "nation": lambda d: {"time": None, "sourcetype": F.lit("nation"), "host": d.n_name, "offset": d.n_nationkey},
    "region": lambda d: {"time": None, "sourcetype": F.lit("region"), "host": d.r_name, "offset": d.r_regionkey},
    "documents": lambda d: {"time": None, "sourcetype": d.lang, "host": d.source, "offset": d.doc_id, "raw": d.text},
    "pages": lambda d: {"time": None, "sourcetype": F.lit("html"), "host": F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), "offset": d.page_id, "raw": d.html},
}


class TableCatalog:
    """Parquet tables of a folder as indexes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def names(self) -> Iterable[str]:
        return _TABLES.keys()

    def __getitem__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return as_events(df, name, **_TABLES[name](df))


def historical_and_live(old: DataFrame, live: DataFrame, epoch: int) -> DataFrame:
    """Events before the epoch from one frame, and from it on from another."""
    at = F.timestamp_seconds(F.lit(epoch))
    return old.where(col("_time") < at).unionByName(live.where(col("_time") >= at), allowMissingColumns=True)
