"""Saved results: folders with the data and a description in JSON."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lexer import QueryError

_META = "description.json"
FORMATS = ("parquet", "avro", "csv")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def save(df: DataFrame, path: str, form: str = "parquet", overwrite: bool = False, header: bool = True, retention: str | None = None) -> None:
    """The data in path/data, and its schema, column names and time in path/description.json. avro stands for the lossless format, which is Parquet here."""
    spark = df.sparkSession
    if form not in FORMATS:
        raise QueryError(f"Format {form} is not supported")
    if exists(spark, path) and not overwrite:
        raise QueryError(f"{path} exists; overwrite=true replaces it")
    names = [f"c{i}" for i in range(len(df.columns))]  # any name will do in a query, but not in every file
    writer = df.toDF(*names).write.mode("overwrite")
    if form == "csv":
        texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if not isinstance(df.schema[c].dataType, T.ArrayType) else F.to_json(f"`{c}`").alias(c) for c in df.columns])
        texts.write.mode("overwrite").option("header", header).csv(f"{path}/data")
    else:
        writer.parquet(f"{path}/data")
    meta = {"schema": json.loads(df.schema.json()), "columns": df.columns, "format": form, "header": header, "retention": retention, "saved": datetime.now(UTC).isoformat()}
    fs, _, Path = _fs(spark, path)
    out = fs.create(Path(f"{path}/{_META}"), True)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()


def load(spark: SparkSession, path: str, form: str | None = None, header: bool = True, schema: str | None = None) -> DataFrame:
    """What was saved at the path, or at all paths a wildcard stands for; CSV files also without a description: as lines in _raw without a schema."""
    fs, p, Path = _fs(spark, path)
    found = [s.getPath().toString() for s in fs.globStatus(p) or []]
    if not found:
        raise QueryError(f"nothing at {path}")
    frames = []
    for one in sorted(found):
        if fs.exists(Path(f"{one}/{_META}")):
            meta = json.loads(spark.read.text(f"{one}/{_META}", wholetext=True).first()[0])
            kind = T.StructType.fromJson(meta["schema"])
            if meta["format"] == "csv":
                texts = spark.read.option("header", meta["header"]).csv(f"{one}/data", schema=", ".join(f"`{c}` string" for c in meta["columns"]))
                frames.append(texts.select(*[F.from_json(f"`{f.name}`", f.dataType).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kind.fields]))
            else:
                frames.append(spark.read.parquet(f"{one}/data").toDF(*meta["columns"]))
        elif form == "csv":
            if schema:
                frames.append(spark.read.option("header", header).csv(one, schema=", ".join(f"`{c.strip()}` string" for c in schema.split(","))))
            elif header and not schema:
                frames.append(spark.read.option("header", True).csv(one))
            else:
                frames.append(spark.read.text(one).withColumnRenamed("value", "_raw"))
        elif form in (None, "parquet", "avro"):
            frames.append(spark.read.parquet(one))
        else:
            raise QueryError(f"Format {form} is not supported")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


_LISTING = "permissions string, owner string, size string, modificationDate string, accessDate string, name string, path string, type string"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file; none where nothing is."""
    fs, p, _ = _fs(spark, path)
    rows = []
    when = lambda ms: datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%d %H:%M:%S")
    for s in fs.globStatus(p) or []:
        for f in fs.listStatus(s.getPath()) if s.isDirectory() else [s]:
            kind = "d" if f.isDirectory() else "s" if f.isSymlink() else "f"
            rows.append((f.getPermission().toString(), f.getOwner(), f"{f.getLen() / 1024:.2f}".rstrip("0").rstrip(".") + "K", when(f.getModificationTime()), when(f.getAccessTime()), f.getPath().getName(), f.getPath().toString(), kind))
    return spark.createDataFrame(rows, _LISTING)


def delete(spark: SparkSession, path: str) -> DataFrame:
    fs, p, _ = _fs(spark, path)
    there = fs.exists(p)
    done = there and fs.delete(p, True)
    return spark.createDataFrame([(path, "delete", bool(done), "deleted" if done else "can't be deleted" if there else "isn't there")], "path string, operation string, success boolean, reason string")
