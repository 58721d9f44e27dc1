"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to clash with no column of df (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read back: the lineage is cut and a lost executor costs nothing but its running tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_scan(df: DataFrame) -> bool:
    """Whether df is a Parquet table as it lies in its files, so that file and place name a row."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().toString() == "parquet"


def row_order(df: DataFrame, key: str) -> Column:
    """An order of rows for ties: key (nulls last), then a hash of the other columns (maps, which can't be hashed, left out)."""
    rest = [col(f.name) for f in df.schema.fields if not _has_map(f.dataType)]
    return F.struct(col(key).isNull(), col(key), F.xxhash64(*rest))


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def first_rows(df: DataFrame, by: list[Column], key: str) -> DataFrame:
    """One row of df for each value of by, the least in row_order; partial aggregation keeps a hot value from piling up in one task."""
    names = df.columns
    picked = df.groupBy(*[b.alias(f"_k{i}") for i, b in enumerate(by)]).agg(F.min_by(F.struct(*[col(c) for c in names]), row_order(df, key)).alias("_row"))
    return picked.select("_row.*")


def one_row_per_id(df: DataFrame, key: str) -> DataFrame:
    """df with one row for each non-null key; rows without a key all stay. Only the keys are shuffled where none is repeated."""
    again = materialize(df.where(col(key).isNotNull()).groupBy(col(key).alias(key)).agg(F.count("*").alias("_n")).where("_n > 1").select(col(key)))
    if again.isEmpty():
        return df
    return df.join(again, key, "left_anti").select(df.columns).unionByName(first_rows(df.join(again, key, "left_semi").select(df.columns), [col(key)], key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the graph with edges (u, v): root is the least node it is connected with.

    Large-star and small-star rounds; their number grows with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
