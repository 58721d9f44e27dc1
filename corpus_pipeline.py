"""From raw documents to packed training windows, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import is_scan, materialize, table
from sluice.llm.exact_dedup import exact_dedup
from sluice.llm.mixing import mix
from sluice.llm.packing import pack
from sluice.llm.simhash import simhash_dedup
from sluice.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels, rejects go."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in mixed order: the order of the files' names and of the rows in each file."""
    out = mix(docs)
    return out.drop(*out.columns[-2:])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows with their token ids. Shards are runs of 4096 rows of a file, so that each holds neighbours in the mix and they follow it
    by name; rows that don't lie in files are written to the shared folder first."""
    if not is_scan(docs):
        docs = materialize(docs)
    at = docs.metadataColumn("_metadata")
    return pack(docs, shard=F.concat_ws("/", F.regexp_extract(at["file_name"], r"^(part-\d+)", 1), F.lpad(F.floor(at["row_index"] / 4096).cast("string"), 9, "0")))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training and the genetic algorithm can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
