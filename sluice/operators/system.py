"""Commands of the platform, makeresults, explain, the parse tree, and mail."""

from __future__ import annotations

import math
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import col
from ..plans import ast
from ..plans.lexer import QueryError
from ..plans.parser import search as parse_search
from ..sources import files, sinks
from .base import Context, command
from .columns import regex_extract, tokenizer
from .search import filter_frame


@command("makeresults")
def makeresults(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    spark = ctx.engine.spark
    out = spark.range(cmd.options["count"]).select(F.lit(ctx.now).cast("timestamp").alias("_time"))
    if not cmd.options["annotate"]:
        return out
    return out.select("_time", *[F.lit(None).cast("string").alias(c) for c in ("_raw", "host", "source", "sourcetype", "struck_server", "struck_server_group")])


@command("explain", traits=("sequential",))
def explain(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    q = df._jdf.queryExecution()
    text = q.toString() if cmd.options["mode"] == "extended" else q.executedPlan().toString()
    return ctx.engine.spark.createDataFrame([(text,)], "result string")


@command("parsetree")
def parsetree(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    return _lines(ctx, [ast.pretty(ctx.query)])


@command("sendemail", traits=("sequential",))
def sendemail(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    mail = sinks.build_mail(df, cmd.options, ctx.engine.restricted_mail)
    if mail is not None:
        ctx.engine.send_mail(mail, cmd.options)
    return df


def _lines(ctx: Context, lines: list[str]) -> DataFrame:
    spark = ctx.engine.spark
    return spark.createDataFrame([(x,) for x in lines], "_raw string").select(F.lit(ctx.now).cast("timestamp").alias("_time"), "_raw")


def _words(tokens: tuple[str, ...], options: dict[str, str]) -> dict[str, str]:
    """Options written as 'input f' besides those written as input=f."""
    out, i = dict(options), 0
    while i < len(tokens) - 1:
        if tokens[i] in ("input", "output", "format", "regex", "table", "estimates", "host", "port", "url", "servers"):
            out[tokens[i]] = tokens[i + 1]
            i += 1
        i += 1
    return out


def _on(options: dict[str, str], key: str, default: str = "false") -> bool:
    return options.get(key, default).lower() in ("t", "true", "1")


@command("system")
def system(df: DataFrame, cmd: ast.Command, ctx: Context) -> DataFrame:
    tokens, options = cmd.options["tokens"], cmd.options["options"]
    verb, what, rest = tokens[0], (tokens[1].lower() if len(tokens) > 1 else ""), tokens[2:]
    handler = _HANDLERS.get((verb, what))
    if handler is None:
        raise QueryError(f"The provided command '{verb} {what}' is not yet implemented.")
    return handler(df, ctx, rest, _words(rest, options))


def _hdfs(df: DataFrame, ctx: Context, rest: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    spark = ctx.engine.spark
    action, path = rest[0].lower() if rest else "", rest[1] if len(rest) > 1 else options.get("path")
    if action == "list":
        return files.listing(spark, path or f"/user/{spark.sparkContext.sparkUser()}")
    if not path:
        raise QueryError(f"{action} needs a path")
    if action == "save":
        files.save(df, path, options.get("format", "parquet"), _on(options, "overwrite"), _on(options, "header", "true"), options.get("retention"))
        return _lines(ctx, ["HDFS save complete."])
    if action == "load":
        out = files.load(spark, path, options.get("format"), _on(options, "header", "true"), options.get("schema"))
        if "_time" in out.columns and (ends := out.agg(F.min("_time"), F.max("_time")).first())[0] is not None and isinstance(ends[0], datetime):
            ctx.earliest, ctx.latest = (e.replace(tzinfo=UTC) if e.tzinfo is None else e for e in ends)
        return out
    if action == "delete":
        return files.delete(spark, path)
    raise QueryError(f"no file command {action}")


def _kafka(df: DataFrame, ctx: Context, rest: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    topic = rest[1] if len(rest) > 1 else f"sluice.{ctx.engine.spark.sparkContext.applicationId}"
    ctx.engine.send("kafka", sinks.kafka_payload(df, ctx.now.isoformat(), ctx.engine.spark.sparkContext.applicationId), options | {"topic": topic})
    return df


def _syslog(df: DataFrame, ctx: Context, rest: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    if ctx.aggregated:
        raise QueryError("Step 'syslog' cannot be used after aggregations!")
    ctx.engine.send("syslog", sinks.syslog_lines(df), options)
    return df


def _metric(df: DataFrame, ctx: Context, rest: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    if not ctx.aggregated:
        raise QueryError("Step 'metric write' requires a preceding aggregate!")
    ctx.engine.send("metric", sinks.metric_lines(df, rest[2] if len(rest) > 2 else "sluice.metric"), options)
    return df


#: Sizes of filters: expected elements and false-positive probability.
FILTER_SIZES = ((1000, 0.01), (100_000, 0.01), (1_000_000, 0.01), (10_000_000, 0.03), (100_000_000, 0.05))


def bloom_estimate(df: DataFrame, source: str = "tokens", into: str | None = None) -> DataFrame:
    into = into or f"estimate({source})"
    return df.select("partition", F.explode_outer(col(source)).alias("_t")).groupBy("partition").agg(F.approx_count_distinct("_t").alias(into))


def bloom_filters(df: DataFrame, source: str = "tokens", estimates: str | None = None) -> DataFrame:
    """(partition, expected, fpp, filter): a Bloom filter of each partition's tokens, of the smallest size that its estimate fits in.

    Bits are set by grouping 64-bit words with bit_or, so that a partition's tokens never meet in one task.
    """
    of = "_estimate"
    if estimates and estimates in df.columns:
        sized = df.groupBy("partition").agg(F.max(col(estimates)).alias(of))
    else:
        sized = bloom_estimate(df, source, of)
    which = F.coalesce(*[F.when(F.col(of) <= n, i) for i, (n, _) in enumerate(FILTER_SIZES)], F.lit(len(FILTER_SIZES) - 1))
    shape = [(n, p, int(math.ceil(-n * math.log(p) / math.log(2) ** 2 / 64)), max(1, round(-math.log(p) / math.log(2)))) for n, p in FILTER_SIZES]
    pick = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in shape]), which + 1)
    sized = sized.select("partition", pick(0).alias("expected"), pick(1).alias("fpp"), pick(2).cast("bigint").alias("_words"), pick(3).alias("_hashes"))
    tokens = df.select("partition", F.explode(col(source).cast("array<string>")).alias("_t")).distinct().join(sized, "partition")
    h1, h2 = F.xxhash64(F.lit(1), "_t"), F.xxhash64(F.lit(2), "_t").bitwiseOR(F.lit(1))
    bit = lambda i: F.pmod(F.call_function("try_add", h1.bitwiseAND(F.lit(2**40 - 1)), h2.bitwiseAND(F.lit(2**40 - 1)) * i), F.col("_words") * 64)
    bits = tokens.select("partition", "expected", "fpp", "_words", F.explode(F.transform(F.sequence(F.lit(0), F.col("_hashes") - 1), lambda i: bit(i))).alias("_bit"))
    words = bits.groupBy("partition", "expected", "fpp", "_words", F.floor(F.col("_bit") / 64).cast("bigint").alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("_bit"), F.lit(64)).cast("int"))).alias("_v"))
    gathered = words.groupBy("partition", "expected", "fpp", "_words").agg(F.collect_list("_w").alias("_at"), F.collect_list("_v").alias("_values"))

    @F.pandas_udf("binary")
    def dense(n: pd.Series, at: pd.Series, values: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for size, a, v in zip(n, at, values):
            filled = np.zeros(size, np.int64)
            filled[np.asarray(a)] = np.asarray(v)
            out.append(filled.tobytes())
        return pd.Series(out)

    return gathered.select("partition", "expected", "fpp", dense("_words", "_at", "_values").alias("filter"))


def _bloom(df: DataFrame, ctx: Context, rest: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    action = rest[0].lower() if rest else ""
    source = options.get("input", "tokens")
    if action == "estimate":
        return bloom_estimate(df, source, options.get("output"))
    if action not in ("create", "update"):
        raise QueryError(f"no bloom command {action}")
    made = bloom_filters(df, source, options.get("estimates"))
    if "table" in options or "regex" in options:
        made = made.withColumn("pattern", F.lit(options.get("regex", "")))
    if "bloom" in ctx.engine.senders or "url" in options:
        ctx.engine.send("bloom", made, options | {"mode": action, "table": options.get("table", "filters")})
    return made


def _config(df: DataFrame, ctx: Context, rest: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    return _lines(ctx, [f"{k} = {v}" for k, v in sorted(ctx.engine.config.items())])


def _set_config(df: DataFrame, ctx: Context, rest: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    if len(rest) < 2:
        raise QueryError("set config takes a key and a value")
    ctx.engine.set_config(rest[0], rest[1])
    return df


def _version(df: DataFrame, ctx: Context, rest: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    import platform

    return _lines(ctx, ["sluice: 1.0", f"spark: {ctx.engine.spark.version}", f"python: {platform.python_version()}"])


def _archive(df: DataFrame, ctx: Context, rest: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    """Of the events that a search finds, by index, sourcetype and host, how many there are and when."""
    words = [w for w in rest[1:] if w]
    text = " ".join([f"{k}={v}" for k, v in options.items()] + words)
    node = parse_search(text)
    found = filter_frame(ctx.engine.source(node), node, ctx)
    return found.groupBy("index", "sourcetype", "host").agg(F.count("*").alias("events"), F.min("_time").alias("first"), F.max("_time").alias("last"))


_HANDLERS = {
    ("exec", "hdfs"): _hdfs,
    ("exec", "kafka"): _kafka,
    ("exec", "syslog"): _syslog,
    ("exec", "dynatrace"): _metric,
    ("exec", "bloom"): _bloom,
    ("exec", "tokenizer"): lambda df, ctx, rest, o: tokenizer(df, o.get("input", "_raw"), o.get("output", "tokens"), o.get("format", "string")),
    ("exec", "regexextract"): lambda df, ctx, rest, o: regex_extract(df, o["regex"], o.get("input", "_raw"), o.get("output", "tokens")),
    ("exec", "foreachbatch"): lambda df, ctx, rest, o: df,
    ("get", "system"): _version,
    ("get", "config"): _config,
    ("get", "archive"): _archive,
    ("set", "config"): _set_config,
}
