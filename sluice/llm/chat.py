"""Chat formatting: conversations as token ids with reserved ids spliced in, and masks of what is to be learnt."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is split before byte pairs are merged.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROLS = ("endoftext", "im_start", "im_end")
_CONTROL = re.compile(r"<(\\*)\|(" + "|".join(CONTROLS) + r")\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(" + "|".join(CONTROLS) + r")\|>")


def escape(text: str) -> str:
    """A control string gets a backslash, and so does one that has some already; unescape() takes it away."""
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


@lru_cache(maxsize=4)
def encoding(path: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The encoding in a file of ranks, and the reserved ids, which come after its own."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    first = max(ranks.values()) + 1
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), {c: first + i for i, c in enumerate(CONTROLS)}


def assemble(turns: list[tuple[str | None, str | None]], path: str, trained: tuple[str, ...] = ("assistant",)) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of a conversation of (role, text) turns.

    Each turn is im_start, role, line feed, text, im_end, line feed; at last comes endoftext. Role and text are encoded each by itself, so
    that no token spans a border. The mask is the running sum of +1 where a trained text starts and -1 behind its im_end.
    """
    enc, ids = encoding(path)
    line = enc.encode_ordinary("\n")
    segments: list[list[int]] = []
    marks: list[tuple[int, int]] = []
    for role, text in turns:
        head = [ids["im_start"], *enc.encode_ordinary(escape(role or "unknown")), *line]
        marks.append((len(segments) + 1, int(role in trained)))
        segments += [head, enc.encode_ordinary(escape(text or "")) + [ids["im_end"]], line]
    segments.append([ids["endoftext"]])
    ends = np.cumsum([len(s) for s in segments])
    steps = np.zeros(ends[-1] + 1, np.int64)
    for at, on in marks:
        steps[ends[at - 1]] += on
        steps[ends[at]] -= on
    return np.fromiter((i for s in segments for i in s), np.int32, ends[-1]), np.cumsum(steps[:-1]).astype(np.int8)


def disassemble(tokens: list[int], path: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a conversation's ids."""
    enc, ids = encoding(path)
    turns, at = [], 0
    while tokens[at] == ids["im_start"]:
        end = tokens.index(ids["im_end"], at)
        role, _, text = enc.decode(tokens[at + 1 : end]).partition("\n")
        turns.append((unescape(role), unescape(text)))
        at = end + 1 + len(enc.encode_ordinary("\n"))
    return turns


def _assemble_all(path: str, trained: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [assemble([(t["role"], t["text"]) for t in turns], path, trained) for turns in b.column(1).to_pylist()]
            n = [len(i) for i, _ in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i for i, _ in out], pa.list_(pa.int32())), pa.array([m for _, m in out], pa.list_(pa.int8())), pa.array(n, pa.int32()), pa.array([int(m.sum()) for _, m in out], pa.int32())], ["conv_id", "input_ids", "loss_mask", "n_tokens", "n_trained"])

    return run


def format_chats(turns: DataFrame, tokenizer: str = TOKENIZER, trained: tuple[str, ...] = ("assistant",), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, input_ids, loss_mask, n_tokens, n_trained), one row for each conversation.

    Turns are taken in the order of turn; ties and repeated rows all stay, by role and then text; a null turn comes first. A null or empty
    text is an empty message, a null role is written as unknown, rows with a null conv_id are one conversation. Control strings in texts
    and roles are escaped and never become reserved ids. Texts are encoded whole, whatever their length. An empty table gives an empty one.
    Other columns, whatever their names, aren't read.
    """
    rows = turns.select(col(conv).cast("bigint").alias("conv_id"), F.struct(col(turn).alias("turn"), col(role).alias("role"), col(text).alias("text")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return gathered.mapInArrow(_assemble_all(tokenizer, trained), "conv_id bigint, input_ids array<int>, loss_mask array<tinyint>, n_tokens int, n_trained int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
