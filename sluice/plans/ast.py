"""Syntax trees of pipe queries."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass


# Expressions of eval and where


@dataclass(frozen=True)
class Number:
    text: str


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Negation:
    of: object


# Search conditions


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class Member:
    field: str
    values: tuple


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class TimeBound:
    kind: str
    value: str
    format: str | None = None


@dataclass(frozen=True)
class Everything:
    """An empty condition."""


@dataclass(frozen=True)
class SubSearch:
    query: Query


# Commands


@dataclass(frozen=True)
class Aggregate:
    function: str
    field: str | None
    name: str


@dataclass(frozen=True)
class SortKey:
    field: str
    descending: bool = False
    kind: str = "auto"


@dataclass(frozen=True)
class Command:
    name: str
    options: dict = field(default_factory=dict)
    args: tuple = ()


@dataclass(frozen=True)
class Query:
    search: object | None
    commands: tuple = ()


def pretty(node: object, depth: int = 0) -> str:
    """The tree, a node a line."""
    pad = "  " * depth
    if is_dataclass(node):
        lines = [f"{pad}{type(node).__name__}"]
        for f in fields(node):
            value = getattr(node, f.name)
            if is_dataclass(value) or isinstance(value, (tuple, dict)) and value:
                lines += [f"{pad}  {f.name}:", pretty(value, depth + 2)]
            else:
                lines.append(f"{pad}  {f.name} = {value!r}")
        return "\n".join(lines)
    if isinstance(node, dict):
        return "\n".join(f"{pad}{k} = {v!r}" for k, v in node.items())
    if isinstance(node, tuple):
        return "\n".join(pretty(x, depth) for x in node)
    return f"{pad}{node!r}"
