"""URL filters: pattern rules found by their rarest literal token; only rules so found are run."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, table

_TOKEN = re.compile(r"[a-z0-9]+")

#: Rules of the query: || is the border of a domain label, | an end of the URL, * any text, ^ a separator or the end; @@ begins an exception;
#: /.../ is a regular expression.
RULES = (
    "||casino-win.example.com^",
    "||free-bets.example.com^",
    "||cheap-pills.example.com^",
    "||spam-farm.example.com^",
    "||adult-x.example.net^",
    "||ads-track.example.com^",
    "-casino.",
    "/casino/*",
    "/slots/*/play^",
    "://adserver.",
    "/adserv/*",
    "/banners/*.gif|",
    "/popunder.",
    "?affiliate_id=",
    "&click_id=*&pid=",
    "/wp-login.php^",
    "/xmlrpc.php|",
    "||tracker.*^pixel^",
    "/pixel.gif?",
    "^utm_source=feed|",
    "@@||tionble.example.org^",
    "@@^en^*utm_source=feed|",
    "*/tag/*/page/*/comments",
    r"/\/(print|share|login)\/[0-9]+$/",
    r"/:\/\/[^\/]*(xxx|porn)[^\/]*\//",
    r"/[?&]sid=[0-9a-f]{32}/",
    "||m.thth*.example.net^de^",
    "@@||blog.*^fr^",
)


@dataclass(frozen=True)
class Rule:
    number: int
    text: str
    allows: bool
    pattern: str
    tokens: frozenset[str]


def parse(text: str, number: int = 0) -> Rule:
    """A rule's regular expression, and the tokens that every URL it matches has as whole tokens (none for a regular expression)."""
    allows = text.startswith("@@")
    body = text[2:] if allows else text
    if len(body) > 2 and body[0] == body[-1] == "/" and re.search(r"[\\\[\](){}+$^|?]", body[1:-1]):
        return Rule(number, text, allows, body[1:-1], frozenset())
    body = body.lower()
    start, end = "", ""
    if body.startswith("||"):
        start, body = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        start, body = "^", body[1:]
    if body.endswith("|"):
        end, body = "$", body[:-1]
    parts = {"*": ".*", "^": r"([^a-z0-9_.%-]|$)"}
    pattern = start + "".join(parts.get(c) or re.escape(c) for c in body) + end
    tokens = set()
    for m in _TOKEN.finditer(body):
        whole_left = body[m.start() - 1] != "*" if m.start() else bool(start)
        whole_right = body[m.end()] != "*" if m.end() < len(body) else bool(end)
        if whole_left and whole_right:
            tokens.add(m.group())
    return Rule(number, text, allows, pattern, frozenset(tokens))


def index(rules: Sequence[Rule], counts: Mapping[str, int]) -> dict[str, list[int]]:
    """Rule numbers under the rarest token of each, by counts, then by length and spelling; under "" those without one."""
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default=""), []).append(i)
    return out


class Matcher:
    """Of the rules that match a URL (in lower case) the deciding one: the first exception, else the first other rule."""

    def __init__(self, rules: Sequence[Rule], by_token: Mapping[str, list[int]]) -> None:
        self.rules, self.by_token = rules, by_token
        self.always = by_token.get("", [])
        self.patterns: dict[int, re.Pattern] = {}

    def decide(self, url: str | None) -> Rule | None:
        if not url:
            return None
        url = url.lower()
        found = list(self.always)
        for t in set(_TOKEN.findall(url)):
            found += self.by_token.get(t, ())
        best: tuple[bool, int] | None = None
        for i in found:
            p = self.patterns.get(i)
            if p is None:
                p = self.patterns[i] = re.compile(self.rules[i].pattern)
            rank = (not self.rules[i].allows, i)
            if (best is None or rank < best) and p.search(url):
                best = rank
        return self.rules[best[1]] if best else None


def filter_urls(pages: DataFrame, rules: Sequence[str] = RULES, url: str = "url") -> DataFrame:
    """pages with columns url_blocked and url_rule, the text of the deciding rule (null if none matches).

    One pass counts, over all URLs, those of the rules' tokens, so that each rule is indexed by its rarest; the second looks up each URL's
    tokens and runs the rules found there, and those without a whole literal token. Nothing but the counts shuffles. The rules are a
    setting, held by every worker.

    URLs and rules are compared in lower case (regular expressions are written for it). Null and empty URLs match nothing. Of several rules
    the first exception decides, else the first. URLs of any length are searched whole. Repeated rows are judged alike; an empty table gives
    an empty one. Where other columns have these names, those of the new ones get longer.
    """
    parsed = [parse(r, i) for i, r in enumerate(rules)]
    wanted = sorted({t for r in parsed for t in r.tokens})
    blocked, rule = fresh(pages, "url_blocked", "url_rule")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(col(url)), F.lit("[a-z0-9]+"), 0))
    used = F.explode(F.array_intersect(tokens, F.array(*[F.lit(t) for t in wanted]).cast("array<string>")))
    counts = Counter({r["t"]: r["n"] for r in pages.select(used.alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()})
    sent = pages.sparkSession.sparkContext.broadcast((parsed, index(parsed, counts)))
    held: list[Matcher] = []

    @F.pandas_udf("string")
    def decide(urls: pd.Series) -> pd.Series:
        if not held:
            held.append(Matcher(*sent.value))
        found = [held[0].decide(u) for u in urls]
        return pd.Series([r.text if r else None for r in found], dtype=object)

    return pages.withColumn(rule, decide(col(url))).withColumn(blocked, col(rule).isNotNull() & ~F.coalesce(col(rule).startswith("@@"), F.lit(False))).select(*[col(c) for c in pages.columns], blocked, rule)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "url", "url_blocked", "url_rule")


def _sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({r.number}, {r.allows}, {text(r.text)}, {text(r.pattern)})" for r in map(parse, RULES, range(len(RULES))))
    return f"""
WITH rules(number, allows, rule, pattern) AS (VALUES {rows}),
urls AS (SELECT DISTINCT url FROM pages),
hits AS (SELECT url, allows, rule, row_number() OVER (PARTITION BY url ORDER BY allows DESC, number) AS k
         FROM urls JOIN rules ON regexp_matches(lower(url), pattern))
SELECT page_id, p.url, coalesce(NOT allows, false) AS url_blocked, rule AS url_rule
FROM pages p LEFT JOIN hits h ON p.url = h.url AND k = 1
"""


SQL = _sql()
