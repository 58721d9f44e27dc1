import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm.url_filter import RULES, Matcher, filter_urls, index, parse

PAGES = "page_id bigint, url string"
PIECES = ["casino", "ads", "track", "com", "example", "example.com", "/", "/", ".", "-", "?", "=", "&", "://", "http", "https", "slots", "play", "pixel", "gif", "en", "utm_source", "feed", "tag", "page", "comments", "wp-login", "php", "Banners", "12", "é"]
RULE = st.lists(st.sampled_from(PIECES + ["*", "^", "*", "^"]), min_size=1, max_size=6).map("".join)


def brute(rules, url):
    """All rules' expressions, each run."""
    hits = [r for r in rules if url and re.search(r.pattern, url.lower())]
    return min(hits, key=lambda r: (not r.allows, r.number), default=None)


@given(st.lists(st.tuples(st.sampled_from(["", "||", "|", "@@", "@@||"]), RULE, st.sampled_from(["", "|", "^"])).map("".join), min_size=1, max_size=8), st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=20))
@settings(deadline=None, max_examples=300)
def test_index_finds_all_rules_that_match(rules, urls):
    parsed = [parse(r, i) for i, r in enumerate(rules)]
    m = Matcher(parsed, index(parsed, {"example": 50, "com": 40}))
    for u in urls:
        assert m.decide(u) == brute(parsed, u)


def test_rules():
    m = Matcher(p := [parse(r, i) for i, r in enumerate(RULES)], index(p, {}))
    decided = lambda u: getattr(m.decide(u), "text", None)
    assert decided("http://www.casino-win.example.com/a") == "||casino-win.example.com^"
    assert decided("http://notcasino-win.example.com/a") is None
    assert decided("https://x.org/banners/a/b.gif") == "/banners/*.gif|"
    assert decided("https://x.org/banners/a/b.gif?x") is None
    assert decided("https://x.org/print/17") == r"/\/(print|share|login)\/[0-9]+$/"
    assert decided("http://tionble.example.org/casino/1").startswith("@@")


def test_only_fetched_rules_run():
    parsed = [parse(r, i) for i, r in enumerate(["/alpha/one/", "/alpha/two/", "/beta/"])]
    m = Matcher(parsed, index(parsed, {"alpha": 100, "one": 1, "two": 1}))
    m.decide("http://h/alpha/one/")
    assert set(m.patterns) == {0}


def test_nulls_ties_and_clashes(table):
    rows = [(1, "http://a.example.com/casino/x"), (1, "http://a.example.com/casino/x"), (2, None), (3, ""), (None, "HTTP://A.example.com/CASINO/x"), (4, "http://h/" + "x/" * 200_000 + "casino/y"), (5, "http://blog.h/fr/casino/")]
    df = table(rows, PAGES, clash=True)
    out = filter_urls(df)
    blocked, rule = out.columns[-2:]
    assert out.columns[:-2] == df.columns and blocked == "url_blocked_"
    got = [(r["page_id"], r[blocked], r[rule]) for r in out.collect()]
    hit = (True, "/casino/*")
    assert got == [(1, *hit), (1, *hit), (2, False, None), (3, False, None), (None, *hit), (4, *hit), (5, False, "@@||blog.*^fr^")]


def test_empty(table):
    assert filter_urls(table([], PAGES)).collect() == []
    assert [r["url_blocked"] for r in filter_urls(table([(1, "http://a/casino/")], PAGES), rules=()).collect()] == [False]


def test_whole_table_like_brute_force(spark):
    parsed = [parse(r, i) for i, r in enumerate(RULES)]
    rows = filter_urls(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    for r in rows:
        best = brute(parsed, r["url"])
        assert (r["url_rule"], r["url_blocked"]) == (best.text if best else None, bool(best) and not best.allows)
    assert any(r["url_blocked"] for r in rows)
