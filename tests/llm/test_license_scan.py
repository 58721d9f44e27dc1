import math
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.llm.license_scan import TEMPLATES, license_scan

DOCS = "doc_id bigint, text string, path string"
MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
PROSE = "green hills and quiet rivers run past the old mill where nobody ever came to ask about the weather of the day"


def scan(df, **options):
    out = license_scan(df, F.col("path"), **options)
    names = out.columns[-3:]
    return {(r["doc_id"], r["path"]): tuple(r[c] for c in names) for r in out.collect()}, out


def brute(rows, threshold=0.6):
    """The licence and cosine of each text's best run of adjacent lines, by dense dictionaries: all runs, none left out."""
    words = lambda t: re.findall(r"[^\W_]+(?:\.\d+)*", t.lower())
    n, longest = len(rows), max(len(words(t)) for _, t in TEMPLATES)
    df = Counter(w for _, t in rows for w in set(words(t or "")))
    known = {w for _, t in TEMPLATES for w in words(t)}
    idf = lambda w: math.log((n + 1) / ((df[w] if w in known else max(df[w], 1)) + 1)) + 1

    def vector(counts):
        x = {w: c * idf(w) for w, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {w: v / norm for w, v in x.items()} if norm else {}

    templates = [(name, vector(Counter(words(t)))) for name, t in TEMPLATES]
    out = {}
    for i, t in rows:
        best = None
        lines = [x for x in (words(line) for line in re.split(r"[\r\n]+", t or "")) if x]
        for lo in range(len(lines)):
            counts, size = Counter(), 0
            for line in lines[lo:]:
                if size >= longest:
                    break
                counts.update(line)
                size += len(line)
                v = vector(counts)
                scores = [round(sum(v.get(w, 0) * x for w, x in b.items()), 6) for _, b in templates]
                k = max(range(len(scores)), key=lambda k: (scores[k], -k))
                if scores[k] >= threshold:
                    best = min(best or (9, ""), (-scores[k], templates[k][0]))
        out[i] = best and (best[1], -best[0])
    return out


def test_whole_table_like_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    rows = license_scan(docs, F.col("source")).where("license_origin <> 'inherited'").collect()
    got = {r["doc_id"]: (r["license"], pytest.approx(r["license_score"], abs=1e-5)) for r in rows}
    assert {i: x for i, x in want.items() if x} == got and got


def test_templates_find_themselves(table):
    rows = [(i, text, f"d{i}/LICENSE") for i, (_, text) in enumerate(TEMPLATES)]
    got, _ = scan(table(rows + [(i + 1000, PROSE, None) for i in range(100)], DOCS))
    for i, (name, _) in enumerate(TEMPLATES):
        assert got[i, f"d{i}/LICENSE"][::2] == (name, "file"), TEMPLATES[i]


def wrapped(text, mark, width=60):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_versions_of_wrapped_headers(table):
    headers = {}
    for name, text in TEMPLATES:
        if "either version" in text:
            headers[name] = wrapped(text, " * ") + f"\n\n{PROSE}\nint main() {{ return 0; }}\n" + "\n".join([PROSE] * 3)
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"} == headers.keys()
    got, _ = scan(table([(i, text, f"src/{i}.c") for i, text in enumerate(headers.values())], DOCS))
    for i, name in enumerate(headers):
        assert got[i, f"src/{i}.c"][::2] == (name, "header")


def test_a_source_file_is_no_licence_file(table):
    notice = wrapped(next(t for n, t in TEMPLATES if n == "GPL-2.0" and "either" in t), "// ")
    got, _ = scan(table([(1, notice, "r/c.c"), (2, PROSE, "r/d.c"), (3, wrapped(next(t for n, t in TEMPLATES if n == "MIT" and "WARRANTY" in t), ""), "s/LICENSE"), (4, PROSE, "s/a.py")], DOCS))
    assert got[1, "r/c.c"][::2] == ("GPL-2.0", "header") and got[2, "r/d.c"][0] is None
    assert got[3, "s/LICENSE"][::2] == ("MIT", "file") and got[4, "s/a.py"][::2] == ("MIT", "inherited")


def test_nearest_directory(table):
    rows = [
        (1, MIT, "a/LICENSE"), (2, PROSE, "a/x"), (3, PROSE, "a/b/c/y"), (4, GPL, "a/b/COPYING.txt"), (5, PROSE, "z/x"), (6, f"{PROSE}\n{GPL}\n{PROSE}", "a/h"),
        (7, PROSE, "ab/x"), (8, PROSE, "top"), (9, MIT, "q/r/notes"), (10, PROSE, "q/x"), (11, PROSE, "q/r/s/x"), (12, f"{PROSE} {PROSE}\n{MIT}", "w/header"), (13, PROSE, "w/x"),
    ]
    got, _ = scan(table(rows, DOCS))
    short = {i: (l, o) for (i, _), (l, _, o) in got.items()}
    assert short == {
        1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "inherited"), 4: ("GPL-3.0", "file"), 5: (None, None), 6: ("GPL-3.0", "header"),
        7: (None, None), 8: (None, None), 9: ("MIT", "file"), 10: (None, None), 11: ("MIT", "inherited"), 12: ("MIT", "header"), 13: (None, None),
    }


def test_root_licence_and_ties(table):
    rows = [(1, MIT, "LICENSE"), (2, PROSE, "a/b"), (3, PROSE, "c"), (4, f"{MIT}\n{GPL}", "t/LICENSE"), (5, PROSE, "t/x")]
    got, _ = scan(table(rows, DOCS))
    assert got[2, "a/b"][0] == got[3, "c"][0] == "MIT"
    assert got[4, "t/LICENSE"][0] == got[5, "t/x"][0]


def test_nulls_ties_and_clashes(table):
    rows = [(1, MIT, "a/LICENSE"), (1, MIT, "a/LICENSE"), (2, None, "a/x"), (3, "", "a/y"), (4, PROSE, None), (5, MIT, None), (None, MIT, "b/LICENSE"), (6, PROSE, "b/x"), (7, "word " * 200_000 + "\n" + GPL, "long")]
    df = table(rows, DOCS, clash=True)
    got, out = scan(df)
    assert out.columns[:-3] == df.columns and out.count() == 8
    short = {i: (l, o) for (i, _), (l, _, o) in got.items()}
    assert short == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("MIT", "inherited"), 4: (None, None), 5: ("MIT", "file"), None: (None, None), 6: (None, None), 7: ("GPL-3.0", "header")}


def test_empty(table):
    assert scan(table([], DOCS))[0] == {}


LINE = "This document was released under the MIT License."


def test_scores_are_alike_at_every_size(table):
    texts = [LINE, *["this document was about the river", PROSE, "a document of the old days was here", "weather and rivers"] * 12]
    scores = []
    for times in (1, 60):
        got, _ = scan(table([(i, x, f"a/{i}") for i, x in enumerate(texts * times)], DOCS))
        assert got[0, "a/0"][0] == "MIT"
        scores.append(got[0, "a/0"][1])
    assert scores[0] == pytest.approx(scores[1], abs=0.02)


def test_wrapped_notices(table):
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/."
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    mit = "MIT License\n\nCopyright (c) 2024 Example\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"
    apache = "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"
    body = "\n".join([PROSE] * 8)
    rows = [(1, f"{mpl}\n\n{body}", "m"), (2, f"{body}\nReleased under\nthe MIT\nLicense.\n{body}", "r"), (3, f"{gpl}\n{body}", "g"), (4, mit, "x/LICENSE"), (5, apache, "y/LICENSE"), (6, body, "y/z")]
    got = {i: (l, o) for (i, _), (l, _, o) in scan(table(rows + [(i, body, None) for i in range(10, 60)], DOCS))[0].items()}
    assert [got[i] for i in range(1, 7)] == [("MPL-2.0", "header"), ("MIT", "header"), ("GPL-3.0", "header"), ("MIT", "file"), ("Apache-2.0", "file"), ("Apache-2.0", "inherited")]
