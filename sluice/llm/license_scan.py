"""License scans: sparse TF-IDF cosines of notices and licence files to templates; files without one inherit it from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, materialize, one_row_per_id, table

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_CLAUSES = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_APACHE = "Licensed under the Apache License, Version 2.0"
#: The GNU licences by name, version and what their notices call the work.
_GNU = (("GPL", "General Public License", ("2", "3"), "program"), ("LGPL", "Lesser General Public License", ("2.1", "3"), "library"), ("AGPL", "Affero General Public License", ("3",), "program"))


def _gnu() -> list[tuple[str, str]]:
    """For each version the title of the licence's text, the notice of a line, and the one of a file header."""
    out = []
    for short, name, versions, work in _GNU:
        for v in versions:
            spdx, by = f"{short}-{v if '.' in v else v + '.0'}", ";" if v[0] == "2" else ","
            out.append((spdx, f"GNU {name}, version {v}"))
            out.append((spdx, f"This {'work' if short == 'GPL' else work} is licensed under the GNU {name}, version {v}."))
            out.append((spdx, f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{by} either version {v} of the License, or (at your option) any later version."))
    return out


#: Notices and licence texts by SPDX identifier; a licence may have several.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", _GRANT),
    ("MIT", f"MIT License. {_GRANT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"),
    ("Apache-2.0", f"{_APACHE}."),
    ("Apache-2.0", f"{_APACHE} (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", f"{_APACHE} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004. http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution"),
    *_gnu(),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", f"{_BSD}: {_CLAUSES} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", f"{_BSD}: {_CLAUSES}"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal public domain dedication."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
)
TERM = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
#: Files with an ending other than those of texts are no licence files, however much of them is a notice.
OTHER_NAME = r"(?i)\.(?!(?:txt|md|rst|html?|adoc)$)[a-z]\w*$"


def terms(text: str) -> list[str]:
    """A template's terms, as TERM finds them."""
    return re.findall(r"[^\W_]+(?:\.\d+)*", text.lower())


def template_rows(templates: tuple[tuple[str, str], ...], df: Mapping[str, int], n: int) -> list[tuple[int, str, str, float]]:
    """(template, licence, term, weight) with weights of length 1 for each template."""
    out = []
    for i, (name, text) in enumerate(templates):
        w = {t: c * (math.log((n + 1) / (df.get(t, 0) + 1)) + 1) for t, c in Counter(terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out += [(i, name, t, x / norm) for t, x in sorted(w.items())]
    return out


def signature(rows: list[tuple[int, str, str, float]], df: Mapping[str, int], threshold: float) -> list[str]:
    """Terms of which a text has at least one if its cosine to any template is threshold or more.

    Of each template the commonest terms are left out as long as their weights alone are shorter than the threshold, which bounds the cosine.
    """
    out: set[str] = set()
    for i in {r[0] for r in rows}:
        room = max(threshold - 1e-6, 0) ** 2
        for term, weight in sorted(((t, w) for k, _, t, w in rows if k == i), key=lambda x: (-df.get(x[0], 0), x[0])):
            room -= weight * weight
            if room <= 0:
                out.add(term)
    return sorted(out)


def runs(longest: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of texts (id, path, n_terms, lines), lines being (line, n, marked), all runs of adjacent lines with a marked one whose lines but the last
    have fewer than longest terms: (id, path, n_terms, lo, hi, n, line)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, path, n_terms, lines in batch.itertuples(index=False):
                lines = list(lines)
                coming, at = [len(lines)] * len(lines), len(lines)  # the next marked line
                for k in range(len(lines) - 1, -1, -1):
                    at = coming[k] = k if lines[k]["marked"] else at
                for lo in range(len(lines)):
                    n, hi = 0, lo
                    while hi < len(lines) and n < longest:
                        n += lines[hi]["n"]
                        hi += 1
                        if coming[lo] < hi:
                            out.append((i, path, n_terms, lo, hi, n, "\n".join(x["line"] for x in lines[lo:hi])))
            yield pd.DataFrame(out, columns=["id", "path", "n_terms", "lo", "hi", "n", "line"])

    return cut


def line_scores(lines: DataFrame, rows: list[tuple[int, str, str, float]], counts: DataFrame, n: int) -> DataFrame:
    """(line, licence, cosine) for each line that shares a term with a template: its best licence. Ties go to the first template.

    counts has (term, n): of the n documents, how many have the term. Terms of the lines that aren't there are in one document.
    """
    spark = lines.sparkSession
    lines = materialize(lines.select("line", F.monotonically_increasing_id().alias("at")))  # the shuffles carry numbers for the texts
    idf = counts.select("term", (F.log(F.lit(n + 1) / (F.col("n") + 1)) + 1).alias("idf"))
    found = lines.select("at", F.explode(F.regexp_extract_all(F.lower("line"), F.lit(TERM), 0)).alias("term")).groupBy("at", "term").agg(F.count("*").alias("tf"))
    weighed = found.join(idf, "term", "left").select("at", "term", (F.col("tf") * F.coalesce("idf", F.lit(math.log((n + 1) / 2) + 1))).alias("w"))
    norms = weighed.groupBy("at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    templates = spark.createDataFrame(rows, "template int, licence string, term string, weight double")
    dots = weighed.join(templates, "term").groupBy("at", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "at").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
    best = scored.groupBy("at").agg(F.max_by("licence", F.struct("cosine", -F.col("template"))).alias("licence"), F.max("cosine").alias("cosine"))
    return best.join(lines, "at").select("line", "licence", "cosine")


def ancestors(path: Column) -> Column:
    """The directories above a path, as 'a/b/' for 'a/b/c'; '' is above all."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.when(n > 0, F.lit("/")).otherwise(F.lit(""))))


def license_scan(docs: DataFrame, path: Column, text: str = "text", key: str = "doc_id", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """docs with columns license, license_score and license_origin: 'file' for licence files, 'header' for other texts with a notice,
    'inherited' from the nearest directory above with a licence file, or null.

    Every line of every text, and every run of adjacent lines about as long as the longest template, so that notices may be wrapped, is compared
    by the cosine of TF-IDF vectors with the templates; lines without terms don't part a run. The inverse document frequencies are counted over
    all documents for all terms. Only runs that can't reach threshold for want of rare terms of the templates go unscored. A text's licence is
    that of its run of the highest cosine, if that is threshold or more; ties go to the name that sorts first. A licence file has a name like
    LICENSE, or notices make up file_share of its words (where of overlapping runs the best one counts) and its name hasn't the ending of
    a source file. A directory's licence is that of its file of the highest cosine; ties go to the name that sorts first.

    Null and empty texts have no notice and may inherit. A null path has no directories and inherits nothing. Rows with a null key are never
    given a licence; of rows that repeat a key one stays. Texts and lines of any length are scanned whole. An empty table gives an empty one.
    Where other columns have these names, those of the new ones get longer.
    """
    docs = one_row_per_id(docs, key)
    name, score, origin = fresh(docs, "license", "license_score", "license_origin")
    vocabulary = sorted({t for _, x in templates for t in terms(x)})
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(TERM), 0)
    base = docs.where(col(key).isNotNull()).select(col(key).alias("id"), path.alias("path"), col(text).alias("t"))
    n = docs.count()
    counts = materialize(docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("term").isin(vocabulary)))
    df = dict.fromkeys(vocabulary, 0) | {r["term"]: r["n"] for r in counts.where(F.col("term").isin(vocabulary)).collect()}
    rows = template_rows(templates, df, n)
    marks = F.array(*[F.lit(t) for t in signature(rows, df, threshold)])
    of_line = F.transform(F.split("t", r"[\r\n]+"), lambda x: F.struct(x.alias("line"), F.regexp_extract_all(F.lower(x), F.lit(TERM), 0).alias("terms")))
    split = F.transform(F.filter(of_line, lambda x: F.size(x["terms"]) > 0), lambda x: F.struct(x["line"].alias("line"), F.size(x["terms"]).alias("n"), F.arrays_overlap(x["terms"], marks).alias("marked")))
    marked = base.where(F.arrays_overlap(F.regexp_extract_all(F.lower("t"), F.lit(TERM), 0), marks)).select("id", "path", F.regexp_count("t", F.lit(TERM)).alias("n_terms"), split.alias("lines"))
    kind = f"id {docs.schema[key].dataType.simpleString()}, path string, n_terms int, lo int, hi int, n int, line string"
    lines = materialize(marked.mapInPandas(runs(max(len(terms(x)) for _, x in templates)), kind))
    scores = line_scores(lines.select("line").distinct(), rows, counts, n).where(F.col("cosine") >= threshold)
    hits = materialize(lines.join(scores, "line").drop("line"))
    # a run counts if on none of its lines a better one, or one as good and shorter, lies
    rank = F.struct((-F.col("cosine")).alias("c"), (F.col("hi") - F.col("lo")).alias("size"), F.col("lo").alias("lo"))
    first = hits.select("id", "lo", "hi", "cosine", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("at")).groupBy("id", "at").agg(F.min(rank).alias("r"))
    whole = first.groupBy("id", F.col("r.lo").alias("lo"), (F.col("r.lo") + F.col("r.size")).alias("hi")).agg(F.count("*").alias("held")).where("held = hi - lo")
    hits = hits.join(whole, ["id", "lo", "hi"])
    best = F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), F.col("licence")))
    own = materialize(
        hits.groupBy("id", "path", "n_terms")
        .agg(best.alias("b"), F.sum("n").alias("noticed"))
        .select("id", "path", "b.licence", "b.cosine", F.coalesce(F.col("path").rlike(FILE_NAME) | ~F.col("path").rlike(OTHER_NAME) & (F.col("noticed") >= file_share * F.col("n_terms")), F.col("noticed") >= file_share * F.col("n_terms")).alias("is_file"))
    )
    directory = F.concat(F.element_at(ancestors(F.col("path")), -1))
    of_directory = own.where("is_file AND path IS NOT NULL").groupBy(directory.alias("dir")).agg(best.alias("b")).select("dir", "b.licence", "b.cosine")
    lacking = docs.where(path.isNotNull() & col(key).isNotNull()).select(path.alias("path")).select(F.element_at(ancestors(F.col("path")), -1).alias("below")).distinct()
    above = lacking.select("below", F.explode(ancestors(F.col("below"))).alias("dir")).join(of_directory, "dir")
    nearest = materialize(above.groupBy("below").agg(F.max_by(F.struct("licence", "cosine"), F.length("dir")).alias("i")).select("below", "i.licence", "i.cosine"))
    i, mine, score_of, kind, below, theirs, its, at = fresh(docs, "own_id", "own_license", "own_score", "own_kind", "below", "dir_license", "dir_score", "dir")
    given = own.select(F.col("id").alias(i), F.col("licence").alias(mine), F.col("cosine").alias(score_of), F.when(F.col("is_file"), "file").otherwise("header").alias(kind))
    lent = nearest.select(F.col("below").alias(below), F.col("licence").alias(theirs), F.col("cosine").alias(its))
    out = docs.withColumn(at, F.when(col(key).isNotNull(), F.element_at(ancestors(path), -1)))
    out = out.join(given, col(key) == F.col(i), "left").join(lent, F.col(at) == F.col(below), "left")
    return out.select(*[col(c) for c in docs.columns], F.coalesce(mine, theirs).alias(name), F.coalesce(score_of, its).alias(score), F.coalesce(kind, F.when(F.col(theirs).isNotNull(), F.lit("inherited"))).alias(origin))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over documents, as files doc_id in directories source/lang."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("unknown")), F.coalesce(F.col("lang"), F.lit("unknown")), F.col("doc_id").cast("string"))
    return license_scan(docs, path).select("doc_id", "source", "lang", "license", "license_score", "license_origin")
