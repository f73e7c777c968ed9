"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

DataFrame functions only.  Inverse document frequencies come from all texts.  Candidates of a file are each of its lines,
each run of lines most of whose terms some template has (a notice that is wrapped over lines, behind comment marks or
not), and the file as a whole if half of its lines are such lines of one template; blank lines do not count.  The file has the licence of the most similar template if a
candidate's cosine is ``THRESHOLD`` or more.  A licence file gives its licence to its directory; a file without a header
of its own takes that of its nearest ancestor directory that has one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

#: Licence and notice, in the words in which notices are commonly given.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # whole notices and licence texts
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: The least cosine, the least share of a line's terms that its run's template has, and copies of each directory's licence,
#: so that a directory with very many files below it is joined in as many tasks.
THRESHOLD, COVERED, SALTS = 0.75, 0.5, 16
SPLIT = r"[^\p{L}\p{N}.\-]+|[.\-]+(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[.\-]+"
_SPLIT = re.compile(r"[^\w.\-]+|_+|[.\-]+(?!\w)|(?<!\w)[.\-]+")


def terms(text: str) -> list[str]:
    return [t for t in _SPLIT.split(text.lower()) if t]


def terms_column(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """(texts, texts with each term): as many rows as the templates have terms reach the driver."""
    words = files.sparkSession.createDataFrame([(v,) for v in vocabulary], "term string")
    n = files.count()
    found = files.select(F.explode(F.array_distinct(terms_column(F.coalesce("text", F.lit(""))))).alias("term")).join(F.broadcast(words), "term")
    return n, {r.term: r["count"] for r in found.groupBy("term").count().collect()}


def weights(n: int, df: dict[str, int], templates) -> tuple[dict[str, float], list[tuple[str, dict[str, float]]]]:
    """Idf of each term, and the unit vector of each template."""
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, x in templates for t in terms(x)}
    vectors = []
    for name, x in templates:
        v: dict[str, float] = {}
        for t in terms(x):
            v[t] = v.get(t, 0.0) + idf[t]
        norm = math.sqrt(sum(w * w for w in v.values()))
        vectors.append((name, {t: w / norm for t, w in v.items()}))
    return idf, vectors


def telling_terms(idf: dict[str, float], vectors: list[tuple[str, dict[str, float]]], threshold: float) -> list[str]:
    """Terms of which every line at the threshold has one: without them no template keeps enough of its norm."""
    left, out = dict(idf), []
    for t in sorted(idf, key=lambda t: (-idf[t], t)):
        if all(math.sqrt(sum(w * w for u, w in v.items() if u in left)) < threshold for _, v in vectors):
            break
        del left[t]
        out.append(t)
    return out


def any_of(words: list[str]) -> str:
    """A pattern of whole words, with common beginnings shared, so that few alternatives are tried at a place."""

    def tree(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            if w:
                heads.setdefault(w[0], []).append(w[1:])
        parts = [re.escape(c) + tree(tails) for c, tails in sorted(heads.items())]
        if not parts:
            return ""
        return (parts[0] if len(parts) == 1 and "" not in rest else "(?:" + "|".join(parts) + ")") + ("?" if "" in rest else "")

    return r"(?<![\p{L}\p{N}])" + (tree(sorted(set(words))) or "(?!)") + r"(?![\p{L}\p{N}])"


def file_id(key: Column, text: Column) -> Column:
    """Names a file by its key and text: rows without a key, or that share one, are told apart."""
    return F.unhex(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.when(key.isNull(), "?").otherwise("!"), F.coalesce(text, F.lit("")))))


def headers(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, covered: float = COVERED) -> DataFrame:
    """(file, license, score, share): the best candidate of each file (see ``file_id``) that has one; share is that of its
    characters in the file's.  Of equal scores the first candidate counts, then the first template.

    The cosine gives a term that no template has the least weight, 1.
    """
    spark = files.sparkSession
    vocabulary = sorted({t for _, x in templates for t in terms(x)})
    idf, vectors = weights(*document_frequencies(files, vocabulary), templates)
    telling = telling_terms(idf, vectors, threshold)
    some = any_of(telling)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    told = files.filter(F.lower("text").rlike(some)).select(file_id(F.col("key"), F.col("text")).alias("file"), F.length("text").alias("all"), lines.alias("lines")).distinct()
    told = materialize(told, "told")
    values = F.broadcast(spark.createDataFrame([(t, w, [(n, i, v[t]) for i, (n, v) in enumerate(vectors) if t in v]) for t, w in sorted(idf.items())], "term string, idf double, uses array<struct<license:string,template:int,w:double>>"))
    line = told.select("file", F.posexplode("lines").alias("line", "said"))
    # runs: neighbouring lines most of whose terms one template has
    said = line.select("file", "line", F.explode(terms_column(F.col("said"))).alias("term"))
    size = said.groupBy("file", "line").agg(F.count("*").alias("size"))
    shared = said.join(values, "term").select("file", "line", F.explode("uses.template").alias("template")).groupBy("file", "line", "template").agg(F.count("*").alias("n"))
    close = shared.join(size, ["file", "line"]).filter(F.col("n") >= covered * F.col("size")).select("file", "line", "template")
    run = close.withColumn("run", F.col("line") - F.row_number().over(W.partitionBy("file", "template").orderBy("line")))
    runs = run.groupBy("file", "template", "run").agg(F.min("line").alias("first"), F.count("*").cast("int").alias("n")).filter("n > 1").select("file", "first", "n").distinct()
    runs = materialize(runs.unionByName(close.groupBy("file", "template").agg(F.count("*").cast("int").alias("k")).filter("k > 1").groupBy("file").agg(F.lit(0).alias("first"), (-F.max("k")).alias("n"))), "runs")
    wide = told.join(runs, "file").filter((F.col("n") > 0) | ((F.size("lines") > 1) & (-2 * F.col("n") >= F.size("lines"))))
    wide = wide.select("file", "all", "lines", "first", F.when(F.col("n") > 0, F.col("n")).otherwise(F.size("lines")).alias("n")).distinct()
    wide = wide.select("file", "all", "first", "n", F.array_join(F.slice("lines", F.col("first") + 1, F.col("n")), "\n").alias("said"))
    single = told.select("file", "all", F.posexplode("lines").alias("first", "said")).select("file", "all", "first", F.lit(1).alias("n"), "said")
    spans = single.unionByName(wide).filter(F.lower("said").rlike(some))
    span = ["file", "first", "n"]
    counted = spans.select(*span, F.explode(terms_column(F.col("said"))).alias("term")).groupBy(*span, "term").agg(F.count("*").alias("tf"))
    weighed = counted.join(values, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    norms = weighed.groupBy(*span).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.filter("uses is not null").select(*span, "x", F.inline("uses")).groupBy(*span, "license", "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norms, span).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= threshold)
    scored = scored.join(spans.select(*span, "all", F.length("said").alias("own")), span)
    best = scored.groupBy("file").agg(F.max(F.struct("score", (-F.col("first")).alias("first"), (-F.col("n")).alias("n"), (-F.col("template")).alias("template"), "license", F.least(F.lit(1.0), F.col("own") / F.col("all")).alias("share"))).alias("b"))
    return best.select("file", "b.license", "b.score", "b.share")


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, file_names: str = r"(?i)^(licen[cs]e|copying|notice)", file_share: float = 0.5) -> DataFrame:
    """(key, path, license, score, how, from_path) for each row of ``files`` (key, path, text).

    how: ``header`` (its own), ``inherited`` (from_path is the licence file's), or null.  A licence file is one whose
    name says so, or more than ``file_share`` of whose text is the notice, and that has a header.  A null path is in no
    directory; a null or empty text has no header.  Of two licence files in a directory the more similar counts, then
    the first by path.  Rows that repeat get equal results; rows that share a key or have none are files in their own
    right.  An empty table gives an empty one, and no other column is read.
    """
    own = materialize(headers(files, templates, threshold), "headers")
    marked = files.select("key", "path", file_id(F.col("key"), F.col("text")).alias("file")).join(own, "file", "left")
    parts = F.split("path", "/")
    name, folder = F.element_at(parts, -1), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    givers = marked.filter(F.col("license").isNotNull() & F.col("path").isNotNull() & (name.rlike(file_names) | (F.col("share") > file_share)))
    by_folder = givers.groupBy(folder.alias("folder")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("path").alias("from_path"), "license")).alias("g"))
    by_folder = by_folder.select("folder", F.col("g.from_path").alias("from_path"), F.col("g.license").alias("given"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    wanting = marked.filter(F.col("license").isNull() & F.col("path").isNotNull()).select("path").distinct()
    depth = F.greatest(F.size(parts) - 1, F.lit(0))
    up = F.transform(F.sequence(F.lit(0), depth), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder")))
    above = wanting.select("path", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"), F.inline(up))
    nearest = above.join(by_folder, ["folder", "salt"]).groupBy("path").agg(F.max(F.struct("depth", "from_path", "given")).alias("n"))
    out = marked.join(nearest.select("path", F.col("n.from_path").alias("from_path"), F.col("n.given").alias("given")), "path", "left")
    how = F.when(F.col("license").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited")
    return out.select("key", "path", F.coalesce("license", "given").alias("license"), "score", how.alias("how"), F.when(F.col("license").isNull(), F.col("from_path")).alias("from_path"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files.  They have no paths: source, thousands and hundreds of doc_id are the directories, and the
    documents at full thousands and hundreds are the licence files of those."""
    d = F.col("doc_id")
    thousand, hundred = F.floor(d / 1000).cast("string"), F.floor(F.pmod(d, F.lit(1000)) / 100).cast("string")
    path = F.when(F.pmod(d, F.lit(1000)) == 0, F.concat_ws("/", "source", thousand, F.lit("LICENSE"))).when(F.pmod(d, F.lit(100)) == 0, F.concat_ws("/", "source", thousand, hundred, F.lit("LICENSE"))).otherwise(F.concat_ws("/", "source", thousand, hundred, d.cast("string")))
    return docs.select(d.alias("key"), path.alias("path"), "text")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """The directories are made from doc_id, see ``document_files``: few files inherit anything."""
    return scan(document_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("key", "doc_id")
