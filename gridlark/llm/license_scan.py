"""License scans by DataFrame expressions only.

Texts are compared with license templates as sparse TF-IDF vectors, by their cosine:

* notices and headers (`TEMPLATES`): each line of a file, and each span of words as
  long as the template, anywhere in the text and over line ends. Only spans around
  the rarest terms of a template are looked at; no other can reach the cosine.
* license texts (`TEXTS`): the whole of a file that is named like a license file.

Terms of the templates are weighted by their document frequencies over all files, up
to the weight of a term in a thousandth of them; every other term counts in the norm
with that weight at most, or, under a thousand files, as one that no file has.
A file's own license is the best with a cosine of `least` or more. Files that are
named like license files speak for their directory: a file without a license of its
own takes that of the nearest directory above it, found by an equi-join of its
ancestor directories.

Edge cases: null and empty texts and those without words have no license of their
own but inherit, license files too; null
paths inherit nothing; null ids are ids like any other; ties go to the license first
by name, and among license files of a directory to the better score, then the first
path; a license's whole text goes before a notice, which it may hold; rights that are only reserved count where nothing else is found; rows that
repeat get equal results; very long texts are looked at to their end; extra columns
are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm._spark import has_rows_below, stable

#: Notices by license; a license has as many templates as it has usual forms.
TEMPLATES = [
    ("AGPL-3.0", "licensed under the GNU Affero General Public License version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("GPL-2.0", "licensed under the GNU General Public License version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "licensed under the GNU General Public License version 3"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "Proprietary and confidential. All rights reserved"),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole license texts, compared with whole files that are named like license files.
TEXTS = [
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
]
#: Stands beside many notices that grant something, so any other license of a text or a directory goes first.
RESERVED = "All rights reserved"
#: Weight of a word that no template has, and the most that any term weighs: that of a term in a thousandth of all files.
RARE = math.log(1_000) + 1
_WORD = "[^a-z0-9]+"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|unlicense|notice)([._-].*)?$"


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(_WORD, text.lower()) if t]


def scan(df: DataFrame, path, text_col: str = "text", id_col: str = "doc_id", least: float = 0.75, templates: list[tuple[str, str]] | None = None, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """`(doc_id, path, license, via, score, source_path)`: via is `header`, `file`
    (a licence file itself), `inherited` or null."""
    templates = TEMPLATES if templates is None else templates
    texts = TEXTS if texts is None else texts
    vocab = sorted({t for _, x in [*templates, *texts] for t in terms_of(x)})
    files = df.select(F.col(f"`{id_col}`").alias("doc_id"), path.alias("path"), F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text"))
    words = lambda c: F.filter(F.split(c, _WORD), lambda t: t != "")
    known = files.select(F.explode(F.array_distinct(F.filter(F.split("text", _WORD), lambda t: t.isin(vocab)))).alias("term"))
    freq = {r["term"]: r["n"] for r in known.groupBy("term").agg(F.count("*").alias("n")).collect()}  # bounded by the templates
    n = files.count()
    idf = {t: min(RARE, math.log((1 + n) / (1 + freq.get(t, 0))) + 1) for t in vocab}
    rare = min(RARE, math.log(1 + n) + 1)
    code = {t: k for k, t in enumerate(vocab, 1)}  # 0 is any word that no template has

    def vector(text: str) -> tuple[dict[str, int], float, list[float]]:
        """Counts of a template's terms, its norm, and what each term of the
        vocabulary adds to a product with its unit vector."""
        count = {t: terms_of(text).count(t) for t in terms_of(text)}
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in count.items()))
        dots = [0.0] * (len(vocab) + 1)
        for t, c in count.items():
            dots[code[t]] = c * idf[t] * idf[t] / norm
        return count, norm, dots

    rows = []
    for k, (name, text) in enumerate(templates):
        count, norm, dots = vector(text)
        # a span without any of these, the rarest, can't reach the cosine
        left = 1.0
        for t in sorted(count, key=lambda t: (-idf[t], t)):
            if left < least * least - 1e-9:
                break
            left -= (count[t] * idf[t] / norm) ** 2
            rows.append((code[t], k, name, 2 if text == RESERVED else 1, len(terms_of(text)), dots))
    spark = df.sparkSession
    # the templates' terms are fixed values, so this side is bounded
    sought = F.broadcast(spark.createDataFrame(rows, "term int, template int, license string, grade int, length int, dots array<double>"))
    terms = sorted({vocab[r[0] - 1] for r in rows})
    sought_codes = [code[t] for t in terms]
    longest = max((len(terms_of(x)) for _, x in templates), default=1)
    weights, names = F.array(*[F.lit(x) for x in [rare, *(idf[t] for t in vocab)]]), F.array(*[F.lit(t) for t in vocab])
    coded = lambda c: F.transform(words(c), lambda t: F.when(t.isin(vocab), F.array_position(names, t).cast("int")).otherwise(0))
    some = files.where(F.exists(F.split("text", _WORD), lambda t: t.isin(terms)))
    lines = some.select("doc_id", "path", F.explode(F.split("text", "\n")).alias("s")).select("doc_id", "path", coded("s").alias("words"))
    whole = lines.select("doc_id", "path", "words", F.explode(F.array_distinct(F.filter("words", lambda c: c.isin(sought_codes)))).alias("term"), F.lit(None).cast("int").alias("at"))
    bodies = some.select("doc_id", "path", coded("text").alias("words"))
    places = F.filter(F.transform("words", lambda c, i: F.when(c.isin(sought_codes), i)), lambda i: i.isNotNull())
    around = lambda i: F.struct(F.element_at("words", i + 1).alias("term"), F.least(i, F.lit(longest - 1)).alias("at"), F.slice("words", F.greatest(F.lit(1), i - longest + 2), 2 * longest - 1).alias("words"))
    near = bodies.select("doc_id", "path", F.explode(F.transform(places, around)).alias("x")).select("doc_id", "path", "x.words", "x.term", "x.at")
    size = F.size("words")
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("length") + 1), F.greatest(F.lit(0), F.least(F.col("at"), size - F.col("length"))))
    spans = F.when(F.col("at").isNull(), F.array("words")).otherwise(F.transform(starts, lambda i: F.slice("words", i + 1, F.col("length"))))
    total = lambda span, f: F.aggregate(span, F.lit(0.0), lambda s, c: s + f(c))
    weight = lambda c: F.element_at(weights, c + 1)
    dot = lambda span: total(span, lambda c: F.element_at(F.col("dots"), c + 1))
    hits = lambda span: F.filter(span, lambda c: c > 0)
    # counts of a term add to its square at least as often as it occurs: a bound without counting
    possible = lambda span: dot(span) * dot(span) >= (least * least - 1e-9) * total(span, lambda c: weight(c) * weight(c))
    others = lambda span: F.size(F.filter(span, lambda c: c == 0)) * (rare * rare)
    square = lambda span: others(span) + total(F.array_distinct(hits(span)), lambda c: F.pow(F.size(F.filter(span, lambda x: x == c)) * weight(c), F.lit(2.0)))
    cosine = lambda span: F.round(F.least(F.lit(1.0), dot(span) / F.sqrt(square(span))), 9)
    scored = whole.select("doc_id", "path", "words", "term", "at").unionByName(near).join(sought, "term").select("doc_id", "path", "license", "grade", "dots", F.filter(spans, possible).alias("spans"))
    scored = scored.select("doc_id", "path", "license", "grade", F.array_max(F.transform("spans", cosine)).alias("score")).where(F.col("score") >= least)
    name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_replace("path", r"/?[^/]*$", "")
    speaking = files.where(name.rlike(LICENSE_FILE) & F.col("text").rlike("[a-z0-9]")).select("doc_id", "path", coded("text").alias("words")).withColumn("square", square(F.col("words")))
    product = lambda d: total(F.col("words"), lambda c: F.element_at(F.array(*[F.lit(x) for x in d]), c + 1))
    alike = lambda x: F.round(F.least(F.lit(1.0), product(vector(x)[2]) / F.sqrt("square")), 9)
    whole_texts = speaking.select("doc_id", "path", F.explode(F.array(*[F.struct(F.lit(n).alias("license"), F.lit(0).alias("grade"), alike(x).alias("score")) for n, x in texts])).alias("x")).select("doc_id", "path", "x.license", "x.grade", "x.score") if texts else None
    if whole_texts is not None:
        scored = scored.unionByName(whole_texts.where(F.col("score") >= least))
    best = F.struct(F.col("grade").alias("r"), (-F.col("score")).alias("s"), F.col("license").alias("l"))
    own = stable(scored.groupBy("doc_id", "path").agg(F.min(best).alias("b")).select("doc_id", "path", F.col("b.l").alias("own"), (-F.col("b.s")).alias("own_score"), F.col("b.r").alias("grade")))
    base = files.select("doc_id", "path")
    speaks = own.where(name.rlike(LICENSE_FILE)).groupBy(folder.alias("dir")).agg(F.min(F.struct(F.col("grade").alias("r"), (-F.col("own_score")).alias("s"), F.col("path").alias("p"), F.col("own").alias("l"))).alias("f"))
    speaks = speaks.select("dir", F.col("f.l").alias("dir_license"), F.col("f.p").alias("dir_path"), (-F.col("f.s")).alias("dir_score"))
    same = lambda d, p: F.col("doc_id").eqNullSafe(F.col(d)) & F.col("path").eqNullSafe(F.col(p))
    wanting = base.where("path is not null").distinct().join(own.select(F.col("doc_id").alias("d"), F.col("path").alias("p")), same("d", "p"), "left_anti")
    speaks = stable(speaks)
    if has_rows_below(speaks, 1_000_000):  # else the root, which is above all files, is one task's
        speaks = F.broadcast(speaks)
    parts = F.split(folder, "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    up = wanting.select("doc_id", "path", F.posexplode(F.array_distinct(above)).alias("depth", "dir")).join(speaks, "dir")
    taken = up.groupBy("doc_id", "path").agg(F.max_by(F.struct("dir_license", "dir_path", "dir_score"), "depth").alias("d"))
    found = own.select("doc_id", "path", F.col("own").alias("license"), F.when(name.rlike(LICENSE_FILE), "file").otherwise("header").alias("via"), F.col("own_score").alias("score"), F.col("path").alias("source_path"))
    found = found.unionByName(taken.select("doc_id", "path", F.col("d.dir_license").alias("license"), F.lit("inherited").alias("via"), F.col("d.dir_score").alias("score"), F.col("d.dir_path").alias("source_path")))
    found = found.withColumnRenamed("doc_id", "d").withColumnRenamed("path", "p")
    return base.join(found, same("d", "p"), "left").select("doc_id", "path", "license", "via", "score", "source_path")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files: a directory of each source has a hundred ids, of which the
    first is its license file, so the others inherit what that one says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.when(F.pmod("doc_id", F.lit(100)) == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs, F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string"), name))
