"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Units. A text is compared line by line with the one-line notices, and block by block (lines without a blank one
between) and as a whole with the headers, permission texts and license passages, by the cosine of TF-IDF vectors. Inverse
document frequencies of the templates' terms are counted over all documents; other terms weigh as unseen ones. A unit can
reach its threshold only with one of a template's heavy terms, those without which the rest of the template's norm
stays below it; units without any are not scored.

Siblings. Versions and variants of a license are nearly alike by their cosine, so each is a template, a unit must hold the terms that
tell one from its siblings (its version, say), and the best license must be ahead of the second by `MARGIN`; a unit that names no version names no
license.

Equal units are scored once: what is dealt out by term is each distinct unit, named by 128 bits, however many documents hold
it. Scores come back to the documents' units by an equality join, and a document's best unit is its own license.

A document whose units of one kind that are license make up half of its terms, or whose name is that of a license
file, speaks for its directory; documents without a license of their own take that of the nearest
ancestor directory, found by joins of directories with their ancestors.

Only DataFrame functions are used.

Defined results: null and empty texts have no license of their own; ties go to the template first
in the list; several license files of a directory agree on the highest score, then the license
first in the alphabet; a null path inherits nothing; repeated rows are judged row by row, all alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Least cosine of a line to a notice, and of a block or whole text to a longer template.
THRESHOLD, TEXT_THRESHOLD = 0.6, 0.7
#: License and the notice that stands for it, in a line.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-0", "Released under the MIT No Attribution License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: License and a longer text that stands for it: headers of source files, whole permission texts, passages of license files.
TEXTS = (
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    (
        "Apache-2.0",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, "
        "sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
    ),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software "
        "Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General "
        "Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General "
        "Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software "
        "Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General "
        "Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
    ),
    (
        "LGPL-3.0",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, "
        "supplemented by the additional permissions listed below.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to "
        "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MIT-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to "
        "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
        "sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED AS IS, WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)
#: Terms that a unit must hold to be of a license, which tell it from its siblings; of them those count that a template itself has.
NEEDED = {
    "Apache-1.1": ("apache", "1"), "Apache-2.0": ("apache", "2", "0"), "GPL-2.0": ("gnu", "2"), "GPL-3.0": ("gnu", "3"), "LGPL-2.1": ("lesser", "2", "1"), "LGPL-3.0": ("lesser", "3"),
    "AGPL-3.0": ("affero", "3"), "MIT": ("mit", "notice"), "MIT-0": ("mit", "no", "attribution"), "BSD-2-Clause": ("bsd", "2"), "BSD-3-Clause": ("bsd", "3"), "MPL-2.0": ("mozilla", "2", "0"),
    "CC-BY-4.0": ("cc", "by", "4", "0"), "CC-BY-SA-4.0": ("cc", "sa", "4", "0"), "CC-BY-NC-4.0": ("cc", "nc", "4", "0"),
}
#: By how much the best license's cosine must exceed that of the second.
MARGIN = 0.001
#: Share of documents above which a term is common: texts are sieved by other terms where those do.
COMMON = 0.02
_WORD = "[a-z0-9]+"
_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
#: A blank line, between blocks.
BLANK = r"\n[ \t\r]*\n"


class Templates:
    """Notices and texts in one list, notices first, with the terms of each and the vocabulary of all."""

    def __init__(self, notices: tuple[tuple[str, str], ...] = TEMPLATES, texts: tuple[tuple[str, str], ...] = TEXTS, threshold: float = THRESHOLD, text_threshold: float = TEXT_THRESHOLD) -> None:
        self.names = [n for n, _ in (*notices, *texts)]
        self.terms = [re.findall(_WORD, t.lower()) for _, t in (*notices, *texts)]
        self.longer = [False] * len(notices) + [True] * len(texts)
        self.least = [text_threshold if x else threshold for x in self.longer]
        needed = [set(NEEDED.get(n, ())) for n in self.names]
        self.needed = [sorted(n & set(t)) for n, t in zip(needed, self.terms, strict=True)]
        self.vocabulary = sorted({t for terms in self.terms for t in terms})


def terms_of(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))


def frequencies(documents: DataFrame, templates: Templates) -> tuple[int, dict[str, int]]:
    """Number of documents, and of documents with each term of a template, by one pass."""
    found = F.array_intersect(terms_of(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, templates.vocabulary)))
    every = F.concat(F.array(F.lit("")), found)  # the empty term stands for the document
    counts = {r.term: r.n for r in documents.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), {t: counts.get(t, 0) for t in templates.vocabulary}


def weights(n: int, df: dict[str, int], templates: Templates) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Inverse document frequencies, that of unseen terms, and the templates' unit vectors."""
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    out = []
    for terms in templates.terms:
        vector = {t: terms.count(t) * idf[t] for t in sorted(set(terms))}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        out.append({t: v / norm for t, v in vector.items()})
    return idf, math.log(1 + n) + 1, out


def heavy_terms(vectors: list[dict[str, float]], least: list[float], common: frozenset[str] = frozenset()) -> list[str]:
    """Few terms of which a unit must hold one to reach the threshold with some template; `common` ones only if others don't do.

    A unit without them has a cosine of at most the norm of what is left of the template.
    """
    heavy: set[str] = set()
    over = [1 - t**2 + 1e-9 for t in least]  # mass that still has to go, by template
    for allowed in (set().union(*vectors) - common, common):
        while any(x > 0 for x in over):
            gain = {t: sum(min(x, v.get(t, 0.0) ** 2) for x, v in zip(over, vectors, strict=True) if x > 0) for t in allowed - heavy}
            best = min(gain, key=lambda t: (-gain[t], t), default=None)
            if best is None or gain[best] <= 0:
                break
            heavy.add(best)
            over = [x - v.get(best, 0.0) ** 2 for x, v in zip(over, vectors, strict=True)]
    return sorted(heavy)


#: Kinds of units.
LINE, BLOCK, WHOLE = 0, 1, 2


def _units(templates: Templates, vectors: list[dict[str, float]], n: int, df: dict[str, int]) -> Column:
    """Structs (kind, unit) of the text that hold a heavy term of their kind's templates; null where there is none."""
    common = frozenset(t for t, k in df.items() if k > n * COMMON)
    of_kind = lambda values, longer: [x for x, y in zip(values, templates.longer, strict=True) if y == longer]
    heavy = {longer: heavy_terms(of_kind(vectors, longer), of_kind(templates.least, longer), common) for longer in (False, True)}
    pattern = lambda words: "(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])"
    text = F.lower("text")

    def of(kind: int, parts: Column, words: list[str]) -> Column:
        return F.transform(F.filter(parts, lambda u: u.rlike(pattern(words))), lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("unit")))

    kinds = [(LINE, F.split(text, "\n"), heavy[False]), (BLOCK, F.split(text, BLANK), heavy[True]), (WHOLE, F.array(text), heavy[True])]
    found = F.concat(*[of(kind, parts, words) for kind, parts, words in kinds if words])
    likely = text.rlike(pattern(sorted({*heavy[False], *heavy[True]})))
    return F.when(likely, found)


def _name(*columns: Column | str) -> list[Column]:
    """128 bits that name a value."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns).alias("k2")]


def unit_scores(units: DataFrame, templates: Templates, n: int, df: dict[str, int]) -> DataFrame:
    """k1, k2, kind, score, order (the template's place, negative), terms of distinct units (k1, k2, kind, unit) that are a license's.

    A unit is one's if it reaches a template's threshold, holds what tells the license from its siblings, and the best license is ahead of the second.
    """
    idf, unseen, vectors = weights(n, df, templates)
    spark = units.sparkSession
    rows = [
        (t, k, templates.names[k], templates.longer[k], templates.least[k], v * idf[t], int(t in templates.needed[k]), len(templates.needed[k])) for k, vector in enumerate(vectors) for t, v in vector.items()
    ]
    vector = spark.createDataFrame(rows, "term string, at int, license string, longer boolean, least double, w double, need int, needs int")
    weight = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    counted = units.select("k1", "k2", "kind", F.explode(terms_of(F.col("unit"))).alias("term")).groupBy("k1", "k2", "kind", "term").agg(F.count("*").alias("tf"))
    counted = written(counted, "license-terms")
    weighed = counted.join(F.broadcast(weight), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unseen)))  # of the templates' vocabulary
    norms = weighed.groupBy("k1", "k2", "kind").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sum("tf").alias("terms"))
    dots = counted.join(F.broadcast(vector), "term").where((F.col("kind") > LINE) == F.col("longer")).groupBy("k1", "k2", "kind", "at", "license", "least", "needs").agg(F.sum(F.col("tf") * F.col("w")).alias("dot"), F.sum("need").alias("held"))
    scored = dots.where("held = needs").join(norms, ["k1", "k2", "kind"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= F.col("least"))
    every = F.sort_array(F.collect_list(F.struct("score", (-F.col("at")).alias("order"), "terms", "license")), asc=False).alias("every")  # one a template at most
    judged = scored.groupBy("k1", "k2", "kind").agg(every).withColumn("best", F.col("every")[0])
    second = F.get(F.filter("every", lambda x: x["license"] != F.col("best.license")), F.lit(0))["score"]
    ahead = second.isNull() | (F.round(F.col("best.score") - second, 6) >= MARGIN)
    return judged.where(ahead).select("k1", "k2", "kind", "best.score", "best.order", "best.terms")


def own_licenses(documents: DataFrame, templates: Templates) -> DataFrame:
    """r1, r2 (which name doc_id, path and text), score, license, share of rows with a license of their own, once each.

    `documents`: doc_id, path, text. share: terms in units of license of one kind, at most, of all terms.
    """
    n, df = frequencies(documents, templates)
    vectors = weights(n, df, templates)[2]
    row = [c.alias(f"r{i}") for i, c in enumerate(_name("doc_id", F.col("path").isNull(), "path", "text"), 1)]
    held = documents.select(*row, F.size(terms_of(F.col("text"))).alias("size"), _units(templates, vectors, n, df).alias("units")).where(F.size("units") > 0)
    held = written(held, "license-units").select("r1", "r2", "size", F.inline("units")).distinct()
    held = held.select("r1", "r2", "size", "kind", "unit", *_name("unit"))
    scores = written(unit_scores(held.select("k1", "k2", "kind", "unit").dropDuplicates(["k1", "k2", "kind"]), templates, n, df), "license-scores")
    met = held.drop("unit").join(scores, ["k1", "k2", "kind"])
    kinds = met.groupBy("r1", "r2", "size", "kind").agg(F.sum("terms").alias("covered"), F.max(F.struct("score", "order")).alias("best"))
    own = kinds.groupBy("r1", "r2", "size").agg(F.max("covered").alias("covered"), F.max("best").alias("best"))
    license_of = F.element_at(F.array(*map(F.lit, templates.names)), 1 - F.col("best.order"))
    return own.select("r1", "r2", "best.score", license_of.alias("license"), (F.col("covered") / F.col("size")).alias("share"))


def inherited(files: DataFrame, directories: DataFrame) -> DataFrame:
    """dir and the license of the nearest of its ancestors, itself included, that has a license file.

    `files` has dir, score, license; `directories` has dir, distinct. A directory is a row here, so that
    one with very many files is no hot key.
    """
    best = files.groupBy("dir").agg(F.max_by(F.struct("score", "license"), F.struct(F.col("score"), F.transform(F.split("license", ""), lambda ch: -F.ascii(ch)))).alias("from"))
    parts = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up")))
    up = directories.select("dir", F.inline(chain))
    near = up.join(best.withColumnRenamed("dir", "up"), "up")
    return near.groupBy("dir").agg(F.max_by(F.struct("from.license", "from.score", "up"), "depth").alias("near"))


def scan(documents: DataFrame, path: Column, templates: Templates | None = None) -> DataFrame:
    """doc_id, path, license, origin (own, inherited or null), score, license_dir of every row."""
    given = documents.select("doc_id", path.alias("path"), "text")
    own = written(own_licenses(given, templates or Templates()), "license-own")
    row = [c.alias(f"r{i}") for i, c in enumerate(_name("doc_id", F.col("path").isNull(), "path", "text"), 1)]
    folder = F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1)
    judged = given.select("doc_id", "path", folder.alias("dir"), *row).join(own, ["r1", "r2"], "left").drop("r1", "r2")
    judged = written(judged, "license-rows")
    files = judged.where(F.col("license").isNotNull() & ((F.col("share") >= 0.5) | F.col("path").rlike(_FILE)) & F.col("path").isNotNull()).select("dir", "score", "license")
    near = written(inherited(files, judged.select("dir").where("dir is not null").distinct()), "license-near")  # a table of its own, so that Spark can split the join's hot keys
    has = F.col("license").isNotNull()
    return judged.join(near, "dir", "left").select(
        "doc_id",
        "path",
        F.coalesce("license", "near.license").alias("license"),
        F.when(has, "own").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.coalesce("score", "near.score").alias("score"),
        F.when(~has, F.col("near.up")).alias("license_dir"),
    )
