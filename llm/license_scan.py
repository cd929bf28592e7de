"""License scan in DataFrame operations alone: TF-IDF cosine to templates, then inheritance by directory.

Templates are the sentences by which texts declare a license, whole texts of short licenses, and passages that
stand at the head of long licenses or are pasted at the head of files.

1. One pass over the texts. Each is split into words once; what is kept of it are the template terms it holds, its
   number of distinct words, and two kinds of places:
   - statements: at least two of MARKS, words of license statements, stand no more than GAP words apart, with the
     statement terms around them. So a statement is found wherever lines break.
   - windows as long as the texts and passages (SPANS), a quarter of their length apart, that hold DENSE marks or more, and
     as many template terms as a cosine of WHOLE needs. So a license is found within a longer file;
   - runs of RUN or more template terms, with DENSE marks or more: the extent of a license that words of other kinds surround.
   Texts without such places keep none.
2. Weights: a template term weighs by its document frequency over all texts, any other word as if a share of
   RAREST held it, so a cosine doesn't depend on the size of the table. A word counts once for a statement or text.
3. Statements, windows, runs and whole texts are compared with every template by the cosine of sparse TF-IDF vectors, equal ones
   (same terms, same number of words) once. A statement of HEADER or more, or a window, run or whole text of
   WHOLE or more, gives its file a license; a file whose whole text reaches WHOLE is a license file, as is one named so that has a license.
4. A file without a license of its own takes that of the license file in its nearest directory upwards. Each
   distinct directory is resolved once, by an equi-join of its ancestors with the directories of license
   files; files then join their directory.

Edge cases: null or empty text has no license of its own, and may inherit; several licenses in a file: the
highest cosine wins, then the smaller name; several license files in a directory: the highest cosine, then
the smaller path; a null path has no directory; rows that repeat are scanned each (the key must tell rows apart
no further than that equal keys share a result); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

HEADER = 0.6
WHOLE = 0.7
RAREST = 0.001  # share of texts below which words weigh the same
GAP = 8  # words from a mark to the next of a statement at most
BESIDE = 12  # statement terms on either side of the marks that may belong to a statement
SPANS = (32, 48, 72, 108, 162, 243)  # words of windows; a text or passage has the next longer one
DENSE = 2  # marks of a window or run at least
RUN = 16  # words of a run at least
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"

#: Words of which every license statement has two
MARKS = [
    "affero", "agpl", "apache", "bsd", "cc", "cc0", "commons", "copyright", "creative", "domain", "gnu", "gpl", "granted", "hereby", "identifier",
    "isc", "lgpl", "liability", "licence", "license", "licensed", "merchantability", "mit", "mozilla", "mpl", "noninfringement", "permission",
    "permitted", "redistribution", "redistributions", "unlicense", "warranties", "warranty", "zlib",
]

#: License names and statements by which texts declare them
STATEMENTS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Whole license texts
TEXTS = [
    ("BSD-2-Clause", f"{_BSD_CONDITIONS} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_AS_IS}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("Unlicense", f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. {_AS_IS}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]

#: The openings of long licenses, and notices pasted at the head of files
_GPL_HEADER = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_GPL_WARNING = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_CC = "{0} 4.0 International Public License. By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {0} 4.0 International Public License (\"Public License\"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives from making the Licensed Material available under these terms and conditions."
PASSAGES = [
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM} Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("AGPL-3.0", "This program is free software: " + _GPL_HEADER.format("Affero General Public License", 3)),
    ("AGPL-3.0", f"This program is free software: {_GPL_HEADER.format('Affero General Public License', 3)} This program {_GPL_WARNING.format('Affero General Public License')}"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("CC-BY-4.0", _CC.format("Attribution")),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial")),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike")),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN \"AS-IS\" BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER, AND DISCLAIMS LIABILITY FOR DAMAGES RESULTING FROM THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER."),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}"),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM} Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-2.0", "This program is free software; " + _GPL_HEADER.format("General Public License", 2)),
    ("GPL-2.0", f"This program is free software; {_GPL_HEADER.format('General Public License', 2)} This program {_GPL_WARNING.format('General Public License')}"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM} Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("GPL-3.0", "This program is free software: " + _GPL_HEADER.format("General Public License", 3)),
    ("GPL-3.0", f"This program is free software: {_GPL_HEADER.format('General Public License', 3)} This program {_GPL_WARNING.format('General Public License')}"),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM}"),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM} This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("LGPL-2.1", "This library is free software; " + _GPL_HEADER.format("Lesser General Public License", "2.1")),
    ("LGPL-2.1", f"This library is free software; {_GPL_HEADER.format('Lesser General Public License', '2.1')} This library {_GPL_WARNING.format('Lesser General Public License')}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM} This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution. 1.3. \"Contribution\" means Covered Software of a particular Contributor. 1.4. \"Covered Software\" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_terms() -> list[tuple[int, str, list[str]]]:
    """(template, license, distinct terms) of all templates; they are ASCII, where this split equals words()."""
    return [(k, name, sorted(set(re.findall("[a-z0-9]+", text.lower())))) for k, (name, text) in enumerate([*STATEMENTS, *TEXTS, *PASSAGES])]


def _values(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    def literal(v: object) -> str:
        return repr(float(v)) + "D" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "\\'") + "'"

    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} AS t({', '.join(names)})")


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def spans() -> list[int]:
    """The window lengths that texts and passages have."""
    sizes = [len(re.findall("[a-z0-9]+", text.lower())) for _, text in [*TEXTS, *PASSAGES]]
    return sorted({next(s for s in SPANS if s >= n) for n in sizes})


def _windows(w: Column, marks: Column) -> Column:
    """The words of each window with DENSE marks or more: the windows that hold a mark and the DENSE - 1 after it, once each."""

    def of(span: int) -> Column:
        step = span // 4

        def around(a: Column, i: Column) -> Column:
            b = F.get(marks, i + DENSE - 1)
            low = F.floor((F.greatest(F.lit(0), b - span + 1) + step - 1) / step).cast("int")
            high = F.floor(a / step).cast("int")
            return F.when(b.isNotNull() & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

        return F.transform(F.array_distinct(F.flatten(F.transform(marks, around))), lambda k: F.slice(w, k * step + 1, F.lit(span)))

    return F.concat(*[of(s) for s in spans()])


def _runs(w: Column, marks: Column, known: list[str]) -> Column:
    """The maximal runs of RUN ``known`` words or more, with DENSE marks or more."""
    others = F.filter(F.transform(w, lambda x, i: F.when(~x.isin(known), i)), lambda i: i.isNotNull())
    before, after = F.concat(F.array(F.lit(-1)), others), F.concat(others, F.array(F.size(w)))
    ends = F.filter(F.arrays_zip(before.alias("0"), after.alias("1")), lambda e: e["1"] - e["0"] > RUN)
    runs = F.transform(ends, lambda e: F.slice(w, e["0"] + 2, e["1"] - e["0"] - 1))
    return F.when(F.size(marks) >= DENSE, F.filter(runs, lambda x: F.size(F.filter(x, lambda v: v.isin(MARKS))) >= DENSE)).otherwise(F.array())


def _statements(w: Column, marks: Column, near: list[str]) -> Column:
    """The words of each statement in an array of words: marks of GAP words at most apart, and the terms of ``near`` beside them."""
    first = F.filter(marks, lambda i, k: (k == 0) | (i - F.get(marks, k - 1) > GAP))
    last = F.filter(marks, lambda i, k: (k == F.size(marks) - 1) | (F.get(marks, k + 1) - i > GAP))

    def beside(x: Column) -> Column:
        """How many words from the start of x are statement terms."""
        stop = F.array_position(F.transform(x, lambda v: v.isin(near)), False)
        return F.when(stop == 0, F.size(x)).otherwise(stop - 1).cast("int")

    def cut(span: Column) -> Column:
        a, b = span["0"], span["1"]
        left = beside(F.reverse(F.slice(w, F.greatest(F.lit(1), a - BESIDE + 1), F.least(F.lit(BESIDE), a))))
        right = beside(F.slice(w, b + 2, F.lit(BESIDE)))
        return F.slice(w, a - left + 1, b - a + 1 + left + right)

    spans = F.arrays_zip(first.alias("0"), last.alias("1"))
    return F.transform(F.filter(spans, lambda s: s["1"] > s["0"]), cut)


def license_scan(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, path, license, score, origin, inherited_from) from rows of (key, path, text); origin is header, inherited or none."""
    spark = files.sparkSession
    files = files.select(F.col(key).alias("id"), "path", F.coalesce("text", F.lit("")).alias("text"))
    templates = template_terms()
    vocabulary = sorted({t for _, _, terms in templates for t in terms})
    near = sorted({t for k, _, terms in templates if k < len(STATEMENTS) for t in terms})

    known, marks = _literals(vocabulary), _literals(MARKS)
    split = files.select("id", "path", words(F.col("text")).alias("w"))
    distinct = split.select("id", "path", "w", F.array_distinct("w").alias("d"))
    held = distinct.select("id", "path", "w", F.size("d").alias("n"), F.array_sort(F.array_intersect("d", known)).alias("terms"))

    def unit(part: str, window: bool) -> Column:
        return F.transform(part, lambda x: F.struct(F.array_sort(F.array_intersect(x, known)).alias("terms"), F.size(F.array_distinct(x)).alias("n"), F.lit(window).alias("window")))

    at = F.filter(F.transform("w", lambda x, i: F.when(x.isin(MARKS), i)), lambda i: i.isNotNull())
    marked = held.select("id", "path", "w", "n", "terms", F.when(F.size(F.array_intersect("terms", marks)) > 1, at).otherwise(F.array().cast("array<int>")).alias("m"))
    found = marked.select("id", "path", "n", "terms", _statements(F.col("w"), F.col("m"), near).alias("s"), F.concat(_windows(F.col("w"), F.col("m")), _runs(F.col("w"), F.col("m"), vocabulary)).alias("v"))
    # no other window reaches WHOLE: a cosine's square is at most the share of terms among the words, as no word weighs more than a rare one
    full = F.filter(unit("v", True), lambda x: F.size(x["terms"]) >= WHOLE**2 * x["n"])
    scanned = materialise(found.select("id", "path", "n", "terms", F.concat(unit("s", False), full).alias("units")), "words")

    n = scanned.count()
    counts = scanned.select(F.explode_outer("terms").alias("term")).where("term IS NOT NULL").groupBy("term").count()
    df = {r["term"]: r["count"] for r in counts.collect()}  # at most the vocabulary
    idf = {t: 1 - math.log(max(df.get(t, 0) / max(n, 1), RAREST)) for t in vocabulary}
    rare = 1 - math.log(RAREST)
    norms = {k: math.sqrt(sum(idf[t] ** 2 for t in terms)) for k, _, terms in templates}
    weights = _values(spark, [(k, name, t, idf[t], idf[t] / norms[k]) for k, name, terms in templates for t in terms], ["template", "license", "term", "idf", "weight"])
    own_weights = _values(spark, [(t, idf[t] ** 2) for t in vocabulary], ["term", "square"])

    whole = scanned.where(F.size("terms") > 0).where(F.size(F.array_intersect("terms", marks)) > 1).select("id", F.lit(True).alias("whole"), F.lit(False).alias("window"), "terms", "n")
    units = whole.unionByName(scanned.select("id", F.explode_outer("units").alias("u")).where("u IS NOT NULL").select("id", F.lit(False).alias("whole"), "u.window", "u.terms", "u.n"))
    kinds = materialise(units.groupBy("terms", "n").agg(F.max("whole").alias("any")).select("terms", "n", F.monotonically_increasing_id().alias("kind")), "kinds")
    each = kinds.select("kind", F.size("terms").alias("held"), "n", F.explode("terms").alias("term"))
    norm = each.join(F.broadcast(own_weights), "term").groupBy("kind").agg(F.sqrt(F.sum("square") + (F.max("n") - F.max("held")) * rare**2).alias("norm"))
    dot = each.join(F.broadcast(weights), "term").groupBy("kind", "template", "license").agg(F.sum(F.col("idf") * F.col("weight")).alias("dot"))
    cosine = dot.join(norm, "kind").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    best = cosine.groupBy("kind").agg(F.min(F.struct((-F.col("score")).alias("neg"), "license")).alias("b")).where(-F.col("b.neg") >= min(HEADER, WHOLE))
    scored = materialise(kinds.join(best, "kind").select("terms", "n", (-F.col("b.neg")).alias("score"), "b.license"), "scored")
    given = units.join(scored, ["terms", "n"]).where(F.col("score") >= F.when(F.col("whole") | F.col("window"), WHOLE).otherwise(HEADER))
    own = given.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "license")).alias("b"), F.max(F.when(F.col("whole"), F.col("score"))).alias("whole"))
    own = materialise(own.select("id", (-F.col("b.neg")).alias("score"), "b.license", "whole"), "own")
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    files = materialise(scanned.select("id", "path", directory.alias("dir")).join(own, "id", "left"), "files")
    discard(scanned, kinds, scored, own)

    license_files = files.where(F.col("license").isNotNull() & ((F.col("whole") >= WHOLE) | F.col("path").rlike(FILE_NAMES)))
    at = license_files.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("neg"), "path", "license")).alias("f"))
    at = materialise(at.select(F.col("dir").alias("ancestor"), F.col("f.path").alias("from"), F.col("f.license").alias("given"), (-F.col("f.neg")).alias("given_score")), "at")
    steps = F.split("dir", "/")
    dirs = files.where("dir IS NOT NULL").select("dir").distinct()
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).withColumn("ancestor", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    nearest = ancestors.join(at, "ancestor").groupBy("dir").agg(F.max_by(F.struct("from", "given", "given_score"), "depth").alias("near"))
    nearest = materialise(nearest, "nearest")
    inherits = F.col("license").isNull() & F.col("near").isNotNull()
    return files.join(nearest, "dir", "left").select(
        F.col("id").alias(key),
        "path",
        F.coalesce("license", "near.given").alias("license"),
        F.coalesce(F.when(F.col("license").isNotNull(), F.col("score")), F.col("near.given_score"), F.lit(0.0)).alias("score"),
        F.when(F.col("license").isNotNull(), "header").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(inherits, F.col("near.from")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as a file tree: source / thousands / hundreds / doc_id.txt."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), (F.col("doc_id") / 10_000).cast("long"), ((F.col("doc_id") / 500).cast("long") % 20), F.concat("doc_id", F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(document_paths(table(spark, sf_dir, "documents")))
