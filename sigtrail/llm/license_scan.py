"""License scan, with DataFrame operations only: sparse TF-IDF cosine to templates, then inheritance along paths.

Lines that speak of a license, and whole texts that have such lines, are compared with license templates as sparse TF-IDF vectors;
of near templates the names and versions that a passage has decide. SPDX expressions are read as such. A file without a license
of its own takes those of the license file in the nearest directory above it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.llm.common import durable, table, text_of

MIN_COSINE = 0.6
#: Cosine of a whole text to the whole text of a license, and words more than that has, with which a file of any name is a license file.
FILE_COSINE, FILE_WORDS = 0.9, 1.2

# License identifiers, the names by which notices call them, and notices and texts in the words of the public licenses.
NAMES = {
    "MIT": "the MIT License", "Apache-2.0": "the Apache License, Version 2.0", "GPL-3.0": "the GNU General Public License, version 3", "GPL-2.0": "the GNU General Public License, version 2",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3", "LGPL-2.1": "the GNU Lesser General Public License, version 2.1", "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "the BSD 3-Clause License", "BSD-2-Clause": "the BSD 2-Clause License", "ISC": "the ISC License", "Zlib": "the zlib License", "BSL-1.0": "the Boost Software License, Version 1.0",
    "MPL-2.0": "the Mozilla Public License, Version 2.0", "EPL-2.0": "the Eclipse Public License, Version 2.0", "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC0-1.0": "CC0 1.0", "Unlicense": "the Unlicense",
}
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY '
    "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR '
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)


def _gnu(kind: str, version: str, url: str = "http://www.gnu.org/licenses/") -> str:
    """The notice that files under a GNU license carry."""
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
        f"later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for "
        f"more details. You should have received a copy of the GNU {kind} along with this program. If not, see {url}."
    )


TEXTS = [
    ("MIT", _MIT), ("MIT", f"MIT License {_MIT} {_MIT_NOTICE} {_AS_IS}"), ("ISC", _ISC), ("ISC", f"ISC License {_ISC} {_ISC_AS_IS}"),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD} {_BSD_1} {_BSD_2} {_BSD_AS_IS}"), ("BSD-3-Clause", f"BSD 3-Clause License {_BSD} {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_AS_IS}"), ("BSD-3-Clause", _BSD_3),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."), ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    *((short, said) for short, kind, version in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"))
      for said in (_gnu(kind, version), _gnu(kind, version).split(". ")[0])),
    *((short, f"{title} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.") for short, title in (
        ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
        ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."), ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
                  "for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
]
#: Fixed texts, and what notices and SPDX tags say of each name.
TEMPLATES = TEXTS + [(short, said) for short, name in NAMES.items() for said in (f"Licensed under {name}.", f"Released under {name}.", f"This work is licensed under {name}.", f"SPDX-License-Identifier: {short}")]
# What a passage must have, and must not have, to be of a license; words in lower case with one space between.
_GNU = r"\b(?:lesser|library|affero|lgpl|agpl)\b"
_TWO, _THREE = r"\b(?:version|v|l?gpl) ?2(?: 0)?(?: [^0-9]|$)", r"\b(?:version|v|[la]?gpl) ?3(?: 0)?(?: [^0-9]|$)"
_CC, _CC_4 = r"\b(?:creative commons|cc by)\b", r"\b4 0\b"
_SHARE, _TRADE, _NO_CHANGE = r"\b(?:share ?alike|by sa|nc sa)\b", r"\b(?:non ?commercial|by nc)\b", r"\b(?:no ?deriv\w*|by nd|nc nd)\b"
MUST: dict[str, tuple[list[str], list[str]]] = {
    "MIT": ([r"\bmit\b|permission is hereby granted free of charge"], []), "ISC": ([r"\bisc\b|permission to use copy modify and (?:or )?distribute"], []), "Zlib": ([r"\bzlib\b"], []),
    "Apache-2.0": ([r"\bapache\b", r"\b2(?: 0)?\b"], [r"\bapache (?:software )?license (?:version )?1 "]),
    "GPL-2.0": ([r"\b(?:general public license|gpl)\b", _TWO], [_GNU]), "GPL-3.0": ([r"\b(?:general public license|gpl)\b", _THREE], [_GNU]),
    "LGPL-2.1": ([r"\b(?:lesser|library|lgpl)\b", r"\b2 1\b"], [r"\b(?:affero|agpl)\b"]), "LGPL-3.0": ([r"\b(?:lesser|lgpl)\b", _THREE], [r"\b(?:affero|agpl)\b"]), "AGPL-3.0": ([r"\b(?:affero|agpl)\b", _THREE], []),
    "BSD-2-Clause": ([r"\bbsd\b|redistribution and use in source and binary forms"], [r"\b3 clause\b|neither the name"]), "BSD-3-Clause": ([r"\b3 clause\b|neither the name"], []),
    "BSL-1.0": ([r"\b(?:boost|bsl)\b"], []), "MPL-2.0": ([r"\b(?:mozilla|mpl)\b", r"\b2 0\b"], []), "EPL-2.0": ([r"\b(?:eclipse|epl)\b", r"\b2 0\b"], []),
    "CC-BY-4.0": ([_CC, _CC_4], [_SHARE, _TRADE, _NO_CHANGE]), "CC-BY-SA-4.0": ([_CC, _CC_4, _SHARE], [_TRADE, _NO_CHANGE]), "CC-BY-NC-4.0": ([_CC, _CC_4, _TRADE], [_SHARE, _NO_CHANGE]),
    "CC0-1.0": ([r"\bcc0\b"], []), "Unlicense": ([r"\bunlicense\b|free and unencumbered software"], []), "Proprietary": ([r"\ball rights reserved\b"], []),
}
SPDX, SPDX_ID = r"(?i)SPDX(?:-License-Identifier)?:[ \t]*([A-Za-z0-9.+() \t-]+)", r"[A-Za-z0-9][A-Za-z0-9.+-]*"
#: Named only where nothing else is: other licenses' texts say it too.
LAST = "Proprietary"
SPEAKS = r"(?i)licen[cs]|copyright|all rights reserved|creative commons|public domain|permission is hereby granted|redistribut|spdx"
#: Templates that are whole licenses.
WHOLE = [k for k, (_, text) in enumerate(TEXTS) if text.endswith((_AS_IS, _ISC_AS_IS, _BSD_AS_IS))]
#: A line that is a comment, and what isn't words at its ends.
COMMENT, MARKERS = r"^[ \t]*(/[/*]|[*#;%]|--|<!--|rem )", r"^[ \t/*#;%!<>-]+|[ \t\r*/>-]+$"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _count(text: str) -> int:
    return len([w for w in re.split(r"[\W_]+", text) if w])


_MOST_WORDS = int(FILE_WORDS * max(_count(TEXTS[k][1]) for k in WHOLE))


def _vectors(rows: DataFrame, key: str, idf: DataFrame, most) -> DataFrame:
    """key, word, w: TF-IDF of unit length; a word that no passage has counts as rare."""
    counts = rows.select(key, F.explode(_words(F.col("passage"))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))
    weights = counts.join(idf, "word", "left").select(key, "word", (F.col("tf") * F.coalesce("idf", most)).alias("w"))
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, key).select(key, "word", (F.col("w") / F.col("norm")).alias("w"))


def _spdx(text: Column) -> Column:
    """The identifiers of a text's SPDX expressions; known names as they are here, others as written. What follows WITH is no license."""
    said = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda e: F.regexp_extract_all(F.regexp_replace(e, r"(?i)\bWITH\b\s+\S+", " "), F.lit(SPDX_ID), F.lit(0))))
    bare = F.transform(F.filter(said, lambda x: ~F.upper(x).isin("AND", "OR")), lambda x: F.regexp_replace(x, r"(?i)(?:-only|-or-later|\+)$", ""))
    known = F.create_map(*(F.lit(v) for name in MUST for v in (name.lower(), name)))
    return F.array_distinct(F.transform(bare, lambda x: F.coalesce(F.try_element_at(known, F.lower(x)), x)))


def _may_be(passage: Column) -> Column:
    """The licenses whose names and versions a passage has."""
    words = F.array_join(_words(passage), " ")
    held = []
    for name, (must, must_not) in MUST.items():
        test = F.lit(True)
        for p in must:
            test = test & words.rlike(p)
        for p in must_not:
            test = test & ~words.rlike(p)
        held.append(F.when(test, F.lit(name)))
    return F.array_compact(F.array(*held))


def scan_licenses(files: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """doc_id, path, license, licenses, origin (file, header, inherited, null), score: one row for each row of files.

    Whole texts are read. Compared are lines that speak of a license, runs of comment lines with such a line, and the whole text
    of a file that is named as a license or has no more words than one (FILE_WORDS). The best
    template of at least min_cosine whose names and versions the passage has names its license (`MUST`); identifiers of SPDX expressions
    count with score 1. license is the best of a file, ties go to the last name in order; licenses are all of them, sorted. A license
    file is named so, or its whole text is that of a license (`WHOLE`, by FILE_COSINE and FILE_WORDS); only license files are inherited from, and one
    that isn't recognised has no license to give, nor does what lies above it. Word frequencies count every passage of all files. A null
    path has no directory and inherits nothing; null and empty texts have no license of their own. Where a directory has several
    license files the best score, then the last name, counts; "all rights reserved" counts only where there is no other license. Rows that
    repeat (id, path and text) get the same answer each. Other columns are not read. An empty table gives no rows.
    Equal passages are scored once, so a notice that a third of all files hold is one row; ancestors are joined on directory.
    """
    spark = files.sparkSession
    base = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), text_of(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    key = ["doc_id", "path", "th"]
    lines = F.split("text", r"\r?\n", -1)
    named = F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    speaking = base.filter(F.col("text").rlike(SPEAKS) | named).select(*key, named.alias("named"), F.filter(lines, lambda x: x.rlike(SPEAKS)).alias("said"), "text")
    # Comments without words keep a run together; lines that are no part of one, and a license file's empty lines, end it.
    bare = lambda x: F.regexp_replace(x, MARKERS, "")
    part = F.transform(lines, lambda x: F.when(F.col("named"), bare(x)).when(x.rlike(COMMENT) | x.rlike(SPEAKS), F.concat(bare(x), F.lit(" "))).otherwise(""))
    runs = F.filter(F.split(F.array_join(part, "\n"), "\n\n+"), lambda x: x.rlike(SPEAKS))
    # A text with more words than a license can't be one: of such a file only lines and runs are compared.
    whole = F.when(F.col("named") | (F.size(_words(F.col("text"))) <= _MOST_WORDS), F.col("text")).otherwise("")
    tags = F.when(F.col("text").rlike(SPDX), _spdx(F.col("text")))
    passages = speaking.select(*key, "named", F.posexplode(F.concat(F.array(whole), F.array_except(F.array_union("said", runs), F.array(whole)))).alias("pos", "passage"), tags.alias("tags"))
    passages = passages.filter((F.length(F.trim("passage")) > 0) | ((F.col("pos") == 0) & (F.col("named") | F.col("tags").isNotNull())))
    passages = durable(passages.select(*key, "named", (F.col("pos") == 0).alias("whole"), "passage", F.when(F.col("pos") == 0, F.col("tags")).alias("tags")), "license-passages")

    distinct = durable(passages.filter(F.length(F.trim("passage")) > 0).groupBy("passage").agg(F.count(F.lit(1)).alias("n")).withColumn("pid", F.sha2("passage", 256)), "license-distinct")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    df = distinct.select("n", F.explode(F.array_distinct(_words(F.col("passage")))).alias("word")).groupBy("word").agg(F.sum("n").alias("df"))
    most = F.log(F.lit(1.0 + total)) + 1
    idf = durable(df.select("word", (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf")), "license-idf")
    templates = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(TEMPLATES)], "tid int, license string, passage string")
    ours = F.broadcast(_vectors(templates, "tid", idf, most).withColumnRenamed("w", "tw"))  # the templates' words: a fixed few hundred
    scores = _vectors(distinct, "pid", idf, most).join(ours, "word").groupBy("pid", "tid").agg(F.sum(F.col("w") * F.col("tw")).alias("cosine"))
    # Cosines are compared as hundred-millionths, so that the order of a sum decides nothing.
    may_be = distinct.select("pid", _may_be(F.col("passage")).alias("may_be"), F.size(_words(F.col("passage"))).alias("n_words")).filter(F.size("may_be") > 0)
    best = scores.join(F.broadcast(templates.select("tid", "license")), "tid").withColumn("score", F.round("cosine", 8)).filter(F.col("score") >= min_cosine)
    best = best.join(may_be, "pid").filter(F.array_contains("may_be", F.col("license")))
    covers = F.lit(False)
    for k in WHOLE:
        covers = covers | ((F.col("tid") == k) & (F.col("n_words") <= FILE_WORDS * _count(TEXTS[k][1])))
    covers = (covers & (F.col("score") >= FILE_COSINE)).alias("covers")
    best = best.groupBy("pid").agg(F.max_by(F.struct("license", "score", covers), F.struct("score", -F.col("tid"))).alias("b")).select("pid", "b.*")
    # A notice in a third of all files is a third of these rows: the adaptive join splits it.
    rank = F.struct(F.col("license") != LAST, "score", "license")
    judged = passages.select(*key, "named", "whole", "tags", F.sha2("passage", 256).alias("pid")).join(best, "pid", "left")
    tagged = judged.select(*key, "named", "whole", F.explode("tags").alias("license")).select(*key, "named", F.lit(False).alias("covers"), "license", F.lit(1.0).alias("score"))
    found = judged.select(*key, "named", (F.col("whole") & F.coalesce("covers", F.lit(False))).alias("covers"), "license", "score").unionByName(tagged)
    told = F.collect_set(F.when(F.col("license") != LAST, F.col("license")))
    own = found.groupBy(*key).agg(
        F.max_by(F.struct("license", "score"), F.when(F.col("license").isNotNull(), rank)).alias("b"), F.max(F.col("named") | F.col("covers")).alias("is_file"), F.sort_array(told).alias("licenses")
    )
    own = own.select(*key, F.col("b.license").alias("license"), F.col("b.score").alias("score"), F.when(F.size("licenses") > 0, F.col("licenses")).when(F.col("b.license").isNotNull(), F.array("b.license")).alias("licenses"), "is_file")
    own = durable(own.filter("is_file or license is not null"), "license-own")

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    folders = own.filter("is_file and path is not null").groupBy(folder.alias("folder")).agg(F.max_by(F.struct("license", "score", "licenses"), F.struct(F.col("license").isNotNull(), rank)).alias("f"))
    rows = base.select(*key)
    own_side = own.select(F.col("doc_id").alias("o_id"), F.col("path").alias("o_path"), F.col("th").alias("o_th"), "license", "score", "licenses", "is_file")
    joined = rows.join(own_side, F.col("doc_id").eqNullSafe(F.col("o_id")) & F.col("path").eqNullSafe(F.col("o_path")) & (F.col("th") == F.col("o_th")), "left")
    joined = joined.drop("o_id", "o_path", "o_th")
    # Folders, not files, meet their ancestors: a folder with a third of all files is one row here.
    lacking = joined.filter("license is null and path is not null and not coalesce(is_file, false)").select(folder.alias("own_folder")).distinct()
    parts = F.split("own_folder", "/")
    above = lacking.select("own_folder", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "folder"))
    nearest = above.join(folders, "folder").groupBy("own_folder").agg(F.max_by("f", "depth").alias("f"))
    nearest = nearest.select("own_folder", F.col("f.license").alias("up_license"), F.col("f.score").alias("up_score"), F.col("f.licenses").alias("up_licenses"))
    # Rows that need no ancestor get keys of their own that no folder has (a path holds no null character), so that they spread.
    own_folder = F.coalesce(F.when(F.col("license").isNull() & ~F.coalesce("is_file", F.lit(False)), folder), F.concat(F.lit("\x00"), F.xxhash64(*key).cast("string")))
    out = joined.withColumn("own_folder", own_folder).join(nearest, "own_folder", "left")
    return out.select(
        "doc_id", "path", F.coalesce("license", "up_license").alias("license"),
        F.when(F.col("license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("up_license").isNotNull(), "inherited").alias("origin"),
        F.coalesce("score", "up_score").alias("score"), F.coalesce("licenses", "up_licenses").alias("licenses"),
    )


def with_paths(docs: DataFrame) -> DataFrame:
    """documents has no paths: its source is taken as the top folder, and a folder for every thousand ids."""
    path = F.concat_ws("/", "source", (F.col("doc_id") / 1000).cast("long").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(with_paths(table(spark, sf_dir, "documents"))).withColumn("licenses", F.array_join("licenses", ","))


QUERIES = {"op6_license_scan": op6_license_scan}
_VALUES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
_WORDS = r"list_filter(string_split_regex(lower(passage), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def _vector_sql(name: str, rows: str, key: str) -> str:
    """CTEs of the TF-IDF vectors of unit length of rows (key, passage)."""
    return f"""{name}_c AS (SELECT {key}, word, count(*) AS tf FROM (SELECT {key}, unnest({_WORDS}) AS word FROM {rows}) GROUP BY 1, 2),
{name}_w AS (SELECT {key}, c.word, tf * coalesce(idf, (SELECT ln(1.0 + t) + 1 FROM total)) AS w FROM {name}_c c LEFT JOIN idf ON c.word = idf.word),
{name} AS (SELECT {key}, word, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {name}_w)"""


_COVERS = " OR ".join(f"(s.tid = {k} AND len(string_split(words, ' ')) <= {FILE_WORDS * _count(TEXTS[k][1])})" for k in WHOLE)
_MAY_BE = " UNION ALL ".join(f"SELECT passage, '{name}' AS license FROM worded WHERE " + " AND ".join([*(f"regexp_matches(words, '{p}')" for p in must), *(f"NOT regexp_matches(words, '{p}')" for p in must_not)]) for name, (must, must_not) in MUST.items())

ORACLE_SQL = {
    "op6_license_scan": f"""
WITH files AS (SELECT doc_id, source || '/' || (doc_id // 1000) || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents),
lines AS (SELECT *, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM files WHERE regexp_matches(text, '{SPEAKS}')),
said AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '{SPEAKS}')) AS s FROM lines),
runs AS (SELECT *, list_filter(string_split_regex(array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '{COMMENT}') OR regexp_matches(x, '{SPEAKS}') THEN regexp_replace(x, '{MARKERS}', '', 'g') || ' ' ELSE '' END), chr(10)), '\n\n+'), lambda x: regexp_matches(x, '{SPEAKS}')) AS u FROM said),
passages AS (SELECT doc_id, path, passage, passage = text AS whole FROM (SELECT doc_id, path, text, unnest(list_distinct(list_concat(s, u, CASE WHEN len({_WORDS.replace("passage", "text")}) <= {_MOST_WORDS} THEN [text] ELSE [] END))) AS passage FROM runs) WHERE trim(passage) <> ''),
tags AS (SELECT doc_id, path, unnest(regexp_extract_all(e, '{SPDX_ID}')) AS tag FROM (SELECT doc_id, path, regexp_replace(unnest(regexp_extract_all(text, '{SPDX}', 1)), '(?i)\\bWITH\\b\\s+\\S+', ' ', 'g') AS e FROM files)),
tagged AS (SELECT doc_id, path, coalesce(k.name, t.t) AS license FROM (SELECT doc_id, path, regexp_replace(tag, '(?i)(-only|-or-later|\\+)$', '') AS t FROM tags WHERE upper(tag) NOT IN ('AND', 'OR')) t LEFT JOIN (SELECT unnest([{", ".join(f"'{n}'" for n in MUST)}]) AS name) k ON lower(t.t) = lower(k.name)),
kinds AS (SELECT passage, count(*) AS n FROM passages GROUP BY 1),
total AS (SELECT sum(n)::DOUBLE AS t FROM kinds),
df AS (SELECT word, sum(n) AS df FROM (SELECT n, unnest(list_distinct({_WORDS})) AS word FROM kinds) GROUP BY 1),
idf AS (SELECT word, ln((1.0 + t) / (1 + df)) + 1 AS idf FROM df, total),
templates AS (SELECT * FROM (VALUES {_VALUES}) AS v(tid, license, passage)),
{_vector_sql("ours", "templates", "tid")},
{_vector_sql("theirs", "kinds", "passage")},
scores AS (SELECT theirs.passage, ours.tid, round(sum(ours.w * theirs.w), 8) AS score FROM theirs JOIN ours USING (word) GROUP BY 1, 2),
worded AS (SELECT passage, array_to_string({_WORDS}, ' ') AS words FROM kinds),
may_be AS ({_MAY_BE}),
best AS (SELECT s.passage, t.license, score, score >= {FILE_COSINE} AND ({_COVERS}) AS covers FROM scores s JOIN worded w ON w.passage = s.passage JOIN templates t USING (tid) JOIN may_be m ON m.passage = s.passage AND m.license = t.license WHERE score >= {MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY s.passage ORDER BY score DESC, tid) = 1),
found AS (SELECT doc_id, path, whole AND covers AS covers, license, score FROM passages JOIN best USING (passage) UNION ALL SELECT doc_id, path, false, license, 1.0 FROM tagged),
files_ AS (SELECT doc_id, bool_or(covers) AS is_file, string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE license <> '{LAST}') AS licenses FROM found GROUP BY 1),
own AS (SELECT f.doc_id, path, is_file, license, score, coalesce(licenses, license) AS licenses FROM found f JOIN files_ USING (doc_id) QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY license <> '{LAST}' DESC, score DESC, license DESC) = 1),
folders AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, license, score, licenses FROM own WHERE is_file QUALIFY row_number() OVER (PARTITION BY folder ORDER BY license <> '{LAST}' DESC, score DESC, license DESC) = 1),
above AS (SELECT f.doc_id, d.license, d.score, d.licenses FROM files f JOIN folders d ON starts_with(f.path, d.folder || '/') QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(d.folder) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(o.license, a.license) AS license, CASE WHEN o.license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN a.license IS NOT NULL THEN 'inherited' END AS origin, coalesce(o.score, a.score) AS score, coalesce(o.licenses, a.licenses) AS licenses
FROM files f LEFT JOIN own o ON f.doc_id = o.doc_id LEFT JOIN above a ON f.doc_id = a.doc_id
""",
}
