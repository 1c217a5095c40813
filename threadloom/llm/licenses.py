r"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

* Units of a file that holds a licence cue (``CUE``) are, without comment marks, its lines and its paragraphs that hold one (a header of
  several lines is one), and its whole text. Every template holds a cue. Each distinct unit is scored once, however many files hold it, and
  goes by its hash, so that no join carries texts. Templates are notices, tags, titles, headers and whole texts.
* Weights are (1 + ln tf) * idf with idf = ln((1 + n) / (1 + df)) + 1 over the templates; a term no template has weighs as one with
  df 0. Scores come from a join of unit terms with template terms; the template table is counted before it is broadcast.
* A file has the licence of its best unit if its cosine reaches ``SIMILARITY``. Licence files are files named like one that have a licence,
  and files whose whole text reaches ``WHOLE``. A directory has the licences of the licence files in it, joined by AND if they differ.
  Every directory that holds files is joined, by path, with its ancestors (itself included); the deepest licensed one
  wins, and files without a licence of their own inherit it. Directories are resolved once each, not once a file.

Defined results: null text is empty; a null path is a file in no directory; a unit of another licence goes before one that is ``WEAK``; of units that score alike lines come first, then paragraphs, then
the whole text, each in order, then the licence's name; files of equal paths and ids are one file, repeated rows keep a row each; very long
texts are scored whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import checked_broadcast, materialise, text_of

SIMILARITY, WHOLE = 0.8, 0.95
#: A name that counts only where no unit has another licence: the words stand in most licence texts, too.
WEAK = "Proprietary"
# Licence notices, headers and texts by SPDX name, names of licence files, words that a licence line holds, comment marks.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the 3-clause BSD License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Use of this source code is governed by the 2-clause BSD License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. Proprietary and confidential."),
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) All rights reserved. {_BSD} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD} {_BSD_THIRD} {_BSD_AS_IS}"),
    ("ISC", 'ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
)
TAGGED = ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "ISC", "Unlicense")
TEMPLATES = NOTICES + TEXTS + tuple((name, f"SPDX-License-Identifier: {name}") for name in TAGGED)
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
CUE = r"(?i)licen[cs]e|permission is hereby|permission to use, copy|redistribution and use|all rights reserved|public domain|spdx|\bCC0?[ -](BY|0|1)"
MARK = r"\n[ \t]*(//+|/\*+|\*+/|\*+|#+|;+|--+|%+|<!--)?[ \t]*"


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, versions kept whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{N}]+){0,8}"), F.lit(0))


def _term_table(units: DataFrame, key: str) -> DataFrame:
    words = units.select(key, F.explode(terms(F.col("unit"))).alias("term"))
    return words.groupBy(key, "term").agg((F.lit(1.0) + F.log(F.count("*").cast("double"))).alias("tf"))


def score(units: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct units(unit_id, unit) -> (unit_id, license, similarity) of the best template, where it reaches SIMILARITY."""
    kept = known.select("license", F.col("text").alias("unit")).where("unit is not null").distinct()
    kept = materialise(kept.withColumn("template", F.xxhash64("license", "unit")), "licence-templates")
    n = kept.count()
    counts = _term_table(kept, "template")
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = lambda d: F.log((F.lit(1.0) + n) / (F.lit(1.0) + d)) + 1.0
    weighed = counts.join(df, "term").select("template", "term", (F.col("tf") * idf(F.col("df"))).alias("w"), idf(F.col("df")).alias("idf"))
    lengths = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    table = materialise(weighed.join(lengths, "template").join(kept.select("template", "license"), "template"), "licence-terms")
    own = _term_table(units, "unit_id")
    vocabulary = checked_broadcast(table.select("term", "idf").distinct())
    own = own.join(vocabulary, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(0.0) + idf(F.lit(0)))).drop("tf")
    # a term that no template has counts for the length only, and all of them are one number
    size = own.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    shared = own.where("idf is not null").drop("idf")
    dots = shared.join(checked_broadcast(table.withColumnRenamed("w", "tw").drop("idf")), "term").groupBy("unit_id", "template", "license", "length").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(size, "unit_id").withColumn("similarity", F.round(F.col("dot") / (F.col("size") * F.col("length")), 6)).where(F.col("similarity") >= SIMILARITY)
    return scored.groupBy("unit_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b")).select("unit_id", F.col("b.license").alias("license"), (-F.col("b.s")).alias("similarity"))


def directory(path: Column) -> Column:
    """What comes before the last slash; empty at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all above it, the top being the empty one."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def _units(files: DataFrame) -> DataFrame:
    """(file_id, path, place, unit_id, unit, named, is_whole) of files(file_id, path, text)."""
    name = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1)
    plain = F.regexp_replace(F.concat(F.lit("\n"), F.replace("text", F.lit("\r"), F.lit(""))), MARK, "\n")
    flat = lambda x: F.trim(F.regexp_replace(x, r"[ \t\n]+", " "))
    own = files.where(F.col("text").rlike(CUE)).select("file_id", "path", name.rlike(LICENSE_FILE).alias("named"), plain.alias("plain"))
    parts = F.array_append(F.concat(F.split("plain", "\n"), F.split("plain", "\n\n+")), F.col("plain"))
    numbered = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("place"), flat(x).alias("unit"))), lambda x: x["unit"].rlike(CUE))
    rows = own.select("file_id", "path", "named", F.sha2(flat(F.col("plain")), 256).alias("whole"), F.explode(numbered).alias("u")).select("file_id", "path", "named", "whole", "u.*")
    return rows.withColumn("unit_id", F.sha2("unit", 256)).select("file_id", "path", "place", "unit_id", "unit", "named", (F.col("unit_id") == F.col("whole")).alias("is_whole"))


def license_scan(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """files(file_id, path, text) -> a row each: file_id, path, license, similarity, how ('own', 'inherited' or null) and from_path."""
    known = known if known is not None else templates(files.sparkSession)
    own = files.select("file_id", F.col("path"), text_of().alias("text"))
    units = materialise(_units(own), "licence-units")
    best = score(units.groupBy("unit_id").agg(F.first("unit").alias("unit")), known)
    rank = F.struct((F.col("license") == WEAK).alias("weak"), (-F.col("similarity")).alias("s"), "place", "license")
    passes = F.col("named") | (F.col("is_whole") & (F.col("similarity") >= WHOLE))
    matched = units.drop("unit").join(best, "unit_id").groupBy("file_id", "path").agg(F.min(rank).alias("m"), F.min(F.when(passes, rank)).alias("w"))
    matched = materialise(matched, "licence-matches")

    licensed = matched.where("w is not null and path is not null").groupBy(directory(F.col("path")).alias("folder")).agg(
        F.array_join(F.array_sort(F.collect_set("w.license")), " AND ").alias("license"), F.min(-F.col("w.s")).alias("similarity"), F.min("path").alias("from_path")
    )
    folders = own.where("path is not null").select(directory(F.col("path")).alias("own_folder")).distinct()
    chain = folders.select("own_folder", F.posexplode(ancestors(F.col("own_folder"))).alias("depth", "folder"))
    nearest = chain.join(licensed, "folder").groupBy("own_folder").agg(F.max_by(F.struct("license", "similarity", "from_path"), "depth").alias("l"))

    found = matched.select(F.col("file_id").alias("_id"), F.col("path").alias("_path"), "m")
    rows = own.select("file_id", "path", F.coalesce(directory(F.col("path")), F.lit("?")).alias("own_folder"))
    rows = rows.join(found, F.col("file_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    rows = rows.join(nearest, "own_folder", "left")
    inherits = F.col("m").isNull() & F.col("l").isNotNull() & F.col("path").isNotNull()
    return rows.select(
        "file_id", "path", F.when(inherits, F.col("l.license")).otherwise(F.col("m.license")).alias("license"),
        F.when(inherits, F.col("l.similarity")).otherwise(-F.col("m.s")).alias("similarity"),
        F.when(inherits, "inherited").when(F.col("m").isNotNull(), "own").alias("how"),
        F.when(inherits, F.col("l.from_path")).when(F.col("m").isNotNull(), F.col("path")).alias("from_path"),
    )
