"""License scans with DataFrame functions only.

Whole files that have a line which may be a notice are compared with the full
texts of licences, and such lines with notices, by the cosine of their TF-IDF
vectors.  A file that is a licence's text has that licence, whatever its lines
say; files without a licence take that of the nearest directory above them that
has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

# Licence texts, headers and notices by licence.
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_TWO_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_THIRD_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
TEXTS = (
    ("MIT", "MIT License " + _PERMISSION + _AS_IS),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "BSD 2-Clause License " + _TWO_CLAUSES + _BSD_AS_IS),
    ("BSD-3-Clause", "BSD 3-Clause License " + _TWO_CLAUSES + _THIRD_CLAUSE + _BSD_AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Public texts of licences, a file each; they may be copied word for word.
FOLDER = Path(__file__).with_name("licenses")
#: Templates of lines.  The first of equally similar ones counts, so notices stand before headers.
LINES = (*NOTICES, *((name, f"SPDX-License-Identifier: {name}") for name in sorted({n for n, _ in NOTICES})), *TEXTS)
#: Templates of whole files.
WHOLES = (*TEXTS, *sorted((p.stem, p.read_text(errors="replace")) for p in FOLDER.glob("*.txt")))
#: A line that matches this is compared with the templates.
NOTICE = r"(?i)licen[cs]e|copyright|public domain|permission is hereby|redistribution and use|rights reserved|spdx"
MIN_SCORE = 0.6
#: Score from which a whole file may be a licence's text, and by how much it must exceed the next licence's.
TEXT_SCORE, TEXT_MARGIN = 0.7, 0.01
#: Words from which on a file named as a licence's is one only as a whole, or where notices make up enough of it.
LONG_WORDS = 150
#: What is added to every word's idf: words that all licences share say little of which one a text is.
LINE_FLOOR, TEXT_FLOOR = 1.0, 0.1
#: Share of a file's words that stand in notices from which on it is a licence file.
FILE_SHARE = 0.5
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def weights(templates=LINES, floor: float = LINE_FLOOR) -> tuple[list[tuple[str, int, float, float]], float]:
    """(word, template, idf, weight in the template's unit vector) rows, and the idf of other words."""
    own = [Counter(words(t)) for _, t in templates]
    n = len(own)
    df = Counter(w for c in own for w in c)
    idf = {w: math.log((1 + n) / (1 + k)) + floor for w, k in df.items()}
    rows = []
    for t, c in enumerate(own):
        norm = math.sqrt(sum((k * idf[w]) ** 2 for w, k in c.items()))
        rows += [(w, t, idf[w], k * idf[w] / norm) for w, k in sorted(c.items())]
    return rows, math.log(1 + n) + floor


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _weight_table(spark: SparkSession, templates, floor: float, whole: bool) -> tuple[DataFrame, float]:
    """whole, word, idf and entries (template, weight) of the templates' words, and the idf of others."""
    rows, other = weights(templates, floor)
    by_word: dict[str, tuple[float, list[str]]] = {}
    for w, t, i, x in rows:
        by_word.setdefault(w, (i, []))[1].append(f"{t}, {x!r}D")
    values = ", ".join(f"('{w}', {i!r}D, array(named_struct('t', " + "), named_struct('t', ".join(e.replace(", ", ", 'x', ") for e in entries) + ")))" for w, (i, entries) in sorted(by_word.items()))
    return spark.sql(f"select {str(whole).lower()} as whole, * from values {values} as w(word, idf, entries)"), other


def own_notices(files: DataFrame, lines=LINES, wholes=WHOLES) -> DataFrame:
    """Of `files` (id, k, text; k a hash of the text): id, k, own_license, own_score,
    whole (whether the file is a licence's text or notices make it up) and words
    (how many it has) of each that has a licence.

    A file's words, and those of each line that may be a notice, are rows of
    their own; rows that are repeated scale a vector but do not turn it.
    """
    spark = files.sparkSession
    (of_lines, line_other), (of_texts, text_other) = _weight_table(spark, lines, LINE_FLOOR, False), _weight_table(spark, wholes, TEXT_FLOOR, True)
    line_names, text_names = (F.array(*[F.lit(name) for name, _ in templates]) for templates in (lines, wholes))
    split = F.transform(F.split("text", "\n"), lambda line, i: F.struct((i + 1).alias("n"), line.alias("t")))
    units = F.concat(F.array(F.struct(F.lit(0).alias("n"), F.col("text").alias("t"))), F.filter(split, lambda u: u["t"].rlike(NOTICE)))
    noted = files.where(F.col("text").rlike(NOTICE)).select("id", "k", F.explode(units).alias("u"))
    terms = noted.select("id", "k", F.col("u.n").alias("n"), F.explode(_tokens(F.col("u.t"))).alias("word")).groupBy("id", "k", "n", "word").agg(F.count("*").cast("double").alias("tf"))
    v = F.col("tf") * F.coalesce("idf", F.when(F.col("n") == 0, text_other).otherwise(line_other))
    cell = lambda t, x: F.struct(t.alias("t"), x.alias("x"))
    # under -1 the square of the vector's length, under -2 its words
    cells = F.concat(F.array(cell(F.lit(-1), v * v), cell(F.lit(-2), F.col("tf"))), F.coalesce(F.transform("entries", lambda e: cell(e["t"], e["x"] * v)), F.array().cast("array<struct<t:int,x:double>>")))
    # as large as the templates, whatever the files
    table = F.broadcast(of_lines.unionByName(of_texts))
    sums = terms.withColumn("whole", F.col("n") == 0).join(table, ["whole", "word"], "left").select("id", "k", "n", F.explode(cells).alias("c")).groupBy("id", "k", "n", "c.t").agg(F.sum("c.x").alias("x"))
    of = lambda t: F.max(F.when(F.col("t") == t, F.col("x")))
    units = sums.groupBy("id", "k", "n").agg(F.sqrt(of(-1)).alias("norm"), of(-2).alias("words"), F.collect_list(F.when(F.col("t") >= 0, F.struct("t", "x"))).alias("dots"))  # a row for each template at most
    name = lambda t: F.when(F.col("n") == 0, F.get(text_names, t)).otherwise(F.get(line_names, t))
    scored = F.transform("dots", lambda d: F.struct(F.round(d["x"] / F.col("norm"), 6).alias("score"), (-d["t"]).alias("minus"), name(d["t"]).alias("name")))
    best = units.select("id", "k", "n", "words", scored.alias("scored")).withColumn("best", F.array_max("scored"))
    second = F.array_max(F.transform(F.filter("scored", lambda d: d["name"] != F.col("best.name")), lambda d: d["score"]))
    enough = F.when(F.col("n") == 0, (F.col("best.score") >= TEXT_SCORE) & (F.col("best.score") - F.coalesce(second, F.lit(0.0)) >= TEXT_MARGIN)).otherwise(F.col("best.score") >= MIN_SCORE)
    judged = best.select("id", "k", "n", "words", "best", F.coalesce(enough, F.lit(False)).alias("found"))
    own = judged.groupBy("id", "k").agg(
        F.max(F.when(F.col("found") & (F.col("n") == 0), F.col("best"))).alias("text"),
        F.max(F.when(F.col("found") & (F.col("n") > 0), F.col("best"))).alias("line"),
        F.sum(F.when(F.col("found") & (F.col("n") > 0), F.col("words")).otherwise(0.0)).alias("covered"),
        F.max(F.when(F.col("n") == 0, F.col("words"))).alias("words"),
    ).where("text is not null or line is not null")
    top = F.coalesce("text", "line")
    return own.select("id", "k", top["name"].alias("own_license"), top["score"].alias("own_score"), (F.col("text").isNotNull() | (F.col("covered") >= FILE_SHARE * F.col("words"))).alias("whole"), "words")


def directory(path: Column) -> Column:
    """The path before its last slash; empty for none."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^([\s\S]*)/[^/]*$", 1)).otherwise(F.lit(""))


def scan(files: DataFrame, lines=LINES, wholes=WHOLES) -> DataFrame:
    """Per row of `files` (id, path, text; others are ignored): id, path, license,
    score, basis ('own', 'inherited' or null) and license_dir.

    A file's licence is that of the text most similar to the whole of it, if it is
    similar enough and more so than to any other licence's; else that of the notice
    most similar to one of its lines (of equal ones the first template's).  A file
    named as a licence's, of LONG_WORDS or more, is not named by a line that is a
    small part of it.  Without a licence a file has that of the nearest directory from its own upwards which has a licence file
    (of several, the most similar one's; of equal ones the first name).  Null
    texts have no notice and null paths no directory; null ids and repeated rows
    stay, an empty table gives no rows.
    """
    scratch = Scratch(files.sparkSession, "licenses")
    keyed = files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
    noted = scratch.save(own_notices(keyed, lines, wholes), "noted").withColumnsRenamed({"id": "noted_id", "k": "noted_k"})
    named = keyed.select("id", "path", "k").join(noted, F.col("id").eqNullSafe(F.col("noted_id")) & (F.col("k") == F.col("noted_k")), "left")
    by_name = F.coalesce(F.col("path").rlike(LICENSE_NAME), F.lit(False))
    told = F.col("whole") | ~by_name | (F.col("words") < LONG_WORDS)
    named = named.withColumns({c: F.when(told, F.col(c)) for c in ("own_license", "own_score")})
    is_file = F.col("own_license").isNotNull() & F.coalesce(F.col("whole") | by_name, F.lit(False))
    own = scratch.save(named.select("id", "path", "own_license", "own_score", is_file.alias("is_license_file"), directory(F.col("path")).alias("dir")), "own")
    licensed = own.where("is_license_file and path is not null").groupBy("dir").agg(F.min_by(F.struct("own_license", "own_score"), F.struct(-F.col("own_score"), F.col("own_license"))).alias("l"))
    licensed = licensed.select(F.col("dir").alias("license_dir"), "l.own_license", "l.own_score")
    # directories, not files, meet their ancestors
    parts = F.split("dir", "/")
    chain = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n))), F.array(F.lit("")))
    dirs = own.where("own_license is null and path is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(chain)).alias("license_dir"))
    nearest = dirs.join(licensed, "license_dir").groupBy("dir").agg(F.max_by(F.struct("license_dir", "own_license", "own_score"), F.length("license_dir")).alias("near"))
    joined = own.join(nearest, "dir", "left")
    mine = F.col("own_license").isNotNull()
    return joined.select(
        "id", "path",
        F.coalesce("own_license", "near.own_license").alias("license"),
        F.when(mine, F.col("own_score")).otherwise(F.col("near.own_score")).alias("score"),
        F.when(mine, "own").when(F.col("near.own_license").isNotNull(), "inherited").alias("basis"),
        F.when(~mine, F.col("near.license_dir")).alias("license_dir"),
    )
