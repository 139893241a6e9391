"""Licence scans: sparse TF-IDF cosines to templates, then inheritance from the nearest directory.

Units of a file are its lines, its blocks of consecutive lines (paragraphs, and runs of comment lines)
and the file as a whole. Templates are short notices, SPDX tags and headers of several lines, and whole
licence texts, each kind a model of its own. A unit's terms are
weighted by tf * idf, idf taken over a model's templates; terms that no template has weigh most and only
lengthen the unit. The best cosine of a line or block names a file's header licence, that of the whole text
makes it a licence file, whose licence holds for its directory and all below it. A file without a
licence of its own takes that of its nearest ancestor directory that has one: the distinct
directories are expanded to their ancestors, joined with the licensed ones by path, and the deepest
match wins. A unit is scored if it has a word by which a licence is stated (MENTION): common words alone can
be close to a long licence text, but state none. Units meet the templates by an equi-join on terms. The template table has some thousands of rows whatever the input, and alone is
broadcast. Only DataFrame functions are used.

Defined results: a null text has no licence; a null path lies in the root directory; a unit scores by
its best template (ties: the first name), whole texts of any length too. A null source or lang is a
folder "_" of op1_licenses. Several licence files in one directory: the highest score,
then the first path. Repeated rows give equal rows; an empty table gives an empty result. Columns
other than the id, path and text are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table, written

# Short notices by which public licences are declared.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, {1}."
_LATER = "either version {} of the License, or (at your option) any later version"
_NO_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details. You should have received a copy of the GNU {0} Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_GNU_HEADERS = (("AGPL-3.0", "Affero General", "3"), ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"))
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_REST = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
#: SPDX tags, and headers that take several lines: their first paragraphs and the whole of them.
HEADERS: tuple[tuple[str, str], ...] = (
    *((name, f"SPDX-License-Identifier: {name}") for name in sorted({n for n, _ in TEMPLATES} | {"LGPL-2.1"})),
    *((name, f"SPDX-License-Identifier: {name}-{kind}") for name, _, _ in _GNU_HEADERS for kind in ("only", "or-later")),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_REST),
    ("BSD-3-Clause", "All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name, _GNU.format(which, held.format(v)) + rest.format(which)) for name, which, v in _GNU_HEADERS for held in (_LATER, "version {}") for rest in ("", _NO_WARRANTY)),
)


def _texts() -> tuple[tuple[str, str], ...]:
    """Whole licence texts. That of the AGPL is the GPL's with its own name and section 13."""
    found = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    gpl = found["GPL-3.0"]
    begin, end = gpl.index("  13. Use with the GNU Affero"), gpl.index("  14. Revised Versions")
    remote = (
        "  13. Remote Network Interaction; Use with the GNU General Public License.\n\n"
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users "
        "interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the "
        "Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some "
        "standard or customary means of facilitating copying of software.\n\n"
    )
    named = lambda x: re.sub(r"(?i)(GNU) (General Public)", lambda m: f"{m[1]} {'AFFERO' if m[2].isupper() else 'Affero'} {m[2]}", x)
    found["AGPL-3.0"] = named(gpl[:begin]) + remote + named(gpl[end:])
    # the GNU texts end in instructions, which copies may lack
    short = [(n, t.split("END OF TERMS AND CONDITIONS")[0]) for n, t in found.items() if "END OF TERMS AND CONDITIONS" in t]
    return (*sorted(found.items()), *short)


#: A statement of a licence has one of these: a line, block or file that has none states no licence, whatever
#: its cosines. All templates have one.
MENTION = r"(?i)licen[sc]e|spdx|copyright|permission|public domain|free software|\bCC[ -]?(?:BY|0)"
HEADER, WHOLE = 0.7, 0.8
#: What a comment line begins with.
_COMMENT = r"[ \t]*+(?:#|//|/?\*|--|;|%|<!--)"
#: Units from here on are blocks.
_BLOCKS = 1 << 30
_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def _model(templates: tuple[tuple[str, str], ...]) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """(licence, template, term, weight / norm) rows, idf by term, and the idf of other terms."""
    terms = [Counter(re.findall(_TERM, text.lower())) for _, text in templates]
    n = len(templates)
    idf = {t: 1 + math.log((1 + n) / (1 + sum(t in c for c in terms))) for t in set().union(*terms)}
    rows = []
    for i, ((name, _), counts) in enumerate(zip(templates, terms, strict=True)):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in counts.items()))
        rows += [(name, i, t, k * idf[t] / norm) for t, k in sorted(counts.items())]
    return rows, idf, 1 + math.log(1 + n)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant table as one literal of the plan, so that no Python worker makes it."""
    names = [x.split()[0] for x in schema.split(", ")]
    said = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(said), f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>>")))


def cosines(units: DataFrame) -> DataFrame:
    """_row, unit, licence, score: the best template of every unit (_row, unit, text) that has one."""
    spark = units.sparkSession
    models = [_model(x) for x in (TEMPLATES, HEADERS, _texts())]
    weights = _rows(spark, [(k, *row) for k, (rows, _, _) in enumerate(models) for row in rows], "model int, licence string, template int, term string, weight double")
    every = sorted({t for _, idf, _ in models for t in idf})
    known = _rows(spark, [(t, [idf.get(t, other) for _, idf, other in models]) for t in every], "term string, idfs array<double>")
    others = F.array(*(F.lit(other) for _, _, other in models))
    terms = units.select("_row", "unit", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({_TERM})"), F.lit(1))).alias("term")).groupBy("_row", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = terms.join(F.broadcast(known), "term", "left")
    square = lambda k: F.col("tf") * F.get(F.coalesce("idfs", others), F.lit(k)) * F.col("tf") * F.get(F.coalesce("idfs", others), F.lit(k))
    norms = weighed.groupBy("_row", "unit").agg(F.array(*(F.sqrt(F.sum(square(k))) for k in range(len(models)))).alias("norms"))
    met = weighed.where("idfs IS NOT NULL").join(F.broadcast(weights), "term").withColumn("w", F.col("tf") * F.get("idfs", F.col("model")))
    dots = met.groupBy("_row", "unit", "model", "licence", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["_row", "unit"]).withColumn("score", F.round(F.col("dot") / F.get("norms", F.col("model")), 6))
    best = scored.groupBy("_row", "unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("_row", "unit", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def blocks(text: Column) -> Column:
    """Paragraphs and runs of comment lines, of two lines or more."""
    paragraphs = F.split(text, r"\n[^\p{L}\p{N}]*\n")
    runs = F.transform(F.split(text, rf"\n(?!{_COMMENT})"), lambda x: F.regexp_replace(x, rf"^(?!{_COMMENT})[^\n]*\n", ""))
    return F.filter(F.array_distinct(F.concat(paragraphs, runs)), lambda x: x.contains("\n") & x.rlike(MENTION))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, the root "" included, deepest first."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Per file: doc_id, path, header_licence, header_score, file_licence, file_score,
    inherited_licence, inherited_from, licence (header's, else the file's, else the inherited one)."""
    rows = written(files.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.when(F.coalesce(F.col(text_col), F.lit("")).rlike(MENTION), F.col(text_col)).alias("text")))
    named = rows.where("text IS NOT NULL")
    lines = named.select("_row", F.posexplode(F.split("text", "\n")).alias("unit", "text")).where(F.col("text").rlike(MENTION)).withColumn("unit", F.col("unit") + 1)
    several = named.select("_row", F.posexplode(blocks(F.col("text"))).alias("unit", "text")).withColumn("unit", F.col("unit") + _BLOCKS)
    found = written(cosines(lines.unionByName(several).unionByName(named.select("_row", F.lit(0).alias("unit"), "text"))))
    header = found.where((F.col("unit") > 0) & (F.col("score") >= HEADER)).groupBy("_row").agg(F.min(F.struct((-F.col("score")).alias("s"), "unit", "licence")).alias("h"))
    header = header.select("_row", F.col("h.licence").alias("header_licence"), (-F.col("h.s")).alias("header_score"))
    whole = found.where((F.col("unit") == 0) & (F.col("score") >= WHOLE)).select("_row", F.col("licence").alias("file_licence"), F.col("score").alias("file_score"))

    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "^/+", "")
    placed = rows.select("_row", "doc_id", "path", folder.alias("dir"))
    licensed = placed.join(whole, "_row").groupBy("dir").agg(F.min(F.struct((-F.col("file_score")).alias("s"), "path", "file_licence")).alias("l")).select(F.col("dir").alias("up"), F.col("l.file_licence").alias("inherited_licence"))
    climbed = placed.select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("far", "up"))
    nearest = climbed.join(licensed, "up").groupBy("dir").agg(F.min(F.struct("far", "up", "inherited_licence")).alias("n")).select("dir", F.col("n.up").alias("inherited_from"), F.col("n.inherited_licence").alias("inherited_licence"))
    out = placed.join(header, "_row", "left").join(whole, "_row", "left").join(nearest, "dir", "left")
    return out.select("doc_id", "path", "header_licence", "header_score", "file_licence", "file_score", "inherited_licence", "inherited_from", F.coalesce("header_licence", "file_licence", "inherited_licence").alias("licence"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files <source>/<lang>/<doc_id>.txt."""
    part = lambda c: F.coalesce(F.col(c), F.lit("_"))
    path = F.concat_ws("/", part("source"), part("lang"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("_")), F.lit(".txt")))
    return scan(table(spark, sf_dir, "documents").withColumn("path", path))
