"""Licence scan by Dice coefficient over word bigrams (native).

A unit (each line of a text, each block between blank lines, and the whole text)
is normalised to lower-case words of letters and digits and becomes its set of
word bigrams. It matches a template when 2 |A & B| / (|A| + |B|) reaches the
threshold. The coefficient bounds the sizes: for a template of m bigrams only
units of m t / (2 - t) to m (2 - t) / t bigrams can reach t. The templates are
laid out by admissible size, so an equi-join on the unit's size proposes only
those; the table's size is bounded by the fixed templates, and it is broadcast.
Bigrams are compared only for the proposed pairs.

Defined cases: a null or empty text matches nothing; of equal coefficients the
first template by name is the best; repeated rows get equal results; an empty
table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import same_row, text_key, whole_text

# Notices and licence texts, by identifier and part.
TEMPLATES = {
    ("Apache-2.0", "line"): "Licensed under the Apache License, Version 2.0.",
    ("Apache-2.0", "notice"):
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ("CC-BY-4.0", "line"): "Licensed under CC BY 4.0.",
    ("CC-BY-NC-4.0", "line"): "Licensed under CC BY-NC 4.0.",
    ("CC-BY-SA-4.0", "line"): "Licensed under CC BY-SA 4.0.",
    ("CC-BY-4.0", "notice"):
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ("GPL-3.0", "line"): "This work is licensed under the GNU General Public License, version 3.",
    ("GPL-3.0", "notice"):
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ("ISC", "permission"):
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ("MIT", "line"): "Released under the MIT License.",
    ("MIT", "permission"):
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ("MPL-2.0", "notice"):
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ("AGPL-3.0", "notice"):
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU Affero General Public License for more details.",
    ("BSD-2-Clause", "conditions"):
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ("BSD-3-Clause", "conditions"):
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ("CC0-1.0", "notice"):
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ("GPL-2.0", "notice"):
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ("LGPL-2.1", "notice"):
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU Lesser General Public License for more details.",
    ("Unlicense", "notice"):
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
}
# Identifiers of the one-line form, by the licence that they name.
SPDX = {
    "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "Apache-2.0": ["Apache-2.0"], "BSD-2-Clause": ["BSD-2-Clause"],
    "BSD-3-Clause": ["BSD-3-Clause"], "CC0-1.0": ["CC0-1.0"], "GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "ISC": ["ISC"], "LGPL-2.1": ["LGPL-2.1-only", "LGPL-2.1-or-later"],
    "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0"], "Unlicense": ["Unlicense"],
}
TEMPLATES |= {(name, f"tag {i}"): f"SPDX-License-Identifier: {i}" for name, ids in SPDX.items() for i in ids}


def bigrams(normalised: Column) -> Column:
    """Distinct word bigrams of a normalised text as an array."""
    w = F.array_remove(F.split(normalised, " "), "")
    return F.get(F.transform(F.array(w), lambda a: F.when(F.size(a) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(a) - 2), lambda i: F.concat_ws(
            " ", F.get(a, i), F.get(a, i + 1)))))), F.lit(0))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def template_sizes(spark, templates: dict, threshold: float) -> DataFrame:
    """Rows (size, license, part, grams, m): a template at every admissible size."""
    rows = []
    for (name, part), text in sorted(templates.items()):
        w = [x for x in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if x]
        rows.append((name, part, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    table = spark.createDataFrame(rows, "license string, part string, t_grams array<string>")
    m, t = F.size("t_grams"), F.lit(threshold)
    return table.select("license", "part", "t_grams", F.explode(F.sequence(
        F.greatest(F.ceil(m * t / (2 - t) - 1e-9), F.lit(1)).cast("int"), F.floor(m * (2 - t) / t + 1e-9).cast("int"))).alias("size"))


def scan_units(docs: DataFrame, threshold: float = 0.8, templates: dict | None = None) -> DataFrame:
    """Matches: doc_id, text_key, unit, license, part, dice; every unit and template
    whose coefficient reaches the threshold."""
    table = template_sizes(docs.sparkSession, templates or TEMPLATES, threshold)
    t = docs.select("doc_id", whole_text().alias("text"))
    blocks = F.split(F.col("text"), r"\n[\x20\t]*\n")
    lines = F.split(F.col("text"), "\n")
    units = F.concat(
        F.transform(lines, lambda x, i: F.struct(F.concat(F.lit("line "), i + 1).alias("unit"), x.alias("t"))),
        F.when(F.size(blocks) > 1, F.transform(blocks, lambda x, i: F.struct(
            F.concat(F.lit("block "), i + 1).alias("unit"), x.alias("t")))).otherwise(F.array().cast("array<struct<unit:string,t:string>>")),
        F.when(F.size(lines) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.col("text").alias("t")))).otherwise(
            F.array().cast("array<struct<unit:string,t:string>>")))
    most = max(len(re.findall(r"\w+", x)) for x in (templates or TEMPLATES).values()) * (2 - threshold) / threshold + 2
    rows = t.select("doc_id", text_key(F.col("text")).alias("text_key"), F.explode(units).alias("u")).select(
        "doc_id", "text_key", "u.unit", normalised(F.col("u.t")).alias("norm"))
    # a unit has at most as many bigrams as words less one, and may have far fewer
    # if it repeats itself: sizes are those of the distinct bigrams
    sized = rows.select("doc_id", "text_key", "unit", bigrams(F.col("norm")).alias("grams")).filter(
        F.size("grams").between(1, int(most)))
    both = sized.withColumn("size", F.size("grams")).join(F.broadcast(table), "size")
    dice = 2 * F.size(F.array_intersect("grams", "t_grams")) / (F.size("grams") + F.size("t_grams"))
    return both.select("doc_id", "text_key", "unit", "license", "part", dice.alias("dice")).filter(F.col("dice") >= threshold)


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: dict | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, license (best coefficient, then name; null: none),
    dice, n_units (units that match any template), licenses (comma-joined). A unit speaks
    for its best template alone: notices of related licences differ in a word or two."""
    units = scan_units(docs, threshold, templates).groupBy("doc_id", "text_key", "unit").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"))
    found = units.groupBy("doc_id", "text_key").agg(
        F.min("best").alias("best"), F.count(F.lit(1)).alias("n_units"),
        F.array_join(F.array_sort(F.collect_set("best.license")), ",").alias("licenses"))
    rows = docs.select("doc_id", text_key(whole_text()).alias("text_key"))
    return rows.join(found, same_row(rows, found), "left").select(
        rows["doc_id"], F.col("best.license").alias("license"), F.round(-F.col("best.d"), 9).alias("dice"),
        F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.coalesce("licenses", F.lit("")).alias("licenses"))
