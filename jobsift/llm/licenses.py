"""Operator 5 [native] — licence scan.

Documents are read as words without regard to case and punctuation, in
shingles of five words.  Windows of ``2 L`` shingles start at every ``L``-th
shingle, for each power of two ``L`` that a template needs (``L / 2 < shingles
of the template <= L``): any copy of a template lies whole in one of them, and
there the two sets have a Jaccard similarity of 0.18 or more even if a fifth of
the template is changed.  MinHash signatures of ``BANDS`` bands of one row then
meet with probability 1 - (1 - 0.18) ** 64 > 0.99999.  What meets is verified
exactly, by the share of the template's shingles that the window contains.

A band of one row meets only on a shingle that window and template share, so
windows without any shingle of a template of their size need no signature; all
others get one.  Templates are a parameter of some dozens of texts: their
bands are broadcast, and documents are never shuffled, only windows that met.
Everything is DataFrame and SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

SHINGLE, CONTAINED, BANDS = 5, 0.8, 64

# FIXED VALUES: licence notices as their publishers word them (SPDX name, text).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of
        his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the
        extent allowed by law."""),
    ("MIT", """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution."""),
    ("BSD", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version."""),
    ("GPL", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following:"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions:"""),
    ("Unlicense", """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_hashes(w: Column) -> Column:
    """Hash of each shingle.  The words are bound by a lambda first: an expression that the optimizer moves
    into a filter would otherwise split the text again for every shingle."""

    def of(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(x) - SHINGLE)
        each = F.transform(at, lambda i: F.xxhash64(*[F.get(x, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(x) < SHINGLE, F.array().cast("array<bigint>")).otherwise(each)

    return F.transform(F.array(w), of)[0]


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(template, license, t_shingles, n, scale, hashes); templates of under five words have nothing to match."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template INT, license STRING, text STRING")
    rows = rows.withColumn("w", words(F.col("text"))).where(F.size("w") >= SHINGLE)
    rows = rows.withColumn("t_shingles", F.array_distinct(shingle_texts("w"))).withColumn("hashes", F.array_distinct(shingle_hashes(F.col("w"))))
    rows = rows.withColumn("n", F.size("t_shingles"))
    scale = f"if(size(w) = {SHINGLE}, 1, shiftleft(1, length(bin(size(w) - {SHINGLE}))))"  # least power of two >= positions
    return rows.withColumn("scale", F.expr(scale)).drop("text", "w")


def shingle_texts(w: str) -> Column:
    return F.expr(f"if(size({w}) < {SHINGLE}, array(), transform(sequence(0, size({w}) - {SHINGLE}), i -> concat_ws(' ', slice({w}, i + 1, {SHINGLE}))))")


def band_values(hashes: str) -> Column:
    """One MinHash value per band."""
    return F.expr(f"transform(sequence(0, {BANDS - 1}), b -> array_min(transform({hashes}, x -> xxhash64(x, b))))")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, template, license, contained, first_word): one row per document and template found in it.

    Templates that differ in little (GPL 2 and 3) are both found, the one that
    is there with the higher ``contained``; so is one that is part of another
    (the two clauses of BSD in its three).
    ``contained`` is the largest share of the template's shingles in one
    window, ``first_word`` where the first of them stands in it.  Documents
    without a licence, null and empty texts have no row.  Rows that repeat a
    doc_id count as one document, rows without one as well.  An empty table
    gives an empty table; further columns are not read.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    by_scale = {r.scale: r.h for r in known.groupBy("scale").agg(F.flatten(F.collect_list("hashes")).alias("h")).collect()}
    if not by_scale:
        return docs.select("doc_id", F.lit(0).alias("template"), F.lit("").alias("license"), F.lit(0.0).alias("contained"), F.lit(0).alias("first_word")).where("false")
    every = F.array(*[F.lit(x) for x in sorted({x for h in by_scale.values() for x in h})])
    read = docs.select("doc_id", words(text_or_empty()).alias("w")).where(F.arrays_overlap(shingle_hashes(F.col("w")), every))
    read = read.withColumn("h", shingle_hashes(F.col("w")))

    def windows(scale: int, hashes: list[int]) -> Column:
        """Windows of this scale that hold a shingle of a template of this scale."""
        own = F.array(*[F.lit(x) for x in sorted(set(hashes))])
        at = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains(own, F.get("h", i)))
        of = F.flatten(F.transform(at, lambda i: F.array(F.floor(i / scale).cast("int"), F.floor(i / scale).cast("int") - 1)))
        return F.transform(F.filter(F.array_distinct(of), lambda k: k >= 0), lambda k: F.struct(F.lit(scale).alias("scale"), k.alias("k")))

    cut = read.select("doc_id", "w", "h", F.explode(F.concat(*[windows(s, h) for s, h in sorted(by_scale.items())])).alias("at"))
    cut = cut.select(
        "doc_id", F.col("at.scale").alias("scale"), F.col("at.k").alias("k"),
        F.expr(f"slice(w, at.k * at.scale + 1, 2 * at.scale + {SHINGLE - 1})").alias("w"),
        F.expr("slice(h, at.k * at.scale + 1, 2 * at.scale)").alias("h"),
    )
    signed = cut.select("doc_id", "scale", "k", "w", F.posexplode(band_values("h")).alias("band", "value"))
    bands = known.select("template", "scale", F.posexplode(band_values("hashes")).alias("band", "value"))
    met = signed.join(F.broadcast(bands), ["scale", "band", "value"]).select("doc_id", "scale", "k", "w", "template").distinct()
    met = met.join(F.broadcast(known.select("template", "license", "t_shingles", "n")), "template")
    met = met.withColumn("s", shingle_texts("w"))
    met = met.withColumn("found", F.size(F.array_intersect("s", "t_shingles")))
    met = met.where(F.col("found") * 10 >= F.col("n") * round(10 * CONTAINED))
    start = F.expr("k * scale + array_position(transform(s, x -> array_contains(t_shingles, x)), true) - 1").cast("int")
    return met.groupBy("doc_id", "template").agg(
        F.first("license").alias("license"), F.max(F.col("found") / F.col("n")).alias("contained"), F.min(start).alias("first_word")
    )
