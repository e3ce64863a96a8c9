"""License scans: lines, paragraphs, runs of paragraphs and whole texts against licence templates.

Text is lower-cased (ASCII) and runs of ASCII characters other than letters and digits become one space. Two texts are
as like as the Dice coefficient of their sets of word bigrams. A Dice coefficient of t needs sizes within a
factor of (2 - t) / t, so only templates within these bounds are compared.

Results for odd rows: a null text is empty. A text or line of less than two words has no bigrams and matches nothing.
Repeated rows get equal results. Of equally like templates the first in order of names counts as best.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 0.8
# Statements, notices and whole texts of common licences; paragraphs of whole texts are apart.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "bsd-2-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.\n\n"
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
        "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text: Column) -> Column:
    """Normalised words; none for an empty text."""
    plain = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), BETWEEN, " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def bigrams(found: Column) -> Column:
    """The set of an array's word bigrams (two words at least)."""
    return F.array_distinct(F.zip_with(F.slice(found, 1, F.size(found) - 1), F.slice(found, 2, F.size(found) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def _plain_bigrams(text: str) -> list[str]:
    kept = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text.translate(str.maketrans(_UPPER, _LOWER)))
    found = kept.split()
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:], strict=False)})


def read_templates(spark: SparkSession, folder: str, most_words: int = 20_000) -> dict[str, str]:
    """Templates from a folder of text files, by file name without its ending: longer licences, or a project's own.

    The list is bounded: files of over most_words words are refused.
    """
    texts = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), "value")
    if not texts.where(F.size(F.split("value", r"\s+")) > most_words).isEmpty():
        raise ValueError(f"a template has over {most_words} words")
    return {r.name: r.value for r in texts.collect()}


def most_paragraphs(text: str) -> int:
    """How many paragraphs a template may be set in: those that it has, or one for each clause and address."""
    if "\n\n" in text:
        return text.count("\n\n") + 1
    return 1 + len(re.findall(r"[.:;]\s", text)) + 2 * len(re.findall(r"\shttps?://", text))


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    *,
    text_col: str = "text",
    least: float = LEAST,
    licenses_col: str = "licenses",
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (columns in keep) with licenses_col: template, unit (text, paragraph, line, 2 paragraphs, 3 paragraphs, ...), index from 0, dice;
    by unit, index, template. The index of several paragraphs is that of the first.

    templates are a part of the query's plan: a bounded list. No rows are shuffled.
    """
    known = {name: b for name, text in sorted((templates or TEMPLATES).items()) if (b := _plain_bigrams(text))}
    sizes = {name: len(b) for name, b in known.items()}
    clauses = {name: most_paragraphs((templates or TEMPLATES)[name]) for name in known}
    most = max(sizes.values(), default=0) * (2 - least) / least + 1  # a first bound; the exact one follows
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kept = [c for c in (docs.columns if keep is None else keep) if c != licenses_col]
    table = F.array(*(F.struct(F.lit(n).alias("template"), F.lit(sizes[n]).alias("size"), F.lit(clauses[n]).alias("clauses"), F.array(*map(F.lit, b)).alias("bigrams")) for n, b in known.items()))

    def units(rank: int, parts: Column) -> Column:
        # a normalised unit with more words than any template's bound times two can still have few different bigrams, so all are built
        return F.transform(parts, lambda p, i: F.struct(F.lit(rank).alias("unit"), i.alias("index"), bigrams_or_none(p).alias("bigrams")))

    def bigrams_or_none(part: Column) -> Column:
        return F.transform(F.array(words(part)), lambda w: F.when(F.size(w) >= 2, bigrams(w)).otherwise(F.array().cast("array<string>")))[0]

    paragraphs = F.split(text, r"\n[ \t]*\n\s*", -1)
    lines = F.split(text, "\n", -1)
    some = F.concat(
        units(0, F.array(text)),
        F.when(F.size(paragraphs) > 1, units(1, paragraphs)).otherwise(F.array().cast("array<struct<unit:int,index:int,bigrams:array<string>>>")),
        F.when(F.size(lines) > 1, units(2, lines)).otherwise(F.array().cast("array<struct<unit:int,index:int,bigrams:array<string>>>")),
    )
    span = max(clauses.values(), default=1)

    def runs(parts: Column) -> Column:
        # a run has the bigrams of each of its paragraphs, so none of them may have too many
        told = F.transform(parts, lambda p: F.transform(F.array(words(p)), lambda w: F.struct(w.alias("words"), F.when(F.size(w) >= 2, F.size(bigrams(w))).otherwise(0).alias("n")))[0])

        def run(all_: Column, k: int) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(all_) - k), lambda i: ~F.exists(F.slice(all_, i + 1, k), lambda q: q["n"] > most))
            joined = F.transform(starts, lambda i: F.struct(i.alias("index"), F.flatten(F.transform(F.slice(all_, i + 1, k), lambda q: q["words"])).alias("words")))
            kept = F.transform(F.filter(joined, lambda r: F.size(r["words"]) >= 2), lambda r: F.struct(F.lit(k + 1).alias("unit"), r["index"].alias("index"), bigrams(r["words"]).alias("bigrams")))
            return F.when(F.size(all_) > k, kept).otherwise(F.array().cast("array<struct<unit:int,index:int,bigrams:array<string>>>"))

        return F.transform(F.array(told), lambda all_: F.concat(*(run(all_, k) for k in range(2, span + 1))))[0]

    if span > 1:
        none = F.array().cast("array<struct<unit:int,index:int,bigrams:array<string>>>")
        some = F.concat(some, F.when(F.size(paragraphs) > 2, runs(paragraphs)).otherwise(none))
    names = [F.lit("text"), F.lit("paragraph"), F.lit("line"), *(F.lit(f"{k} paragraphs") for k in range(2, span + 1))]
    sized = F.filter(some, lambda u: (F.size(u["bigrams"]) > 0) & (F.size(u["bigrams"]) <= most))

    def compared(u: Column) -> Column:
        near = F.filter(
            table,
            # the most that sizes allow, reckoned like the coefficient itself so that both round alike
            lambda t: (2.0 * F.least(F.size(u["bigrams"]), t["size"]) / (F.size(u["bigrams"]) + t["size"]) >= least)
            # a run of paragraphs is compared with templates that may be set in as many
            & ((u["unit"] < 3) | (t["clauses"] >= u["unit"] - 1)),
        )
        return F.transform(
            near,
            lambda t: F.struct(
                t["template"].alias("template"),
                F.element_at(F.array(*names), u["unit"] + 1).alias("unit"),
                u["index"].cast("long").alias("index"),
                (2.0 * F.size(F.array_intersect(u["bigrams"], t["bigrams"])) / (F.size(u["bigrams"]) + t["size"])).alias("dice"),
            ),
        )

    found = F.filter(F.flatten(F.transform(sized, compared)), lambda m: m["dice"] >= least)
    if not known:
        found = F.array().cast("array<struct<template:string,unit:string,index:bigint,dice:double>>")
    return docs.select(*(F.col(f"`{c}`") for c in kept), found.alias(licenses_col))
