"""Licence recognition by sentence rules.

Method: a text is cut into sentences, each normalised (A-Z lower-cased, every
run of other characters than a-z and 0-9 one blank); a sentence that the table
of known licence sentences holds becomes its identifier; the sequence of
identifiers of a document is matched against ordered rules, one or more for a
licence.  Known sentences in a row form a rule's match whatever unknown
sentences stand between.

A text is cut in two ways, by lines and by full stops with line ends as blanks,
since notices stand on lines of their own and licence texts are wrapped; a rule
may match either sequence.  The cut by stops parts some known sentences too:
their parts are known sentences, counted each, with rules of their own.  SPDX
tags are found on lines of their own only.

Only DataFrame operations run.  Sentences are exploded where the text is read
and meet the table of known sentences, of fixed size, in a broadcast join; only
matches are shuffled, by document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences (identifier, sentence).
SENTENCES = (
    ("apache2_notice", "Licensed under the Apache License, Version 2.0."),
    ("apache2_notice_the_license", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("apache2_may_not_use", "you may not use this file except in compliance with the License."),
    ("apache2_obtain", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2_as_is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache2_see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit_notice", "Released under the MIT License."),
    ("mit_notice_licensed", "Licensed under the MIT License."),
    ("mit_title", "The MIT License (MIT)"),
    ("mit_title_short", "MIT License"),
    ("mit_grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit_condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit_as_is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mit_liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd_grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd_source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd_binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd_endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl2_notice", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl3_notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl_redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl_hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl_details", "See the GNU General Public License for more details."),
    ("mpl2_notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2_obtain", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc_by_notice", "Licensed under CC BY 4.0."),
    ("cc_by_sa_notice", "Licensed under CC BY-SA 4.0."),
    ("cc_by_nc_notice", "Licensed under CC BY-NC 4.0."),
    ("cc_by_nd_notice", "Licensed under CC BY-ND 4.0."),
    ("cc_by_nc_sa_notice", "Licensed under CC BY-NC-SA 4.0."),
    ("cc0_notice", "Licensed under CC0 1.0."),
    ("unlicense_domain", "This is free and unencumbered software released into the public domain."),
    ("spdx_mit", "SPDX-License-Identifier: MIT"),
    ("spdx_apache2", "SPDX-License-Identifier: Apache-2.0"),
    ("spdx_bsd3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("spdx_gpl3_only", "SPDX-License-Identifier: GPL-3.0-only"),
    # what the cut by stops makes of sentences with such marks inside; the rest of mpl2_notice, "2.0.", says nothing alone
    ("gpl_free_part", "This program is free software:"),
    ("gpl_redistribute_part", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl_hope_part", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("gpl_implied_part", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mpl2_notice_part", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
)

#: Rules: (licence, identifiers in order).
RULES = (
    ("Apache-2.0", ("apache2_notice",)),
    ("Apache-2.0", ("apache2_notice_the_license", "apache2_may_not_use")),
    ("Apache-2.0", ("apache2_as_is", "apache2_see")),
    ("Apache-2.0", ("spdx_apache2",)),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_notice_licensed",)),
    ("MIT", ("mit_grant", "mit_condition")),
    ("MIT", ("mit_title", "mit_grant")),
    ("MIT", ("mit_title_short", "mit_grant")),
    ("MIT", ("spdx_mit",)),
    ("ISC", ("isc_grant",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-3-Clause", ("spdx_bsd3",)),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("GPL-2.0", ("gpl2_notice",)),
    ("GPL-3.0", ("gpl3_notice",)),
    ("GPL-3.0", ("spdx_gpl3_only",)),
    ("GPL-3.0", ("gpl_redistribute", "gpl_hope", "gpl_details")),
    ("GPL-3.0", ("gpl_free_part", "gpl_redistribute_part", "gpl_hope_part", "gpl_implied_part", "gpl_details")),
    ("MPL-2.0", ("mpl2_notice", "mpl2_obtain")),
    ("MPL-2.0", ("mpl2_notice_part", "mpl2_obtain")),  # the version stands in the second sentence too
    ("CC-BY-4.0", ("cc_by_notice",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_notice",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_notice",)),
    ("CC-BY-ND-4.0", ("cc_by_nd_notice",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa_notice",)),
    ("CC0-1.0", ("cc0_notice",)),
    ("Unlicense", ("unlicense_domain",)),
)
#: A licence whose rule holds another's: where both match, only the first is reported.
COVERS = (("BSD-3-Clause", "BSD-2-Clause"),)

#: Stands between sentences while a text is cut.
MARK = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def normal_text(sentence: str) -> str:
    """``normal`` in plain Python, for the table of known sentences."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(_UPPER, _LOWER))).strip()


def by_lines(text: Column) -> Column:
    return F.split(text, "[\r\n]+")


def by_stops(text: Column) -> Column:
    """Sentences end at blank lines and after one of .!?;: before white space; other line ends are blanks."""
    parts = F.regexp_replace(F.regexp_replace(text, "\n[ \t\r]*\n", MARK), "[ \t\r\n]+", " ")
    return F.split(F.regexp_replace(parts, "([.!?;:]) ", f"$1{MARK}"), MARK)


def known_sentences(docs: DataFrame, id_col: str, text_col: str, known: DataFrame) -> DataFrame:
    """(id, cut, ids): the identifiers of a row's known sentences in order, for each way of cutting that finds any."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cuts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), F.explode(F.array(
        F.struct(F.lit("lines").alias("cut"), by_lines(text).alias("s")), F.struct(F.lit("stops").alias("cut"), by_stops(text).alias("s")))).alias("c"))
    each = cuts.select("id", "tag", "c.cut", F.posexplode("c.s").alias("pos", "sentence")).withColumn("sentence", normal(F.col("sentence")))
    return (each.join(F.broadcast(known), "sentence").groupBy("id", "tag", "cut")
            .agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "sid"))), lambda x: x["sid"]).alias("ids")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: tuple = SENTENCES, rules: tuple = RULES, covers: tuple = COVERS) -> DataFrame:
    """Licences of every row of ``docs``.

    Returns (doc_id, licenses: sorted names, sentence_ids: sorted distinct known
    sentences, n_known: how many known sentences stand in the text, by the way
    of cutting that finds more).

    Edge cases: null and empty texts, and texts without known sentences, have
    empty lists and 0.  Null ids are kept.  Rows with equal id and text have
    equal results.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(normal_text(s), i) for i, s in sentences], "sentence string, sid string")
    found = known_sentences(docs, id_col, text_col, known)
    line = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))
    hits = F.array(*[F.when(F.instr(line, f",{','.join(ids)},") > 0, F.lit(name)) for name, ids in rules])
    per = (found.withColumn("hits", F.array_compact(hits)).groupBy("id", "tag")
           .agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("sids"),
                F.max(F.size("ids")).cast("long").alias("n")))
    names = F.col("names")
    for more, less in covers:
        names = F.when(F.array_contains(names, more), F.array_remove(names, less)).otherwise(names)
    per = per.select(F.col("id").alias("k"), F.col("tag").alias("g"), F.array_sort(names).alias("names"), "sids", "n")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tag"))
    empty = F.array().cast("array<string>")
    return (rows.join(per, F.col("id").eqNullSafe(F.col("k")) & (F.col("tag") == F.col("g")), "left")
            .select(F.col("id").alias(id_col), F.coalesce("names", empty).alias("licenses"), F.coalesce("sids", empty).alias("sentence_ids"),
                    F.coalesce("n", F.lit(0).cast("long")).alias("n_known")))
