"""Licence texts by known sentences: each normalised sentence maps to an identifier, and the sequence of
identifiers of a document is matched against ordered licence rules.

Sentences end at a line without letters or digits or after ``.``, ``!``, ``?``, ``:`` or ``;`` before white space, so a text may
be wrapped anywhere and stand in comments; normalised is lower case with every run of other characters than ASCII letters and
digits as one space. An unknown sentence is read line by line (titles and one-line references stand without
an end mark); unknown lines are skipped. A rule is a sequence of identifiers that has to occur in this order without
another known one between; rules are tried in their order, an occurrence that an earlier rule covers is
not looked at again, and identifiers that no rule covers are reported as fragments. All of it is SQL
within a row, in time proportional to the text.

Null, empty or wordless text: no identifiers, no licence. Null ids and repeated rows are carried as they
are; a licence that occurs twice is listed once; other columns are ignored; an empty table is empty.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servescope.llm.spans import sql_text

# fixed values: sentences of public licences and notices, normalised
SENTENCES = {
    "apache_ref": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    "apache_use": ("you may not use this file except in compliance with the license",),
    "apache_copy": ("you may obtain a copy of the license at",),
    "apache_asis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
                    "as is basis without warranties or conditions of any kind either express or implied",),
    "apache_see": ("see the license for the specific language governing permissions and limitations under the license",),
    "mit_ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "mit_title": ("mit license", "the mit license", "the mit license mit"),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
                  "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
                  "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
                  "to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit_asis": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
                 "merchantability fitness for a particular purpose and noninfringement",),
    "gpl3_ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3",
                 "released under the gnu general public license version 3"),
    "gpl_grant": ("this program is free software",),
    "gpl_terms3": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
                   "foundation either version 3 of the license or at your option any later version",),
    "gpl_terms2": ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
                   "foundation either version 2 of the license or at your option any later version",),
    "gpl_warranty": ("this program is distributed in the hope that it will be useful but without any warranty",),
    "bsd_redist": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                   "conditions are met",),
    "bsd_endorse": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission",),
    "bsd_asis": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but "
                 "not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "ccbync4_ref": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "licensed under a creative commons attribution "
                    "noncommercial 4 0 international license"),
    "ccbysa4_ref": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"),
    "ccby4_ref": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0"),
    "spdx_mit": ("spdx license identifier mit",),
    "spdx_apache": ("spdx license identifier apache 2 0",),
    "reserved": ("all rights reserved",),
}
# ordered: the first rule that fits an occurrence has it
RULES = (
    ("Apache-2.0", ("apache_ref", "apache_use", "apache_copy", "apache_asis", "apache_see")),
    ("MIT", ("mit_title", "mit_grant", "mit_notice", "mit_asis")),
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("GPL-3.0-or-later", ("gpl_grant", "gpl_terms3", "gpl_warranty")),
    ("GPL-2.0-or-later", ("gpl_grant", "gpl_terms2", "gpl_warranty")),
    ("BSD-3-Clause", ("bsd_redist", "bsd_endorse", "bsd_asis")),
    ("BSD-2-Clause", ("bsd_redist", "bsd_asis")),
    ("Apache-2.0", ("apache_ref",)),
    ("MIT", ("mit_ref",)),
    ("GPL-3.0-only", ("gpl3_ref",)),
    ("CC-BY-NC-4.0", ("ccbync4_ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4_ref",)),
    ("CC-BY-4.0", ("ccby4_ref",)),
    ("MIT", ("spdx_mit",)),
    ("Apache-2.0", ("spdx_apache",)),
    ("all-rights-reserved", ("reserved",)),
)

SENTENCE_END = r"[.!?:;]+(?=[\x20\x09-\x0D]|$)|\n[^a-z0-9\n]*\n"
NO_WORD = r"[^a-z0-9\nE]+"
LINE_BREAK = r"[\x20\n]*\n[\x20\n]*"


def license_rules(docs: DataFrame, sentences: Mapping[str, Sequence[str]] = SENTENCES,
                  rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """``doc_id, sentence_ids, licenses, fragments, n_licenses`` per row of ``docs(doc_id, text)``.

    ``sentence_ids`` are in text order; ``licenses`` and ``fragments`` are distinct, in order of rules and
    of first occurrence. Both tables are parameters of some hundred entries.
    """
    known = "map(" + ", ".join(f"{sql_text(s)}, {sql_text(k)}" for k, v in sentences.items() for s in v) + ")"
    # in lower case an E can stand for the end of a sentence; a line feed is a line break inside one
    ends = f"regexp_replace(lower(t), {sql_text(SENTENCE_END)}, 'E')"
    plain = f"regexp_replace(regexp_replace({ends}, {sql_text(NO_WORD)}, ' '), {sql_text(LINE_BREAK)}, '\\n')"
    lines = f"filter(transform(split(u, '\\n'), s -> element_at({known}, trim(s))), k -> k IS NOT NULL)"
    whole = f"element_at({known}, trim(translate(u, '\\n', ' ')))"
    ids = f"flatten(transform(split({plain}, 'E'), u -> transform(array({whole}), k -> CASE WHEN k IS NULL THEN {lines} ELSE array(k) END)[0]))"
    # a text without any sentence's first words has none
    heads = "|".join(sorted({"[^a-z0-9]+".join(s.split()[:2]) for v in sentences.values() for s in v}))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(
        f"transform(array(coalesce(CAST(text AS STRING), '')), t -> "
        f"CASE WHEN lower(t) RLIKE {sql_text('(?s)' + heads)} THEN {ids} ELSE CAST(array() AS array<string>) END)[0]").alias("__ids"))
    # each rule in turn takes its occurrences out of the sequence
    left = found.withColumn("__left", F.expr("concat(';', array_join(transform(__ids, k -> concat(k, ';')), ';'), ';')"))
    left = left.withColumn("__got", F.expr("CAST(array() AS array<string>)"))
    for name, sequence in rules:
        chain = ";;".join(sequence)
        left = left.select(
            "doc_id", "__ids",
            F.expr(f"CASE WHEN contains(__left, ';{chain};') THEN array_append(__got, {sql_text(name)}) ELSE __got END").alias("__got"),
            F.expr(f"replace(__left, ';{chain};', ';|;')").alias("__left"))
    return left.select(
        "doc_id", F.array_join("__ids", ",").alias("sentence_ids"), F.array_join(F.array_distinct("__got"), ",").alias("licenses"),
        F.expr("array_join(array_distinct(filter(split(__left, ';'), k -> k NOT IN ('', '|'))), ',')").alias("fragments"),
        F.expr("CAST(size(array_distinct(__got)) AS BIGINT)").alias("n_licenses"))
