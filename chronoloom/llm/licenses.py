"""Licence scans by sentences: known licence sentences become identifiers, and the sequence of a
text's identifiers is matched against ordered rules.

Marks of comments (#, //, /* */, *, --, ;, %, <!-- -->, dnl, rem) at the ends of lines go first, so
that headers of source files read like plain texts. A text is cut into sentences at line ends and at
. ! ? before white space, after lines that were wrapped are joined again (a lower-case letter or
comma before, a lower-case letter after; a word such as "the" or "of" before, a capital or quote
after; a lower-case letter before, a word of licence names after; or capitals on both sides). A sentence is normalised to its lower-case letters and digits with
single spaces; marks of a list before it ("1. ", "(a) ", "iv) ") are no sentences and no part of it,
and the name of a holder in "neither the name of ..." becomes the general one. Unknown sentences have
identifier 0, and break a sequence. Of each licence the first of its rules whose identifiers occur in
a row gives the kind of match, fullest first.

All of it runs in the JVM; one narrow stage without a shuffle.

Defined results: a null or empty text has no identifiers and no licences ('' each). Repeated
sentences count each time. Every row gets a row, repeated ones and null doc_ids too; doc_id may be of
any type; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
#: identifier -> normalised sentence
SENTENCES = {
    1: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    2: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    3: _WARRANTY,
    4: "released under the mit license",
    5: "licensed under the mit license",
    6: "this project is licensed under the mit license",
    7: "mit license",
    10: "licensed under the apache license version 2 0 the license",
    11: "you may not use this file except in compliance with the license",
    12: "you may obtain a copy of the license at",
    13: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    14: "see the license for the specific language governing permissions and limitations under the license",
    15: "licensed under the apache license version 2 0",
    16: "released under the apache license version 2 0",
    20: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    21: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    22: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    23: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    24: "released under the bsd license",
    25: "licensed under the bsd 3 clause license",
    26: "licensed under the bsd 2 clause license",
    30: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    31: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    32: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    33: "see the gnu general public license for more details",
    34: "this work is licensed under the gnu general public license version 3",
    35: "this work is licensed under the gnu general public license version 2",
    36: "licensed under the gnu general public license version 3",
    40: "licensed under cc by nc 4 0",
    41: "licensed under cc by 4 0",
    42: "licensed under cc by sa 4 0",
    43: "this work is licensed under a creative commons attribution 4 0 international license",
    44: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    50: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    60: "this is free and unencumbered software released into the public domain",
    61: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    70: "this source code form is subject to the terms of the mozilla public license v 2 0",
    71: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    72: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    73: "mozilla public license version 2 0",
    80: "all rights reserved",
    90: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    91: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    92: "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    93: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    94: "see the gnu lesser general public license for more details",
    95: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    96: "see the gnu affero general public license for more details",
    97: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3",
    98: "gnu general public license",
    99: "version 3 29 june 2007",
    100: "version 2 june 1991",
    101: "gnu lesser general public license",
    102: "version 2 1 february 1999",
    103: "gnu affero general public license",
    104: "version 3 19 november 2007",
    105: "apache license",
    106: "version 2 0 january 2004",
    107: "terms and conditions for use reproduction and distribution",
    110: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    111: "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which is available at https www eclipse org legal epl 2 0",
    112: "eclipse public license v 2 0",
    113: "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    120: "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    121: "creative commons legal code",
    122: "cc0 1 0 universal",
    123: "licensed under cc0 1 0",
    130: "this software is provided as is without any express or implied warranty",
    131: "in no event will the authors be held liable for any damages arising from the use of this software",
    132: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    133: "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    140: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    141: "boost software license version 1 0",
    142: "distributed under the boost software license version 1 0",
    150: "do what the fuck you want to public license",
    160: "bsd 3 clause license",
    161: "bsd 2 clause license simplified",
    162: "isc license",
    163: "the mit license mit",
    164: "the mit license",
    165: "use of this source code is governed by a bsd style license that can be found in the license file",
    166: "licensed under the gnu general public license version 2",
}
#: Names in tags of the form "SPDX-License-Identifier: name".
TAGS = [
    "0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
]
FIRST_TAG = 200
SENTENCES |= {FIRST_TAG + i: "spdx license identifier " + t.lower().replace("-", " ").replace(".", " ") for i, t in enumerate(TAGS)}
_RULES = {
    "0BSD": [],
    "AGPL-3.0": [("text", (103, 104)), ("notice", (95, 32, 96)), ("notice", (95,)), ("notice", (97,))],
    "Apache-2.0": [("text", (105, 106)), ("notice", (10, 11, 12)), ("notice", (10, 11)), ("terms", (13, 14)), ("reference", (15,)), ("reference", (16,)), ("reference", (10,))],
    "BSD": [("reference", (24,)), ("reference", (165,))],
    "BSD-2-Clause": [("text", (20, 21, 22)), ("reference", (26,)), ("reference", (161,))],
    "BSD-3-Clause": [("text", (20, 21, 22, 23)), ("reference", (25,)), ("reference", (160,))],
    "BSL-1.0": [("text", (140,)), ("reference", (142,)), ("reference", (141,))],
    "CC-BY-4.0": [("reference", (41,)), ("reference", (43,))],
    "CC-BY-NC-4.0": [("reference", (40,)), ("reference", (44,))],
    "CC-BY-SA-4.0": [("reference", (42,))],
    "CC0-1.0": [("text", (121, 122)), ("notice", (120,)), ("reference", (123,))],
    "EPL-1.0": [("notice", (113,))],
    "EPL-2.0": [("text", (112,)), ("notice", (110,)), ("notice", (111,))],
    "GPL-2.0": [("text", (98, 100)), ("notice", (31, 32, 33)), ("notice", (31,)), ("reference", (35,)), ("reference", (166,))],
    "GPL-3.0": [("text", (98, 99)), ("notice", (30, 32, 33)), ("notice", (30,)), ("reference", (34,)), ("reference", (36,))],
    "ISC": [("text", (50,)), ("reference", (162,))],
    "LGPL-2.1": [("text", (101, 102)), ("notice", (90, 93, 94)), ("notice", (90,))],
    "LGPL-3.0": [("text", (101, 99)), ("notice", (91, 93, 94)), ("notice", (91,)), ("notice", (92,))],
    "MIT": [("text", (1, 2, 3)), ("text", (1, 2)), ("part", (1,)), ("reference", (4,)), ("reference", (5,)), ("reference", (6,)), ("reference", (7,)), ("reference", (163,)), ("reference", (164,))],
    "MPL-2.0": [("notice", (70, 71)), ("notice", (70, 72)), ("notice", (70,)), ("reference", (73,))],
    "Proprietary": [("reference", (80,))],
    "Unlicense": [("text", (60, 61)), ("text", (60,))],
    "WTFPL": [("text", (150,))],
    "Zlib": [("text", (130, 131, 132)), ("notice", (132,))],
}
#: licence -> rules (kind, identifiers in a row), the fullest first; names in alphabetical order
RULES = {name: [*rules, *(("tag", (FIRST_TAG + i,)) for i, t in enumerate(TAGS) if t.removesuffix("-only").removesuffix("-or-later") == name)] for name, rules in _RULES.items()}

_COMMENT = "(?:#+|/+[*]+|[*]+/|[*]+|//+|--+|;+|%+|<!--|(?:@?rem|REM|dnl)[ \\t])[ \\t]*"
_SMALL = "(?:a|an|and|any|as|at|by|for|from|in|is|of|on|or|the|this|to|under|with)"
#: What is done to a text before it is cut, in order: pattern, what takes its place ($1 and $2 are groups).
STEPS = [
    (f"(?m)^[ \\t]*(?:{_COMMENT})+", ""),
    ("(?m)[ \\t]*(?:[*]+/|-->)[ \\t\\r]*$", ""),
    ("([a-z,])[ \\t]*\\n[ \\t]*([a-z])", "$1 $2"),
    (f"([ \\n(]{_SMALL})[ \\t]*\\n[ \\t]*([A-Z\"'(])", "$1 $2"),
    ("([a-z])[ \\t]*\\n[ \\t]*((?:License|Lesser|Affero|General|Public|Free|Software|Foundation|GNU)[ ,;.])", "$1 $2"),
    ("([A-Z,])[ \\t]*\\n[ \\t]*([A-Z][A-Z])", "$1 $2"),
    # numbers, letters and small Roman numbers of list items
    ("(?m)^[ \\t]*(?:[-+>][ \\t]+)*(?:[(]?(?:[0-9]{1,2}|[A-Za-z]|[ivxIVX]{1,4})[.)]+[ \\t]+)([A-Za-z])", "$1"),
]
HOLDER = ("^neither the name of .* nor the names of its contributors may", "neither the name of the copyright holder nor the names of its contributors may")


def sentences(text):
    """Normalised sentences of a text column, in order."""
    for pattern, put in STEPS:
        text = F.regexp_replace(text, pattern.replace("(?m)", "(?md)"), put)
    cut = F.split(F.regexp_replace(F.lower(text), "[.!?]+([ \\t\\n\\r]|$)", "\n"), "\n")
    plain = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    named = lambda s: F.when(F.startswith(s, F.lit("neither the name of ")), F.regexp_replace(s, *HOLDER)).otherwise(s)
    return F.transform(F.filter(F.transform(cut, plain), lambda s: s != ""), named)


def scan_licenses(docs: DataFrame, catalog: dict = SENTENCES, rules: dict = RULES) -> DataFrame:
    """(doc_id, sequence, licenses, matches) of every row.

    sequence: identifiers in order as <1><2>, a run of unknown sentences as one <0>, '' if none is
    known. licenses: names in order of the alphabet. matches: name:kind likewise.
    """
    known = F.create_map(*[x for i, s in catalog.items() for x in (F.lit(s), F.lit(f"<{i}>"))])
    longest, shortest = max(map(len, catalog.values())), min(map(len, catalog.values()))
    mark = lambda s: F.when(F.length(s).between(shortest, longest), F.coalesce(F.element_at(known, s), F.lit("<0>"))).otherwise("<0>")
    marks = F.array_join(F.transform(sentences(F.coalesce("text", F.lit(""))), mark), "")
    seq = F.regexp_replace(marks, "(<0>)+", "<0>")
    base = docs.select("doc_id", F.when(F.instr(F.replace(seq, F.lit("<0>"), F.lit("")), "<") > 0, seq).otherwise("").alias("sequence"))
    hits = []
    for name, ordered in rules.items():
        hit = F.lit(None).cast("string")
        for kind, ids in reversed(ordered):
            hit = F.when(F.contains("sequence", F.lit("".join(f"<{i}>" for i in ids))), F.lit(f"{name}:{kind}")).otherwise(hit)
        hits.append(hit)
    found = base.withColumn("__hits", F.array_compact(F.array(*hits)))
    return found.select("doc_id", "sequence", F.array_join(F.transform("__hits", lambda x: F.substring_index(x, ":", 1)), ",").alias("licenses"), F.array_join("__hits", ",").alias("matches"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    known = ", ".join(f"('{s}', '<{i}>')" for i, s in SENTENCES.items())
    hits = []
    for name, ordered in RULES.items():
        cases = " ".join(f"WHEN contains(sequence, '{''.join(f'<{i}>' for i in ids)}') THEN '{name}:{kind}'" for kind, ids in ordered)
        hits.append(f"CASE {cases} END")
    text = "coalesce(text, '')"
    for pattern, put in STEPS:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{put.replace('$', chr(92))}', 'g')"
    return f"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, {text} AS t FROM documents),
s AS (
  SELECT r, unnest(string_split(regexp_replace(lower(t), '[.!?]+([ \\t\\n\\r]|$)', chr(10), 'g'), chr(10))) AS s,
    generate_subscripts(string_split(regexp_replace(lower(t), '[.!?]+([ \\t\\n\\r]|$)', chr(10), 'g'), chr(10)), 1) AS i FROM w),
n AS (SELECT r, i, regexp_replace(trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'), ' '), '{HOLDER[0]}', '{HOLDER[1]}') AS s FROM s),
k(s, id) AS (VALUES {known}),
q AS (
  SELECT r, regexp_replace(string_agg(coalesce(k.id, '<0>'), '' ORDER BY i), '(<0>)+', '<0>', 'g') AS seq
  FROM n LEFT JOIN k ON k.s = n.s WHERE n.s <> '' GROUP BY r),
d AS (SELECT w.doc_id, CASE WHEN replace(coalesce(seq, ''), '<0>', '') = '' THEN '' ELSE seq END AS sequence FROM w LEFT JOIN q ON q.r = w.r),
h AS (SELECT doc_id, sequence, list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) AS hits FROM d)
SELECT doc_id, sequence, array_to_string(list_transform(hits, lambda x: split_part(x, ':', 1)), ',') AS licenses, array_to_string(hits, ',') AS matches FROM h
"""


ORACLE_SQL = _oracle()
