"""Operator 3: licence scans by sentence rules, in DataFrame functions alone.

A text is tidied: comment leaders and list marks at the start of lines go, an address on a line of
its own joins the line before it, and the dot of "v. 2.0" goes. Then it is cut into sentences, and
a sentence is normalised to its lower-case ASCII letters and digits, one space between words.
Sentences that a table knows get their identifiers, and a licence is found where the identifiers
of one of its rules stand in order; unknown sentences may stand between them, as may parts
without letters or digits.

A line end may be a wrap or the end of a sentence, so there are two readings: cut at ends of
sentences and line ends, or at ends of sentences and blank lines alone. In a reading the longest
rules take their identifiers first, so a licence that begins like a longer one is found only where
it stands for itself; of a rule and a longer one that only the other reading finds, the longer
counts. Every rule has one of CUES, so texts without CUES are not cut at all. Every row is its own
task's work: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices and texts, as their authors word them.
SENTENCES = {
    1: "Released under the MIT License",
    2: "Licensed under the Apache License, Version 2.0",
    3: "This work is licensed under the GNU General Public License, version 3",
    4: "Licensed under CC BY-NC 4.0",
    5: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    6: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    7: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    8: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    9: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    10: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    11: "See the License for the specific language governing permissions and limitations under the License",
    12: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    13: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    14: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    15: "See the GNU General Public License for more details",
    16: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    17: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    18: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    19: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    20: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    21: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    22: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    23: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    24: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    25: "See the GNU Lesser General Public License for more details",
    26: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    27: "See the GNU Affero General Public License for more details",
    28: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    29: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    30: "This is free and unencumbered software released into the public domain",
    31: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    32: "This software is provided 'as-is', without any express or implied warranty",
    33: "In no event will the authors be held liable for any damages arising from the use of this software",
    34: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    35: "Distributed under the Boost Software License, Version 1.0",
    36: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    37: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    38: "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License",
    39: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    40: "Licensed under the MIT License",
    41: "All advertising materials mentioning features or use of this software must display the following acknowledgement",
}
#: Ordered rules: (licence, identifiers in order).
RULES = [
    ("AGPL-3.0-or-later", (26, 14, 27)),
    ("Apache-2.0", (2,)),
    ("Apache-2.0", (8, 9, 10, 11)),
    ("BSD-2-Clause", (16, 17, 18)),
    ("BSD-3-Clause", (16, 17, 18, 19)),
    ("BSD-4-Clause", (16, 17, 18, 41)),
    ("BSL-1.0", (35,)),
    ("CC-BY-4.0", (20,)),
    ("CC-BY-NC-4.0", (4,)),
    ("CC-BY-NC-4.0", (37,)),
    ("CC-BY-SA-4.0", (36,)),
    ("CC0-1.0", (39,)),
    ("GPL-2.0-only", (29, 14, 15)),
    ("GPL-2.0-or-later", (13, 14, 15)),
    ("GPL-3.0-only", (3,)),
    ("GPL-3.0-or-later", (12, 14, 15)),
    ("ISC", (22,)),
    ("LGPL-2.1-or-later", (23, 24, 25)),
    ("LGPL-3.0-or-later", (28, 14, 25)),
    ("MIT", (1,)),
    ("MIT", (40,)),
    ("MIT", (5, 6, 7)),
    ("MPL-1.1", (38,)),
    ("MPL-2.0", (21,)),
    ("Unlicense", (30, 31)),
    ("Zlib", (32, 33, 34)),
]
#: Every rule's first sentence has one of these in its normal form.
CUES = ("licen", "permi", "warrant", "redistribut", "free software", "public domain")
#: What tidying takes away: (pattern, what stays: a group of it). Patterns without look-around, for either engine.
TIDY = (
    (r"(^|[\r\n])[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+|;+|--+|%+|>+|<!--|dnl[ \t]|rem[ \t])", 1),
    (r"(^|[\r\n])[ \t]*(?:\(?[0-9]{1,2}[.)]|\(?[a-z]\)|-|•)[ \t]+", 1),
    (r"[ \t\r\n]+(https?://)", 1),
    (r"([ \t\r\n]v)\.[ \t\r\n]*([0-9])", 2),
)
#: Ends of sentences: marks before white space, and line ends (LINE) or blank lines (WRAP).
LINE = r"[.!?:;]+[ \t\r\n]+|[\r\n]+"
WRAP = r"[.!?:;]+[ \t\r\n]+|\r?\n[ \t\r]*\n"
OTHER = r"[^a-z0-9]+"


def _kept(groups: int, mark: str, before: str = "") -> str:
    """What stays of a tidied match: its groups; an address gets a space before it, a version one after its letter."""
    return before + " ".join(f"{mark}{i}" for i in range(1, groups + 1))


def _tidied(text: str) -> str:
    out = re.sub(r"[A-Z]+", lambda m: m[0].lower(), text)
    for pattern, groups in TIDY:
        out = re.sub(pattern, _kept(groups, "\\", " " if "http" in pattern else ""), out)
    return out


def _cut(sentence: str) -> list[str]:
    """The normal forms of the parts that the cutting rule makes of a sentence."""
    parts = [re.sub(OTHER, " ", p).strip() for p in re.split(LINE, _tidied(sentence))]
    return [p for p in parts if p]


def _parts() -> dict[str, int]:
    """Normal forms of the parts of the known sentences, with their identifiers."""
    parts: dict[str, int] = {}
    for number, s in SENTENCES.items():
        for k, part in enumerate(_cut(s)):
            parts.setdefault(part, number * 10 + k)
    return parts


PARTS = _parts()
#: Between the identifiers of a rule there may be unknown sentences (a stroke each).
GAP = r"[|]*"


def _pattern(identifiers: tuple[int, ...]) -> str:
    """A rule as a pattern on a sequence of identifiers."""
    return GAP.join(f"<{PARTS[p]}>" for i in identifiers for p in _cut(SENTENCES[i]))


def _ordered() -> list[tuple[str, str]]:
    """(licence, pattern), the rules of most identifiers first."""
    return [(name, _pattern(ids)) for name, ids in sorted(RULES, key=lambda r: (-_pattern(r[1]).count("<"), r[0], r[1]))]


def _yields() -> list[tuple[str, str]]:
    """(shorter, longer): licences whose rule begins another's."""
    return sorted({(a, b) for a, x in RULES for b, y in RULES if a != b and len(x) < len(y) and y[: len(x)] == x})


def _identified(body: Column, boundary: str) -> Column:
    """The known sentences of a tidied text as `<identifier>` each, `|` for an unknown one."""
    table = F.create_map(*[F.lit(x) for p, n in PARTS.items() for x in (p, n)])
    parts = F.filter(F.transform(F.split(body, boundary), lambda s: F.trim(F.regexp_replace(s, OTHER, " "))), lambda s: s != "")
    marked = F.transform(parts, lambda s: F.when(s.isin(*PARTS), F.concat(F.lit("<"), F.element_at(table, s).cast("string"), F.lit(">"))).otherwise(F.lit("|")))
    return F.array_join(marked, "")


def _licences(sequence: Column) -> Column:
    """Licences (names, perhaps repeated) whose rules a sequence has; a rule takes its identifiers from those after it."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern")) for name, pattern in _ordered()])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        fits = F.regexp_like(state["left"], rule["pattern"])
        return F.struct(F.when(fits, F.regexp_replace(state["left"], rule["pattern"], F.lit("|"))).otherwise(state["left"]).alias("left"), F.when(fits, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"))

    found = F.aggregate(rules, start, apply, lambda state: F.array_distinct(state["names"]))
    return F.when(F.contains(sequence, F.lit("<")), found).otherwise(F.array().cast("array<string>"))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_known (known sentence parts, in the reading with more), licenses (distinct, ascending, joined by commas; "" for none), n_licenses, and the kept columns.

    Null or empty text has none; null ids keep their row; repeated rows each give theirs; other
    columns are ignored; a kept one may not have an output's name. Letters are compared in lower
    case; anything but ASCII letters and digits parts words.
    """
    if clash := set(keep) & {"doc_id", "n_known", "licenses", "n_licenses"}:
        raise ValueError(f"kept columns have names of outputs: {sorted(clash)}")
    kept = {c: f"__k{i}" for i, c in enumerate(keep)}
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(body, F.lit(c))
    for pattern, groups in TIDY:
        body = F.regexp_replace(body, pattern, _kept(groups, "$", " " if "http" in pattern else ""))
    read = df.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(k) for c, k in kept.items()], F.when(cue, body).alias("__text"))
    read = read.select("doc_id", *kept.values(), *[F.when(F.col("__text").isNotNull(), _identified(F.col("__text"), cut)).otherwise(F.lit("")).alias(name) for name, cut in (("__a", LINE), ("__b", WRAP))])
    read = read.withColumns({"__x": _licences(F.col("__a")), "__y": _licences(F.col("__b"))})
    names = F.array_union("__x", "__y")
    for short, long in _yields():
        for one, other in (("__x", "__y"), ("__y", "__x")):
            beaten = F.array_contains(one, short) & ~F.array_contains(other, short) & F.array_contains(other, long) & ~F.array_contains(one, long)
            names = F.when(beaten, F.array_remove(names, short)).otherwise(names)
    count = lambda c: F.length(c) - F.length(F.translate(c, "<", ""))
    found = read.select("doc_id", *kept.values(), F.greatest(count("__a"), count("__b")).cast("long").alias("n_known"), F.array_sort(names).alias("__names"))
    return found.select("doc_id", *[F.col(k).alias(c) for c, k in kept.items()], "n_known", F.array_join("__names", ",").alias("licenses"), F.size("__names").cast("long").alias("n_licenses"))


def _sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql(table: str = "documents") -> str:
    """The same scan as DuckDB SQL, which cuts and normalises the known sentences itself."""
    plain = lambda p: p.replace("\\r", "\r").replace("\\n", "\n").replace("\\t", "\t")

    def tidied(column: str) -> str:
        out = f"lower({column})"
        for pattern, groups in TIDY:
            out = f"regexp_replace({out}, {_sql_string(plain(pattern))}, {_sql_string(_kept(groups, chr(92), ' ' if 'http' in pattern else ''))}, 'g')"
        return out

    def cut(rows: str, key: str, boundary: str) -> str:
        return f"SELECT {key}, i, trim(regexp_replace(s, '{OTHER}', ' ', 'g')) AS s FROM (SELECT {key}, unnest(ws) AS s, unnest(range(len(ws))) AS i FROM (SELECT {key}, regexp_split_to_array(t, {_sql_string(plain(boundary))}) AS ws FROM {rows}))"

    rules = sorted(((name, ids) for name, ids in RULES), key=lambda r: (r[0], r[1]))
    sentences = ", ".join(f"({n}, {_sql_string(s)})" for n, s in SENTENCES.items())
    steps = ", ".join(f"({k}, '{name}', {i}, {n})" for k, (name, ids) in enumerate(rules) for i, n in enumerate(ids))
    longest = f"SELECT k, any_value(name) AS name, string_agg('<' || ident || '>', '{GAP}' ORDER BY step, j) AS pattern, count(*) AS size FROM steps JOIN pieces ON pieces.n = steps.n GROUP BY k"
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in _yields())
    return f"""
WITH RECURSIVE sentences(n, sentence) AS (VALUES {sentences}), steps(k, name, step, n) AS (VALUES {steps}), yields(short, long) AS (VALUES {pairs}),
known AS (SELECT n, {tidied("sentence")} AS t FROM sentences),
cut AS (SELECT n, i AS j, s FROM ({cut("known", "n", LINE)}) WHERE s <> ''),
idents AS (SELECT s, min(n * 100 + j) AS ident FROM cut GROUP BY s),
pieces AS (SELECT n, j, ident FROM cut JOIN idents ON idents.s = cut.s),
rules AS (SELECT row_number() OVER (ORDER BY size DESC, k) AS turn, name, pattern FROM ({longest})),
d AS (SELECT row_number() OVER () AS rn, doc_id, text FROM {table}),
body AS (SELECT rn, {tidied("coalesce(text, '')")} AS t FROM d),
parts AS (
  SELECT rn, 'a' AS way, i, p.s, ident FROM ({cut("body", "rn", LINE)}) p LEFT JOIN idents ON idents.s = p.s WHERE p.s <> ''
  UNION ALL SELECT rn, 'b', i, p.s, ident FROM ({cut("body", "rn", WRAP)}) p LEFT JOIN idents ON idents.s = p.s WHERE p.s <> ''
),
marks AS (SELECT rn, way, count(ident) AS n, string_agg(CASE WHEN ident IS NULL THEN '|' ELSE '<' || ident || '>' END, '' ORDER BY i) AS seq FROM parts GROUP BY rn, way),
taken(rn, way, turn, hit, rest) AS (
  SELECT rn, way, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), seq FROM marks WHERE n > 0
  UNION ALL
  SELECT rn, way, rules.turn, CASE WHEN regexp_matches(rest, pattern) THEN name END, regexp_replace(rest, pattern, '|', 'g') FROM taken JOIN rules ON rules.turn = taken.turn + 1
),
hits AS (SELECT DISTINCT rn, way, hit AS name FROM taken WHERE hit IS NOT NULL),
beaten AS (
  SELECT x.rn, x.name FROM hits x JOIN yields ON short = x.name JOIN hits y ON y.rn = x.rn AND y.name = long AND y.way <> x.way
  WHERE NOT EXISTS (SELECT 1 FROM hits z WHERE z.rn = x.rn AND z.name = x.name AND z.way <> x.way) AND NOT EXISTS (SELECT 1 FROM hits z WHERE z.rn = x.rn AND z.name = y.name AND z.way = x.way)
),
names AS (SELECT rn, string_agg(name, ',' ORDER BY name) AS licenses, count(*) AS k FROM (SELECT DISTINCT rn, name FROM hits ANTI JOIN beaten USING (rn, name)) GROUP BY rn)
SELECT d.doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_known, coalesce(licenses, '') AS licenses, CAST(coalesce(k, 0) AS BIGINT) AS n_licenses
FROM d LEFT JOIN (SELECT rn, max(n) AS n FROM marks GROUP BY rn) m ON m.rn = d.rn LEFT JOIN names ON names.rn = d.rn
"""
