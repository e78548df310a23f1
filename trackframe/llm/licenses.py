"""Licence scans by sentence rules; DataFrame and SQL operations only.

Each sentence of a text is normalised and looked up among known licence sentences; the identifiers found,
in order, are matched against ordered rules, most specific first. A line break inside a paragraph is white
space, so that wrapped headers are read; a line that is a known sentence by itself stands for itself. Sentences that differ
from a known one by a name or number (whose names may not be used to endorse, what is licensed under a licence, the number of a
clause) are normalised to it. Every rule of a licence with versions demands one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CC = "this work is licensed under a creative commons {} license"
_HOPE = "this {} is distributed in the hope that it will be useful but without any warranty"
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
#: Kinds of GNU licences as their notices name them, and their versions.
GNU = {"gpl": ("general public license", ("2", "3")), "lgpl": ("lesser general public license", ("2 1", "3")), "agpl": ("affero general public license", ("3",))}
#: Names of licences that texts are said to be under -> identifier.
NAMES = {
    "mit license": "mit-name", "apache license version 2 0": "apache-name", "apache license v2 0": "apache-name", "apache license 2 0": "apache-name", "apache 2 0 license": "apache-name",
    "gnu general public license version 2": "gpl2-name", "gnu general public license v2 0": "gpl2-name", "gnu general public license version 3": "gpl3-name", "gnu general public license v3 0": "gpl3-name",
    "gnu lesser general public license version 2 1": "lgpl2.1-name", "gnu lesser general public license version 3": "lgpl3-name", "gnu affero general public license version 3": "agpl3-name",
    "bsd 3 clause license": "bsd3-name", "3 clause bsd license": "bsd3-name", "bsd 2 clause license": "bsd2-name", "2 clause bsd license": "bsd2-name", "bsd license": "bsd-name",
    "mozilla public license version 2 0": "mpl-name", "mozilla public license 2 0": "mpl-name", "isc license": "isc-name", "boost software license version 1 0": "boost-name",
    "eclipse public license version 2 0": "epl-name", "eclipse public license 2 0": "epl-name", "zlib license": "zlib-name",
}
#: A tag, behind which the colon ends no sentence; names that follow it, their identifier is spdx-<name>.
TAG = "SPDX-License-Identifier"
TAGGED = ["mit", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "gpl 2 0 only", "gpl 2 0 or later", "gpl 2 0", "gpl 3 0 only", "gpl 3 0 or later", "gpl 3 0", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "mpl 2 0", "isc", "zlib", "bsl 1 0", "epl 2 0", "unlicense", "cc0 1 0"]
#: Kinds of Creative Commons licences -> name and class; the versions, with what stands behind them.
CC = {"by": ("attribution", "permissive"), "by-sa": ("attribution sharealike", "copyleft"), "by-nd": ("attribution noderivatives", "no-derivatives"), "by-nc": ("attribution noncommercial", "non-commercial"), "by-nc-sa": ("attribution noncommercial sharealike", "non-commercial"), "by-nc-nd": ("attribution noncommercial noderivatives", "non-commercial")}
CC_VERSIONS = {"3.0": "3 0 unported", "4.0": "4 0 international"}


def _gnu_sentences() -> dict[str, str]:
    """The sentences of GNU notices: with no version (<kind>-terms), 'or later' (<kind><version>-terms) and one version only (<kind><version>-only)."""
    out = {}
    for kind, (name, versions) in GNU.items():
        for terms in ("terms", "terms and conditions"):
            free, by = f"you can redistribute it and or modify it under the {terms} of the gnu {name}", "as published by the free software foundation"
            out[f"{free} {by}"] = f"{kind}-terms"
            for v in versions:
                short = v.replace(" ", ".")
                out[f"{free} {by} either version {v} of the license or at your option any later version"] = f"{kind}{short}-terms"
                out[f"{free} {by} version {v} of the license"] = out[f"{free} version {v} {by}"] = out[f"{free} version {v} only {by}"] = f"{kind}{short}-only"
        out[f"see the gnu {name} for more details"] = f"{kind}-details"
        out[f"you should have received a copy of the gnu {name} along with this program"] = f"{kind}-copy"
    for v in ("2", "2 1", "3"):
        out[f"either version {v} of the license or at your option any later version"] = f"gnu-{v.replace(' ', '.')}"
        out[f"version {v} of the license"] = f"gnu-{v.replace(' ', '.')}-only"
    return out


def _cc_sentences() -> dict[str, str]:
    out = {}
    for kind, (name, _) in CC.items():
        for v, long in CC_VERSIONS.items():
            short = f"cc {kind.replace('-', ' ')} {v.replace('.', ' ')}"
            out |= {f"licensed under {short}": f"{kind}-{v}-name", f"licensed under {short} license": f"{kind}-{v}-name", _CC.format(f"{name} {long}"): f"{kind}-{v}-name"}
    return out


#: Normalised licence sentence (lower case, letters and digits, single spaces) -> identifier.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-name",
    "licensed under the apache license version 2 0 the license": "apache-name",
    "apache license version 2 0 january 2004": "apache-title",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache-title",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-limits",
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    "the mit license": "mit-name",
    "the mit license mit": "mit-name",
    "mit license": "mit-name",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "as-is",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liable",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "this program is free software": "gnu-free",
    "this library is free software": "gnu-free",
    _HOPE.format("program"): "gnu-hope",
    _HOPE.format("library"): "gnu-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-implied",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "boost software license version 1 0 august 17th 2003": "boost-title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-terms",
    "all rights reserved": "rights",
    f"neither the name of the copyright holder nor the names of its contributors {_ENDORSE}": "bsd-endorse",
    f"nor the names of its contributors {_ENDORSE}": "bsd-endorse",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl2.1-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
}
SENTENCES |= {f"licensed under {name}": i for name, i in NAMES.items()} | {f"this work is licensed under the {name}": i for name, i in NAMES.items()}
SENTENCES |= {name: i for name, i in NAMES.items() if i in ("bsd3-name", "bsd2-name", "isc-name", "mpl-name", "zlib-name")}  # titles of their texts
SENTENCES |= _gnu_sentences() | _cc_sentences() | {f"spdx license identifier {name}": f"spdx-{name.replace(' ', '-')}" for name in TAGGED}


def _gnu_rules() -> list[tuple[str, str, list[str]]]:
    """One version only before 'or later'. A version apart from its terms must follow them at once: of two notices, none lends the other its version."""
    shown = {("gpl", "3"): "gpl-3.0-header"}
    out = []
    for kind in ("agpl", "lgpl", "gpl"):
        for v in (x.replace(" ", ".") for x in GNU[kind][1]):
            name = f"{kind}-{v if '.' in v else v + '.0'}"
            out += [(f"{name}-only", "copyleft", [f"{kind}{v}-only"]), (f"{name}-only", "copyleft", [f"{kind}-terms  gnu-{v}-only"])]
            out += [(shown.get((kind, v), name), "copyleft", [f"{kind}{v}-terms"]), (shown.get((kind, v), name), "copyleft", [f"{kind}-terms  gnu-{v}"])]
    return out


def _tag_rules() -> list[tuple[str, str, list[str]]]:
    shown = {"gpl-3.0-or-later": "gpl-3.0", "gpl-2.0-or-later": "gpl-2.0", "lgpl-2.1-or-later": "lgpl-2.1", "lgpl-3.0-or-later": "lgpl-3.0", "agpl-3.0-or-later": "agpl-3.0", "bsl-1.0": "boost-1.0"}
    kind = lambda n: "copyleft" if n[:3] in ("gpl", "lgp", "agp", "mpl", "epl") else "public-domain" if n[:3] in ("unl", "cc0") else "permissive"
    dotted = {name: "-".join(name.split()).replace("-0", ".0").replace("2-1", "2.1") for name in TAGGED}
    return [(shown.get(n, n), kind(n), [f"spdx-{name.replace(' ', '-')}"]) for name, n in dotted.items()]


#: Ordered rules: (licence, class, identifiers that must come in this order; two spaces: one right after the other).
RULES = [
    ("apache-2.0-header", "permissive", ["apache-name", "apache-use", "apache-copy", "apache-limits"]),
    ("mit-text", "permissive", ["mit-grant", "mit-notice", "as-is"]),
    ("bsd-3-clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-2-clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    *_gnu_rules(),
    ("mpl-2.0", "copyleft", ["mpl-terms", "mpl-2"]),
    ("isc", "permissive", ["isc-grant"]),
    ("zlib", "permissive", ["zlib-as-is", "zlib-grant"]),
    ("boost-1.0", "permissive", ["boost-title"]),
    ("epl-2.0", "copyleft", ["epl-terms"]),
    ("unlicense", "public-domain", ["unlicense"]),
    *_tag_rules(),
    ("apache-2.0", "permissive", ["apache-name"]),
    ("apache-2.0", "permissive", ["apache-title"]),
    ("mit", "permissive", ["mit-name"]),
    ("mit", "permissive", ["mit-grant"]),
    *((lic, "copyleft", [f"{i}-{end}"]) for lic, i in (("gpl-3.0", "gpl3"), ("gpl-2.0", "gpl2"), ("lgpl-3.0", "lgpl3"), ("lgpl-2.1", "lgpl2.1"), ("agpl-3.0", "agpl3")) for end in ("name", "title")),
    ("mpl-2.0", "copyleft", ["mpl-name"]),
    ("epl-2.0", "copyleft", ["epl-name"]),
    ("isc", "permissive", ["isc-name"]),
    ("zlib", "permissive", ["zlib-name"]),
    ("boost-1.0", "permissive", ["boost-name"]),
    ("bsd-3-clause", "permissive", ["bsd3-name"]),
    ("bsd-2-clause", "permissive", ["bsd2-name"]),
    *((f"cc-{kind}-{v}", cls, [f"{kind}-{v}-name"]) for kind, (_, cls) in reversed(CC.items()) for v in CC_VERSIONS),
    ("bsd", "permissive", ["bsd-name"]),
    ("bsd", "permissive", ["bsd-grant"]),
    ("proprietary", "restricted", ["rights"]),
]
#: Licences that the text of another holds, and that are not listed beside it.
PART_OF = {"mit": ["mit-text"], "bsd-2-clause": ["bsd-3-clause"], "bsd": ["bsd-3-clause", "bsd-2-clause"]} | {f"{k}-{v}": [f"{k}-{v}-only"] for k, v in (("gpl", "2.0"), ("gpl", "3.0"), ("lgpl", "2.1"), ("lgpl", "3.0"), ("agpl", "3.0"))}
#: Every known sentence holds one of these words, so texts without any have no licence sentence.
KEYS = ("licen", "permission", "warranty", "software", "rights", "redistribution", "mozilla", "mpl", "warranties", "endorse")
assert all(any(k in s for k in KEYS) for s in SENTENCES)


def _matched(rule: list[str]) -> str:
    """SQL LIKE pattern of identifiers in this order, others between."""
    return "%" + "%".join(f" {i} " for i in rule) + "%"


def _normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


#: Patterns of sentences that stand for a known one, in both engines' syntax.
_ANY_HOLDER = r"^([0-9]{1,2} )?neither the name of .+ nor the names? of (its|their|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission$"
_NUMBERED = r"^[0-9]{1,2} "
_UNDER = r"^(?:[a-z0-9]+ ){0,8}?(?:licensed|released|distributed|available|published) under (?:the |a |an )?(?:terms of )?(?:the |a )?((?:[a-z0-9]+ ){1,6}?license)((?: version| v)? ?[0-9]{1,2}(?: [0-9]{1,2})?)?"
_HOLDER = f"neither the name of the copyright holder nor the names of its contributors {_ENDORSE}"


def _known(n: Column, known) -> Column:
    """The known sentence that a normalised one is or stands for, else NULL."""
    under = lambda more: F.concat(F.lit("licensed under "), F.regexp_extract(n, _UNDER, 1), F.regexp_extract(n, _UNDER, 2) if more else F.lit(""))
    plain = F.regexp_replace(n, _NUMBERED, "")
    named = F.when(known(under(True)), under(True)).when(known(under(False)), under(False))
    return F.when(known(n), n).when(n.rlike(_ANY_HOLDER), F.lit(_HOLDER)).when(n.rlike(_NUMBERED) & known(plain), plain).when(F.contains(n, F.lit("ed under ")) | F.contains(n, F.lit("able under ")), named)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, license, license_class, licenses of every row of docs.

    A sentence ends at . ! ? : ; before white space or the text's end, at a blank line, and at the ends of a line or part
    of one that is a known sentence by itself; other line ends are white space. sentence_ids are the known ones in
    text order, space-joined ('' for none). licenses are all whose rules match, in the rules' order, space-joined, but for
    those that are part of another that does (PART_OF); license is the first, NULL for none: of rules that tie, the earlier. Null texts have no sentence; repeated rows repeat; a null
    doc_id stays null; other columns are ignored; texts of any length are read whole; an empty table gives
    none. Each row is judged alone, so nothing is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    by_text = F.create_map(*(F.lit(x) for s, i in SENTENCES.items() for x in (s, i)))
    known = lambda s: s.isin(*SENTENCES)
    lines = F.split(F.regexp_replace(F.replace(text, F.lit(f"{TAG}:"), F.lit(f"{TAG} ")), r"[.!?:;](?=[ \t\r\n]|\z)", "\n\n"), "\n")
    may = F.lit(False)
    for k in KEYS:
        may = may | F.contains(F.lower(text), F.lit(k))
    # Lines that are known by themselves are set apart; texts that can hold none need no such step.
    apart = F.transform(lines, lambda x: F.when(_known(_normal(x), known).isNotNull(), F.concat(F.lit("\n"), x, F.lit("\n"))).otherwise(x))
    joined = F.array_join(F.when(may, apart).otherwise(lines), "\n")
    sentences = F.filter(F.split(joined, "\n[ \t\r]*\n"), lambda s: s.rlike("[A-Za-z0-9]"))
    ids = F.transform(F.array_compact(F.transform(F.transform(sentences, _normal), lambda s: _known(s, known))), lambda s: F.element_at(by_text, s))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(sentences).cast("long").alias("n_sentences"), F.when(may, F.array_join(ids, "  ")).otherwise(F.lit("")).alias("ids"))
    spaced = F.concat(F.lit(" "), F.col("ids"), F.lit(" "))
    every = F.array_distinct(F.array_compact(F.array(*(F.when(spaced.like(_matched(rule)), F.lit(lic)) for lic, _, rule in RULES))))
    held = lambda x, e: reduce(or_, ((x == part) & F.arrays_overlap(e, F.array(*map(F.lit, wholes))) for part, wholes in PART_OF.items()))
    every = F.element_at(F.transform(F.array(every), lambda e: F.filter(e, lambda x: ~held(x, e))), 1)
    kind = F.lit(None).cast("string")
    for _, cls, rule in reversed(RULES):
        kind = F.when(spaced.like(_matched(rule)), F.lit(cls)).otherwise(kind)
    return found.select("doc_id", "n_sentences", F.replace("ids", F.lit("  "), F.lit(" ")).alias("sentence_ids"), F.get(every, F.lit(0)).alias("license"), kind.alias("license_class"), F.array_join(every, " ").alias("licenses"))


def _oracle() -> str:
    known = ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items())
    normal = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    under = lambda more: f"'licensed under ' || regexp_extract(n, '{_UNDER}', 1)" + f" || regexp_extract(n, '{_UNDER}', 2)" * more
    stands = (
        f"CASE WHEN m[n] IS NOT NULL THEN n WHEN regexp_matches(n, '{_ANY_HOLDER}') THEN '{_HOLDER}' WHEN regexp_matches(n, '{_NUMBERED}') AND m[regexp_replace(n, '{_NUMBERED}', '')] IS NOT NULL THEN regexp_replace(n, '{_NUMBERED}', '') "
        f"WHEN contains(n, 'ed under ') OR contains(n, 'able under ') THEN CASE WHEN m[{under(True)}] IS NOT NULL THEN {under(True)} WHEN m[{under(False)}] IS NOT NULL THEN {under(False)} END END"
    )
    case = lambda k: "CASE " + " ".join(f"WHEN ' ' || ids || ' ' LIKE '{_matched(r[2])}' THEN '{r[k]}'" for r in RULES) + " END"
    names = list(dict.fromkeys(r[0] for r in RULES))
    hit = lambda name: " OR ".join(f"' ' || ids || ' ' LIKE '{_matched(r[2])}'" for r in RULES if r[0] == name)
    every = ", ".join(f"CASE WHEN {hit(name)} THEN '{name}' END" for name in names)
    part = " OR ".join(f"(x = '{p}' AND list_has_any(e, {wholes}))" for p, wholes in PART_OF.items())
    return f"""
WITH m AS (SELECT map {{{known}}} AS m),
l AS (SELECT doc_id, m, list_transform(string_split(regexp_replace(replace(coalesce(text, ''), '{TAG}:', '{TAG} '), '[.!?:;]([ \t\r\n]|\\z)', chr(10) || chr(10) || '\1', 'g'), chr(10)),
  lambda x: CASE WHEN list_transform([{normal('x')}], lambda n: {stands})[1] IS NOT NULL THEN chr(10) || x || chr(10) ELSE x END) AS l FROM documents, m),
s AS (SELECT doc_id, m, list_filter(string_split_regex(array_to_string(l, chr(10)), '\n[ \t\r]*\n'), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS s FROM l),
k AS (SELECT doc_id, len(s) AS n_sentences, array_to_string(list_filter(list_transform(list_transform(s, lambda x: {normal('x')}), lambda n: m[{stands}]), lambda x: x IS NOT NULL), '  ') AS ids FROM s),
r AS (SELECT *, list_filter([{every}], lambda x: x IS NOT NULL) AS e FROM k)
SELECT doc_id, n_sentences, replace(ids, '  ', ' ') AS sentence_ids, {case(0)} AS license, {case(1)} AS license_class,
  array_to_string(list_filter(e, lambda x: NOT ({part})), ' ') AS licenses FROM r"""


ORACLE = _oracle()
