"""Licence scan by sentence rules.

A text is cut into sentences, each is normalised and looked up among known
licence sentences. The text becomes a sequence of sentence identifiers, ``-``
for a sentence that no licence has; a licence is found where the sequence holds
the identifiers of one of its ordered rules. A rule states how many foreign
sentences may lie between two of its own.

Every text is read twice: by lines, where a line end ends a sentence, and over
line ends, where only a blank line does; the rules see both sequences. The
lookup is in a hashed set, the matching is inside the row: no shuffle, no join,
and copies or a hot source cost nothing extra. DataFrame functions only.

Defined cases: a null or blank text has no sentence and no licence; sentences
of any length are normalised and looked up; repeated rows each get their result;
an empty table gives an empty result; other columns than id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, need

_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_AS_IS = "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_FREE = "this program is free software"
_LATER = "either version {} of the license or at your option any later version"
_NAMES = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_CC = "creative commons attribution{} {} {} license"


def _marked(sentence: str, *after: str, before: tuple[str, ...] = ()) -> tuple[str, ...]:
    """``sentence`` as it is and with the number of a clause before or after it."""
    return (sentence, *[f"{sentence} {x}" for x in after], *[f"{x} {sentence}" for x in before])


# Sentences of public licence texts and notices, normalised (lower case, runs of other
# than letters and digits as one blank). Identifier -> spellings.
SENTENCES: dict[str, tuple[str, ...]] = {
    "APACHEGRANT": ("licensed under the apache license version 2 0 the license",),
    "APACHEFILE": ("you may not use this file except in compliance with the license",),
    "APACHECOPY": ("you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0",
                   "you may obtain a copy of the license at"),
    "APACHETERMS": ("terms and conditions for use reproduction and distribution",),
    "APACHETITLE": ("apache license", "apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"),
    "APACHEDATE": ("version 2 0 january 2004",),
    "MITGRANT": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "MITNOTICE": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "MITASIS": (f"the software is provided as is {_AS_IS}",),
    "BSDGRANT": _marked(_BSD, "1", "a"),  # wrapped, the first clause's number ends the sentence before it
    "BSDSOURCE": _marked(_SOURCE, before=("1", "a")),
    "BSDBOTH": tuple(f"{_BSD} {s}" for s in _marked(_SOURCE, before=("1", "a"))),  # wrapped, with a bullet or a number in brackets
    "BSDBINARY": _marked(_BINARY, before=("2", "b")),
    "BSDNAMES": (_NAMES,),
    "BSDASIS": (_BSD_AS_IS,),
    "ISCGRANT": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "ZEROGRANT": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "ISCASIS": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "ZLIBASIS": ("this software is provided as is without any express or implied warranty",),
    "ZLIBGRANT": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "UNLICENSE": ("this is free and unencumbered software released into the public domain",),
    "MPLFORM": ("this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license version 2 0"),
    "MPLHEAD": ("this source code form is subject to the terms of the mozilla public license v",),  # the abbreviation's full stop ends it
    "TWOZERO": ("2 0",),
    "MPLTITLE": ("mozilla public license version 2 0",),
    "GPLTITLE": ("gnu general public license",),
    "LGPLTITLE": ("gnu lesser general public license",),
    "AGPLTITLE": ("gnu affero general public license",),
    "V2DATE": ("version 2 june 1991",),
    "V21DATE": ("version 2 1 february 1999",),
    "V3DATE": ("version 3 29 june 2007",),
    "AGPLDATE": ("version 3 19 november 2007",),
    "GPLTITLE2": ("gnu general public license version 2 june 1991",),  # over the line end
    "GPLTITLE3": ("gnu general public license version 3 29 june 2007",),
    "LGPLTITLE21": ("gnu lesser general public license version 2 1 february 1999",),
    "LGPLTITLE3": ("gnu lesser general public license version 3 29 june 2007",),
    "AGPLTITLE3": ("gnu affero general public license version 3 19 november 2007",),
    "GNUFREE": (_FREE,),
    "GPLTERMS": (_GNU.format("general public license"),),
    "LGPLTERMS": (_GNU.format("lesser general public license"), _GNU.format("library general public license")),
    "AGPLTERMS": (_GNU.format("affero general public license"),),
    "GPLTERMS2": (_GNU.format("general public license version 2"), _GNU.format("general public license version 2 only")),
    "GPLTERMS3": (_GNU.format("general public license version 3"),),
    "LGPLTERMS21": (_GNU.format("lesser general public license version 2 1"),),
    "EITHER2": ("either version 2 of the license or at your option any later version",),
    "EITHER21": ("either version 2 1 of the license or at your option any later version",),
    "EITHER3": ("either version 3 of the license or at your option any later version",),
    "GPLNOTICE2": (f"{_FREE} {_GNU.format('general public license')} {_LATER.format('2')}",),
    "GPLNOTICE3": (f"{_FREE} {_GNU.format('general public license')} {_LATER.format('3')}",),
    "LGPLNOTICE21": (f"{_FREE} {_GNU.format('lesser general public license')} {_LATER.format('2 1')}",),
    "LGPLNOTICE3": (f"{_FREE} {_GNU.format('lesser general public license')} {_LATER.format('3')}",),
    "AGPLNOTICE3": (f"{_FREE} {_GNU.format('affero general public license')} {_LATER.format('3')}",),
    "GPLONLY2": (f"{_FREE} {_GNU.format('general public license version 2')}",),
    "BOOSTTITLE": ("boost software license version 1 0 august 17th 2003",),
    "BOOSTNOTICE": ("distributed under the boost software license version 1 0",),
    "CCZERO": ("cc0 1 0 universal", "creative commons legal code cc0 1 0 universal"),
    "RIGHTS": ("all rights reserved",),
}
# Names in sentences such as "licensed under the NAME", by licence; normalised.
NAMES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    "MIT": ("mit license",),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license"),
    "ISC": ("isc license",),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "gnu lgpl version 2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lgpl version 3"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu agpl version 3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0"),
    "Unlicense": ("unlicense",),
    "BSL-1.0": ("boost software license version 1 0",),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license v 2 0"),
    "CC0-1.0": ("cc0 1 0",),
}
NAMING = ("licensed under the {}", "released under the {}", "distributed under the {}", "this work is licensed under the {}", "this project is licensed under the {}", "licensed under {}", "this work is licensed under {}")
TITLES = ("apache license version 2 0", "mit license", "the mit license", "isc license", "bsd 2 clause license", "bsd 3 clause license")
CC_KINDS = {"BY": "", "BY-SA": " sharealike", "BY-NC": " noncommercial", "BY-ND": " noderivatives", "BY-NC-SA": " noncommercial sharealike", "BY-NC-ND": " noncommercial noderivatives"}
CC_VERSIONS = {"4.0": "international", "3.0": "unported"}
TAG = "spdx license identifier {}"


def _plain(name: str) -> str:
    return "".join(c if c.isalnum() else " " for c in name.lower())


def _named() -> tuple[dict[str, tuple[str, ...]], dict[str, str]]:
    """Sentences that name a licence, built from the names: (identifier -> spellings, identifier -> licence)."""
    names = {k: v for k, v in NAMES.items()}
    for kind, words in CC_KINDS.items():
        for version, scope in CC_VERSIONS.items():
            names[f"CC-{kind}-{version}"] = (_plain(f"cc {kind} {version}"), _CC.format(words, version.replace(".", " "), scope), "a " + _CC.format(words, version.replace(".", " "), scope))
    spelled, licence = {}, {}
    for k, (name, ways) in enumerate(names.items()):
        tags = [TAG.format(_plain(name))] + [TAG.format(_plain(name + x)) for x in ("-only", "-or-later") if "GPL" in name]
        own = [way.format(w) for w in ways for way in NAMING] + [t for t in TITLES if any(t in (w, "the " + w) for w in ways)] + tags
        spelled[f"NAMED{k}"], licence[f"NAMED{k}"] = tuple(dict.fromkeys(own)), name
    return spelled, licence


NAMED, NAMED_LICENCE = _named()
SENTENCES |= NAMED


class Rule(NamedTuple):
    licence: str
    #: Identifiers in order.
    ids: tuple[str, ...]
    #: Most foreign sentences before each identifier but the first; one number for all, or one for each.
    gap: int | tuple[int, ...] = 2


_LONG = 12  # the clauses of the licence itself
RULES: tuple[Rule, ...] = (
    Rule("Apache-2.0", ("APACHEGRANT", "APACHEFILE", "APACHECOPY")), Rule("Apache-2.0", ("APACHEGRANT",)), Rule("Apache-2.0", ("APACHETITLE", "APACHEDATE", "APACHETERMS")), Rule("Apache-2.0", ("APACHETITLE", "APACHETERMS")),
    Rule("MIT", ("MITGRANT", "MITNOTICE", "MITASIS")), Rule("MIT", ("MITGRANT",)),
    Rule("BSD-3-Clause", ("BSDGRANT", "BSDSOURCE", "BSDBINARY", "BSDNAMES", "BSDASIS"), _LONG), Rule("BSD-3-Clause", ("BSDBOTH", "BSDBINARY", "BSDNAMES", "BSDASIS"), _LONG), Rule("BSD-3-Clause", ("BSDGRANT", "BSDNAMES", "BSDASIS"), _LONG),
    # A sentence between the second clause and the disclaimer would be a third clause.
    Rule("BSD-2-Clause", ("BSDGRANT", "BSDSOURCE", "BSDBINARY", "BSDASIS"), (_LONG, _LONG, 0)), Rule("BSD-2-Clause", ("BSDBOTH", "BSDBINARY", "BSDASIS"), (_LONG, 0)),
    Rule("ISC", ("ISCGRANT", "ISCASIS")), Rule("ISC", ("ISCGRANT",)), Rule("0BSD", ("ZEROGRANT", "ISCASIS")), Rule("Zlib", ("ZLIBASIS", "ZLIBGRANT"), 4), Rule("Unlicense", ("UNLICENSE",)),
    Rule("MPL-2.0", ("MPLFORM",)), Rule("MPL-2.0", ("MPLHEAD", "TWOZERO"), 0), Rule("MPL-2.0", ("MPLTITLE",)),
    Rule("GPL-2.0", ("GPLTITLE", "V2DATE"), 0), Rule("GPL-2.0", ("GPLTITLE2",)), Rule("GPL-2.0", ("GNUFREE", "GPLTERMS", "EITHER2"), 1), Rule("GPL-2.0", ("GPLNOTICE2",)), Rule("GPL-2.0", ("GNUFREE", "GPLTERMS2"), 0), Rule("GPL-2.0", ("GPLONLY2",)), Rule("GPL-3.0", ("GNUFREE", "GPLTERMS3"), 0), Rule("LGPL-2.1", ("GNUFREE", "LGPLTERMS21"), 0), Rule("LGPL-2.1", ("LGPLNOTICE21",)),
    Rule("GPL-3.0", ("GPLTITLE", "V3DATE"), 0), Rule("GPL-3.0", ("GPLTITLE3",)), Rule("GPL-3.0", ("GNUFREE", "GPLTERMS", "EITHER3"), 1), Rule("GPL-3.0", ("GPLNOTICE3",)),
    Rule("LGPL-2.1", ("LGPLTITLE", "V21DATE"), 0), Rule("LGPL-2.1", ("LGPLTITLE21",)), Rule("LGPL-2.1", ("GNUFREE", "LGPLTERMS", "EITHER21"), 1),
    Rule("LGPL-3.0", ("LGPLTITLE", "V3DATE"), 0), Rule("LGPL-3.0", ("LGPLTITLE3",)), Rule("LGPL-3.0", ("GNUFREE", "LGPLTERMS", "EITHER3"), 1), Rule("LGPL-3.0", ("LGPLNOTICE3",)),
    Rule("AGPL-3.0", ("AGPLTITLE", "AGPLDATE"), 0), Rule("AGPL-3.0", ("AGPLTITLE3",)), Rule("AGPL-3.0", ("GNUFREE", "AGPLTERMS", "EITHER3"), 1), Rule("AGPL-3.0", ("AGPLNOTICE3",)),
    Rule("BSL-1.0", ("BOOSTTITLE",)), Rule("BSL-1.0", ("BOOSTNOTICE",)), Rule("CC0-1.0", ("CCZERO",)),
    *[Rule(name, (k,)) for k, name in NAMED_LICENCE.items()],
    Rule("all-rights-reserved", ("RIGHTS",)),
)
#: Ends of sentences: a full stop, question or exclamation mark or semicolon before white space, and line ends.
ENDS = r"[.!?;]+(?:\s|\z)|\n"
#: The same without line ends, for sentences that run over several lines.
WRAPPED_ENDS = r"[.!?;]+(?:\s|\z)|\n\s*\n"
FOREIGN = "-"
# Sentences with a slot for a name, normalised, and the form they are looked up in.
SLOTS = (
    # The name may end in a full stop, which ends a sentence; what follows still tells the clause.
    (r"^(?:(?:3|c|4|d) )?(?:neither the names? of .{1,160}? )?nor the names? of .{1,120}? may be used to endorse or promote products derived from this software without (?:specific )?prior written permission$", _NAMES),
    (r"^this software is provided by .{1,160}? as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed$", _BSD_AS_IS),
    (r"^.{1,80}? is free software( you can redistribute it .*)?$", _FREE + "{1}"),
)
SPDX = "SPDX-License-Identifier:"
#: Parts of an expression: what joins licences, and an exception to the one before it.
SPDX_JOINS, SPDX_EXCEPTION = r"\s+(?:OR|AND|or|and)\s+|[()]", r"\s+(?:WITH|with)\s+[A-Za-z0-9.+-]+"
EITHER_OF, OR, OF_CHOICE = "licensed under either of ", " or ", r"^the | at your option$"
#: Every rule has a sentence with one of these; other texts hold none and need not be read over line ends.
GATE = r"licen[cs]e|software|distribut|released|rights|gnu|\bcc"


def normal(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def lookups(sentence: Column) -> Column:
    """The normalised sentences that a sentence stands for: one, or one for each licence it lists."""

    def one(n: Column) -> Column:
        for pattern, form in SLOTS:
            n = F.when(n.rlike(pattern), F.regexp_replace(n, pattern, form.replace("{1}", "$1"))).otherwise(n)
        return n

    operands = F.split(F.regexp_replace(F.substring_index(sentence, SPDX, -1), SPDX_EXCEPTION, ""), SPDX_JOINS)
    tags = F.transform(F.filter(F.transform(operands, normal), lambda x: x != ""), lambda x: F.concat(F.lit(TAG.format("")), x))
    chosen = lambda n: F.transform(F.split(F.substr(n, F.lit(len(EITHER_OF) + 1)), OR), lambda x: F.concat(F.lit("licensed under the "), F.regexp_replace(x, OF_CHOICE, "")))
    plain = lambda n: F.when(n.startswith(EITHER_OF), chosen(n)).when(n.contains("software"), F.array(one(n))).otherwise(F.array(n))
    return F.when(sentence.contains(SPDX), tags).otherwise(let(normal(sentence), plain))


def sequences(text: Column) -> tuple[Column, Column]:
    """The text by lines, and by sentences that run over line ends: an identifier or ``-`` a sentence, parted by blanks.

    The second is null for a text without words of a licence.
    """
    spelled = [(s, k) for k, all_ in SENTENCES.items() for s in all_]
    names, ids = F.array(*[F.lit(s) for s, _ in spelled]), F.array(*[F.lit(k) for _, k in spelled])

    def code(s: Column) -> Column:  # the few known sentences alone are searched for their identifier
        known = lambda all_: F.filter(all_, lambda n: n.isin([s for s, _ in spelled]))
        named = lambda found: F.array_join(F.transform(found, lambda n: F.get(ids, F.array_position(names, n).cast("int") - 1)), "+")
        return let(known(lookups(s)), lambda k: F.when(F.size(k) > 0, named(k)).otherwise(FOREIGN))

    coded = lambda ends: F.array_join(F.transform(F.filter(F.split(text, ends, -1), lambda s: F.btrim(s) != ""), code), " ")
    return coded(ENDS).alias("by_line"), F.when(F.lower(text).rlike(GATE), coded(WRAPPED_ENDS)).alias("wrapped")


def rule_regex(rule: Rule) -> str:
    gaps = rule.gap if isinstance(rule.gap, tuple) else (rule.gap,) * (len(rule.ids) - 1)
    return r"\b" + rule.ids[0] + "".join(f"(?: {FOREIGN}){{0,{n}}} {k}" for n, k in zip(gaps, rule.ids[1:])) + r"\b"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_sentences (by lines), sentence_ids (known identifiers by lines, then over line ends after ``/``), licenses (sorted, comma-joined), rules."""
    rows = need(docs, id_col, text_col).select(F.col(id_col), *sequences(F.coalesce(F.col(text_col), F.lit(""))))
    n = F.when(F.col("by_line") == "", 0).otherwise(F.size(F.split("by_line", " "))).cast("long")
    # One string for the rules: "/" is neither a sentence nor foreign, so none matches across it.
    seq = rows.select(id_col, n.alias("n_sentences"), F.concat_ws(" / ", "by_line", "wrapped").alias("both"))
    known = F.col("both").rlike("[A-Z]")
    ids = F.array_join(F.filter(F.split("both", " "), lambda x: x != FOREIGN), " ")
    met = F.array_compact(F.array(*[F.when(F.col("both").rlike(rule_regex(r)), F.lit(f"{r.licence}:{'+'.join(r.ids)}")) for r in RULES]))
    seq = seq.select(id_col, "n_sentences", F.when(known, ids).otherwise("").alias("sentence_ids"), F.when(known, met).otherwise(F.array().cast("array<string>")).alias("met"))
    names = F.array_sort(F.array_distinct(F.transform(F.col("met"), lambda x: F.substring_index(x, ":", 1))))
    return seq.select(id_col, "n_sentences", "sentence_ids", F.array_join(names, ",").alias("licenses"), F.array_join("met", ",").alias("rules"))
