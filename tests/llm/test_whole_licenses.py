"""Verbatim BSD texts, with and without line wraps."""

import textwrap

import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm import license_scan

HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
CLAUSES = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DAMAGES.'
COPYRIGHT = "Copyright (c) 2020, A Holder"


def bsd(n, mark, gap, width, top=COPYRIGHT):
    wrap = lambda s: textwrap.fill(s, width, subsequent_indent="   ") if width else s
    items = [wrap(f"{mark(k)} {c}") for k, c in enumerate(CLAUSES[:n], 1)]
    return f"{top}\n\n{wrap(HEAD)}{gap}{gap.join(items)}\n\n{wrap(TAIL)}\n"


def licenses(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licenses for r in license_scan.license_scan(docs).orderBy("doc_id").collect()]


MARKS = [lambda k: f"{k}.", lambda k: "*", lambda k: f"({k})"]


def test_verbatim_bsd(spark):
    cases = [(n, m, gap, w) for n in (2, 3) for m in MARKS for gap in ("\n", "\n\n") for w in (0, 72)]
    assert licenses(spark, [bsd(*c) for c in cases]) == [f"BSD-{c[0]}-Clause" for c in cases]


def test_another_third_clause_is_no_bsd_2(spark):
    text = bsd(3, MARKS[0], "\n", 0).replace("Neither the name of the copyright holder nor", "All papers must cite the copyright holder and")
    assert licenses(spark, [text]) == [""]


@pytest.mark.parametrize("holder", ["the University", "Google Inc.", "Google LLC", "the <ORGANIZATION>", "the Regents of the University of X, Y. Z. Corp.", "Jane Doe"])
@pytest.mark.parametrize("width", [0, 72])
def test_other_holders(spark, holder, width):
    texts = [bsd(3, m, gap, width).replace("the copyright\n   holder", "the copyright holder").replace("the copyright holder nor", f"{holder} nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", who) for m in MARKS for gap in ("\n", "\n\n") for who in ("THE REGENTS AND CONTRIBUTORS", "Jane Doe", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS")]
    assert licenses(spark, texts) == ["BSD-3-Clause"] * len(texts)


GNU = "{} is free software{} you can redistribute it and/or modify it under the terms of the {}License{} as published by the Free Software Foundation{}"


def test_other_programs_and_notices(spark):
    import textwrap

    later = "; either version {} of the License, or (at your option) any later version."
    cases = {}
    for who in ("This program", "GNU Foo", "Foo", "The Foo Library 2"):
        for stop, comma in ((";", ";"), (":", ",")):
            for kind, name in (("GNU General Public ", "GPL"), ("GNU Lesser General Public ", "LGPL"), ("GNU Affero General Public ", "AGPL")):
                for version in {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}[name]:
                    cases[GNU.format(who, stop, kind, "", later.format(version).replace(";", comma, 1))] = f"{name}-{version if '.' in version else version + '.0'}"
        cases[GNU.format(who, ";", "GNU General Public ", " version 2", ".")] = "GPL-2.0"
        cases[GNU.format(who, ":", "GNU General Public ", " version 2", ".")] = "GPL-2.0"
    got = licenses(spark, list(cases) + [textwrap.fill(c, 70) for c in cases])
    assert got == list(cases.values()) * 2


def test_expressions(spark):
    cases = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT", "/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */": "GPL-2.0", "// SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR GPL-2.0-or-later": "BSD-3-Clause,GPL-2.0,MIT",
        "# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR unknown-1.0": "GPL-2.0", "SPDX-License-Identifier: unknown OR other": "", "SPDX-License-Identifier:": "", "x\nSPDX-License-Identifier: ISC\ny": "ISC",
        "Licensed under either of Apache License, Version 2.0 or MIT license": "Apache-2.0,MIT", "Licensed under either of the Apache License 2.0 or the MIT License at your option.": "Apache-2.0,MIT",
        "Licensed under either of\n\n * Apache License, Version 2.0\n   (LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0)\n * MIT license\n   (LICENSE-MIT or http://opensource.org/licenses/MIT)\n\nat your option.": "Apache-2.0,MIT",
        "Licensed under either of two names or none.": "",
    }
    assert licenses(spark, list(cases)) == list(cases.values())
