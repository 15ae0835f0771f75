"""A short hit by lines does not switch off the sentences that run over line ends."""

import pytest

pytest.importorskip("prosegrain.llm")
from prosegrain.llm import license_scan
from test_whole_licenses import COPYRIGHT, MARKS, bsd, licenses

GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"


def test_wrapped_beside_a_line(spark):
    texts = [bsd(3, MARKS[0], "\n", 72, COPYRIGHT + "\nAll rights reserved."), "MIT License\n\n" + GPL, "SPDX-License-Identifier: MIT\n\nThis work is licensed under\nCC BY-SA 4.0.\n", "MIT License", GPL]
    assert licenses(spark, texts) == ["BSD-3-Clause,all-rights-reserved", "GPL-3.0,MIT", "CC-BY-SA-4.0,MIT", "MIT", "GPL-3.0"]
    docs = spark.createDataFrame([(1, texts[0])], "doc_id long, text string")
    (r,) = license_scan.license_scan(docs).collect()
    assert r.sentence_ids == "RIGHTS / BSDGRANT BSDSOURCE BSDBINARY BSDNAMES BSDASIS" and r.rules == "BSD-3-Clause:BSDGRANT+BSDSOURCE+BSDBINARY+BSDNAMES+BSDASIS,all-rights-reserved:RIGHTS"


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""
GNU2 = """This {} is free software; you can redistribute it and/or modify
it under the terms of the GNU {} as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"


def test_published_notices(spark):
    cases = {
        APACHE: "Apache-2.0",
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n": "Apache-2.0",
        GNU2.format("program", "General Public License", "2"): "GPL-2.0",
        GNU2.format("library", "Lesser General Public License", "2.1"): "LGPL-2.1",
        GPL.replace("GNU General", "GNU Affero General"): "AGPL-3.0",
        GPL.replace("GNU General", "GNU Lesser General"): "LGPL-3.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright": "GPL-2.0",
        "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007\n": "AGPL-3.0",
        ISC.format(", provided that the above\ncopyright notice and this permission notice appear in all copies"): "ISC",
        ISC.format(""): "0BSD",
        MPL: "MPL-2.0",
        "This is free and unencumbered software released into the public domain.\n": "Unlicense",
        "This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
        "SPDX-License-Identifier: LGPL-2.1-or-later\n": "LGPL-2.1",
        "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "Licensed under the" + " " * 5000 + "MIT License.": "MIT",
        "Licensed under the MIT License, or so they say.": "",
    }
    assert licenses(spark, list(cases)) == list(cases.values())


def test_sql_agrees(spark, tmp_path):
    import duckdb

    from prosegrain.llm.oracle import ORACLE

    texts = [None, "", " \n ", "SPDX-License-Identifier: (MIT AND ISC) OR GPL-2.0 WITH x\nrest", "Licensed under either of MIT license or the ISC license.", bsd(3, MARKS[0], "\n", 72).replace("the copyright holder nor", "Acme Inc. nor"), GPL.replace("This program", "GNU Foo"), APACHE, MPL, GPL, bsd(2, MARKS[1], "\n", 72), "word " * 60_000 + "All rights reserved.", "All rights reserved.\n" + MPL, "no licence. at all", "rights"]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts + texts)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    columns = ["doc_id", "n_sentences", "sentence_ids", "licenses", "rules"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE['op8_license_scan']})").fetchall()
    assert sorted(map(tuple, license_scan.license_scan(docs).select(*columns).collect())) == sorted(want)


def test_every_rule_has_a_sentence_the_gate_lets_in():
    import re

    for rule in license_scan.RULES:
        assert any(all(re.search(license_scan.GATE, s) for s in license_scan.SENTENCES[k]) for k in rule.ids), rule
