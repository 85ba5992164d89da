"""License scans, with odd rows."""

import random

from skein.llm import licenses

KIND = "doc_id long, text string, score double, licenses string"


def invented(rng, n):
    return " ".join("".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_every_template_is_found_once_where_it_stands(spark):
    rng, rows, want = random.Random(3), [], {}
    for k, (name, text) in enumerate(licenses.TEMPLATES * 4):
        before = invented(rng, rng.choice((0, 5, 300, 900))) + rng.choice(" \n")
        rows.append((k, before + text + rng.choice(" \n") + invented(rng, rng.choice((0, 200, 900))), None, None))
        want[k] = (name, len(before), len(before) + len(text))
    for r in licenses.scan(spark.createDataFrame(rows, KIND)).collect():
        name, start, end = want[r.doc_id]
        assert r.licenses == [name], r
        (n,) = r.notices
        assert start == n.start and end - 4 <= n.end <= end, (r, want[r.doc_id])
        assert not n.missing and not n.changed and n.coverage == 1


def test_wording_differences_and_what_only_speaks_of_licenses(spark):
    apache, mit = licenses.TEMPLATES[4][1], licenses.TEMPLATES[2][1]
    texts = [
        apache.replace("may not use", "shall not use"),
        "Licensed under the Apache License, Version 1.1.",
        "My driving licence and my fishing license are in the public domain of my wallet.",
        "RELEASED   under the\n MIT license!",
        mit + "\n\n" + apache,
        "Copyright 2020\n" * 3000 + "Licensed under CC BY-NC 4.0.",
        "license" * 5000,
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(k, t, 1.0, "x") for k, t in enumerate(texts)], KIND)).collect()}
    assert got[0].licenses == ["Apache-2.0"] and got[0].notices[0].missing == ["may"] and got[0].notices[0].changed == ["shall"]
    assert not got[1].notices and not got[2].notices and got[2].n_blocks == 1
    assert got[3].licenses == ["MIT"]
    assert got[4].licenses == ["Apache-2.0", "MIT"] and len(got[4].notices) == 2
    assert got[5].licenses == ["CC-BY-NC-4.0"] and not got[6].notices


def test_standard_notices(spark):
    terms = "you can redistribute it and/or modify\nit under the terms of the GNU {} General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
    bsd = licenses.TEMPLATES[16][1] + "\n\n1. Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\nthis list of conditions and the following disclaimer in the documentation\nand/or other materials provided with the distribution.\n\n"
    neither = "3. Neither the name of the copyright holder nor the names of its contributors\nmay be used to endorse or promote products derived from this software without\nspecific prior written permission.\n\n"
    shield = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, ARE DISCLAIMED.'
    texts = {
        "AGPL-3.0": "This program is free software: " + terms.format("Affero", "3"),
        "LGPL-3.0": "This library is free software: " + terms.format("Lesser", "3"),
        "LGPL-2.1": "This library is free software; " + terms.format("Lesser", "2.1"),
        "BSD-2-Clause": bsd + shield,
        "BSD-3-Clause": bsd + neither + shield,
    }
    rows = [(k, "Copyright 2020 A. Body\n\n" + t, None, None) for k, t in enumerate(texts.values())]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, KIND)).collect()}
    assert [got[k] for k in range(len(texts))] == [[name] for name in texts]


def test_licenses_of_odd_rows(spark):
    line = "Released under the MIT License."
    rows = [(None, line, None, None), (1, None, None, None), (2, "", 1.0, None), (3, line, None, "a"), (3, line, None, "a")]
    got = licenses.scan(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r.doc_id or 0, r.n_blocks, tuple(r.licenses)) for r in got) == [(0, 1, ("MIT",)), (1, 0, ()), (2, 0, ()), (3, 1, ("MIT",)), (3, 1, ("MIT",))]
    assert licenses.scan(spark.createDataFrame([], KIND)).count() == 0


def test_identifier_lines_and_headings(spark):
    texts = [
        ("# SPDX-License-Identifier: MIT\nimport os\n", ["MIT"]),
        ("/* SPDX-License-Identifier: LGPL-3.0-or-later */", ["LGPL-3.0"]),
        ("// SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0"]),
        ("// SPDX-License-Identifier: CC-BY-NC-SA-4.0\n\n// SPDX-License-Identifier: CC-BY-4.0", ["CC-BY-4.0", "CC-BY-NC-SA-4.0"]),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation", ["GPL-3.0"]),
        ("Distributed under the MIT license, see the file beside this one.", ["MIT"]),
        ("# SPDX-License-Identifier: GPL-1.0-only", []),
        ("An identifier of a license is what SPDX calls a short name.", []),
        ("Unlike the MIT license, the GNU General Public License is a copyleft license.", []),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([(k, t, None, None) for k, (t, _) in enumerate(texts)], KIND)).collect()}
    assert [got[k] for k in range(len(texts))] == [want for _, want in texts]
