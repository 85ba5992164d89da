"""License notices by conditional compression: how much shorter a block gets once a template is known."""

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import text_slices

# The wordings of public licenses' notices, by SPDX name. A license may have several wordings.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Distributed under the terms of the MIT license."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("GPL-2.0", "Licensed under the GPLv2."),
    ("GPL-2.0", "Licensed under the GNU General Public License v2.0."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "Licensed under the GPLv3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License v2.1."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License v3.0."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License v3.0."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
    ("Artistic-2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
]
# Identifiers of the SPDX list, as file headers give them, under the names above.
IDENTIFIERS = [
    ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("ISC", "ISC"), ("Zlib", "Zlib"),
    ("GPL-2.0", "GPL-2.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0", "GPL-3.0-or-later"),
    ("LGPL-2.1", "LGPL-2.1"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"), ("LGPL-3.0", "LGPL-3.0"), ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"),
    ("AGPL-3.0", "AGPL-3.0"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("MPL-2.0", "MPL-2.0"), ("EPL-2.0", "EPL-2.0"), ("BSL-1.0", "BSL-1.0"),
    ("CDDL-1.0", "CDDL-1.0"), ("EUPL-1.2", "EUPL-1.2"), ("Artistic-2.0", "Artistic-2.0"), ("OFL-1.1", "OFL-1.1"), ("WTFPL", "WTFPL"), ("Unlicense", "Unlicense"), ("CC0-1.0", "CC0-1.0"),
    ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("CC-BY-NC-SA-4.0", "CC-BY-NC-SA-4.0"), ("CC-BY-ND-4.0", "CC-BY-ND-4.0"),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {tag}") for name, tag in IDENTIFIERS]
#: A block holds one of these, in lower case. Every template does, too.
KEYS = ("licens", "permission", "redistribut", "copyright", "public domain", "list of conditions", "neither the name")
#: Words that tell licenses apart: a block that lacks one, or has another in its place, isn't of the template.
TELLING = re.compile(r"\d|^(?:mit|apache|gnu|gpl|lgpl|agpl|mpl|epl|bsl|lesser|affero|documentation|mozilla|bsd|by|nc|sa|nd|cc|cc0|attribution|sharealike|noncommercial)$")
TOKEN = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Characters of a block, about; a longer line is cut between words.
BLOCK = 600
#: A block is judged by itself and with so many characters on both sides: a notice may begin in another line than its key is in.
EDGE = 300

FRAME = {"format": zstandard.FORMAT_ZSTD1_MAGICLESS, "write_content_size": False, "write_checksum": False, "write_dict_id": False}


def normal(text: str) -> bytes:
    """What is compressed: lower case, one space between words."""
    return " ".join(text.lower().split()).encode()


class Judge:
    """The templates as raw dictionaries."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        params = zstandard.ZstdCompressionParameters.from_level(19, **FRAME)
        self.plain = zstandard.ZstdCompressor(compression_params=params)
        self.known = []
        for name, text in templates:
            words = TOKEN.findall(text.lower())
            knows = zstandard.ZstdCompressionDict(normal(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            with_it = zstandard.ZstdCompressor(compression_params=params, dict_data=knows)
            most = len(self.plain.compress(normal(text))) - len(with_it.compress(normal(text)))
            self.known.append((name, words, with_it, most))
        self.judged = lru_cache(10_000)(self._judged)

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(bytes saved as a share of what the template saves of itself, template), the largest first."""
        raw = normal(block)
        alone = len(self.plain.compress(raw))
        return sorted((((alone - len(c.compress(raw))) / most, k) for k, (_, _, c, most) in enumerate(self.known)), key=lambda x: (-x[0], x[1]))

    def _judged(self, block: str, least: float, near: float) -> list[tuple]:
        """[(license, reduction, coverage, missing words, changed words, start, end)], one for each notice that the block holds.

        Templates are tried in the order of their reductions; those under `least` aren't. The words of a template are aligned with the
        block's; of the stretch that they span, `near` of the words of both must agree and every telling word. A confirmed
        stretch is taken out of the block, so other notices of the same block are found too.
        """
        at = [(m[0].lower(), m.start(), m.end()) for m in TOKEN.finditer(block)]
        words, ok = [w for w, _, _ in at], []
        for reduction, k in self.ranked(block):
            if reduction < least:
                break
            name, want = self.known[k][:2]
            free = list(words)
            while (hit := aligned(want, free, near)) is not None:
                a, b, covered, missing, changed = hit
                ok.append((covered, len(want), reduction, name, a, b, missing, changed))
                free[a:b] = [""] * (b - a)
        found, used = [], set()
        # the longer wording first: a short notice may be the beginning of a long one
        for covered, size, reduction, name, a, b, missing, changed in sorted(ok, key=lambda x: (-x[0] * x[1], -x[2], x[3], x[4])):
            if used.isdisjoint(range(a, b)):
                used.update(range(a, b))
                found.append((name, round(reduction, 4), round(covered, 4), missing, changed, at[a][1], at[b - 1][2]))
        return sorted(found, key=lambda x: x[5])


def aligned(want: list[str], words: list[str], near: float):
    """(first word, end, share of agreeing words, words of `want` missing, words in their place) of the stretch most like `want`, or None."""
    anchor = SequenceMatcher(None, want, words, autojunk=False).find_longest_match()
    if not anchor.size:
        return None
    slack = max(2, len(want) // 8)
    low, high = max(0, anchor.b - anchor.a - slack), min(len(words), anchor.b - anchor.a + len(want) + slack)
    steps = SequenceMatcher(None, want, words[low:high], autojunk=False).get_opcodes()
    same = [s for s in steps if s[0] == "equal"]
    a, b = low + same[0][3], low + same[-1][4]
    missing = [w for tag, i, j, _, _ in steps if tag in ("replace", "delete") for w in want[i:j]]
    changed = [w for tag, i, j, x, y in steps if tag in ("replace", "insert") and low + x >= a and low + y <= b for w in words[low + x : low + y]]
    agree = len(want) - len(missing)
    if agree < near * max(len(want), b - a) or any(TELLING.search(w) for w in [*missing, *changed]):
        return None
    return a, b, agree / max(len(want), b - a), missing, changed


def blocks(text: str) -> list[tuple[int, int]]:
    """Bounds of candidate blocks: lines (longer ones cut between words, each piece overlapping the next) with a key; such lines with at most one other between join."""
    low = text.lower()
    if not any(k in low for k in KEYS):
        return []
    units = []
    for m in re.finditer(r"[^\n]+", text):
        start, end = m.span()
        while end - start > 3 * BLOCK:
            cut = text.rfind(" ", start + 2 * BLOCK, start + 3 * BLOCK)
            cut = start + 3 * BLOCK if cut < 0 else cut
            units.append((start, cut))
            start = cut - BLOCK
        units.append((start, end))
    found = []
    for k, (start, end) in enumerate(units):
        part = text[start:end].lower()
        if any(x in part for x in KEYS):
            close = found and k - found[-1][2] <= 2
            if close and end - found[-1][0] <= 4 * BLOCK:
                found[-1] = (found[-1][0], end, k)
            else:  # a block that is full hands its last line to the next
                found.append((units[found[-1][2]][0] if close else start, end, k))
    return [(a, b) for a, b, _ in found]


@lru_cache(1)
def the_judge() -> Judge:
    """One for each Python worker."""
    return Judge()


def notices(text: str, least: float, near: float) -> tuple[int, list[dict]]:
    """(candidate blocks, confirmed notices with their place in the text), each once."""
    parts, found = blocks(text), []
    for a, b in [p for a, b in parts for p in ((a, b), (max(0, a - EDGE), min(len(text), b + EDGE)))]:
        for name, reduction, covered, missing, changed, start, end in the_judge().judged(text[a:b], least, near):
            found.append({"license": name, "start": a + start, "end": a + end, "reduction": reduction, "coverage": covered, "missing": missing, "changed": changed})
    kept = []
    for x in sorted(found, key=lambda x: (x["start"], -x["coverage"], -x["end"])):  # several blocks may hold a notice
        if not kept or x["start"] >= kept[-1]["end"]:
            kept.append(x)
        elif x["coverage"] > kept[-1]["coverage"]:
            kept[-1] = x
    return len(parts), kept


NOTICE = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("coverage", pa.float64()), ("missing", pa.list_(pa.string())), ("changed", pa.list_(pa.string()))])


def scan(docs: DataFrame, least: float = 0.2, near: float = 0.85) -> DataFrame:
    """(doc_id, n_blocks, licenses, notices) for each row of docs(doc_id, text): the license notices of its whole text.

    licenses: distinct names in order; notices: each with its characters' bounds, what its template saves of the block's compressed bytes against
    what it saves of its own, the share of agreeing words and the wording's differences. A template is tried at a saving of `least`, confirmed at `near` of the words.
    Defined cases: a null or empty text has no block; a text that only speaks of licenses has blocks, but no notice; repeated
    rows get the same result each; an empty table gives no rows; a null doc_id stays null; other columns are not looked at.
    """

    def run(batches):
        for part in text_slices(batches):
            both = [notices(t or "", least, near) for t in part.column(1).to_pylist()]
            names = [sorted({x["license"] for x in found}) for _, found in both]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array([f for _, f in both], pa.list_(NOTICE))], ["doc_id", "n_blocks", "licenses", "notices"])

    kind = "array<struct<license: string, start: bigint, end: bigint, reduction: double, coverage: double, missing: array<string>, changed: array<string>>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_blocks long, licenses array<string>, notices {kind}")
