"""License scans by conditional compression.

Around each license word of a text, a window of words is a candidate, across line breaks and comment marks, as wide as each template needs. It
is compressed with zstandard alone and with the template as a raw dictionary, unless it lacks too many of the template's words; the bytes
saved rank the templates. The winner is then confirmed by exact word differences: template words missing from the window, and words within
the match that the template lacks, after slots such as years and holders are set aside. The words before and after it are searched again.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import Match, SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Whole short licenses and notices of these and longer ones, by SPDX identifier and form. {..} marks a slot for free words.
TEMPLATES = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0-only", "notice", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "notice", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "notice", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "notice", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "notice", "To the extent possible under law, {holder} has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "notice", "All rights reserved."),
    ("Proprietary", "notice", "Copyright {year} {holder}. All rights reserved."),
)
TEMPLATES += tuple((spdx, "identifier", f"SPDX-License-Identifier: {spdx}") for spdx in dict.fromkeys(t[0] for t in TEMPLATES) if spdx != "Proprietary")
#: A window of words is a candidate if it holds one of these, in any case.
GATE = ("licens", "licenc", "copyright", "©", "(c)", "spdx", "redistribut", "permission", "public domain", "free software", "creative commons", "cc by", "cc-by", "cc0", "rights reserved", "lizenz", "derechos reservados", "tous droits", "urheberrecht")
_GATE = re.compile("|".join(map(re.escape, GATE)), re.I)
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_END = re.compile(r"[^\w\s]*")
_IDENTIFIER = "spdx-license-identifier"
#: Least share of the template's words that must be there.
COVERAGE = 0.85
#: High enough that templates which differ in a word save the same to two bytes; at level 3 up to a third was noise.
LEVEL = 12
#: Share and bytes by which a saving may fall short of the best one and still count as equal.
NEAR = (0.1, 3)


@dataclass
class Template:
    spdx: str
    form: str
    words: list[str]
    slots: int
    dictionary: object


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def templates() -> list[Template]:
    out = []
    for spdx, form, text in TEMPLATES:
        plain = re.sub(r"\{\w+\}", " ", text)
        data = zstandard.ZstdCompressionDict(" ".join(_words(plain)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(Template(spdx, form, _words(plain), text.count("{"), zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def differences(template: list[str], block: list[str], most: int | None = None) -> tuple[list[str], list[str], int, int]:
    """(template words missing, block words added within the match, first and last matched block word) by exact alignment. Single runs at
    either end, such as a `the` far off, are left out while more than `most` words are added."""
    pairs = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    if not pairs:
        return list(template), [], 0, 0

    def added(pairs: list[Match]) -> int:
        return pairs[-1].b + pairs[-1].size - pairs[0].b - sum(m.size for m in pairs)

    while most is not None and len(pairs) > 1 and added(pairs) > most:
        pairs = pairs[1:] if pairs[0].size <= pairs[-1].size else pairs[:-1]
    first, last = pairs[0].b, pairs[-1].b + pairs[-1].size
    held = {i for m in pairs for i in range(m.a, m.a + m.size)}
    there = {j for m in pairs for j in range(m.b, m.b + m.size)}
    return [w for i, w in enumerate(template) if i not in held], [block[j] for j in range(first, last) if j not in there], first, last


def best_match(block: str, known: list[Template], plain: zstandard.ZstdCompressor) -> tuple | None:
    """(template, saving, missing, added) of the confirmed winner in a block of text."""
    got = _confirmed(_words(block), None, known, plain)
    return got and got[:4]


def _confirmed(words: list[str], at: int | None, known: list[Template], plain: zstandard.ZstdCompressor) -> tuple | None:
    """(template, saving, missing, added, first, last) of the confirmed winner among the words around words[at], or among all.

    Each template's candidate block holds half as many words again as the template on either side. Templates are ranked by the bytes
    that their dictionary saves on their block; the first whose wording holds wins. Those that save nearly as much (NEAR) say the
    same to the compressor; of these the one with the fewest differences is taken, then the longest, then the first. saving is the
    share of the block."""
    there = set(words)
    ranked, alone = [], {}
    for i, t in enumerate(known):
        if sum(w not in there for w in t.words) > (1 - COVERAGE) * len(t.words):
            continue
        reach = 3 * len(t.words) // 2
        lo, hi = (0, len(words)) if at is None else (max(0, at - reach), min(len(words), at + reach + 1))
        data = " ".join(words[lo:hi]).encode("utf-8", "surrogatepass")
        if (lo, hi) not in alone:
            alone[lo, hi] = len(plain.compress(data))
        ranked.append((len(t.dictionary.compress(data)) - alone[lo, hi], i, lo, hi))
    best, bar = None, 0
    for size, i, lo, hi in sorted(ranked):
        if size >= bar:
            break
        t = known[i]
        most = max(4 * t.slots, len(t.words) // 4)
        missing, added, first, last = differences(t.words, words[lo:hi], most)
        if 1 - len(missing) / len(t.words) < COVERAGE or len(added) > most:
            continue
        found = (t, -size / alone[lo, hi], missing, added, lo + first, lo + last)
        if best is None:
            best, bar = found, min(0, (1 - NEAR[0]) * size + NEAR[1])
        elif (len(missing) + len(added), -len(t.words)) < (len(best[2]) + len(best[3]), -len(best[0].words)):
            best = found
    return best


def licenses_in(text: str | None, known: list[Template], plain: zstandard.ZstdCompressor) -> Iterator[tuple]:
    """(start, template, saving, missing, added, block) of every license that is confirmed in the text. Windows hold half as many words
    again as the longest template on either side of a gate word. Every known identifier of an SPDX line counts."""
    text = text or ""
    low = text.lower()
    if not any(g in low for g in GATE):
        return
    found = list(_WORD.finditer(text))
    if not found:
        return
    words, starts = [m[0].lower() for m in found], [m.start() for m in found]
    gates = sorted({max(0, bisect_right(starts, m.start()) - 1) for m in _GATE.finditer(text)})
    reach = 3 * max(len(t.words) for t in known) // 2
    lines = {t.words[1]: t for t in known if t.form == "identifier"}

    def within(gates: list[int], low: int, high: int) -> Iterator[tuple]:
        i = 0
        while i < len(gates):
            g = gates[i]
            if g < low:
                i += 1
                continue
            lo, hi = max(low, g - reach), min(high, g + reach + 1)
            if words[g] == _IDENTIFIER:
                stop = text.find("\n", starts[g])
                end = bisect_right(starts, stop if stop >= 0 else len(text))
                for j in range(g + 1, min(end, high)):
                    if words[j] in lines:
                        t = lines[words[j]]
                        data = f"{_IDENTIFIER}: {words[j]}".encode()
                        yield starts[g], t, 1 - len(t.dictionary.compress(data)) / len(plain.compress(data)), [], [], text[starts[g] : found[j].end()]
                low, i = min(end, high), i + 1
                continue
            got = _confirmed(words[lo:hi], g - lo, known, plain)
            if not got:
                i += 1
                continue
            t, saving, missing, added, first, last = got
            first, last = lo + first, lo + last
            yield from within([x for x in gates[i:] if x < first], low, first)
            yield starts[first], t, saving, missing, added, text[starts[first] : _END.match(text, found[last - 1].end()).end()]
            low = last

    yield from within(gates, 0, len(words))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, start, license, form, match, saving, missing, added, block) of every confirmed license in docs(doc_id, text).

    match is `exact` if no word differs, else `modified`; missing and added hold the words that differ. One row for each license that
    a text names, however many stand side by side; texts that are null, empty or without a license give none; repeated rows give
    their rows again. block is the text of the match, start its place in characters from 0.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates()
        plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        names = ["doc_id", "start", "license", "form", "match", "saving", "missing", "added", "block"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0), b.column(1)):
                for start, t, saving, missing, added, block in licenses_in(text.as_py(), known, plain):
                    rows.append((doc.as_py(), start, t.spdx, t.form, "modified" if missing or added else "exact", saving, missing, added, block))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, start long, license string, form string, match string, saving double, missing array<string>, added array<string>, block string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
