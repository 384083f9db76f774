"""Operator 6: license scans by conditional compression.

Words are runs without white space, in lower case and without punctuation at their
ends. A notice is a template's wording with at most one difference (a word in place
of another, missing or added) for every eight words of the template.

1. A template that may have ``d`` differences is cut into ``d + 1`` parts, one of
   which stands in any such notice word for word; so the index of all parts meets
   every notice. A text with none of the parts' longest words is not read further.
2. What a part points at is a candidate block: as many words as its template, and ``d``
   more on both sides. Which template it came from is forgotten.
3. The block is compressed by itself and with each template as a raw zstandard
   dictionary, and the templates are ranked by the bytes that this saves; those that
   save none go.
4. The exact wording confirms in that order: words of the template that the block lacks
   and words that it has inside the template's wording are differences. A difference
   counts as PENALTY bytes, about what it costs a compressor, so that of two templates
   that save alike the one with the exact wording wins.
5. Of blocks that overlap, the one with the greater saving less its differences stays.

Null and empty texts have no notices; each row is scanned by itself, and a line may
hold several.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantryplan.llm.common import table, text_batches

# The customary wording of licence notices.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-full-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
_WORD = re.compile(r"[^\s]+")
WORDS_PER_DIFFERENCE, PENALTY = 8, 6


def _bare(word: str) -> str:
    return word.lower().strip("\"'.,;:()[]*#/-")


def parts_of(words: list[str]) -> list[tuple[int, tuple[str, ...]]]:
    """Offset and words of the parts of a template, one more than it may have differences."""
    n = len(words) // WORDS_PER_DIFFERENCE + 1
    cuts = [len(words) * i // n for i in range(n + 1)]
    return [(a, tuple(words[a:b])) for a, b in zip(cuts, cuts[1:])]


def rare_words(templates: dict[str, str]) -> list[str]:
    """Of each part its longest word: a text with a notice has one of them at least."""
    parts = (p for t in templates.values() for _, p in parts_of([w for w in map(_bare, t.split()) if w]))
    return sorted({max(p, key=lambda w: (len(w), w)) for p in parts})


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.templates = {k: [w for w in map(_bare, t.split()) if w] for k, t in sorted(templates.items())}
        self.plain = zstandard.ZstdCompressor(level=3)
        self.given = {k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in templates.items()}
        self.parts: dict[tuple[str, str], list] = defaultdict(list)
        for name, words in self.templates.items():
            for offset, part in parts_of(words):
                self.parts[part[:2]].append((part, offset, name))
        self.bags = {k: Counter(t) for k, t in self.templates.items()}
        self.rare = ahocorasick.Automaton()
        for word in rare_words(templates):
            self.rare.add_word(word, word)
        self.rare.make_automaton()
        self.memo: dict[str, tuple | None] = {}

    def wording(self, block: str, name: str) -> tuple[int, int, list[str], int, int] | None:
        """Start and end of the template's wording in the block, the differences inside it, their number and that of equal words."""
        want = self.templates[name]
        found = [(m.start(), m.end(), b) for m in _WORD.finditer(block) if (b := _bare(m[0]))]
        have = [b for _, _, b in found]
        same = [m for m in difflib.SequenceMatcher(None, have, want, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return None
        first, last = same[0].a, same[-1].a + same[-1].size
        changes, cost, a, b = [], 0, first, 0
        for m in same:
            changes += [f"-{w}" for w in want[b : m.b]] + [f"+{w}" for w in have[a : m.a]]
            cost += max(m.b - b, m.a - a)  # a word in place of another counts once
            a, b = m.a + m.size, m.b + m.size
        changes += [f"-{w}" for w in want[b:]]
        return found[first][0], found[last - 1][1], changes, cost + len(want) - b, sum(m.size for m in same)

    def savings(self, block: str) -> list[tuple[int, str]]:
        """Bytes that a block's compressed form loses with each template at hand, most first; templates that save none are left out."""
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        saved = ((alone - len(given.compress(raw)), name) for name, given in self.given.items())
        return sorted((x for x in saved if x[0] > 0), key=lambda x: (-x[0], x[1]))

    def winner(self, block: str) -> tuple | None:
        """Rank (saving less penalties, the smaller the better), template, saving, and what ``wording`` gives, of the confirmed template that ranks first."""
        if block not in self.memo:
            best, bag = None, Counter(b for m in _WORD.finditer(block) if (b := _bare(m[0])))
            for saved, name in self.savings(block):
                if best and -saved > best[0]:  # whatever its wording, it ranks behind
                    break
                allowed = len(self.templates[name]) // WORDS_PER_DIFFERENCE
                if (self.bags[name] - bag).total() > allowed:
                    continue
                found = self.wording(block, name)
                if found and found[3] <= allowed:
                    mine = (PENALTY * found[3] - saved, name, saved, *found)
                    best = min(best, mine, key=lambda x: x[:2]) if best else mine
            if len(self.memo) >= 50_000:
                self.memo.clear()
            self.memo[block] = best
        return self.memo[block]

    def blocks(self, words: list[tuple[int, int, str]]) -> set[tuple[int, int]]:
        """First and last word of every candidate block."""
        bare = [b for _, _, b in words]
        out = set()
        for i, pair in enumerate(zip(bare, bare[1:])):
            for part, offset, name in self.parts.get(pair, ()):
                if tuple(bare[i : i + len(part)]) == part:
                    n = len(self.templates[name])
                    slack = n // WORDS_PER_DIFFERENCE
                    out.add((max(i - offset - slack, 0), min(i - offset + n + slack, len(words)) - 1))
        return out

    def chosen(self, text: str, words: list[tuple[int, int, str]], blocks: set[tuple[int, int]]) -> list[tuple]:
        """Of the blocks' notices those that no better one overlaps; a notice is only held against its neighbours among the ones kept."""
        found = []
        for first, last in blocks:
            at = words[first][0]
            if hit := self.winner(text[at : words[last][1]]):
                rank, name, saved, start, stop, changes, *_ = hit
                found.append((rank, name, at + start, at + stop, saved, changes))
        starts: list[int] = []
        kept: list[tuple] = []
        for _, name, start, stop, saved, changes in sorted(found, key=lambda x: x[:4]):
            i = bisect_left(starts, start)
            if (i == 0 or kept[i - 1][1] <= start) and (i == len(kept) or kept[i][0] >= stop):
                starts.insert(i, start)
                kept.insert(i, (start, stop, name, saved, changes))
        return kept

    def scan(self, text: str | None) -> list[tuple]:
        """(start, end, license, saved bytes, differences) in code points."""
        if not text or next(self.rare.iter(text.lower()), None) is None:
            return []
        words = [(m.start(), m.end(), b) for m in _WORD.finditer(text) if (b := _bare(m[0]))]
        return self.chosen(text, words, self.blocks(words))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, start, stop, license, saved and differences of each notice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            ids, rows = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = scanner.scan(text.as_py())
                ids += [doc] * len(found)
                rows += found
            start, stop, name, saved, changes = map(list, zip(*rows)) if rows else ([], [], [], [], [])
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(start, pa.int64()), "stop": pa.array(stop, pa.int64()), "license": pa.array(name, pa.string()), "saved": pa.array(saved, pa.int64()), "differences": pa.array(changes, pa.list_(pa.string()))})

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.mapInArrow(run, "doc_id long, start long, stop long, license string, saved long, differences array<string>")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return scan(table(spark, sf_dir, "documents"))
