"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A text's words (letters and digits, lower-cased) make shingles of five words; a template of fewer words is one shingle
of them all. Templates of a level have up to W / 2 shingles, and windows have W shingles and start every W / 2, so that
an occurrence lies whole in a window. Each of a level's bands is one MinHash: a window that holds 80 % of a template's
shingles has at least the Jaccard similarity J with it, and so many bands are used that (1 - J)^bands is at most
``MISS``. A window and a template that agree in a band are verified by the shingles themselves.

A window can agree with a template only on a shingle that both have, so MinHashes are worked out for the windows that
hold any shingle of the level's templates, and for no others; a table of bits finds these.

Defined cases: a null or empty text has no match; templates without words are left out; repeated rows and equal ids give
rows of their own, told apart by ``row``; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import column, in_small_batches, texts

SHINGLE = 5
CONTAINMENT = 0.8
#: Highest probability that a band structure passes over a window that has a template.
MISS = 1e-6
CHUNK = 2048
MEMO = 400_000
_WORD = re.compile(r"[^\W_]+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash that the table of template shingles looks at.
_TABLE_BITS = 20

# Public notices, headers and texts of licenses.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_GNU = """This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "agpl-3.0-header": _GNU.format(colon=":", name="Affero General Public License", comma=",", version="3"),
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause-license": _BSD_CONDITIONS + _BSD_WARRANTY,
    "bsd-3-clause-license": _BSD_CONDITIONS + _BSD_NAMES + _BSD_WARRANTY,
    "bsl-1.0-license": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "gpl-2.0-header": _GNU.format(colon=";", name="General Public License", comma=";", version="2"),
    "gpl-3.0-header": _GNU.format(colon=":", name="General Public License", comma=",", version="3"),
    "isc-license": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "lgpl-2.1-header": _GNU.format(colon=";", name="Lesser General Public License", comma=";", version="2.1"),
    "lgpl-3.0-header": _GNU.format(colon=":", name="Lesser General Public License", comma=",", version="3"),
    "mit-license": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "zlib-license": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
# Other usual wordings of the short notices.
WORDINGS = {
    "apache-2.0-license": "Licensed under the Apache License 2.0",
    "cc-by-4.0-license": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0-program": "This program is licensed under the GNU General Public License, version 3.",
    "mit-licensed": "Licensed under the MIT License.",
}
TEMPLATES = NOTICES | TEXTS | WORDINGS


def templates_from(folder: str) -> dict[str, str]:
    """Templates from the text files of a folder that the driver can read, such as the whole texts of long licenses, by file name."""
    names = sorted(n for n in os.listdir(folder) if os.path.isfile(os.path.join(folder, n)))
    out = {}
    for name in names:
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            out[name] = f.read()
    return out


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(own: list[str], size: int) -> list[tuple[str, ...]]:
    return [tuple(own[i : i + size]) for i in range(len(own) - size + 1)]


def joined(coded: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes of shingles from their words' hashes, one array for each place in the shingle."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for row in coded:
            out = (out ^ row) * _MULTIPLY
            out ^= out >> np.uint64(29)
    return out


def spot(hashes: np.ndarray) -> np.ndarray:
    """The place of a hash in a table of bits."""
    return hashes >> np.uint64(64 - _TABLE_BITS)


class Level:
    """Templates of like size, with their band values."""

    def __init__(self, size: int, window: int, templates: list[tuple[str, frozenset]], word_hash):
        self.size, self.window, self.stride = size, window, window // 2
        self.templates = templates
        jaccard = min(math.ceil(CONTAINMENT * len(t)) / (window + len(t) - math.ceil(CONTAINMENT * len(t))) for _, t in templates)
        self.bands = math.ceil(math.log(MISS) / math.log(1 - jaccard))
        rng = np.random.default_rng(size * 1000 + window)
        self.factor = rng.integers(0, 1 << 63, (self.bands, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.values, self.table = [], np.zeros(1 << _TABLE_BITS, bool)
        for _, own in templates:
            hashes = joined(np.array([[word_hash(w) for w in s] for s in own], np.uint64).T)
            self.table[spot(hashes)] = True
            self.values.append(self.permuted(hashes).min(1))

    def permuted(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (hashes[None, :] * self.factor) >> np.uint64(16)

    def retrieve(self, hashes: np.ndarray, spots: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first shingle of a window, template) for windows and templates that agree in a band; ``spots``: where a template's shingle may be."""
        n = len(hashes)
        spots = spots[self.table[spot(hashes[spots])]]
        if not len(spots):
            return
        # A window is two blocks of a stride; a text of one block is one window.
        block = np.unique(spots // self.stride)
        last = max(0, -(-n // self.stride) - 2)
        for k in np.unique(np.clip(np.concatenate([block - 1, block]), 0, last)).tolist():
            low = np.full(self.bands, np.iinfo(np.uint64).max, np.uint64)
            for at in range(k * self.stride, min(n, k * self.stride + self.window), CHUNK):
                np.minimum(low, self.permuted(hashes[at : min(n, at + CHUNK, k * self.stride + self.window)]).min(1), out=low)
            for t, own in enumerate(self.values):
                if (low == own).any():
                    yield k * self.stride, t


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.memo: dict[str, int] = {}
        by_level: dict[tuple[int, int], list] = {}
        for name, text in sorted(templates.items()):
            own = words(text)
            if own:
                size = min(SHINGLE, len(own))
                found = frozenset(shingles(own, size))
                window = 2 << (len(found) - 1).bit_length()
                by_level.setdefault((size, window), []).append((name, found))
        self.levels = [Level(*key, own, self.word_hash) for key, own in sorted(by_level.items())]
        self.tables = {size: np.any([level.table for level in self.levels if level.size == size], axis=0) for size in sorted({level.size for level in self.levels})}

    def word_hash(self, word: str) -> int:
        return xxhash.xxh64_intdigest(word.encode())

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, windows that hold it, first word of the first such window, highest containment)."""
        own = words(text)
        if len(self.memo) > MEMO:
            self.memo = {}
        found = list(map(self.memo.get, own))
        if None in found:
            for w in {w for w, h in zip(own, found) if h is None}:
                self.memo[w] = self.word_hash(w)
            found = list(map(self.memo.get, own))
        coded = np.array(found, np.uint64)
        hits: dict[str, list] = {}
        shingled = {}
        for size, table in self.tables.items():
            n = max(0, len(coded) - size + 1)
            hashes = joined([coded[i : i + n] for i in range(size)])
            shingled[size] = hashes, np.flatnonzero(table[spot(hashes)])
        for level in self.levels:
            for at, t in level.retrieve(*shingled[level.size]):
                name, template = level.templates[t]
                here = set(shingles(own[at : at + level.window + level.size - 1], level.size))
                share = len(here & template) / len(template)
                if share >= CONTAINMENT:
                    hits.setdefault(name, []).append((at, share))
        return [(name, len({a for a, _ in h}), min(a for a, _ in h), max(s for _, s in h)) for name, h in sorted(hits.items())]


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template found: row, doc_id, license, windows, first_word, containment.

    ``templates`` (name: text) is a driver-side list of licenses, of a size that does not follow the corpus.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(texts(batch)):
                own = scanner.scan(text)
                at += [i] * len(own)
                rows += own
            names, counts, firsts, shares = zip(*rows) if rows else ((), (), (), ())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "row").take(at), column(batch, "doc_id").take(at), pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64()), pa.array(shares, pa.float64())],
                ["row", "doc_id", "license", "windows", "first_word", "containment"],
            )

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_small_batches(own).mapInArrow(run, f"row long, doc_id {kind}, license string, windows long, first_word long, containment double")
