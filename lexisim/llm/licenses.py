"""License scans: MinHash bands over overlapping text windows, verified by exact containment.

Texts and templates are words (runs of letters, digits and non-ASCII bytes,
A-Z lower-cased) and their shingles of ``SHINGLE`` words. For each size class
of templates, every text is covered by overlapping windows of three half
blocks, one half block apart, so any stretch of up to a block lies whole in
one. A window retrieves the templates that share one of ``BANDS`` MinHash
values with it (bands of one value). A stretch that has ``CONTAINED`` of a
template's shingles makes up at least ``LEAST`` of window and template
together, so it is retrieved with probability ``1 - (1 - LEAST)**BANDS``, over
0.999. Every retrieved window is then verified: a template is found where
``CONTAINED`` or more of its different shingles occur in the window. Templates
below ``SHINGLE`` words are looked up exactly: the whole template among all
stretches of as many words.

Defined cases: null and empty texts have no licenses;
equal texts have equal findings; an empty table gives an empty result; very
long texts are scanned whole, window by window; repeated rows are scanned
each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisim.llm.common import bound_batches, chunks, mix64, span_hashes, text_bytes, word_spans

SHINGLE, CONTAINED = 5, 0.8
#: Least Jaccard similarity of a window and a template whose stretch it holds, and MinHash values compared.
LEAST, BANDS = 0.2, 32

# Public license notices, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
]
# Identifiers whose one-line notice is a template too.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in ("BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")]

_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and the offsets of rows into them."""
    starts, ends, words = word_spans(data, off, _SEPARATES)
    return span_hashes(data, starts, ends, lower=True), words


def stretches(h: np.ndarray, words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all stretches of ``size`` words within a row, in order, and the offsets of rows into them."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(words), np.int64)
    x = np.zeros(n, np.uint64)
    for k in range(size):
        x = mix64(x + h[k : k + n])
    count = np.maximum(np.diff(words) - size + 1, 0)
    edge = np.zeros(len(words), np.int64)
    np.cumsum(count, out=edge[1:])
    row = np.repeat(np.arange(len(count)), count)
    return x[words[row] + np.arange(edge[-1]) - edge[row]], edge


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all that templates can be found by, and the offsets of rows into them: row by row the stretches of SHINGLE words, then the shorter ones."""
    h, words = word_hashes(data, off)
    found = [stretches(h, words, size) for size in range(SHINGLE, 0, -1)]
    rows = [x[edge[r] : edge[r + 1]] for r in range(len(off) - 1) for x, edge in found]
    return np.concatenate([np.zeros(0, np.uint64), *rows]), sum(edge for _, edge in found)


class Index:
    """Templates by size class, with their MinHash values as tables."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.names, self.sets, self.classes, self.short = [], [], {}, {}
        for name, text in templates:
            raw = np.frombuffer(text.encode(), np.uint8)
            h, words = word_hashes(raw, np.array([0, len(raw)]))
            own = np.unique(stretches(h, words, min(SHINGLE, max(1, len(h))))[0])
            if 0 < len(h) < SHINGLE:
                self.short.setdefault(len(h), []).append(len(self.names))
                self.names.append(name)
                self.sets.append(own)
            elif len(own):  # a template without words can't be found
                block = 1
                while block < len(own) / CONTAINED and (block > 1 or len(own) > 1):
                    block *= 2
                self.classes.setdefault(block, []).append(len(self.names))
                self.names.append(name)
                self.sets.append(own)
        rng = np.random.Generator(np.random.PCG64(5))
        self.factors = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.tables = {}
        for block, members in self.classes.items():
            for band, f in enumerate(self.factors):
                low = np.array([(self.sets[t] * f).min() for t in members])
                order = np.argsort(low)
                few = np.zeros(1 << 16, bool)
                few[(low & np.uint64(0xFFFF)).astype(np.int64)] = True
                self.tables[block, band] = low[order], np.array(members)[order], few

    def find_short(self, h: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, template, first and last word within the row) of the short templates among rows of words."""
        for size, members in self.short.items():
            x, edge = stretches(h, words, size)
            for t in members:
                for at in np.flatnonzero(x == self.sets[t][0]).tolist():
                    row = int(np.searchsorted(edge, at, "right")) - 1
                    yield row, t, at - int(edge[row]), at - int(edge[row]) + size - 1

    def find(self, x: np.ndarray, edge: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(row, template, first and last shingle within the row, containment) of what rows of shingles hold."""
        retrieved: set[tuple[int, int, int]] = set()
        if not len(x):
            return []
        sizes = sorted(self.classes)
        for band, f in enumerate(self.factors):
            low, step = x * f, 1
            start = np.arange(len(x))
            for block in sizes:
                half = max(1, block // 2)
                while step < half:  # minima of half blocks, from those of half the size
                    low, start = _paired(low, start, edge)
                    step *= 2
                three = 1 if block == 1 else 3
                own = low
                if three == 3 and len(low) > 1:
                    own = low.copy()
                    row = np.searchsorted(edge, start, "right")
                    for k in (1, 2):
                        same = np.flatnonzero(row[k:] == row[:-k])
                        own[same] = np.minimum(own[same], low[same + k])
                table, members, few = self.tables[block, band]
                maybe = np.flatnonzero(few[(own & np.uint64(0xFFFF)).astype(np.int64)])
                if len(maybe):
                    a, b = np.searchsorted(table, own[maybe], "left"), np.searchsorted(table, own[maybe], "right")
                    for w, i, j in zip(maybe[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                        at = int(start[w])
                        retrieved.update((at, three * half, int(t)) for t in members[i:j])
        found: dict[tuple[int, int], list[list]] = {}
        for at, span, t in sorted(retrieved):
            row = int(np.searchsorted(edge, at, "right")) - 1
            window = x[at : min(at + span, int(edge[row + 1]))]
            inside = np.isin(window, self.sets[t])
            share = len(np.unique(window[inside])) / len(self.sets[t])
            if share >= CONTAINED:
                places = np.flatnonzero(inside) + at - int(edge[row])
                runs = found.setdefault((row, t), [])
                if runs and places[0] <= runs[-1][1]:  # the next window over the same stretch
                    runs[-1] = [runs[-1][0], max(runs[-1][1], int(places[-1])), max(runs[-1][2], share)]
                else:
                    runs.append([int(places[0]), int(places[-1]), share])
        return [(row, t, *run) for (row, t), runs in found.items() for run in runs]


def _paired(low: np.ndarray, start: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of two neighbours each; rows are paired from their own start."""
    row = np.searchsorted(edge, start, "right") - 1
    first = np.searchsorted(row, np.arange(len(edge) - 1))
    even = (np.arange(len(low)) - first[row]) % 2 == 0
    at = np.flatnonzero(even)
    out = low[at]
    twin = at + 1 < len(low)
    twin[twin] = row[at[twin] + 1] == row[at[twin]]
    out[twin] = np.minimum(out[twin], low[at[twin] + 1])
    return out, start[at]


_OUT = "doc_id long, n_licenses int, licenses string, spans array<struct<license:string,first_word:int,last_word:int,containment:double>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_licenses, licenses (different identifiers, in order, by comma) and spans of each row of ``docs``.

    Spans count words from 0. The templates are a short list of the program, sent to the executors with it.
    """
    bound_batches(docs.sparkSession)
    listed = TEMPLATES if templates is None else templates
    span = pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(listed)
        for whole in batches:
            for batch in chunks(whole):
                data, off = text_bytes(batch.column(1))
                spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                h, words = word_hashes(data, off)
                for row, t, first, last in index.find_short(h, words):
                    spans[row].append({"license": index.names[t], "first_word": first, "last_word": last, "containment": 1.0})
                for row, t, first, last, share in index.find(*stretches(h, words)):
                    spans[row].append({"license": index.names[t], "first_word": first, "last_word": last + SHINGLE - 1, "containment": share})
                spans = [sorted(s, key=lambda x: (x["first_word"], x["last_word"], x["license"])) for s in spans]
                names = [sorted({x["license"] for x in s}) for s in spans]
                columns = [batch.column(0), pa.array([len(n) for n in names], pa.int32()), pa.array([",".join(n) for n in names], pa.string()), pa.array(spans, pa.list_(span))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_licenses", "licenses", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)
