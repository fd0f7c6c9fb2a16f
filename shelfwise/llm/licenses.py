"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts are taken as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in lower case, templates as sets of shingles of five words
(a template of fewer words is one shingle). A template occurs where a window of as many words as it has holds at least
``percent`` of its shingles. For retrieval a text is cut into windows of one and a half times a template's length, half a
length apart, so that some window holds any occurrence whole; its similarity to the template is then at least
0.75 / (1.5 + 0.25) = 0.43, and with ``BANDS`` bands of one hash a window misses its template once in 60 million times.
Windows that hold no shingle of any template can be no match and are left out first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import hashes_of, mapped, mixed, shingles_of, slices, texts_of, words_of
from .decontaminate import _TABLE

BANDS = 32
#: Templates in a block, which is broadcast; more templates mean more blocks.
BLOCK_WORDS = 200_000

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Notices that name a license, openings of license texts, and whole texts and headers of the short ones.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("reserved", "All rights reserved."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("bsd", _BSD),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", f"{_GRANT} {_MIT_END}"),
    ("bsd-2-clause", f"{_BSD}: {_BSD_TWO} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD}: {_BSD_TWO} {_BSD_THIRD} {_BSD_END}"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct, counts = words_of(mapped(texts, _TABLE))
    return hashes_of(distinct)[codes], counts


def _seeds() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


class Library:
    """Templates with the same shingle length and number of words: their shingle sets and the bands' minima."""

    def __init__(self, templates: Sequence[tuple[int, np.ndarray]], k: int, n_words: int) -> None:
        self.k, self.n_words = k, n_words
        self.ids = [i for i, _ in templates]
        self.sets = [np.unique(s) for _, s in templates]
        self.known = np.unique(np.concatenate(self.sets))
        self.bands: list[dict[int, list[int]]] = [{} for _ in range(BANDS)]
        for j, s in enumerate(self.sets):
            for b, seed in enumerate(_seeds()):
                self.bands[b].setdefault(int(mixed(s ^ seed).min()), []).append(j)

    def retrieved(self, shingles: np.ndarray) -> set[int]:
        """Templates that share a band with some window of one text that holds a known shingle."""
        at = np.flatnonzero(np.isin(shingles, self.known))
        if not len(at):
            return set()
        span, step = max(1, -(-3 * self.n_words // 2) - self.k + 1), max(1, self.n_words // 2)
        starts = np.unique(np.concatenate([(at // step - j) * step for j in range(-(-span // step) + 1)]))
        starts = starts[(starts >= 0) & (starts < len(shingles))]
        found: set[int] = set()
        for lo in starts.tolist():
            window = shingles[lo : lo + span]
            for b, seed in enumerate(_seeds()):
                found.update(self.bands[b].get(int(mixed(window ^ seed).min()), ()))
            if len(found) == len(self.sets):
                break
        return found

    def best(self, j: int, shingles: np.ndarray, percent: int) -> tuple[int, int, int] | None:
        """Most shingles of template ``j`` in a window of its words, the first such window, and the runs of windows that match."""
        own = self.sets[j]
        width = min(self.n_words - self.k + 1, len(shingles))
        at = np.flatnonzero(np.isin(shingles, own))
        which = np.searchsorted(own, shingles[at])
        # between events the count stays: a shingle comes in at at - width + 1 and goes out at at + 1
        last = len(shingles) - width
        counts = np.zeros(len(own), dtype=np.int64)
        events = sorted([(max(0, a - width + 1), 1, w) for a, w in zip(at.tolist(), which.tolist(), strict=True)] + [(a + 1, 0, w) for a, w in zip(at.tolist(), which.tolist(), strict=True)])
        most = first = runs = distinct = i = 0
        inside = False
        while i < len(events) and events[i][0] <= last:
            place = events[i][0]
            while i < len(events) and events[i][0] == place:
                _, comes, w = events[i]
                counts[w] += 1 if comes else -1
                distinct += int(comes and counts[w] == 1) - int(not comes and counts[w] == 0)
                i += 1
            if distinct > most:
                most, first = distinct, place
            ok = 100 * distinct >= percent * len(own)
            runs += ok and not inside
            inside = ok
        return (most, first, runs) if 100 * most >= percent * len(own) else None


def _scanner(libraries, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = libraries.value
        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                ids = piece.column("doc_id").to_pylist()
                hashes, counts = _words(texts_of(piece.column("text")))
                out: list[tuple] = []
                for k in sorted({x.k for x in every}):
                    mine = [x for x in every if x.k == k]
                    shingles, sizes = shingles_of(hashes, counts, k)
                    ends = np.cumsum(sizes)
                    known = np.unique(np.concatenate([x.known for x in mine]))
                    place = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
                    for r in np.unique(np.searchsorted(ends, np.flatnonzero(known[place] == shingles), side="right")).tolist():
                        if counts[r] < k:
                            continue
                        own = shingles[ends[r] - sizes[r] : ends[r]]
                        for x in mine:
                            for j in sorted(x.retrieved(own)):
                                if (got := x.best(j, own, percent)) is not None:
                                    out.append((ids[r], x.ids[j], len(x.sets[j]), *got))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                names = ["doc_id", "template", "size", "shared", "first_word", "runs"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, *, percent: int = 75, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, license, template, size, shared, first_word, runs`` for each document and template that occurs in it.

    ``template`` is its number in ``templates``, ``size`` its shingles, ``shared`` the most of them in one window,
    ``first_word`` the first window that has so many (from 0), ``runs`` the runs of windows that match. A text of fewer
    words than a template is one window; one of fewer words than a template's shingle matches nothing. Null and empty
    texts and templates match nothing. Rows that repeat an id are documents each. An empty table, or no templates, gives no
    rows. Very long texts are read whole, in a piece of their own. Only ``doc_id`` and ``text`` are read, so other columns may
    have any names.
    """
    spark = docs.sparkSession
    hashes, counts = _words(texts_of(pa.array([t for _, t in templates], pa.string())))
    ends = np.cumsum(counts)
    groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for i, (hi, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
        if n:
            k = min(5, n)
            groups.setdefault((k, n), []).append((i, shingles_of(hashes[hi - n : hi], np.array([n]), k)[0]))
    blocks: list[list[Library]] = [[]]
    held = 0
    for (k, n), own in sorted(groups.items()):
        step = max(1, block_words // n)
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            if held and held + n * len(part) > block_words:
                blocks.append([])
                held = 0
            blocks[-1].append(Library(part, k, n))
            held += n * len(part)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = F.array(*(F.lit(n) for n, _ in templates))
    found = None
    for block in blocks:
        if block:
            part = chosen.mapInArrow(_scanner(spark.sparkContext.broadcast(block), percent), "doc_id long, template long, size long, shared long, first_word long, runs long")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, license string, template long, size long, shared long, first_word long, runs long")
    return found.select("doc_id", F.element_at(names, (F.col("template") + 1).cast("int")).alias("license"), "template", "size", "shared", "first_word", "runs")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH templates(template, license, w) AS (
  SELECT template, license, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM (VALUES {values}) AS t(template, license, text)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (SELECT template, license, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS m, w FROM templates),
own AS (SELECT DISTINCT template, license, k, m, array_to_string(w[i : i + k - 1], ' ') AS s FROM kept, unnest(range(1, m + 1)) AS u(i)),
sized AS (SELECT *, count(*) OVER (PARTITION BY template) AS size FROM own),
lengths AS (SELECT DISTINCT k FROM kept),
places AS (SELECT doc_id, k, i, len(w) - k + 1 AS n, array_to_string(w[i : i + k - 1], ' ') AS s FROM docs, lengths, unnest(range(1, len(w) - k + 2)) AS u(i) WHERE len(w) >= k),
hits AS (SELECT doc_id, template, license, size, i, n, least(m, n) AS width, p.s FROM places p JOIN sized t ON p.s = t.s AND p.k = t.k),
windows AS (
  SELECT doc_id, template, license, size, p, count(DISTINCT s) AS shared
  FROM hits h, unnest(range(greatest(1, h.i - h.width + 1), least(h.i, h.n - h.width + 1) + 1)) AS u(p) GROUP BY ALL),
good AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, template ORDER BY p) AS run FROM windows WHERE 100 * shared >= 75 * size)
SELECT doc_id, license, CAST(template AS BIGINT) AS template, CAST(size AS BIGINT) AS size, CAST(max(shared) AS BIGINT) AS shared,
  CAST(arg_min(p, (-shared, p)) - 1 AS BIGINT) AS first_word, CAST(count(DISTINCT run) AS BIGINT) AS runs
FROM good GROUP BY doc_id, license, template, size
""".replace("{values}", ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES)))
