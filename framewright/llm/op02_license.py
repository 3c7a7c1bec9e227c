"""License scans with a positional rare-token index.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased.  Every
template is a licence text or a short notice with a mandatory key phrase.  One
pass over all documents counts in how many each licence word stands; the inverse
document frequency decides which words of a key phrase are its ``RARE`` rare
tokens (the first at ties).  The second pass looks up the rare tokens that a file
holds: a posting (template, place in the key phrase) of a word gives a start by
its relative position.  The postings of a template are intersected: a start stays
where all its rare tokens agree on it.  There the whole mandatory key phrase is
verified, and the template words that stand at their relative positions are
weighed by IDF.

A template counts as found where its key phrase stands and at least
``MIN_SHARE`` of its IDF mass stands around it.  The three base phrases are
templates that are nothing but their key phrase, so all their places are found.

Defined cases: null text is an empty text (no words, score 0, empty labels);
very long texts are scanned whole; repeated rows give repeated rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, draw_seed, expand, flat, hash_words, pieces, table, text_col, words

BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: label, notice, mandatory key phrase in it
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
]
#: Licence texts and standard headers (fixed values), without their copyright lines: label, text, mandatory key phrase
TEXTS = [
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "permission is hereby granted free of charge"),
    ("isc-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "for any purpose with or without fee is hereby granted"),
    ("bsd-2-clause-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""", "redistribution and use in source and binary forms"),
    ("bsd-3-clause-text", """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""", "may be used to endorse or promote products derived from this software"),
    ("apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "apache license version 2 0"),
    ("gpl-3.0-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "general public license as published by the free software foundation"),
    ("mpl-2.0-header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", "mozilla public license v 2 0"),
    ("zlib-text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""", "the origin of this software must not be misrepresented"),
]
MIN_SHARE, RARE = 0.5, 2


def template_words(text: str) -> list[str]:
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


class Templates:
    """Templates as word numbers, and after ``weigh`` the postings of their rare tokens."""

    def __init__(self, base: dict[str, str], notices: list[tuple[str, str, str]]):
        rows = [(label, *[template_words(p)] * 2, True) for label, p in base.items()] + [(label, template_words(t), template_words(k), False) for label, t, k in notices]
        self.labels = [r[0] for r in rows]
        self.base = np.array([r[3] for r in rows])
        vocabulary = sorted({w for r in rows for w in r[1]})
        self.seed = draw_seed()
        h = hash_words(vocabulary, self.seed)
        order = np.argsort(h)
        self.hashes = h[order]
        number = {vocabulary[o]: k for k, o in enumerate(order)}
        self.notice = [np.array([number[w] for w in r[1]]) for r in rows]
        self.key = [np.array([number[w] for w in r[2]]) for r in rows]
        self.shift = []
        for n, k in zip(self.notice, self.key, strict=True):
            at = [i for i in range(len(n) - len(k) + 1) if (n[i : i + len(k)] == k).all()]
            if not at:
                raise ValueError("a key phrase must stand in its notice")
            self.shift.append(at[0])

    def weigh(self, documents: int, holding: np.ndarray) -> Templates:
        self.idf = np.log((1 + documents) / (1 + holding)) + 1e-3
        rare = [np.argsort(-self.idf[k], kind="stable")[:RARE] for k in self.key]  # places in the key phrase
        self.rare = np.array([len(r) for r in rare])
        template, self.place = np.repeat(np.arange(len(rare)), self.rare), np.concatenate(rare)
        token = np.array([self.key[t][p] for t, p in zip(template, self.place, strict=True)])
        order = np.argsort(token, kind="stable")
        self.postings, self.place = template[order], self.place[order]
        self.first = np.append(0, np.cumsum(np.bincount(token, minlength=len(self.hashes))))
        return self

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at, -1)

    def find(self, numbers: np.ndarray, rows: np.ndarray):
        """(row, template, first word of the key phrase, share of IDF mass) of all places."""
        where = np.flatnonzero(numbers >= 0)
        token = numbers[where]
        group, nth = expand(self.first[token + 1] - self.first[token])
        at = self.first[token[group]] + nth
        # the postings of a template are intersected: all its rare tokens must give the same start
        most = max(map(len, self.key))
        wide = len(numbers) + 2 * most
        votes, count = np.unique(self.postings[at] * wide + where[group] - self.place[at] + most, return_counts=True)
        template, starts = votes // wide, votes % wide - most
        agreed = count == self.rare[template]
        template, starts = template[agreed], starts[agreed]
        out = []
        for t in np.unique(template):
            start = starts[template == t]
            start = start[(start >= 0) & (start < len(numbers))]
            r = np.searchsorted(rows, start, side="right") - 1
            ok = start + len(self.key[t]) <= rows[r + 1]
            start, r = start[ok], r[ok]
            for j, w in enumerate(self.key[t]):
                same = numbers[start + j] == w
                start, r = start[same], r[same]
            if not len(start):
                continue
            mass = np.zeros(len(start))
            for j, w in enumerate(self.notice[t]):
                p = start + j - self.shift[t]
                inside = (p >= rows[r]) & (p < rows[r + 1])
                p = np.where(inside, p, 0)
                mass += np.where(inside & (numbers[p] == w), self.idf[w], 0.0)
            share = np.minimum(mass / self.idf[self.notice[t]].sum(), 1.0)
            keep = share >= MIN_SHARE
            out.append((r[keep], np.full(keep.sum(), t), start[keep], share[keep]))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def holding_documents(source: DataFrame, templates: Templates) -> tuple[int, np.ndarray]:
    """Over all documents: how many there are, and how many hold each licence word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(templates.hashes), np.int64), 0
        for batch in batches:
            buf, offs = flat(batch.column(0))
            n += len(offs) - 1
            for i, j in pieces(offs):
                _, _, h, rows = words(LOWER[buf[offs[i] : offs[j]]], offs[i : j + 1] - offs[i], ALNUM, templates.seed)
                v = templates.numbers(h)
                where = np.flatnonzero(v >= 0)
                row = np.searchsorted(rows, where, side="right") - 1
                both = np.unique(row * len(total) + v[where])
                total += np.bincount(both % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(total)), -1], pa.int64()), pa.array([*total.tolist(), n], pa.int64())], names=["w", "n"])

    rows = source.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()  # one row a licence word
    got = {r.w: r.n for r in rows}
    return got.get(-1, 0), np.array([got.get(k, 0) for k in range(len(templates.hashes))], np.int64)


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: list[tuple[str, str, str]] = NOTICES + TEXTS) -> DataFrame:
    """One row per document: words, places of base phrases, labels found, and the best share of IDF mass as score."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text"))
    templates = Templates(base, notices)
    templates.weigh(*holding_documents(source, templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(1))
            rows_n = len(offs) - 1
            n_words, n_base = np.zeros(rows_n, np.int64), np.zeros(rows_n, np.int64)
            firsts: list[int | None] = [None] * rows_n
            lasts: list[int | None] = [None] * rows_n
            base_labels, labels, score = [""] * rows_n, [""] * rows_n, np.zeros(rows_n)
            for i, j in pieces(offs):
                _, _, h, rows = words(LOWER[buf[offs[i] : offs[j]]], offs[i : j + 1] - offs[i], ALNUM, templates.seed)
                n_words[i:j] = np.diff(rows)
                row, template, start, share = templates.find(templates.numbers(h), rows)
                order = np.argsort(row, kind="stable")
                row, template, start, share = row[order], template[order], start[order], share[order]
                for a, b in _groups(row):
                    k = i + int(row[a])
                    t, is_base = template[a:b], templates.base[template[a:b]]
                    if is_base.any():
                        s = start[a:b][is_base] - rows[row[a]]
                        n_base[k], firsts[k], lasts[k] = len(s), int(s.min()), int(s.max())
                        base_labels[k] = ",".join(sorted({templates.labels[x] for x in t[is_base]}))
                    labels[k] = ",".join(sorted({templates.labels[x] for x in t}))
                    score[k] = float(share[a:b].max())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64()), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return source.mapInArrow(run, OUT)


def _groups(row: np.ndarray):
    cut = np.flatnonzero(np.diff(row)) + 1
    return zip(np.append(0, cut), np.append(cut, len(row)), strict=True) if len(row) else ()


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract query: licence places and labels of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
