"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file's segments are the file itself, its lines, paragraphs (runs of lines between empty ones) and sentences, windows of a
template's length at the places that its rarer words point to (templates of up to WINDOW words), and stretches that share runs of
GRAM words with a longer template, with gaps of at most GAP words. Templates are notices, standard headers and whole
licences (``license_texts``). A segment's sparse TF-IDF vector (words of letters, digits, dots and dashes, lower case) is compared with each
template's; inverse document frequencies are those of the templates, and a word of no template weighs as a rarest
one. All segments of a batch of texts are multiplied with all templates at once, as one sparse product; a segment is left out only if its words
known to the templates hold less than THRESHOLD**2 of its squared length, which bounds its cosine (Cauchy and Schwarz). One
word in common is no statement (mit, isc), unless it is an identifier with a digit (apache-2.0).

A segment's licence is the template's of highest cosine, at THRESHOLD or more; templates of several licences that are equal make it all of
these, joined by OR, as the terms that two licences begin with do. A file's own licence is that of its best segment: of one licence before
several, then by cosine, name and place. Whole texts are scanned.

A file named like LICENSE or COPYING, or whose licence segment is at least half of its words, speaks for its
directory (best cosine first, then path). A file without an own licence takes that of its nearest
ancestor directory that has one. Directories are joined once each, not once a file.

Null and empty text: no licence. Null path: never inherits. Rows that repeat an id or path are files of their own. Very long texts are
scanned whole, BATCH words of segments at a time, or one longer segment. An empty table gives no rows. Extra columns are not used,
whatever their names.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import slices, stored, table

THRESHOLD = 0.7
#: Terms that two licences share.
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
TEMPLATES = {
    "0BSD": ["Released under the Zero-Clause BSD License.", FEE, "SPDX-License-Identifier: 0BSD"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Released under the Simplified BSD License.", BSD, "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Released under the BSD License.", BSD, "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3", "SPDX-License-Identifier: GPL-3.0"],
    "ISC": ["Released under the ISC License.", FEE, "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
#: Standard headers and file titles.
HEADERS = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0"],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC License"],
    "LGPL-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-2.1"],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "MIT License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public", "Mozilla Public License Version 2.0"],
}
TEXTS = ("0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
WINDOW, GRAM, GAP, BATCH = 240, 4, 200, 1 << 21
FILE_NAME = r"^(?i)(licen[cs]e|copying|copyright|notice)([._-].*)?$"
_WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*[A-Za-z0-9]|[A-Za-z0-9]")
_BREAK = re.compile(r"[.!?][\"')\]]*\s+(?=[^a-z0-9\s])|\n[ \t\r\f\v]*(?=\n)")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def all_templates() -> dict[str, list[str]]:
    """Notices, standard headers and whole licences by name."""
    out = {n: [*TEMPLATES.get(n, []), *HEADERS.get(n, [])] for n in {**TEMPLATES, **HEADERS}}
    for n in TEXTS:
        out[n].append(pkgutil.get_data("strandline.llm", f"license_texts/{n}.txt").decode())
    return out


class Templates:
    """Normalised TF-IDF weights, a row a word; where the keys of short templates stand, and the runs of words of long ones.

    A key is a word left when a template's commonest words of together less than THRESHOLD**2 of its squared length are set aside.
    """

    def __init__(self, templates: dict[str, list[str]], threshold: float = THRESHOLD):
        self.threshold, self.least = threshold, threshold**2 - 1e-9
        texts = [(name, words(x)) for name in sorted(templates) for x in templates[name]]
        docs = [Counter(x) for _, x in texts]
        n = len(docs)
        df = Counter(w for c in docs for w in c)
        self.rare = math.log((1 + n) / 2) + 1
        self.names = [name for name, _ in texts]
        self.size = np.array([len(x) for _, x in texts])
        self.id = {w: i for i, w in enumerate(df)}
        self.idf = np.array([math.log((1 + n) / (1 + k)) + 1 for k in df.values()])
        self.tag = np.array([w in {x.lower() for x in templates} and any(x.isdigit() for x in w) for w in df])
        self.weight = np.zeros((len(df), n))
        for k, c in enumerate(docs):
            at = [self.id[w] for w in c]
            v = np.array(list(c.values())) * self.idf[at]
            self.weight[at, k] = v / math.sqrt((v * v).sum())
        self.votes = np.ones(n, np.int64)
        places, runs = [], []
        for k, (_, x) in enumerate(texts):
            ids = np.array([self.id[w] for w in x])
            if len(x) > WINDOW:
                runs += [(g, k) for g in set(self._runs(ids).tolist())]
                continue
            order = sorted(docs[k], key=lambda w: (self.idf[self.id[w]], w))
            mass = np.cumsum([self.weight[self.id[w], k] ** 2 for w in order])
            keys = {self.id[w] for w, m in zip(order, mass, strict=True) if m >= threshold**2}
            at = [i for i, w in enumerate(ids.tolist()) if w in keys]
            self.votes[k] = max(1, len(at) // 3)
            places += [(int(ids[i]), k, i) for i in at]
        self.places = np.array(sorted(places), np.int64).reshape(-1, 3)
        self.runs = np.array(sorted(runs), np.int64).reshape(-1, 2)

    def _runs(self, ids: np.ndarray) -> np.ndarray:
        """A number for each GRAM words in a row; -1 where one is not a template's."""
        n, v = max(0, len(ids) - GRAM + 1), len(self.id)
        out = np.zeros(n, np.int64)
        for j in range(GRAM):
            out = out * v + ids[j : j + n]
        bad = np.cumsum(np.concatenate([[0], ids >= v]))
        return np.where(bad[GRAM : GRAM + n] > bad[:n], -1, out)

    def _pointed(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and stretches (from, to) in the words of texts that begin at ``first``."""
        t, which = _hits(ids, self.places[:, 0])
        k, place = self.places[which, 1], self.places[which, 2]
        text = np.searchsorted(first, t, "right") - 1
        order = np.lexsort((t - place, k, text))
        rows = np.stack([text, k, t - place])[:, order]
        new = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)])) if len(order) else order
        many = np.diff(np.append(new, len(order))) >= self.votes[rows[1, new]]
        text, k, at = rows[:, new[many]]
        ends = np.append(first[1:], len(ids))
        a, b = np.maximum(first[text], at), np.minimum(ends[text], at + self.size[k])
        t, which = _hits(self._runs(ids), self.runs[:, 0])
        k, text = self.runs[which, 1], np.searchsorted(first, t, "right") - 1
        inside = t + GRAM <= ends[text]
        t, k, text = t[inside], k[inside], text[inside]
        order = np.lexsort((t, k, text))
        t, k, text = t[order], k[order], text[order]
        if not len(t):
            return a, b
        new = np.flatnonzero(np.concatenate([[True], (np.diff(t) > GAP) | (np.diff(k) != 0) | (np.diff(text) != 0)]))
        return np.concatenate([a, t[new]]), np.concatenate([b, t[np.append(new[1:], len(t)) - 1] + GRAM])

    def scores(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray, codes: int) -> list[tuple[int, float, str]]:
        """(segment, cosine, licence) of the segments ids[a:b] that reach the threshold; ids of no template's word lie below ``codes``."""
        out, v = [], len(self.id)
        lo, total = 0, np.cumsum(b - a)
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BATCH, "right")))
            n = b[lo:hi] - a[lo:hi]
            seg = np.repeat(np.arange(hi - lo), n)
            at = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[lo:hi], n)
            key, count = np.unique(seg * codes + ids[at], return_counts=True)
            seg, word = key // codes, key % codes
            known = word < v
            other = np.bincount(seg[~known], count[~known].astype(float) ** 2, hi - lo) * self.rare**2
            seg, word = seg[known], word[known]
            x = count[known] * self.idf[word]
            own = np.bincount(seg, x * x, hi - lo)
            stays = (own >= self.least * (own + other))[seg]
            seg, word, x = seg[stays], word[stays], x[stays]
            new = np.flatnonzero(np.concatenate([[True], np.diff(seg) != 0])) if len(seg) else seg
            for i in range(0, len(new), 4096):
                part = slice(new[i], new[i + 4096] if i + 4096 < len(new) else len(seg))
                w, start = self.weight[word[part]], new[i : i + 4096] - new[i]
                score = np.add.reduceat(w * x[part, None], start) / np.sqrt((own + other)[seg[new[i : i + 4096]]])[:, None]
                alone = np.add.reduceat((w > 0).astype(np.int32), start) + np.add.reduceat((w > 0) & self.tag[word[part], None], start, dtype=np.int32) < 2
                score[alone] = 0
                top = score.max(1)
                for j in np.flatnonzero(top >= self.threshold):
                    best = sorted({self.names[k] for k in np.flatnonzero(score[j] >= top[j] - 1e-12)})
                    out.append((lo + int(seg[new[i + j]]), min(float(top[j]), 1.0), " OR ".join(best)))
            lo = hi
        return out

    def scan_all(self, texts: list[str]) -> list[tuple[str | None, float | None, int, int]]:
        """(licence, cosine, start, end) of the best segment of each text."""
        code, ids, starts, ends, first = dict(self.id), [], [], [], []
        spans: list[np.ndarray] = []
        for text in texts:
            base = len(ids)
            first.append(base)
            at, to = [], []
            for m in _WORD.finditer(text):
                at.append(m.start())
                to.append(m.end())
                ids.append(code.setdefault(m[0].lower(), len(code)))
            starts += at
            ends += to
            cuts = np.array(_spans(text), np.int64)
            spans.append(np.concatenate([np.searchsorted(np.array(at, np.int64), cuts) + base, cuts, np.full((len(cuts), 1), len(first) - 1)], axis=1))
        words_, starts, ends, first = np.array(ids, np.int64), np.array(starts, np.int64), np.array(ends, np.int64), np.array(first, np.int64)
        a, b = self._pointed(words_, first)
        spans.append(np.stack([a, b, starts[a], ends[b - 1], np.searchsorted(first, a, "right") - 1], axis=1) if len(a) else np.zeros((0, 5), np.int64))
        s = np.concatenate(spans)
        s = s[s[:, 1] > s[:, 0]]
        _, keep = np.unique(s[:, 0] * (len(ids) + 1) + s[:, 1], return_index=True)
        s = s[np.sort(keep)]
        best: dict[int, tuple] = {}
        for i, cosine, name in self.scores(words_, s[:, 0], s[:, 1], len(code)):
            _, _, start, end, text = s[i].tolist()
            found = (" OR " in name, -round(cosine, 12), name, start, end, cosine)
            best[text] = min(best.get(text, found), found)
        return [(x[2], x[5], x[3], x[4]) if (x := best.get(k)) else (None, None, 0, 0) for k in range(len(texts))]

    def scan(self, text: str) -> tuple[str | None, float | None, int, int]:
        return self.scan_all([text])[0]


def _hits(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (place in values, row of the sorted table) of equal numbers."""
    lo, hi = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
    n = hi - lo
    t = np.repeat(np.arange(len(values)), n)
    return t, np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _spans(text: str) -> list[tuple[int, int]]:
    """Lines, paragraphs, sentences and the whole of a text."""
    out, start = [], 0
    for line in text.split("\n"):
        out.append((start, start + len(line)))
        start += len(line) + 1
    block = None
    for s, e in [*out, (len(text), len(text))]:
        if text[s:e].strip():
            block = (block[0] if block else s, e)
        elif block:
            out.append(block)
            block = None
    start = 0
    for m in _BREAK.finditer(text):
        out.append((start, m.end()))
        start = m.end()
    return [*out, (start, len(text)), (0, len(text))]


def _scan(templates: dict, threshold: float):
    def run(batches):
        t = Templates(templates, threshold)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in slices(np.fromiter((len(x or "") for x in texts), np.int64, len(texts)), 4 << 20):
                rows = t.scan_all([x or "" for x in texts[lo:hi]])
                half = [r[0] is not None and 2 * len((x or "")[r[2] : r[3]].split()) >= len((x or "").split()) for r, x in zip(rows, texts[lo:hi], strict=True)]
                name, score, s, e = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("path").slice(lo, hi - lo), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(half)], ["doc_id", "path", "own", "cosine", "start", "end", "mostly"])

    return run


def licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: dict | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row a file: doc_id, path, license, origin (own or inherited), cosine, start, end, license_dir."""
    f = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    s = stored(f.mapInArrow(_scan(templates or all_templates(), threshold), "doc_id long, path string, own string, cosine double, start long, end long, mostly boolean"))
    s = s.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    speaks = s.filter(F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("mostly") | F.col("name").rlike(FILE_NAME)))
    best = F.min_by(F.struct("own", "cosine"), F.struct((-F.col("cosine")).alias("c"), "path", "own"))
    speaks = speaks.groupBy(F.col("dir").alias("license_dir")).agg(best.alias("b")).select("license_dir", F.col("b.own").alias("inherited"))
    dirs = s.filter(F.col("own").isNull() & F.col("path").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select("dir", "depth", F.array_join(F.slice(parts, 1, F.col("depth")), "/").alias("license_dir"))
    up = up.join(speaks, "license_dir").groupBy("dir").agg(F.max_by(F.struct("inherited", "license_dir"), "depth").alias("x")).select("dir", "x.*")
    out = s.join(up.withColumnRenamed("dir", "_dir"), F.col("own").isNull() & (F.col("dir") == F.col("_dir")), "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce("own", "inherited").alias("license"), origin.alias("origin"), "cosine", F.when(F.col("own").isNotNull(), F.col("start")).alias("start"), F.when(F.col("own").isNotNull(), F.col("end")).alias("end"), "license_dir")


def document_paths(docs: DataFrame) -> DataFrame:
    """documents have no paths: source/lang/hundred/id.txt; the first twenty ids of each hundred (one a source) are named LICENSE."""
    top = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    hundred = F.floor(F.col("doc_id") / 100)
    name = F.when(F.col("doc_id") % 100 < 20, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.withColumn("path", F.concat_ws("/", top, hundred.cast("string"), name))


def query(spark, sf_dir: str) -> DataFrame:
    return licenses(document_paths(table(spark, sf_dir, "documents")))
