"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased; shingles
are five words. Templates fall into size classes. For a class of up to T shingles, windows of
T + s shingles start every s = max(1, T // 4) shingles, so that any T consecutive shingles lie in
one of them. A window that contains 0.8 of a template of at least 0.8 T shingles has a Jaccard
similarity of at least J = 0.8 * 0.8 T / (W + 0.2 * 0.8 T) with it, W being T + s in whole steps; the number of bands (one
MinHash each) is set so that 1 - (1 - J) ** bands is at least ``RECALL``. Retrieved templates are
verified: the window must contain at least ``CONTAINMENT`` of the template's distinct shingles.

Texts without any template's shingle cannot match and get no windows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _text
from ._store import small_batches
from .decontaminate import prepare

WORDS = 5
CONTAINMENT = 0.8
RECALL = 0.9999

# License notices as their owners publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "LGPL-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions."
    ),
}


class Class:
    """Templates of one size class: window size, step and bands."""

    def __init__(self, most: int, names: list[str], sets: list[np.ndarray], containment: float, recall: float):
        self.names, self.sets = names, sets
        self.step = max(1, most // 4)
        self.size = most + self.step
        least = min(map(len, sets))
        inside = containment * least
        #: shingles of a window: whole steps
        self.width = -(-self.size // self.step) * self.step
        similar = inside / (self.width + least - inside)
        self.bands = math.ceil(math.log(1 - recall) / math.log(1 - similar)) if similar < 1 else 1
        self.salts = _text.mix64(np.arange(1, self.bands + 1, dtype=np.uint64))
        prints = np.stack([_text.mix64(s[:, None] ^ self.salts).min(axis=0) for s in sets], axis=1)
        #: per band: the templates in the order of their minima, and these
        self.order = np.argsort(prints, axis=1, kind="stable")
        self.sorted = np.take_along_axis(prints, self.order, axis=1)

    def starts(self, n: int) -> np.ndarray:
        """Window starts: every step, the last one reaching the end."""
        return np.arange(0, max(1, n - self.size + self.step), self.step)

    def retrieve(self, own: np.ndarray) -> list[tuple[int, int]]:
        """(start, template) of windows that share a band."""
        n, start = len(own), self.starts(len(own))
        found: set[tuple[int, int]] = set()
        for salt, prints, order in zip(self.salts, self.sorted, self.order, strict=True):
            h = _text.mix64(own ^ salt)
            # minima over steps, then over the steps of a window
            low = np.minimum.reduceat(h, np.arange(0, n, self.step))
            span = self.width // self.step
            low = np.concatenate([low, np.full(span, ~np.uint64(0))])
            least = np.lib.stride_tricks.sliding_window_view(low, span)[: len(start)].min(axis=1)
            a, b = np.searchsorted(prints, least, "left"), np.searchsorted(prints, least, "right")
            for w in np.flatnonzero(a < b).tolist():
                found.update((w, i) for i in order[a[w] : b[w]].tolist())
        return sorted(found)


class Templates:
    """All templates by class, and a sieve of their shingles."""

    def __init__(self, texts: dict[str, str], words: int = WORDS, containment: float = CONTAINMENT, recall: float = RECALL):
        self.words, self.containment = words, containment
        names = sorted(texts)
        sh, off = _text.shingles(*_text.word_hashes([prepare(texts[k]) for k in names], _text.ALNUM), words)
        sets = {k: np.unique(sh[off[i] : off[i + 1]]) for i, k in enumerate(names) if off[i + 1] > off[i]}
        self.classes, most = [], 0
        for k in sorted(sets, key=lambda k: (-len(sets[k]), k)):
            if not most or len(sets[k]) < 0.8 * most:
                most = len(sets[k])
                self.classes.append((most, [], []))
            self.classes[-1][1].append(k)
            self.classes[-1][2].append(sets[k])
        self.classes = [Class(m, n, s, containment, recall) for m, n, s in self.classes]
        self.all = np.unique(np.concatenate([np.empty(0, np.uint64), *sets.values()]))
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(self.all >> np.uint64(46)).astype(np.int64)] = True

    def hits(self, sh: np.ndarray) -> np.ndarray:
        out = self.sieve[(sh >> np.uint64(46)).astype(np.int64)] if len(sh) else np.zeros(0, bool)
        at = np.flatnonzero(out)
        out[at] = np.isin(sh[at], self.all)
        return out

    def scan(self, own: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(template, containment, first shingle, shingles) of the best window of each template found in one text."""
        best: dict[str, tuple[str, float, int, int]] = {}
        for c in self.classes:
            for w, i in c.retrieve(own):
                s = w * c.step
                # the window as retrieved: whole steps
                part = own[s : s + c.width]
                value = np.isin(c.sets[i], part).sum() / len(c.sets[i])
                if value >= self.containment and (c.names[i] not in best or value > best[c.names[i]][1]):
                    best[c.names[i]] = (c.names[i], float(value), s, len(part))
        return [best[k] for k in sorted(best)]


FOUND = "license string, containment double, start_word long, n_words long"


def license_scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, containment: float = CONTAINMENT, recall: float = RECALL) -> DataFrame:
    """(doc_id, license, containment, start_word, n_words): each template found, at its best window.

    Of windows that contain equally much the first counts. Null and empty texts match nothing; a
    text of fewer than five words only a template that is the same words. Templates are a mapping, or
    a table (name, text) of which nulls are left out, and are held in memory; default: TEMPLATES, which
    names what is covered. Repeated rows of ``docs`` give repeated rows. Bytes that are no UTF-8 count as
    replacement characters. doc_id keeps its type.
    """
    small_batches(docs.sparkSession)
    if isinstance(templates, DataFrame):
        templates = {r[0]: r[1] for r in templates.select("name", "text").filter("name IS NOT NULL AND text IS NOT NULL").orderBy("name", "text").collect()}
    known = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates, WORDS, containment, recall))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(FOUND).fields])
    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_pylist()
            for a, b in _text.groups_of(sizes, _text.SLAB):
                part = batch.slice(a, b - a)
                ids = part.column("doc_id").to_pylist()
                h, at = _text.word_hashes([prepare(t) for t in _text.strings(part.column("text"))], _text.ALNUM)
                sh, off = _text.shingles(h, at, WORDS)
                count = np.concatenate([[0], np.cumsum(known.value.hits(sh))])[off]
                for i in np.flatnonzero(np.diff(count)).tolist():
                    for name, value, s, n in known.value.scan(sh[off[i] : off[i + 1]]):
                        rows.append((ids[i], name, value, s, min(n + WORDS - 1, int(at[i + 1] - at[i]) - s)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], ["doc_id", "license", "containment", "start_word", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(templates: dict[str, str] | None = None) -> str:
    """Exact containment of every template in every window, as DuckDB SQL."""
    known = Templates(TEMPLATES if templates is None else templates)
    rows = ", ".join("('{}', '{}', {}, {}, {})".format(k.replace("'", "''"), (templates or TEMPLATES)[k].replace("'", "''"), c.step, c.size, c.width) for c in known.classes for k in c.names)
    words = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH t AS (SELECT name, {words.format("text")} AS w, step, size, width FROM (VALUES {rows}) v(name, text, step, size, width)),
 d AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
 l AS (SELECT doc_id, len(w) AS words, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [hash(array_to_string(w, ' '))]
         ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: hash(array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS l FROM d),
 s AS (SELECT doc_id, words, len(l) AS n, unnest(l) AS h, generate_subscripts(l, 1) - 1 AS pos FROM l),
 k AS (SELECT name, step, size, width, list_distinct(CASE WHEN len(w) < {WORDS} THEN [hash(array_to_string(w, ' '))] ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: hash(array_to_string(w[i:i + {WORDS - 1}], ' '))) END) AS l FROM t),
 b AS (SELECT name, step, size, width, len(l) AS m, unnest(l) AS h FROM k),
 hit AS (SELECT doc_id, name, words, n, m, step, width, pos, h, (greatest(1, n - size + step) - 1) // step AS most FROM s JOIN b USING (h)),
 win AS (SELECT *, unnest(range(greatest(0, (pos - width + step) // step), least(most, pos // step) + 1)) * step AS start FROM hit),
 v AS (SELECT doc_id, name, start, words, n, width, count(DISTINCT h) / m::DOUBLE AS containment FROM win GROUP BY doc_id, name, start, words, n, width, m HAVING count(DISTINCT h) >= {CONTAINMENT} * m)
SELECT doc_id, name AS license, max(containment) AS containment, arg_max(start, (containment, -start))::BIGINT AS start_word,
       arg_max(least(least(width, n - start) + {WORDS - 1}, words - start), (containment, -start))::BIGINT AS n_words FROM v GROUP BY ALL
"""


ORACLE = oracle()
