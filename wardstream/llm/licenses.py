"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Tokens are runs of ASCII letters, digits and non-ASCII characters, lower-cased (A-Z).  A template's 3-grams of tokens are
winnowed: of every ``WINNOW`` consecutive ones the least hash is kept, in an inverted index.  All 3-grams of a whole text
are looked up in it; hits of a template at about the same offset make a candidate, and a local alignment within ``BAND``
tokens of that offset gives the matched share of the template and the matched span of the text.

The result has a row for every document: the licenses found (least share ``COVERAGE``; where spans overlap, the one
with more matched tokens), as name:start:end:share with code points, end exclusive.  Copies next to each other are one each;
a notice cut by more than ``BAND`` other tokens counts by its parts.  Null and empty texts hold none.
Repeated rows and null or equal ids are rows each; other columns are not read; an empty table gives an empty result.  Very
long texts are scanned whole, in memory linear in them.  Of overlapping licenses with as many matched tokens
the one of the higher share stays, then the earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import U, batch, buffers, chunks, mix, prepare, table, texts, windows, words

GRAM, WINNOW, BAND, COVERAGE = 3, 4, 12, 0.6
MATCH, MISMATCH, GAP = 2, -1, -1

# Notices of public licenses, and the short statements by which texts refer to them.
TEMPLATES: dict[str, str] = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-statement": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    "all-rights-reserved-statement": "All rights reserved.",
}

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
OUT = pa.schema([("doc_id", pa.int64()), ("n_licenses", pa.int64()), ("best", pa.string()), ("coverage", pa.float64()), ("licenses", pa.string())])


def tokens(data: np.ndarray, offsets: np.ndarray):
    return words(data, offsets, lower=True, separator=SEPARATOR)


class Index(NamedTuple):
    names: tuple[str, ...]
    tokens: tuple[np.ndarray, ...]
    grams: np.ndarray  # sorted
    template: np.ndarray
    place: np.ndarray


def winnowed(g: np.ndarray, w: int = WINNOW) -> np.ndarray:
    """Places of the least hash (the last of equal ones) of every w consecutive ones; of fewer, of all."""
    if not len(g):
        return np.zeros(0, np.int64)
    w = min(w, len(g))
    v = np.lib.stride_tricks.sliding_window_view(mix(g, 5), w)
    return np.unique(np.arange(len(v)) + w - 1 - v[:, ::-1].argmin(1))


def index(templates: dict[str, str]) -> Index:
    names, own, grams, template, place = [], [], [], [], []
    for i, (name, text) in enumerate(templates.items()):
        data = np.frombuffer(text.encode(), np.uint8)
        h = tokens(data, np.array([0, len(data)]))[2]
        if len(h) < GRAM:
            raise ValueError(f"template {name} has fewer than {GRAM} tokens")
        g = windows(h, GRAM, 0)
        at = winnowed(g)
        names.append(name)
        own.append(h)
        grams.append(g[at])
        template.append(np.full(len(at), i))
        place.append(at)
    grams, template, place = (np.concatenate(x) for x in (grams, template, place))
    order = np.lexsort((place, template, grams))
    return Index(tuple(names), tuple(own), grams[order], template[order], place[order])


def aligned(template: np.ndarray, text: np.ndarray, offset: int) -> tuple[int, int, int]:
    """Local alignment near the diagonal where the template begins at ``offset`` of the text: matched tokens, and the
    first and last matched token of the text (-1 if none)."""
    n, width = len(template), 2 * BAND + 1
    before: list[tuple[int, int, int, int]] = [(0, 0, -1, -1)] * (width + 1)  # score, matches, first, last; one more at the end
    best = (0, 0, -1, -1)
    for i in range(n):
        row: list[tuple[int, int, int, int]] = []
        left = (0, 0, -1, -1)
        for k in range(width):
            j = offset + i - BAND + k
            if not 0 <= j < len(text):
                cell = (0, 0, -1, -1)
            else:
                d = before[k]
                if template[i] == text[j]:
                    cell = (d[0] + MATCH, d[1] + 1, j if d[2] < 0 else d[2], j)
                else:
                    cell = (d[0] + MISMATCH, *d[1:])
                up = before[k + 1]
                if up[0] + GAP > cell[0]:
                    cell = (up[0] + GAP, *up[1:])
                if left[0] + GAP > cell[0]:
                    cell = (left[0] + GAP, *left[1:])
                if cell[0] <= 0:
                    cell = (0, 0, -1, -1)
                elif cell[0] > best[0]:
                    best = cell
            row.append(cell)
            left = cell
        before = [*row, (0, 0, -1, -1)]
    return best[1:]


def copies(template: np.ndarray, text: np.ndarray, offsets: list[int]) -> list[tuple[int, int, int]]:
    """Matched tokens, first and last token of each copy of the template near these offsets, none of them shared: what is
    found is cut out, and what lies before and after it is aligned again."""
    out, todo = [], [(0, len(text), offsets)]
    while todo:
        lo, hi, own = todo.pop()
        if not own:
            continue
        middle = own[len(own) // 2]
        a = max(lo, middle - 2 * BAND)
        n, first, last = aligned(template, text[a : max(a, min(hi, middle + len(template) + 2 * BAND))], middle - a)
        if first >= 0 and n >= COVERAGE * len(template):
            out.append((n, a + first, a + last))
            todo.append((lo, a + first, [o for o in own if o + len(template) // 2 < a + first]))
            todo.append((a + last + 1, hi, [o for o in own if o + len(template) // 2 > a + last]))
    return out


def scan(ix: Index, h: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(first token, last token, template, share) of the licenses in a text's tokens, by place."""
    g = windows(h, GRAM, 0)
    lo, hi = np.searchsorted(ix.grams, g, "left"), np.searchsorted(ix.grams, g, "right")
    hit = np.flatnonzero(hi > lo)
    at: dict[int, list[int]] = {}
    for j in hit:
        for k in range(lo[j], hi[j]):
            at.setdefault(int(ix.template[k]), []).append(int(j) - int(ix.place[k]))
    found = []
    for t, offsets in at.items():
        offsets.sort()
        group: list[int] = []
        for o in [*offsets, None]:
            if o is not None and (not group or o - group[0] <= BAND):
                group.append(o)
                continue
            own = ix.tokens[t]
            found += [(n, first, last, t, n / len(own)) for n, first, last in copies(own, h, group)]
            group = [o] if o is not None else []
    found.sort(key=lambda x: (-x[0], -x[4], x[1], x[3]))
    chosen: list[tuple[int, int, int, float]] = []
    from bisect import bisect, insort

    for _, first, last, t, share in found:
        i = bisect(chosen, (last, 1 << 60, 0, 0.0))
        if (i == 0 or chosen[i - 1][1] < first) and (i == len(chosen) or chosen[i][0] > last):
            insort(chosen, (first, last, t, share))
    return chosen


def scanned(ix):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Index = ix.value
        for b in batches:
            data, offsets = buffers(b.column("text"))
            rows: dict = {"n_licenses": [], "best": [], "coverage": [], "licenses": []}
            for lo, hi in chunks(offsets):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                start, end, h, first = tokens(part, at)
                g = windows(h, GRAM, 0)
                place = np.searchsorted(x.grams, g)
                place[place == len(x.grams)] = 0
                maybe = np.unique(np.searchsorted(first, np.flatnonzero(x.grams[place] == g), "right") - 1) if len(g) else []
                found = {}
                for r in maybe:
                    a, z = first[r], first[r + 1]
                    if own := scan(x, h[a:z]):
                        points = np.cumsum((part[at[r] : at[r + 1]] & 0xC0) != 0x80)
                        found[int(r)] = [(x.names[t], int(points[start[a + s] - at[r]]) - 1, int(points[end[a + e] - 1 - at[r]]), share) for s, e, t, share in own]
                for r in range(hi - lo):
                    own = found.get(r, [])
                    top = max(own, key=lambda v: (v[3], v[0]), default=None)
                    rows["n_licenses"].append(len(own))
                    rows["best"].append(top and top[0])
                    rows["coverage"].append(round(top[3], 4) if top else 0.0)
                    rows["licenses"].append(",".join(f"{n}:{s}:{e}:{c:.4f}" for n, s, e, c in own))
            yield batch(rows | {"doc_id": b.column("doc_id")}, OUT)

    return run


def license_scan(spark: SparkSession, documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_licenses, best (of highest share; null if none), its coverage, and licenses of every document."""
    prepare(spark)
    ix = spark.sparkContext.broadcast(index(templates or TEMPLATES))
    return texts(documents).mapInArrow(scanned(ix), "doc_id long, n_licenses long, best string, coverage double, licenses string")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark, table(spark, sf_dir, "documents"))
