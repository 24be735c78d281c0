"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports spans.

A template's fingerprints are single words, so that words between them do not
matter. Of m words of which d may be missing, some ceil((m - d) / (d + 1)) in a
row are left; winnowing with a window of that size takes one of any such run, so
each text at the stated coverage holds a fingerprint, and all but d at least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm.common import map_batches, texts_of
from foliospark.llm.patterns import GramIndex, candidates, pattern_words
from foliospark.llm.words import grams_of, words_of

#: Notices and opening passages of common licenses, as published.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
BAND = 12
MATCH, GAP = 2, 1


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the least hash of every ``window`` neighbours, the last among equals."""
    n = len(hashes)
    if n <= window:
        return [int(n - 1 - np.argmin(hashes[::-1]))] if n else []
    return sorted({i + window - 1 - int(np.argmin(hashes[i : i + window][::-1])) for i in range(n - window + 1)})


def align(template: np.ndarray, words: np.ndarray, start: int, band: int) -> tuple[int, int, int]:
    """(matched words, first word, word after the last) of the best local alignment around a diagonal.

    A match counts 2, a substitution, insertion or deletion -1; only cells within
    ``band`` of the diagonal that puts the template at ``start`` are looked at.
    """
    m, width = len(template), 2 * band + 1
    offsets = np.arange(width)
    score = np.zeros((m + 1, width), np.int64)
    place = start - band + np.arange(m)[:, None] + offsets  # column c of row i + 1 is word place[i, c]
    inside = (place >= 0) & (place < len(words))
    same = inside & (words[np.clip(place, 0, len(words) - 1)] == template[:, None])
    for i in range(m):
        diagonal = score[i] + np.where(same[i], MATCH, -1)
        skip_template = np.r_[score[i, 1:] - GAP, 0]
        best = np.where(inside[i], np.maximum(np.maximum(diagonal, skip_template), 0), 0)
        score[i + 1] = np.maximum.accumulate(best + GAP * offsets) - GAP * offsets
    i, c = (int(x) for x in np.unravel_index(int(np.argmax(score)), score.shape))
    matched, stop, first = 0, 0, 0
    while i > 0 and score[i, c] > 0:
        s = score[i, c]
        if inside[i - 1, c] and s == score[i - 1, c] + (MATCH if same[i - 1, c] else -1):
            if same[i - 1, c]:
                matched, first, stop = matched + 1, int(place[i - 1, c]), stop or int(place[i - 1, c]) + 1
            i -= 1
        elif c + 1 < width and s == score[i - 1, c + 1] - GAP:
            i, c = i - 1, c + 1
        elif c > 0:
            c -= 1
        else:
            break
    return matched, first, stop


def fingerprints(text: str, missing: int) -> tuple[list[int], int]:
    """(places, least): winnowed words of a template, and how many of them a text with all but ``missing`` words has at least.

    Of a window's words the longest is taken, for long words are rare.
    """
    words = words_of([text.lower().encode()], letters_only=True)
    size = np.minimum(words.ends - words.starts, 255).astype(np.uint64)
    longest_first = (np.uint64(255) - size) << np.uint64(48) | words.hashes >> np.uint64(16)
    places = winnow(longest_first, max(1, -(-(len(size) - missing) // (missing + 1))))
    return places, max(1, len(places) - missing)


def may_reach(template: np.ndarray, words: np.ndarray, start: int, band: int) -> int:
    """Words of the template that stand anywhere in the band: no alignment there matches more."""
    place = start - band + np.arange(len(template))[:, None] + np.arange(2 * band + 1)
    return int((words.take(place, mode="clip") == template[:, None]).any(1).sum())


FOUND = "doc_id long, license string, template int, matched int, template_words int, coverage double, start int, stop int"


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, coverage: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, template, matched, template_words, coverage, start, stop.

    One row for each row of ``docs`` and template of which it holds at least
    ``coverage`` in one place (the best and first). start, stop: its bytes in the
    lower-cased text. In one place: words added and left out between matches move
    the text by at most 12 words, or as many as may be missing. Coverage is that of
    the best local alignment. Words are lower-cased, punctuation aside. Null and empty
    texts, and an empty table, give no rows; the templates are a parameter, sent
    with the code.
    """
    words = [pattern_words(text) for _, text in templates]
    needed = [int(np.ceil(coverage * len(w) - 1e-9)) for w in words]
    entries, bands, least = [], [], []
    for p, w in enumerate(words):
        places, hits = fingerprints(templates[p][1], len(w) - max(1, needed[p])) if len(w) else ([], 1)
        entries += [(1, int(grams_of(w, 1)[i]), p, i) for i in places]
        bands.append(max(BAND, len(w) - needed[p]))
        least.append(hits)
    index, slack, least = GramIndex(entries), np.array(bands, np.int64), np.array(least, np.int64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        rows = []
        for t, p, starts, hashes, begin, end in candidates(batch.column(1).to_pylist(), index, slack, least):
            best = (0, 0, 0)
            for s in starts:
                # a match's diagonal is under a band after s, the others a band to either side of it
                if may_reach(words[p], hashes, s, 2 * bands[p]) < needed[p]:
                    continue
                found = align(words[p], hashes, s, 2 * bands[p])
                if found[0] > best[0]:
                    best = found
            matched, first, stop = best
            if best[0] and matched >= needed[p]:
                rows.append((ids[t], templates[p][0], p, matched, len(words[p]), matched / len(words[p]), int(begin[first]), int(end[stop - 1])))
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
        columns = list(zip(*rows, strict=True)) or [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=[x.strip().split(" ")[0] for x in FOUND.split(",")])

    return map_batches(texts_of(docs, id_col, text_col), run, FOUND)
